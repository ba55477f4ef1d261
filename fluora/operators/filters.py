"""Filters that need a whole trace: asymmetric least squares baselines and zero-phase band-pass.

Traces (trace, frame, y) are packed into arrays; tasks take lots of traces of similar length and work on a lot at once in
numpy. Gaps are filled before; a trace without any sample stays missing.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluora.operators.traces import gap_filled

#: Samples in a lot of traces: at most, and at least where there are enough.
VALUES, LEAST = 1 << 18, 1 << 12


def penalty(n: int, lam: float, factor: float, up: float, down: float) -> np.ndarray:
    """Weights of the second-difference penalty by row: a ramp up, a plateau and a ramp down."""
    a, b = max(1, int(up * n)), max(1, int(down * n))
    ramp = np.concatenate([np.linspace(lam * factor, lam, a), np.full(max(0, n - a - b), lam), np.linspace(lam, lam * factor, b)])
    return ramp[:n]


def bands(n: int) -> np.ndarray:
    """The five diagonals (offsets -2 to 2, by row) of the squared second difference."""
    d = np.zeros((5, n))
    for i in range(n - 2):
        for p, a in ((0, 1.0), (1, -2.0), (2, 1.0)):
            for q, b in ((0, 1.0), (1, -2.0), (2, 1.0)):
                d[q - p + 2, i + p] += a * b
    return d


def solve(d: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Solves pentadiagonal systems of one size together, in place; d is (5, n, systems), x (n, systems); no pivoting."""
    n = x.shape[0]
    for i in range(n):
        for r in range(i + 1, min(i + 3, n)):
            f = d[2 - (r - i), r] / d[2, i]
            for c in range(1, min(3, n - i)):
                d[2 - (r - i) + c, r] -= f * d[2 + c, i]
            x[r] -= f * x[i]
    for i in range(n - 1, -1, -1):
        for c in range(1, min(3, n - i)):
            x[i] -= d[2 + c, i] * x[i + c]
        x[i] /= d[2, i]
    return x


def als(y: np.ndarray, lam: float, p: float, steps: int, factor: float = 1.0, up: float = 0.0, down: float = 0.0, lengths: np.ndarray | None = None) -> np.ndarray:
    """Baselines of traces (traces, n), which end at their ``lengths``; zeros follow.

    Traces of zeros only have a baseline of zeros, those of less than three samples have themselves. Rows of the systems
    beyond a trace's end are those of the identity, so traces of several lengths are solved together. The steps end early
    where no weight changes any more, as the next step would be the same.
    """
    lengths = np.full(len(y), y.shape[1]) if lengths is None else lengths
    z, live = np.where((lengths < 3)[:, None], y, 0.0), np.any(y != 0, axis=1) & (lengths >= 3)
    if not live.any():
        return z
    v, sizes = np.ascontiguousarray(y[live].T), lengths[live]
    base = np.zeros((5, *v.shape))
    for n in np.unique(sizes):
        base[:, :n, sizes == n] = (bands(n) * penalty(n, lam, factor, up, down))[:, :, None]
    inside = np.arange(len(v))[:, None] < sizes
    base[2] += ~inside
    w, found = inside.astype(float), np.zeros_like(v)
    for _ in range(steps):
        d = base.copy()
        d[2] += w
        found = solve(d, w * v)
        new = np.where(v > found, p, np.where(v < found, 1 - p, 0.0)) * inside
        if (new == w).all():
            break
        w = new
    z[live] = found.T
    return z


def bleach_corrected(y: np.ndarray, offset: float = 0.0, lam: float = 1e5, p: float = 0.01, steps: int = 10, factor: float = 1e-3, up: float = 0.2, down: float = 0.2, smooth_lam: float = 10.0, smooth_p: float = 0.5, smooth_steps: int = 10, lengths: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(baseline, corrected, smoothed) of traces that end at their ``lengths``."""
    lengths = np.full(len(y), y.shape[1]) if lengths is None else lengths
    v = np.where(np.arange(y.shape[1]) < lengths[:, None], y + offset, 0.0)
    base = als(v, lam, p, steps, factor, up, down, lengths)
    corrected = (v - base) / np.maximum(np.abs(base), np.finfo(float).eps)
    return base - offset, corrected, als(corrected, smooth_lam, smooth_p, smooth_steps, lengths=lengths)


def band_mask(f: np.ndarray, low: float, high: float, order: int) -> np.ndarray:
    """Magnitudes of a Butterworth band-pass; a cutoff of 0 leaves that side open."""
    gain = np.ones_like(f)
    if high > 0:
        gain /= np.sqrt(1 + (f / high) ** (2 * order))
    if low > 0:
        with np.errstate(divide="ignore"):
            gain *= np.where(f > 0, 1 / np.sqrt(1 + (low / np.where(f > 0, f, np.inf)) ** (2 * order)), 0.0)
            gain[f == 0] = 0.0
    return gain


def band_passed(y: np.ndarray, fps: float = 10.0, low: float = 0.1, high: float = 3.0, order: int = 2) -> np.ndarray:
    """Band-passed traces of one length (traces, n), padded by reflection."""
    n = y.shape[1]
    if fps <= 0 or high >= fps / 2 or (low > 0 and high > 0 and low >= high):
        raise ValueError("cutoffs must be in order and below half the frame rate")
    if n < 3:
        return y.copy()
    pad = min(n - 1, max(1, round(fps)))
    wide = np.pad(y, ((0, 0), (pad, pad)), mode="reflect")
    gain = band_mask(np.fft.rfftfreq(wide.shape[1], 1 / fps), low, high, order)
    return np.fft.irfft(np.fft.rfft(wide) * gain, n=wide.shape[1])[:, pad : pad + n]


def by_trace(traces: DataFrame, kernel: Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]], names: list[str]) -> DataFrame:
    """(trace, frame, *names): a kernel's series for every trace.

    The kernel gets lots of traces of similar length (within a fourth of a power of two), padded with zeros, and their
    lengths. A lot has at most ``VALUES`` samples, or is one trace.
    """
    kind, spark = traces.schema["trace"].dataType.simpleString(), traces.sparkSession
    lengths = traces.groupBy("trace").agg(F.count("*").alias("n"))
    like = F.floor(4 * F.log2("n")).cast("int")
    classes = lengths.groupBy(like.alias("like")).agg(F.sum("n").alias("n")).collect()  # some hundred rows at most
    cores = spark.sparkContext.defaultParallelism
    room = min(VALUES, max(LEAST, sum(r.n for r in classes) // (2 * cores)))
    lots = {r.like: max(1, -(-r.n // room)) for r in classes}
    if not lots:
        lots = {0: 1}
    rows = gap_filled(traces).groupBy("trace").agg(F.sort_array(F.collect_list(F.struct("frame", "filled"))).alias("s"))
    rows = rows.select("trace", F.col("s.frame").alias("frames"), F.col("s.filled").alias("ys"), F.size("s").alias("n")).withColumn("like", like)
    most = F.element_at(F.create_map(*[F.lit(x) for pair in lots.items() for x in pair]), F.col("like"))
    rows = rows.withColumn("lot", F.pmod(F.xxhash64("trace"), most))

    def run(lot: pd.DataFrame) -> pd.DataFrame:
        n = lot.n.to_numpy()
        inside = np.arange(n.max()) < n[:, None]
        y = np.zeros(inside.shape)
        y[inside] = np.concatenate(lot.ys.tolist()).astype(float)
        empty = np.isnan(y).any(axis=1)
        series = kernel(np.where(empty[:, None], 0.0, y), n)
        missing = np.repeat(empty, n)
        data = {k: np.where(missing, np.nan, series[k][inside]) for k in names}
        return pd.DataFrame({"trace": np.repeat(lot.trace.to_numpy(), n), "frame": np.concatenate(lot.frames.tolist()).astype(np.int64), **data})

    schema = f"trace {kind}, frame long, " + ", ".join(f"{k} double" for k in names)
    tasks = min(sum(lots.values()), max(cores, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    out = rows.repartition(tasks, "like", "lot").groupBy("like", "lot").applyInPandas(run, schema)
    return out.select("trace", "frame", *[F.nanvl(F.col(k), F.lit(None).cast("double")).alias(k) for k in names])


def als_filtered(traces: DataFrame, **options) -> DataFrame:
    """(trace, frame, baseline, corrected, smoothed)."""
    names = ["baseline", "corrected", "smoothed"]
    return by_trace(traces, lambda y, n: dict(zip(names, bleach_corrected(y, lengths=n, **options), strict=True)), names)


def band_pass(traces: DataFrame, **options) -> DataFrame:
    """(trace, frame, filtered)."""

    def kernel(y: np.ndarray, lengths: np.ndarray) -> dict[str, np.ndarray]:
        out = np.zeros_like(y)
        for n in np.unique(lengths):
            out[lengths == n, :n] = band_passed(y[lengths == n, :n], **options)
        return {"filtered": out}

    return by_trace(traces, kernel, ["filtered"])
