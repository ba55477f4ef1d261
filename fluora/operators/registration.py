"""Registration of videos: transforms of frames onto a reference, their composition, and moved frames.

Frames are rows (frame, px). A transform is the 2 by 3 matrix of a frame's places to the reference's, row by row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fluora.operators.imaging import pixels, warped

#: Frames whose transforms are composed in one task.
STEPS = 1 << 14
KINDS = ("translation", "rigid body", "affine")
REFERENCES = ("previous", "first", "mean")
#: Rounds at most, least change of the correlation, and the smoothing of both images (taps, deviation).
ROUNDS, CHANGE, TAPS, SIGMA = 50, 1e-4, 5, 1.1
IDENTITY = np.array([[1.0, 0, 0], [0, 1, 0]])


def _smooth_size(n: int) -> int:
    """The next number without prime factors but 2, 3 and 5."""
    while True:
        rest = n
        for p in (2, 3, 5):
            while rest % p == 0:
                rest //= p
        if rest == 1:
            return n
        n += 1


def shift(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """(dx, dy) by which b is moved against a, in parts of a pixel: phase correlation under a Hann window.

    The peak is the centre of mass of the 5 by 5 places around the largest value.
    """
    h, w = a.shape
    hann = lambda n: 0.5 * (1 - np.cos(2 * np.pi * np.arange(n) / max(n - 1, 1)))
    window = np.sqrt(np.outer(hann(h), hann(w)))
    size = _smooth_size(h), _smooth_size(w)
    fa, fb = (np.fft.fft2(m * window, size) for m in (a, b))
    cross = fa * np.conj(fb)
    around = np.fft.fftshift(np.fft.ifft2(cross / np.maximum(np.abs(cross), 1e-12)).real)
    y, x = np.unravel_index(np.argmax(around), size)
    ys, xs = np.arange(max(y - 2, 0), min(y + 3, size[0])), np.arange(max(x - 2, 0), min(x + 3, size[1]))
    part = around[np.ix_(ys, xs)]
    total = part.sum() + 1e-12
    return float(size[1] // 2 - (part.sum(0) @ xs) / total), float(size[0] // 2 - (part.sum(1) @ ys) / total)


def _blurred(a: np.ndarray) -> np.ndarray:
    taps = np.exp(-0.5 * ((np.arange(TAPS) - TAPS // 2) / SIGMA) ** 2)
    taps /= taps.sum()
    for axis in (0, 1):
        wide = np.pad(a, [(TAPS // 2,) * 2 if i == axis else (0, 0) for i in (0, 1)], mode="reflect")
        a = sum(t * np.take(wide, np.arange(k, k + a.shape[axis]), axis) for k, t in enumerate(taps))
    return a


def ecc(a: np.ndarray, b: np.ndarray, rigid: bool) -> np.ndarray | None:
    """The map of a's places to b's that has the highest correlation coefficient; None where it isn't found.

    Each round moves b and its slopes by the present map and takes the step that is best for the linearized coefficient;
    only places that come from inside b count.
    """
    a, b = _blurred(a), _blurred(b)
    wide = np.pad(b, 1, mode="reflect")
    slope_x, slope_y = (wide[1:-1, 2:] - wide[1:-1, :-2]) / 2, (wide[2:, 1:-1] - wide[:-2, 1:-1]) / 2
    y, x = (v.astype(float) for v in np.mgrid[: a.shape[0], : a.shape[1]])
    turn, move, m, before = 0.0, np.zeros(2), IDENTITY.copy(), None
    for _ in range(ROUNDS):
        inside = warped(np.ones(b.shape), m) > 0.5
        if inside.sum() < 6:
            return None
        now, gx, gy = (warped(v, m)[inside] for v in (b, slope_x, slope_y))
        px, py, then = x[inside], y[inside], a[inside]
        now, then = now - now.mean(), then - then.mean()
        size, size_then = np.sqrt(now @ now), np.sqrt(then @ then)
        if not (size > 0 and size_then > 0):
            return None
        if rigid:
            slopes = np.stack([gx * (-px * np.sin(turn) - py * np.cos(turn)) + gy * (px * np.cos(turn) - py * np.sin(turn)), gx, gy])
        else:
            slopes = np.stack([gx * px, gy * px, gx * py, gy * py, gx, gy])
        both = now @ then
        found = both / (size * size_then)
        if before is not None and abs(found - before) < CHANGE:
            return m
        before = found
        try:
            inverse = np.linalg.inv(slopes @ slopes.T)
        except np.linalg.LinAlgError:
            return None
        on_now, on_then = slopes @ now, slopes @ then
        below = both - on_then @ inverse @ on_now
        if below <= 0:
            return None
        scale = (size**2 - on_now @ inverse @ on_now) / below
        step = inverse @ (slopes @ (scale * then - now))
        if not np.isfinite(step).all():
            return None
        if rigid:
            turn, move = turn + step[0], move + step[1:]
            m = np.array([[np.cos(turn), -np.sin(turn), move[0]], [np.sin(turn), np.cos(turn), move[1]]])
        else:
            m = m + np.array([[step[0], step[2], step[4]], [step[1], step[3], step[5]]])
    return m


def inverted(m: np.ndarray) -> np.ndarray | None:
    turn = m[:, :2]
    if not abs(np.linalg.det(turn)) > 1e-12:
        return None
    back = np.linalg.inv(turn)
    return np.column_stack([back, -back @ m[:, 2]])


def transform(a: np.ndarray, b: np.ndarray, kind: str) -> np.ndarray:
    """The matrix that brings b onto a; the identity where none is found."""
    if kind == "translation":
        dx, dy = shift(a, b)
        return np.array([[1, 0, -dx], [0, 1, -dy]])
    m = ecc(a, b, kind == "rigid body")
    m = None if m is None else inverted(m)
    return IDENTITY.copy() if m is None else m


def numbered(frames: DataFrame) -> DataFrame:
    """(frame, nth): frames in order, from 0; blocks of frames are counted first, so that no task sorts all of them."""
    rows = frames.select(F.col("frame").cast("long").alias("frame")).withColumn("block", F.floor(F.col("frame") / STEPS))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    first = rows.groupBy("block").agg(F.count("*").alias("n")).select("block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    nth = F.row_number().over(Window.partitionBy("block").orderBy("frame")) - 1
    return rows.withColumn("k", nth).join(first, "block").select("frame", (F.col("first") + F.col("k")).alias("nth"))


def _compared(rows: DataFrame, height: int, width: int, kind: str) -> DataFrame:
    """(frame, m) of rows (frame, px, ref); without a reference it is the identity."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        image = lambda p: np.asarray(p, float).reshape(height, width)
        for part in parts:
            found = [IDENTITY if r is None else transform(image(r), image(p), kind) for p, r in zip(part.px, part.ref, strict=True)]
            yield pd.DataFrame({"frame": part.frame, "m": [m.ravel().tolist() for m in found]})

    return rows.select(F.col("frame").cast("long").alias("frame"), "px", "ref").mapInPandas(run, "frame long, m array<double>")


def composed(steps: DataFrame) -> DataFrame:
    """(frame, m) against the first frame from transforms (frame, m) of each frame onto the one before.

    Products are associative, so each block of ``STEPS`` frames is multiplied by itself, then the blocks' products, of
    which there is one a block, and the block's frames by the product of all blocks before.
    """
    square = lambda m: np.vstack([np.reshape(m, (2, 3)), [0, 0, 1]])

    def products(rows: pd.DataFrame, by: str) -> pd.DataFrame:
        rows = rows.sort_values(by)
        out, now = [], np.eye(3)
        for m in rows.m:
            now = now @ square(m)
            out.append(now[:2].ravel().tolist())
        return rows.assign(m=out)

    def after(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            m = [a if b is None else (square(b) @ square(a))[:2].ravel().tolist() for a, b in zip(part.m, part.before, strict=True)]
            yield pd.DataFrame({"frame": part.frame, "m": m})

    rows = steps.select(F.col("frame").cast("long").alias("frame"), "m", F.floor(F.col("frame") / STEPS).alias("block"))
    within = rows.groupBy("block").applyInPandas(lambda r: products(r, "frame"), "frame long, m array<double>, block long")
    ends = within.groupBy("block").agg(F.max_by("m", "frame").alias("m"))
    ends = ends.groupBy().applyInPandas(lambda r: products(r, "block").assign(block=lambda d: d.block.shift(-1, fill_value=-1)), "block long, m array<double>")
    return within.join(ends.withColumnRenamed("m", "before"), "block", "left").select("frame", "m", "before").mapInPandas(after, "frame long, m array<double>")


def transforms(frames: DataFrame, height: int, width: int, kind: str = "translation", reference: str = "previous") -> DataFrame:
    """(frame, m) of frames (frame, px) against the first frame or the mean one; the first frame isn't moved.

    With ``previous`` each frame meets the one before it in order, whatever its number, and the steps are composed.
    """
    if kind not in KINDS or reference not in REFERENCES:
        raise ValueError(f"no such transformation or reference: {kind}, {reference}")
    order = numbered(frames)
    rows = frames.join(order, "frame")
    if reference == "previous":
        before = rows.select((F.col("nth") + 1).alias("nth"), F.col("px").alias("ref"))
        steps = _compared(rows.join(before, "nth", "left").select(F.col("nth").alias("frame"), "px", "ref"), height, width, kind)
        return composed(steps).withColumnRenamed("frame", "nth").join(order, "nth").select("frame", "m")
    if reference == "first":
        image = rows.where("nth = 0").select(F.col("px").alias("ref"))
    else:
        means = pixels(frames).groupBy("pixel").agg(F.avg("v").alias("v"))
        image = means.agg(F.sort_array(F.collect_list(F.struct("pixel", "v"))).alias("s")).select(F.col("s.v").alias("ref"))
    rows = rows.join(F.broadcast(image)).withColumn("ref", F.when(F.col("nth") > 0, F.col("ref")))  # one image
    return _compared(rows, height, width, kind)


def moved(frames: DataFrame, found: DataFrame, height: int, width: int) -> DataFrame:
    """(frame, px): frames (frame, px) moved by transforms (frame, m), bilinear, zero outside."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            back = [inverted(np.reshape(m, (2, 3))) for m in part.m]
            px = [warped(np.asarray(p, float).reshape(height, width), IDENTITY if b is None else b).ravel().tolist() for p, b in zip(part.px, back, strict=True)]
            yield pd.DataFrame({"frame": part.frame, "px": px})

    rows = frames.join(found, "frame").select(F.col("frame").cast("long").alias("frame"), "px", "m")
    return rows.mapInPandas(run, "frame long, px array<double>")
