"""Pairwise measures of traces: Pearson correlation and normalised mutual information.

All pairs are looked at, so the work is dealt in cells, pairs of blocks of traces, and a task makes the matrix products or
the joint histograms of one cell, tile by tile (``cells``). A trace is sent once to each cell of its block; no frame-by-frame
join of pairs is made. Only frames count in which every trace has a sample. What is wanted of a cell is a fold: all pairs,
the strongest, or sums.

Of traces of more than ``FRAMES`` frames products are made for so many at a time and added up, so a task holds parts of
traces, however long they are. Histograms hold whole traces, as one small number a frame.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluora.functions.shared import cut
from fluora.operators import cells
from fluora.operators.traces import shared_frames

BLOCK, FRAMES = 256, 4096


def _cells(rows: DataFrame, n: int) -> DataFrame:
    """The rows with the cells (low, high) of their trace, for n traces."""
    blocks = max(1, -(-n // BLOCK))
    block = F.pmod(F.xxhash64("trace"), F.lit(blocks)).cast("int")
    rows = rows.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return rows.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))


def _sides(cell: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    """The rows of both blocks of a cell, each by name."""
    cell = cell.sort_values("trace")
    return cell[cell.block == cell.low], cell[cell.block == cell.high]


def _scaled(digits: int | None) -> float | None:
    if digits is not None and not 0 <= digits <= 7:
        raise ValueError(f"from 0 to 7 digits, not {digits}")
    return None if digits is None else 10.0**digits


def _correlated(names: pa.Array, norms: tuple[np.ndarray, np.ndarray], same: bool, product: Callable[[slice, slice], np.ndarray], scale: float | None, tile: int) -> cells.Cell:
    def values(at: slice, to: slice) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            r = product(at, to) / np.outer(norms[0][at], norms[1][to])
        return np.clip(np.where(np.isfinite(r), r, 0.0), -1, 1)

    return cells.Cell(names, len(norms[0]), same, values, scale, tile)


def correlated(traces: DataFrame, digits: int | None = None) -> Callable[[cells.Fold], DataFrame]:
    """Folds of the correlations of all pairs, 0 where a trace is constant, within -1 and 1, rounded to so many digits.

    Traces are packed once, whatever is folded.
    """
    scale, tile = _scaled(digits), cells.TILE
    rows = shared_frames(traces)
    mean = rows.groupBy("trace").agg(F.avg("y").alias("mean"))
    y = F.col("y") - F.col("mean")
    part = F.floor(F.col("frame") / FRAMES).alias("part")
    packed = rows.join(mean, "trace").groupBy("trace", part).agg(F.sort_array(F.collect_list(F.struct("frame", y.alias("y")))).alias("s"), F.sum(y * y).alias("square"))
    packed = cut(packed.select("trace", "part", F.col("s.y").alias("ys"), "square"))
    sizes = packed.groupBy("trace").agg(F.sqrt(F.sum("square")).alias("norm"))
    seen = packed.agg(F.count_distinct("trace").alias("n"), F.count_distinct("part").alias("parts"), F.max(F.size("ys")).alias("frames")).first()
    n = seen["n"]

    def whole(left: pa.Table, right: pa.Table, same: bool) -> cells.Cell:
        a = cells.stacked(left["ys"])
        b = a if same else cells.stacked(right["ys"])
        norms = left["norm"].to_numpy(), right["norm"].to_numpy()
        return _correlated(cells.joined(left, right, same), norms, same, lambda at, to: a[at] @ b[to].T, scale, tile)

    if seen["parts"] == 1:
        single = packed.select("trace", "ys", F.sqrt("square").alias("norm"))
        first = cells.starts(single, n, cells.blocks_of(n, 8 * seen["frames"]))
        return lambda fold: cells.dealt(single, first, fold, whole)

    def partial(cell: pd.DataFrame) -> pd.DataFrame:
        left, right = _sides(cell)
        if not (len(left) and len(right)):
            return pd.DataFrame(columns=["low", "high", "products"])
        product = np.array(left.ys.tolist(), float) @ np.array(right.ys.tolist(), float).T
        return pd.DataFrame({"low": [cell.low.iloc[0]], "high": [cell.high.iloc[0]], "products": [product.ravel()]})

    def folded(fold: cells.Fold) -> DataFrame:
        out = fold.schema.format(kind=traces.schema["trace"].dataType.simpleString())
        columns = [c.split()[0] for c in out.split(", ")]

        def added(names: pd.DataFrame, sums: pd.DataFrame) -> pd.DataFrame:
            left, right = _sides(names)
            if not (len(left) and len(right)):
                return pd.DataFrame(columns=columns)
            whole, same = np.sum(sums.products.tolist(), 0).reshape(len(left), len(right)), left.low.iloc[0] == left.high.iloc[0]
            own = pa.array(left.trace if same else pd.concat([left.trace, right.trace]))
            cell = _correlated(own, (left.norm.to_numpy(), right.norm.to_numpy()), same, lambda at, to: whole[at, to], scale, tile)
            return pd.concat([pd.DataFrame(columns=columns), *(b.to_pandas() for b in fold.run(cell))])

        sums = _cells(packed.drop("square").join(sizes, "trace"), n).groupBy("low", "high", "part").applyInPandas(partial, "low int, high int, products array<double>")
        return _cells(sizes, n).groupBy("low", "high").cogroup(sums.groupBy("low", "high")).applyInPandas(added, out)

    return folded


def pearson(traces: DataFrame, digits: int | None = None, least: float | None = None) -> DataFrame:
    """(i, j, value) for all pairs i < j, or those of at least this absolute value: 0 where a trace is constant, within -1 and 1."""
    return correlated(traces, digits)(cells.every_pair(least))


def matrix(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """The whole symmetric matrix with 1 on its diagonal; names has (trace)."""
    side = lambda a, b: F.struct(F.col(a).alias("i"), F.col(b).alias("j"))
    both = pairs.select(F.explode(F.array(side("i", "j"), side("j", "i"))).alias("e"), "value").select("e.*", "value")  # pairs are made once
    return both.unionByName(names.select(F.col("trace").alias("i"), F.col("trace").alias("j"), F.lit(1.0).alias("value")))


def auto_bins(n: int) -> int:
    """Twice the cube root of the number of frames, rounded half to even, from 8 to 64."""
    return min(64, max(8, round(2 * n ** (1 / 3))))


def binned(traces: DataFrame, bins: int) -> DataFrame:
    """(trace, frame, bin): equal widths between a trace's least and greatest value; 0 for constant traces."""
    rows = shared_frames(traces)
    span = rows.groupBy("trace").agg(F.min("y").alias("lo"), F.max("y").alias("hi"))
    width = F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(1.0)
    place: Column = F.least(F.lit(bins - 1), F.floor((F.col("y") - F.col("lo")) / width * bins).cast("int"))
    return rows.join(span, "trace").select("trace", "frame", place.alias("bin"))


def entropies(traces: DataFrame, bins: int) -> DataFrame:
    """(trace, entropy) of the binned values in nats."""
    counts = binned(traces, bins).groupBy("trace", "bin").agg(F.count("*").alias("c"))
    total = counts.groupBy("trace").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log("c")).alias("s"))
    return total.select("trace", (F.log("n") - F.col("s") / F.col("n")).alias("entropy"))


def nmi(traces: DataFrame, bins: int, digits: int | None = None) -> DataFrame:
    """(i, j, value) for all pairs i < j: mutual information over the root of both entropies, from 0 to 1."""
    codes = binned(traces, bins).groupBy("trace").agg(F.sort_array(F.collect_list(F.struct("frame", F.col("bin").cast("tinyint").alias("bin")))).alias("s")).select("trace", F.col("s.bin").alias("ys"))
    codes = cut(codes)
    scale, tile = _scaled(digits), cells.TILE
    seen = codes.agg(F.count("*").alias("n"), F.max(F.size("ys")).alias("frames")).first()

    def shared(left: pa.Table, right: pa.Table, same: bool) -> cells.Cell:
        x = cells.stacked(left["ys"]).astype(np.int16)
        y = x if same else cells.stacked(right["ys"]).astype(np.int16)
        n = x.shape[1]
        p = np.arange(n + 1) / n
        terms = -np.where(p > 0, p * np.log(np.where(p > 0, p, 1)), 0)  # of an entropy, by count
        own = [terms[np.stack([np.bincount(row, minlength=bins) for row in m])].sum(-1) for m in (x, y)]
        lot = max(1, (1 << 22) // (n + bins * bins))  # traces that are counted at once

        def values(at: slice, to: slice) -> np.ndarray:
            a, out = x[at].astype(np.int64) * bins, []
            for k in range(to.start, to.stop, lot):
                others = y[k : min(k + lot, to.stop)]
                codes = others + np.arange(len(others))[:, None] * bins * bins
                joint = [terms[np.bincount((row + codes).ravel(), minlength=len(others) * bins * bins)].reshape(len(others), -1).sum(-1) for row in a]
                out.append(np.array(joint).reshape(len(a), len(others)))
            first, second = own[0][at, None], own[1][None, to]
            with np.errstate(divide="ignore", invalid="ignore"):
                v = (first + second - np.concatenate(out, 1)) / np.sqrt(first * second)
            return np.where((first > 0) & (second > 0), np.clip(v, 0, 1), 0.0)

        return cells.Cell(cells.joined(left, right, same), len(x), same, values, scale, tile)

    first = cells.starts(codes, seen["n"], cells.blocks_of(seen["n"], seen["frames"] or 0))
    return cells.dealt(codes, first, cells.every_pair(), shared)
