"""Images cut into tiles, so that no image is one task's work: windows with a margin, connected regions across tiles.

Images are rows (image, pixel, ...), pixel being y * width + x.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluora.functions.shared import checkpoint, cut

#: Pixels on a side of a tile.
SIDE = 256


Columns = dict[str, np.ndarray]


def by_group(rows: DataFrame, keys: list[str], run: Callable[[Columns], dict | None], schema: str) -> DataFrame:
    """What ``run`` makes of the columns of each group; it gives arrays or lists by name, or nothing.

    Groups lie one after the other in sorted partitions, so many small ones share a batch, where ``applyInPandas`` makes
    batches and frames for each; a task holds a batch and its largest group.
    """
    fields = [f.strip().split(" ", 1) for f in schema.split(", ")]

    def framed(made: list[dict]) -> pd.DataFrame:
        out = {}
        for name, kind in fields:
            parts = [m[name] for m in made]
            whole = np.concatenate(parts) if all(isinstance(p, np.ndarray) and p.ndim == 1 for p in parts) else list(chain(*parts))
            out[name] = pd.array(whole, "Int64") if kind == "long" and isinstance(whole, np.ndarray) and whole.dtype.kind == "f" else whole
        return pd.DataFrame(out)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[Columns] = []  # parts of the group that may go on
        whole = lambda: {c: np.concatenate([h[c] for h in held]) for c in held[0]}
        for batch in batches:
            if not len(batch):
                continue
            columns = {c: batch[c].to_numpy() for c in batch.columns}
            new = np.logical_or.reduce([columns[k][1:] != columns[k][:-1] for k in keys])
            at = [0, *(np.flatnonzero(new) + 1).tolist(), len(batch)]
            made = []
            for a, b in zip(at, at[1:], strict=False):
                part = {c: v[a:b] for c, v in columns.items()}
                if held and any(held[0][k][0] != part[k][0] for k in keys):
                    made.append(run(whole()))
                    held = []
                held.append(part)
            if made := [m for m in made if m]:
                yield framed(made)
        if held and (last := run(whole())):
            yield framed([last])

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(each, schema)


def windows(image: DataFrame, width: int, height: int, margin: int = 0, side: int = SIDE) -> DataFrame:
    """The rows with (ty, tx), repeated for each tile whose window, ``margin`` pixels larger on all sides, holds the pixel."""

    def tiles(at: Column, most: int) -> Column:
        low, high = F.greatest(at - margin, F.lit(0)), F.least(at + margin, F.lit(most - 1))
        return F.explode(F.sequence(F.floor(low / side), F.floor(high / side)))

    rows = image.select("*", tiles(F.expr(f"pixel div {width}"), height).alias("ty"))
    return rows.select("*", tiles(F.col("pixel") % width, width).alias("tx"))


def by_tile(image: DataFrame, width: int, height: int, work: Callable[[np.ndarray], dict[str, np.ndarray]], schema: str, margin: int = 0, fill: float | None = None, side: int = SIDE) -> DataFrame:
    """(image, pixel, *schema) of images (image, pixel, v): ``work`` gets a tile's window and gives arrays over the tile itself.

    Beyond the image the window is mirrored at the outermost pixels, or has the value ``fill``; ``fill`` also stands for pixels
    without a row. Rows come back for the pixels that have one.
    """
    kind = image.schema["image"].dataType.simpleString()

    def run(rows: Columns) -> dict:
        top, left = int(rows["ty"][0]) * side, int(rows["tx"][0]) * side
        bottom, right = min(top + side, height), min(left + side, width)
        y0, y1, x0, x1 = max(top - margin, 0), min(bottom + margin, height), max(left - margin, 0), min(right + margin, width)
        window, there = np.full((y1 - y0, x1 - x0), 0.0 if fill is None else fill), np.zeros((y1 - y0, x1 - x0), bool)
        y, x = np.divmod(rows["pixel"].astype(np.int64), width)
        window[y - y0, x - x0], there[y - y0, x - x0] = rows["v"].astype(float), True
        around = ((y0 - top + margin, bottom + margin - y1), (x0 - left + margin, right + margin - x1))
        window = np.pad(window, around, mode="reflect") if fill is None else np.pad(window, around, constant_values=fill)
        there = there[top - y0 : bottom - y0, left - x0 : right - x0]
        yy, xx = np.nonzero(there)
        out = {"image": np.repeat(rows["image"][:1], len(yy)), "pixel": (yy + top) * width + xx + left}
        for name, values in work(window).items():
            own = values[there]
            out[name] = own if own.ndim == 1 else list(own)
        return out

    rows = windows(image.select("image", "pixel", "v"), width, height, margin, side)
    return by_group(rows, ["image", "ty", "tx"], run, f"image {kind}, pixel long, {schema}")


def blob_labels(at: np.ndarray, width: int) -> np.ndarray:
    """For sorted pixels the least pixel of their 8-connected blob."""
    x, label = at % width, at.copy()
    steps = []
    for dy in (-1, 0, 1):
        for dx in (-1, 0, 1):
            to = np.minimum(np.searchsorted(at, at + dy * width + dx), len(at) - 1)
            here = np.flatnonzero((x + dx >= 0) & (x + dx < width) & (at[to] == at + dy * width + dx))
            steps.append((here, to[here]))
    while True:
        new = label.copy()
        for here, to in steps:
            new[here] = np.minimum(new[here], label[to])
        new = np.minimum(new, new[np.searchsorted(at, new)])
        if (new == label).all():
            return label
        label = new


def components(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, node, least) of the undirected graphs of (*keys, a, b): the least node that can be reached from each.

    Every round points each node to its least neighbour, follows pointers to their ends, which doubles the way each time,
    and keeps only edges between different ends.
    """
    both = edges.select(*keys, "a", "b").unionByName(edges.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
    edges = checkpoint(both.where("a != b").distinct())
    least = edges.select(*keys, F.col("a").alias("node"), F.col("a").alias("least")).distinct()
    while not edges.isEmpty():
        to = checkpoint(edges.groupBy(*keys, F.col("a").alias("node")).agg(F.min("b").alias("b")).select(*keys, "node", F.least("node", "b").alias("to")))
        while True:
            further = to.select(*keys, F.col("node").alias("to"), F.col("to").alias("end"))
            jumped = checkpoint(to.join(further, [*keys, "to"]).select(*keys, "node", F.col("end").alias("to"), (F.col("end") != F.col("to")).alias("moved")))
            to = jumped.drop("moved")
            if jumped.where("moved").isEmpty():
                break
        ends = to.withColumnRenamed("to", "end")
        least = checkpoint(least.join(ends.withColumnRenamed("node", "least"), [*keys, "least"], "left").select(*keys, "node", F.coalesce("end", "least").alias("least")))
        for side in ("a", "b"):
            edges = edges.join(ends.withColumnRenamed("node", side), [*keys, side]).drop(side).withColumnRenamed("end", side)
        edges = checkpoint(edges.select(*keys, "a", "b").where("a != b").distinct())
    return least


def labelled(masks: DataFrame, width: int, side: int = SIDE) -> DataFrame:
    """(image, pixel, blob) of 8-connected pixels (image, pixel); blob is the least pixel of each.

    Tiles are labelled by themselves; labels that touch over the border of two tiles are merged by following pointers.
    """
    kind = masks.schema["image"].dataType.simpleString()

    def run(rows: Columns) -> dict:
        at = np.unique(rows["pixel"])
        return {"image": np.repeat(rows["image"][:1], len(at)), "pixel": at, "blob": blob_labels(at, width)}

    y, x = F.expr(f"pixel div {width}"), F.col("pixel") % width
    rows = masks.select("image", F.col("pixel").cast("long").alias("pixel"))
    tiled = rows.withColumn("ty", F.floor(y / side)).withColumn("tx", F.floor(x / side))
    within = cut(by_group(tiled, ["image", "ty", "tx"], run, f"image {kind}, pixel long, blob long"))
    # a pixel in a tile's first row or column, and those before it in other tiles
    place = within.select("image", "pixel", "blob", y.alias("y"), x.alias("x")).where(f"(y > 0 and y % {side} = 0) or (x > 0 and x % {side} = 0) or (x + 1) % {side} = 0")
    step = F.explode(F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in ((-1, -1), (-1, 0), (-1, 1), (0, -1))]))
    met = place.select("image", F.col("blob").alias("a"), "y", "x", step.alias("s")).where(f"x + s.dx between 0 and {width - 1} and y + s.dy >= 0")
    apart = (F.floor((F.col("y") + F.col("s.dy")) / side) != F.floor(F.col("y") / side)) | (F.floor((F.col("x") + F.col("s.dx")) / side) != F.floor(F.col("x") / side))
    met = met.where(apart).select("image", "a", ((F.col("y") + F.col("s.dy")) * width + F.col("x") + F.col("s.dx")).alias("pixel"))
    edges = met.join(within.withColumnRenamed("blob", "b"), ["image", "pixel"]).select("image", "a", "b").distinct()
    edges = checkpoint(edges)
    if edges.isEmpty():
        return within
    least = components(edges, ["image"]).withColumnRenamed("node", "blob")
    return within.join(least, ["image", "blob"], "left").select("image", "pixel", F.coalesce("least", "blob").alias("blob"))
