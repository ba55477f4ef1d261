"""Regions of interest, projections and frame statistics.

Videos come as frames (frame, px ARRAY<DOUBLE>) or pixels (frame, pixel, v); regions as (roi_id, pixel).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluora.operators.tiles import labelled

#: Frames whose moves are summed in one task.
STEPS = 1 << 14
#: Pixels of regions (4 bytes each) that are broadcast together.
MASK_PIXELS = 4_000_000


def pixels(frames: DataFrame) -> DataFrame:
    """(frame, pixel, v) of frames (frame, px)."""
    return frames.select("frame", F.posexplode("px").alias("pixel", "v"))


def roi_metrics(frames: DataFrame, masks: DataFrame, more: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """(frame, roi_id, max, mean, std, int, *more) of the pixels of each region; std is the population one.

    ``more`` has further metrics by name: functions from the array of a region's values to a number.

    Region masks are packed into arrays, of which all frames meet at most ``MASK_PIXELS`` pixels at a time, so pixels are
    never shuffled; regions without pixels have null metrics. The result has a row for each frame and region.
    """
    packed = masks.groupBy("roi_id").agg(F.collect_list(F.col("pixel").cast("int")).alias("at"))
    parts = max(1, -(-masks.count() // MASK_PIXELS))
    some = [packed.where(F.pmod(F.xxhash64("roi_id"), F.lit(parts)) == i) for i in range(parts)]
    rows = reduce(DataFrame.unionByName, [frames.join(F.broadcast(p)) for p in some])
    values = F.filter(F.transform("at", lambda i: F.get(F.col("px"), i)), lambda v: v.isNotNull())
    rows = rows.select("frame", "roi_id", values.alias("v")).withColumn("n", F.size("v"))
    total = F.aggregate("v", F.lit(0.0), lambda a, v: a + v)
    rows = rows.withColumn("total", total).withColumn("mean", F.try_divide("total", F.col("n")))
    square = F.aggregate("v", F.lit(0.0), lambda a, v: a + (v - F.col("mean")) * (v - F.col("mean")))
    return rows.select("frame", "roi_id", F.array_max("v").alias("max"), "mean", F.sqrt(F.try_divide(square, F.col("n"))).alias("std"), F.when(F.col("n") > 0, F.col("total")).alias("int"), *[F.when(F.col("n") > 0, f(F.col("v"))).alias(k) for k, f in (more or {}).items()])


def projection(frames: DataFrame) -> DataFrame:
    """(pixel, mean, max, std) over all frames; std is the population one."""
    return pixels(frames).groupBy("pixel").agg(F.avg("v").alias("mean"), F.max("v").alias("max"), F.stddev_pop("v").alias("std"))


def to_u8(image: DataFrame, column: str) -> DataFrame:
    """(pixel, u8): a column scaled from its range to 0..255 and cut to integers; 0 for a flat image."""
    span = image.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    share = F.when(F.col("hi") > F.col("lo"), (F.col(column) - F.col("lo")) / (F.col("hi") - F.col("lo")) * 255).otherwise(0.0)
    return image.join(F.broadcast(span)).select("pixel", F.floor(share).cast("int").alias("u8"))


def mask_union(masks: DataFrame) -> DataFrame:
    return masks.select("pixel").distinct()


def mask_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("pixel").distinct().join(b.select("pixel"), "pixel", "left_anti")


def median_background(frames: DataFrame) -> DataFrame:
    """(pixel, median) over all frames."""
    return pixels(frames).groupBy("pixel").agg(F.median("v").alias("median"))


def with_background(frames: DataFrame, window: int = 0) -> DataFrame:
    """(frame, pixel, v, median): pixels with their temporal median over all frames, or over ``window`` frames around each.

    A window reaches window // 2 frames to either side and is cut at the ends; from the number of frames on it is all of
    them. A pixel's frames are cut into blocks that take along the frames their windows reach into, so a long video isn't
    one task's work a pixel.
    """
    if window <= 0 or window >= frames.count():
        return pixels(frames).join(median_background(frames), "pixel").select("frame", "pixel", "v", "median")
    half, block = window // 2, max(1024, 4 * window)
    first = frames.agg(F.min("frame").alias("a"), F.max("frame").alias("b"), F.count("*").alias("n")).first()
    if first["b"] - first["a"] + 1 != first["n"]:
        raise ValueError("a windowed background needs frames numbered without gaps")
    at = F.col("frame") - first["a"]
    blocks = F.sequence(F.floor(F.greatest(at - half, F.lit(0)) / block), F.floor((at + half) / block))
    rows = frames.select("frame", F.explode(blocks).alias("block"), "px").select("frame", "block", F.posexplode("px").alias("pixel", "v"))
    around = Window.partitionBy("pixel", "block").orderBy("frame").rowsBetween(-half, half)
    rows = rows.withColumn("median", F.percentile("v", 0.5).over(around))
    return rows.where(F.floor((F.col("frame") - first["a"]) / block) == F.col("block")).select("frame", "pixel", "v", "median")


def _differences(background: DataFrame, k: float) -> DataFrame:
    diff = background.select("frame", "pixel", F.abs(F.col("v") - F.col("median")).alias("d"))
    limit = diff.groupBy("frame").agg((F.avg("d") + k * F.greatest(F.stddev_pop("d"), F.lit(1e-6))).alias("limit"))
    return diff.join(limit, "frame")


def outlier_pixels(frames: DataFrame, k: float = 3.0, window: int = 0) -> DataFrame:
    """(frame, n): pixels that differ from the temporal median by more than mean + k population deviations of a frame."""
    return _differences(with_background(frames, window), k).groupBy("frame").agg(F.count_if(F.col("d") > F.col("limit")).alias("n"))


def outliers(frames: DataFrame, k: float = 3.0, window: int = 0) -> DataFrame:
    """(image, pixel) of these pixels."""
    return outliers_of(with_background(frames, window), k)


def outliers_of(background: DataFrame, k: float = 3.0) -> DataFrame:
    """The same of pixels with their background, as ``with_background`` gives them."""
    return _differences(background, k).where("d > limit").select(F.col("frame").alias("image"), F.col("pixel").cast("long").alias("pixel"))


def rect_pixels(rois: DataFrame, height: int, width: int) -> DataFrame:
    """(roi_id, pixel) of rois (roi_id, left, top, width, height), cut to the image."""
    side = lambda a, n, most: F.sequence(F.greatest(F.lit(0), a), F.least(F.lit(most), a + n) - 1)
    xs = side(F.col("left").cast("int"), F.col("width").cast("int"), width)
    ys = side(F.col("top").cast("int"), F.col("height").cast("int"), height)
    inside = (F.least(F.lit(width), F.col("left") + F.col("width")) > F.greatest(F.lit(0), "left")) & (F.least(F.lit(height), F.col("top") + F.col("height")) > F.greatest(F.lit(0), "top"))
    rows = rois.where(inside).select("roi_id", F.explode(ys).alias("y"), xs.alias("xs")).select("roi_id", "y", F.explode("xs").alias("x"))
    return rows.select("roi_id", (F.col("y") * width + F.col("x")).alias("pixel"))


def _crossings(xs: Column, ys: Column, x: Column, y: Column) -> Column:
    """How many edges of a closed polygon a ray to the right of the point crosses."""
    nth = F.sequence(F.lit(0), F.size(xs) - 1)

    def crosses(i: Column) -> Column:
        j = F.pmod(i + 1, F.size(xs))
        y1, y2, x1, x2 = F.get(ys, i), F.get(ys, j), F.get(xs, i), F.get(xs, j)
        return F.when((y1 > y) != (y2 > y), x < x1 + F.try_divide((y - y1) * (x2 - x1), y2 - y1)).otherwise(False)

    return F.size(F.filter(nth, crosses))


def polygon_pixels(rois: DataFrame, height: int, width: int) -> DataFrame:
    """(roi_id, pixel) of rois (roi_id, xs, ys) whose integer coordinates lie inside by the even-odd rule.

    Polygons of less than three corners have no pixels.
    """
    corner = lambda f, c, most: F.greatest(F.lit(0), F.least(F.lit(most - 1), F.floor(f(c)).cast("int")))
    box = rois.where(F.size("xs") >= 3).select("*", *[corner(f, c, m).alias(n) for f, c, m, n in ((F.array_min, "xs", width, "x0"), (F.array_max, "xs", width, "x1"), (F.array_min, "ys", height, "y0"), (F.array_max, "ys", height, "y1"))])
    rows = box.withColumn("y", F.explode(F.sequence("y0", "y1"))).withColumn("x", F.explode(F.sequence("x0", "x1")))
    return rows.where(_crossings(F.col("xs"), F.col("ys"), F.col("x"), F.col("y")) % 2 == 1).select("roi_id", (F.col("y") * width + F.col("x")).alias("pixel"))


def centroids(rois: DataFrame) -> DataFrame:
    """(roi_id, x, y): the mean of the corners, else the middle of the box, else its corner."""
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.size(a)
    has = F.coalesce(F.size("xs") > 0, F.lit(False))
    return rois.select("roi_id", F.when(has, mean(F.col("xs"))).otherwise(F.coalesce(F.col("left") + F.col("width") / 2, "left")).alias("x"), F.when(has, mean(F.col("ys"))).otherwise(F.coalesce(F.col("top") + F.col("height") / 2, "top")).alias("y"))


def reading_order(points: DataFrame) -> DataFrame:
    """points (roi_id, x, y) with new ids from 1 by y, then x; there is one row per region."""
    return points.withColumn("ord", F.row_number().over(Window.orderBy("y", "x", "roi_id")))


def blobs(masks: DataFrame, width: int) -> DataFrame:
    """(image, blob, area, x, y) of 8-connected pixels (image, pixel): blob is the least pixel of each."""
    x, y = F.col("pixel") % width, F.expr(f"pixel div {width}")
    return labelled(masks, width).groupBy("image", "blob").agg(F.count("*").alias("area"), F.avg(x).alias("x"), F.avg(y).alias("y"))


def oval_pixels(rois: DataFrame, height: int, width: int) -> DataFrame:
    """(roi_id, pixel) inside the ellipses of rois (roi_id, left, top, width, height), as polygons of 360 corners."""
    turn = F.transform(F.sequence(F.lit(0), F.lit(359)), lambda i: i * float(np.pi / 180))
    cx, cy = F.col("left") + F.col("width") / 2, F.col("top") + F.col("height") / 2
    xs, ys = F.transform(turn, lambda a: cx + F.col("width") / 2 * F.cos(a)), F.transform(turn, lambda a: cy + F.col("height") / 2 * F.sin(a))
    return polygon_pixels(rois.select("roi_id", xs.alias("xs"), ys.alias("ys")), height, width)


def roi_pixels(rois: DataFrame, height: int, width: int) -> DataFrame:
    """(roi_id, pixel) of regions of any kind; ids keep their gaps where a region has no pixels."""
    rect = rect_pixels(rois.where("kind = 'rect'"), height, width)
    oval = oval_pixels(rois.where("kind = 'oval'"), height, width)
    return rect.unionByName(oval).unionByName(polygon_pixels(rois.where("kind not in ('rect', 'oval')"), height, width))


def neighbours_in(masks: DataFrame, width: int, height: int, cross: bool = True) -> DataFrame:
    """(image, pixel, near): the pixels of masks (image, pixel) with each place next to them, themselves included."""
    steps = [(0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)] + ([] if cross else [(1, 1), (1, -1), (-1, 1), (-1, -1)])
    x, y = F.col("pixel") % width, F.expr(f"pixel div {width}")
    step = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in steps]))
    rows = masks.select("image", "pixel", x.alias("x"), y.alias("y"), step.alias("s"))
    rows = rows.select("image", "pixel", (F.col("x") + F.col("s.a")).alias("x"), (F.col("y") + F.col("s.b")).alias("y"))
    return rows.select("image", "pixel", F.when(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1), F.col("y") * width + F.col("x")).alias("near"))


def dilated(masks: DataFrame, width: int, height: int) -> DataFrame:
    """Masks grown by one pixel up, down, left and right (the elliptical 3 by 3 element)."""
    return neighbours_in(masks, width, height).where("near is not null").select("image", F.col("near").alias("pixel")).distinct()


def eroded(masks: DataFrame, width: int, height: int) -> DataFrame:
    """Masks shrunk likewise; places outside the image don't count against a pixel."""
    near = neighbours_in(masks, width, height).where("near is not null")
    gone = near.join(masks.select("image", F.col("pixel").alias("near")), ["image", "near"], "left_anti").select("image", "pixel").distinct()
    return masks.join(gone, ["image", "pixel"], "left_anti")


def opened(masks: DataFrame, width: int, height: int) -> DataFrame:
    return dilated(eroded(masks, width, height), width, height)


def floater_masks(background: DataFrame, width: int, height: int, k: float = 3.0, least: int = 2, most: int = 200) -> DataFrame:
    """(image, pixel) of moving particles in pixels with their background: outliers, opened, of fitting size, grown by one."""
    masks = opened(outliers_of(background, k), width, height)
    fit = labelled(masks, width)
    sizes = fit.groupBy("image", "blob").agg(F.count("*").alias("area"))
    kept = sizes.where((F.col("area") >= least) & ((F.lit(most) == 0) | (F.col("area") <= most)))
    return dilated(fit.join(kept, ["image", "blob"]).select("image", "pixel"), width, height)


def background_filled(background: DataFrame, masks: DataFrame) -> DataFrame:
    """(frame, pixel, v): of pixels with their background, masked ones (image, pixel) take it, the others stay."""
    hit = masks.select(F.col("image").alias("frame"), "pixel", F.lit(True).alias("hit"))
    return background.join(hit, ["frame", "pixel"], "left").select("frame", "pixel", F.when(F.col("hit"), F.col("median")).otherwise(F.col("v")).alias("v"))


def warped(image: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """An image seen through a 2 by 3 affine map of target to source places: bilinear, zero outside."""
    h, w = image.shape
    y, x = np.mgrid[:h, :w]
    sx, sy = (m[0] * x + m[1] * y + m[2] for m in np.asarray(matrix, float))
    x0, y0 = np.floor(sx).astype(int), np.floor(sy).astype(int)
    wide, out = np.pad(image, 1), np.zeros(image.shape)
    for dy in (0, 1):
        for dx in (0, 1):
            share = np.abs(1 - dx - (sx - x0)) * np.abs(1 - dy - (sy - y0))
            out += share * wide[np.clip(y0 + dy + 1, 0, h + 1), np.clip(x0 + dx + 1, 0, w + 1)]
    return out


def summed_steps(steps: DataFrame) -> DataFrame:
    """(frame, dy, dx) against frame 0 from moves of each frame against the one before.

    Sums of blocks of ``STEPS`` frames are summed first, so that no task takes all frames.
    """
    rows = steps.withColumn("block", F.floor(F.col("frame") / STEPS))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    blocks = rows.groupBy("block").agg(F.sum("dy").alias("y"), F.sum("dx").alias("x"))
    blocks = blocks.select("block", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("y", "x")])
    within = Window.partitionBy("block").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("frame", "block", *[F.sum(c).over(within).alias(c) for c in ("dy", "dx")])
    return rows.join(blocks, "block").select("frame", (F.col("dy") + F.col("y")).alias("dy"), (F.col("dx") + F.col("x")).alias("dx"))
