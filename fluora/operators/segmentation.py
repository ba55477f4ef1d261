"""Cell bodies from images: pixel features, a forest on painted examples, splitting of touching bodies, fitted shapes.

Images are rows (image, pixel, v), masks (image, pixel); pixel is y * width + x. Work on neighbourhoods goes by tiles,
distances by strips of columns and then of rows, flooding and shapes by region.
"""

from __future__ import annotations

from collections import deque

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluora.functions.shared import cut
from fluora.operators import contours, imaging
from fluora.operators.tiles import Columns, by_group, by_tile, labelled

#: Scales of the features, and how far around a pixel the largest reaches.
SCALES, REACH = (1, 2, 4), 17
FEATURES = 2 + 3 * len(SCALES)
#: Training pixels of a class at most; all are counted, a seeded share beyond this many is trained on.
MOST_SAMPLES = 10_000
#: Columns or rows that are worked on together.
STRIP = 64


def _along(a: np.ndarray, taps: np.ndarray, axis: int) -> np.ndarray:
    """The correlation along an axis, where the taps fit."""
    n = a.shape[axis] - len(taps) + 1
    return sum(t * a[(slice(None),) * axis + (slice(k, k + n),)] for k, t in enumerate(taps))


def _stack(window: np.ndarray) -> np.ndarray:
    """Features of the pixels at least ``REACH`` away from the edges of a window."""
    inner = lambda a, n: a[n : a.shape[0] - n, n : a.shape[1] - n]
    out, soft = [inner(window, REACH)], []
    for s in SCALES:
        taps = np.exp(-0.5 * (np.arange(-4 * s, 4 * s + 1) / s) ** 2)
        a = inner(window, REACH - 1 - 4 * s)
        for axis in (0, 1):
            a = _along(a, taps / taps.sum(), axis)
        smooth, slope = np.array([1.0, 2, 1]), np.array([-1.0, 0, 1])
        gx, gy = _along(_along(a, smooth, 0), slope, 1), _along(_along(a, slope, 0), smooth, 1)
        corners = a[:-2, :-2] + a[:-2, 2:] + a[2:, :-2] + a[2:, 2:]
        soft.append(inner(a, 1))
        out += [soft[-1], np.hypot(gx, gy), 2 * corners - 8 * soft[-1]]
    return np.stack([*out, soft[0] - soft[1]], -1).astype(np.float32)


def features(image: DataFrame, width: int, height: int, side: int = 256) -> DataFrame:
    """(image, pixel, features): the value; at three scales its blur, gradient and Laplacian; the difference of two blurs.

    Images are mirrored at their outermost pixels.
    """
    return by_tile(image, width, height, lambda window: {"features": _stack(window)}, "features array<float>", REACH, None, side)


def samples(pixels: DataFrame, inner: DataFrame, outer: DataFrame, most: int = MOST_SAMPLES, seed: int = 0) -> DataFrame:
    """(label, features) of pixels (image, pixel, features) in masks of both classes, inner ones counting where both do.

    Of a class with more than ``most`` pixels those with the smallest seeded hashes are taken.
    """
    key = ["image", "pixel"]
    inner, outer = inner.select(*key).distinct(), outer.select(*key).distinct()
    out = []
    for label, masks, what in ((1.0, inner, "inner"), (0.0, outer.join(inner, key, "left_anti"), "outer")):
        own = pixels.join(masks, key)
        if own.isEmpty():
            raise ValueError(f"the {what} regions have no pixels")
        taken = own.orderBy(F.xxhash64(F.lit(seed), *key), *key).limit(most)
        out.append(taken.select(F.lit(label).alias("label"), "features"))
    return out[0].unionByName(out[1])


def forest(rows: DataFrame, seed: int = 0):
    """A forest of 40 trees of depth 10 of samples (label, features)."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    rows = rows.select("label", array_to_vector("features").alias("features"))
    n = max(1, round(FEATURES**0.5))
    return RandomForestClassifier(numTrees=40, maxDepth=10, minInstancesPerNode=2, maxBins=256, featureSubsetStrategy=str(n), seed=seed).fit(rows)


def probability(model, pixels: DataFrame) -> DataFrame:
    """(image, pixel, v): the forest's probability of the inner class for pixels (image, pixel, features)."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    out = model.transform(pixels.select("image", "pixel", array_to_vector("features").alias("features")))
    return out.select("image", "pixel", vector_to_array("probability")[1].alias("v"))


def _strips(rows: DataFrame, keep: str) -> DataFrame:
    return rows.withColumn("strip", F.floor(F.col(keep) / STRIP))


def distances(masks: DataFrame, width: int, height: int) -> DataFrame:
    """(image, pixel, d2): the exact squared distance of masks' pixels to the nearest place of the image outside the mask.

    Null where an image has no such place. The first pass goes down and up columns, the second along rows.
    """
    kind = masks.schema["image"].dataType.simpleString()

    def columns(rows: Columns) -> dict:
        y, x = np.divmod(rows["pixel"].astype(np.int64), width)
        left = int(rows["strip"][0]) * STRIP
        far = np.zeros((height, STRIP))
        far[y, x - left] = np.inf
        for way in (range(1, height), range(height - 2, -1, -1)):
            for i in way:
                far[i] = np.minimum(far[i], far[i - 1 if way.step > 0 else i + 1] + 1)
        g = far[y, x - left]
        return {"image": rows["image"], "pixel": rows["pixel"], "g": np.where(np.isfinite(g), g, -1).astype(np.int64)}

    def along(rows: Columns) -> dict:
        y, x = np.divmod(rows["pixel"].astype(np.int64), width)
        top = int(rows["strip"][0]) * STRIP
        f = np.zeros((STRIP, width))
        g = rows["g"].astype(float)
        f[y - top, x] = np.where(g < 0, np.inf, g * g)
        best = f.copy()
        for k in range(1, width):
            if k * k >= best.max():
                break
            best[:, k:] = np.minimum(best[:, k:], f[:, :-k] + k * k)
            best[:, :-k] = np.minimum(best[:, :-k], f[:, k:] + k * k)
        d2 = best[y - top, x]
        return {"image": rows["image"], "pixel": rows["pixel"], "d2": np.where(np.isfinite(d2), d2, np.nan)}

    rows = masks.select("image", F.col("pixel").cast("long").alias("pixel")).distinct()
    down = by_group(_strips(rows.withColumn("x", F.col("pixel") % width), "x"), ["image", "strip"], columns, f"image {kind}, pixel long, g long")
    return by_group(_strips(down.withColumn("y", F.expr(f"pixel div {width}")), "y"), ["image", "strip"], along, f"image {kind}, pixel long, d2 long")


def peaks(far: DataFrame, width: int, height: int, radius: int, side: int = 256) -> DataFrame:
    """(image, pixel) of distances (image, pixel, d2) that no other in the square of this radius exceeds."""

    def work(window: np.ndarray) -> dict[str, np.ndarray]:
        most = window
        for axis in (0, 1):
            n = most.shape[axis] - 2 * radius
            most = np.maximum.reduce([most[(slice(None),) * axis + (slice(k, k + n),)] for k in range(2 * radius + 1)])
        own = window[radius : window.shape[0] - radius, radius : window.shape[1] - radius]
        return {"peak": (own == most) & (own > 0)}

    rows = far.select("image", "pixel", F.coalesce(F.col("d2").cast("double"), F.lit(float("inf"))).alias("v"))
    return by_tile(rows, width, height, work, "peak boolean", radius, 0.0, side).where("peak").select("image", "pixel")


def flooded(guide: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Labels after marker-based flooding: 0 is free, above 0 are markers, below 0 are borders.

    Free places next to markers wait in queues by the difference of the guide to the nearest-valued such neighbour. The
    first place of the lowest queue takes the label around it, or becomes a border between two; then its free neighbours queue.
    """
    h, w = labels.shape
    lab, g = labels.ravel().tolist(), guide.astype(int).ravel().tolist()
    queues = [deque() for _ in range(256)]
    near = (-1, 1, -w, w)
    for p in np.flatnonzero(labels == 0).tolist():
        if met := [abs(g[p] - g[p + s]) for s in near if lab[p + s] > 0]:
            queues[min(met)].append(p)
    waits = [p for q in queues for p in q]
    for p in waits:
        lab[p] = -2
    level = 0
    while level < 256:
        if not queues[level]:
            level += 1
            continue
        p = queues[level].popleft()
        around = {lab[p + s] for s in near if lab[p + s] > 0}
        lab[p] = around.pop() if len(around) == 1 else -1
        if lab[p] > 0:
            for s in near:
                if lab[p + s] == 0:
                    t = abs(g[p] - g[p + s])
                    queues[t].append(p + s)
                    lab[p + s] = -2
                    level = min(level, t)
    return np.array(lab).reshape(h, w)


def split(masks: DataFrame, guide: DataFrame, width: int, height: int, least: int) -> DataFrame:
    """(image, region, pixel): masks split at the necks between bodies; region is the least pixel of a body's middle.

    Middles are the peaks of the distance to the outside, in squares of half the least diameter around. From them, and from
    outside, the guide (image, pixel, u8) is flooded, each connected part of a mask by itself. The outermost pixels of an
    image belong to no body.
    """
    kind = masks.schema["image"].dataType.simpleString()
    parts = cut(labelled(masks, width))
    middles = labelled(peaks(distances(parts, width, height), width, height, max(1, least // 2)), width).withColumnRenamed("blob", "seed")
    inside = parts.join(middles, ["image", "pixel"], "left").select("image", "blob", "pixel", F.coalesce("seed", F.lit(-1)).alias("seed"))
    x, near = F.col("pixel") % width, F.array(*[F.col("pixel") + s for s in (-1, 1, -width, width)])
    ring = parts.select("image", "blob", x.alias("x"), F.explode(near).alias("pixel"))
    ring = ring.where(f"pixel between 0 and {width * height - 1} and abs(pixel % {width} - x) <= 1").select("image", "blob", "pixel").distinct()
    ring = ring.join(parts.select("image", "pixel"), ["image", "pixel"], "left_anti").withColumn("seed", F.lit(-2).cast("long"))
    rows = inside.unionByName(ring.select(*inside.columns)).join(guide.select("image", "pixel", "u8"), ["image", "pixel"], "left")

    def run(rows: Columns) -> dict:
        y, x = np.divmod(rows["pixel"].astype(np.int64), width)
        seed = rows["seed"].astype(np.int64)
        top, left = y.min() - 1, x.min() - 1
        labels, g = np.full((y.max() - top + 2, x.max() - left + 2), -1, np.int64), np.zeros((y.max() - top + 2, x.max() - left + 2), np.int64)
        g[y - top, x - left] = np.nan_to_num(rows["u8"].astype(float)).astype(np.int64)
        edge = (y == 0) | (x == 0) | (y == height - 1) | (x == width - 1)
        labels[y - top, x - left] = np.where(edge, -1, np.where(seed == -2, 1, np.where(seed == -1, 0, seed + 2)))
        out = flooded(g, labels)[y - top, x - left]
        own = (out > 1) & (seed != -2)
        return {"image": rows["image"][own], "region": out[own] - 2, "pixel": rows["pixel"][own]}

    return by_group(rows, ["image", "blob"], run, f"image {kind}, region long, pixel long")


#: What ``shapes`` gives besides the image.
SHAPE = "region long, kind string, xs array<double>, ys array<double>, left double, top double, width double, height double, x double, y double, area double, perimeter double"


def shape(points: np.ndarray, kind: str) -> dict:
    """A boundary as a circle, a box or a simplified polygon, with its middle."""
    low, size = points.min(0), np.ptp(points, axis=0) + 1
    if kind == "circular":
        x, y, r = contours.enclosing_circle(points)
        return {"kind": "oval", "xs": [], "ys": [], "left": x - r, "top": y - r, "width": 2 * r, "height": 2 * r, "x": x, "y": y}
    box = {"left": low[0], "top": low[1], "width": size[0], "height": size[1]}
    if kind == "rectangular":
        return {"kind": "rect", "xs": [], "ys": [], **box, "x": low[0] + size[0] / 2, "y": low[1] + size[1] / 2}
    corners = contours.simplified(points, max(1.0, 0.01 * contours.perimeter(points)))
    if len(corners) < 3:
        corners = low + size * np.array([[0, 0], [1, 0], [1, 1], [0, 1]])
    x, y = contours.centre(points)
    return {"kind": "polygon", "xs": corners[:, 0].tolist(), "ys": corners[:, 1].tolist(), **box, "x": x, "y": y}


def shapes(regions: DataFrame, width: int, kind: str = "circular", least: float = 5, most: float = 40, round_: float = 0.5) -> DataFrame:
    """(image, *SHAPE) of regions (image, region, pixel) whose boundary has a fitting diameter and circularity.

    The diameter is that of a circle of the boundary's area, the circularity 4 pi area / perimeter^2; regions without area go.
    """
    if kind not in ("circular", "rectangular", "polygonal"):
        raise ValueError(f"no such shape: {kind}")
    image = regions.schema["image"].dataType.simpleString()

    def run(rows: Columns) -> dict | None:
        y, x = np.divmod(rows["pixel"].astype(np.int64), width)
        inside = np.zeros((np.ptp(y) + 1, np.ptp(x) + 1), bool)
        inside[y - y.min(), x - x.min()] = True
        points = contours.boundary(inside) + [x.min(), y.min()]
        size, around = abs(contours.area(points)), contours.perimeter(points)
        diameter = 2 * np.sqrt(size / np.pi)
        if not size or not least <= diameter <= most or 4 * np.pi * size / around**2 < round_:
            return None
        found = {"image": rows["image"][0], "region": rows["region"][0], **shape(points, kind), "area": size, "perimeter": around}
        return {name: [value] for name, value in found.items()}

    return by_group(regions, ["image", "region"], run, f"image {image}, {SHAPE}")


def bodies(image: DataFrame, width: int, height: int, threshold: float = 0.5, least: int = 5, most: int = 40, round_: float = 0.5, separate: bool = True, kind: str = "circular") -> DataFrame:
    """(image, *SHAPE) of cell bodies in a probability image (image, pixel, v): at the threshold or above, opened, split, fitted."""
    masks = cut(imaging.opened(image.where(F.col("v") >= threshold).select("image", F.col("pixel").cast("long").alias("pixel")), width, height))
    if separate:
        regions = split(masks, scaled(image), width, height, least)
    else:
        regions = labelled(masks, width).select("image", F.col("blob").alias("region"), "pixel")
    return shapes(regions, width, kind, least, most, round_)


def scaled(image: DataFrame) -> DataFrame:
    """(image, pixel, u8): each image scaled from its range to 0..255 and cut to integers; 0 for a flat one."""
    span = image.groupBy("image").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    share = F.when(F.col("hi") > F.col("lo"), (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 255).otherwise(0.0)
    return image.join(span, "image").select("image", "pixel", F.floor(share).cast("int").alias("u8"))


def numbered(found: DataFrame) -> DataFrame:
    """Shapes with roi_id from 1 in the order of their middles, and whole coordinates as region files hold them."""
    places = imaging.reading_order(found.select(F.struct("image", "region").alias("roi_id"), "x", "y")).select(F.col("roi_id.image").alias("image"), F.col("roi_id.region").alias("region"), F.col("ord").alias("roi_id"))
    whole = [F.bround(c).alias(c) for c in ("left", "top")]
    far = [(F.bround(F.col(a) + F.col(b)) - F.bround(a)).alias(b) for a, b in (("left", "width"), ("top", "height"))]
    rows = found.join(places, ["image", "region"])
    return rows.select("image", "roi_id", "region", F.format_string("%04d", "roi_id").alias("name"), "kind", *[F.transform(c, lambda v: F.bround(v)).alias(c) for c in ("xs", "ys")], *whole, *far, "x", "y", "area", "perimeter")
