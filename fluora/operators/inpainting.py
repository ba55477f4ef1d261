"""Filling of holes in frames from their surroundings, by fast marching.

A hole's pixels are filled in the order of their distance to its edge, each by a weighted mean of the known pixels around
it, carried on along their slopes. Holes are keys: those that are close enough to see each other are filled together.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluora.operators import imaging
from fluora.operators.tiles import labelled

#: How far around a pixel known ones count, in pixels.
RADIUS = 3
FAR = 1e6


def _time(t: np.ndarray, known: np.ndarray, y: int, x: int) -> float:
    """The arrival time of the front at a pixel from its neighbours that have one: |grad T| = 1, upwind."""
    out = FAR
    for dy in (-1, 1):
        for dx in (-1, 1):
            a = t[y + dy, x] if known[y + dy, x] else FAR
            b = t[y, x + dx] if known[y, x + dx] else FAR
            if a < FAR and b < FAR and abs(a - b) < 1:
                out = min(out, (a + b + np.sqrt(2 - (a - b) ** 2)) / 2)
            out = min(out, 1 + min(a, b))
    return out


def _slope(v: np.ndarray, known: np.ndarray, y: int, x: int) -> tuple[float, float]:
    """The slope (y, x) at a pixel from the neighbours that are known: central, one-sided, or zero."""
    out = []
    for dy, dx in ((1, 0), (0, 1)):
        after, before = known[y + dy, x + dx], known[y - dy, x - dx]
        if after and before:
            out.append((v[y + dy, x + dx] - v[y - dy, x - dx]) / 2)
        elif after:
            out.append(v[y + dy, x + dx] - v[y, x])
        elif before:
            out.append(v[y, x] - v[y - dy, x - dx])
        else:
            out.append(0.0)
    return tuple(out)


def _outside(edge: np.ndarray, hole: np.ndarray, radius: int) -> np.ndarray:
    """Arrival times of a front that runs from the hole's edge away from the hole, to twice the radius."""
    t, done, heap = np.where(edge, 0.0, FAR), edge.copy(), []
    h, w = hole.shape

    def reach(y: int, x: int) -> None:
        for yy, xx in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
            if 1 <= yy < h - 1 and 1 <= xx < w - 1 and not done[yy, xx] and not hole[yy, xx] and (new := _time(t, done, yy, xx)) < t[yy, xx]:
                t[yy, xx] = new
                heapq.heappush(heap, (new, yy, xx))

    for y, x in np.argwhere(edge).tolist():
        reach(y, x)
    while heap:
        at, y, x = heapq.heappop(heap)
        if not done[y, x] and at <= 2 * radius:
            done[y, x] = True
            reach(y, x)
    return np.where(done, t, 2 * radius)


def filled(image: np.ndarray, hole: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """The image with the hole filled; what nothing is known around becomes NaN."""
    h, w = image.shape
    margin = radius + 2
    inside = np.pad(hole, margin)
    v = np.pad(np.where(hole, np.nan, image), margin, constant_values=np.nan)
    known = ~np.isnan(v)
    edge = known & np.logical_or.reduce([np.roll(inside, way, axis) for axis in (0, 1) for way in (-1, 1)])
    t = np.where(known, -_outside(edge, inside, radius), FAR)
    near = [(dy, dx) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1) if 0 < dy * dy + dx * dx <= radius * radius]
    heap = [(0.0, y, x) for y, x in np.argwhere(edge).tolist()]
    while heap:
        _, y, x = heapq.heappop(heap)
        for py, px in ((y - 1, x), (y, x - 1), (y + 1, x), (y, x + 1)):
            if not inside[py, px] or known[py, px]:
                continue
            t[py, px] = _time(t, known, py, px)
            ty, tx = _slope(t, known, py, px)
            weights = values = 0.0
            for dy, dx in near:
                qy, qx = py + dy, px + dx
                if known[qy, qx]:
                    far = dy * dy + dx * dx
                    along = abs(dy * ty + dx * tx) / np.sqrt(far)
                    weight = max(along, 1e-6) / far / (1 + abs(t[qy, qx] - t[py, px]))
                    sy, sx = _slope(v, known, qy, qx)
                    values += weight * (v[qy, qx] - dy * sy - dx * sx)
                    weights += weight
            v[py, px], known[py, px] = values / weights, True
            heapq.heappush(heap, (t[py, px], py, px))
    return v[margin : margin + h, margin : margin + w]


def holes(masks: DataFrame, width: int, height: int, radius: int = RADIUS) -> DataFrame:
    """(image, pixel, hole): masks (image, pixel) with a number for pixels whose surroundings overlap."""
    rows = masks.select("image", F.col("pixel").cast("long").alias("pixel")).distinct()
    wide = rows
    for _ in range(radius):
        wide = imaging.neighbours_in(wide, width, height, cross=False).where("near is not null").select("image", F.col("near").alias("pixel")).distinct()
    return labelled(wide, width).join(rows, ["image", "pixel"], "left_semi").select("image", "pixel", F.col("blob").alias("hole"))


def patches(frames: DataFrame, masks: DataFrame, width: int, height: int, radius: int = RADIUS) -> DataFrame:
    """(frame, pixel, v): new values of the masked pixels (image, pixel) of frames (frame, px); null where nothing is known around."""
    margin = radius + 2
    x, y = F.col("pixel") % width, F.expr(f"pixel div {width}")
    box = holes(masks, width, height, radius).groupBy(F.col("image").alias("frame"), "hole").agg(F.collect_list("pixel").alias("at"), F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    low, high = (lambda c: F.greatest(F.col(c) - margin, F.lit(0))), (lambda c, most: F.least(F.col(c) + margin, F.lit(most - 1)))
    box = box.select("frame", "at", low("x0").alias("x0"), high("x1", width).alias("x1"), low("y0").alias("y0"), high("y1", height).alias("y1"))
    rows = F.transform(F.sequence("y0", "y1"), lambda r: F.slice("px", (r * width + F.col("x0") + 1).cast("int"), (F.col("x1") - F.col("x0") + 1).cast("int")))
    cut_out = frames.select("frame", "px").join(box, "frame").select("frame", "at", "x0", "y0", rows.alias("window"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for r in part.itertuples(index=False):
                image, at = np.array([list(w) for w in r.window], float), np.asarray(r.at)
                hole = np.zeros(image.shape, bool)
                hole[at // width - r.y0, at % width - r.x0] = True
                new = filled(image, hole, radius)[at // width - r.y0, at % width - r.x0]
                yield pd.DataFrame({"frame": r.frame, "pixel": at, "v": [None if np.isnan(a) else float(a) for a in new]})

    kind = frames.schema["frame"].dataType.simpleString()
    return cut_out.mapInPandas(run, f"frame {kind}, pixel long, v double")


def patched(frames: DataFrame, new: DataFrame) -> DataFrame:
    """(frame, px): frames (frame, px) with the values of (frame, pixel, v); null values leave a pixel as it is."""
    listed = new.where("v is not null").groupBy("frame").agg(F.collect_list(F.struct("pixel", "v")).alias("new"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for px, put in zip(part.px, part.new, strict=True):
                px = np.array(px, float)
                for p in put if put is not None else ():
                    px[p["pixel"]] = p["v"]
                out.append(px)
            yield pd.DataFrame({"frame": part.frame, "px": out})

    kind = frames.schema["frame"].dataType.simpleString()
    return frames.select("frame", "px").join(listed, "frame", "left").mapInPandas(run, f"frame {kind}, px array<double>")


def inpainted(frames: DataFrame, masks: DataFrame, width: int, height: int, radius: int = RADIUS) -> DataFrame:
    """(frame, px): frames (frame, px) with masked pixels (image, pixel) filled from around them."""
    return patched(frames, patches(frames, masks, width, height, radius))
