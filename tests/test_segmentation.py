"""Tiles, distances, flooding, shapes and the way from video to signals, against plain versions on whole images."""

import heapq
import itertools
import math
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluora.operators import contours, segmentation, tiles
from fluora.plans import modules
from fluora.plans.pipeline import Context, execute


def rows_of(spark, masks):
    """(image, pixel) of boolean arrays of one size."""
    rows = [(i, int(p)) for i, m in enumerate(masks) for p in np.flatnonzero(m)]
    return spark.createDataFrame(rows, "image int, pixel long").repartition(3)


def flood_fill(mask):
    """The least pixel of each 8-connected part."""
    h, w = mask.shape
    out = {}
    for p in np.flatnonzero(mask).tolist():
        if p in out:
            continue
        out[p], todo = p, deque([p])
        while todo:
            y, x = divmod(todo.popleft(), w)
            for yy, xx in itertools.product((y - 1, y, y + 1), (x - 1, x, x + 1)):
                if 0 <= yy < h and 0 <= xx < w and mask[yy, xx] and yy * w + xx not in out:
                    out[yy * w + xx] = p
                    todo.append(yy * w + xx)
    return out


def test_labels_across_tiles(spark):
    rng = np.random.default_rng(1)
    spiral = np.zeros((23, 31), bool)
    spiral[1::4, 1:-1] = spiral[3::4, 1:-1] = True
    spiral[2::8, -2] = spiral[4::8, 1] = spiral[6::8, -2] = True
    masks = [*(rng.random((23, 31)) < d for d in (0.25, 0.45, 0.6)), spiral, np.ones((23, 31), bool), np.zeros((23, 31), bool)]
    df = rows_of(spark, masks)
    want = {(i, p, b) for i, m in enumerate(masks) for p, b in flood_fill(m).items()}
    for side in (1, 4, 7, 256):
        got = [tuple(r) for r in tiles.labelled(df, 31, side).select("image", "pixel", "blob").collect()]
        assert len(got) == len(want) and set(got) == want
    assert tiles.labelled(df.limit(0), 31).count() == 0


def test_distances(spark, monkeypatch):
    monkeypatch.setattr(segmentation, "STRIP", 5)
    rng = np.random.default_rng(2)
    masks = [rng.random((14, 17)) < d for d in (0.5, 0.9, 0.98)] + [np.ones((14, 17), bool)]
    got = {(r.image, r.pixel): r.d2 for r in segmentation.distances(rows_of(spark, masks), 17, 14).collect()}
    for i, m in enumerate(masks):
        out = np.argwhere(~m)
        for y, x in np.argwhere(m).tolist():
            want = min(((out - [y, x]) ** 2).sum(1).tolist(), default=None)
            assert got.pop((i, y * 17 + x)) == want
    assert not got


def test_features_do_not_depend_on_tiles(spark):
    a = np.random.default_rng(3).integers(0, 256, (37, 45)).astype(float)
    df = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(a.ravel())], "image int, pixel long, v double")
    got = []
    for side in (20, 256):
        rows = sorted((r.pixel, r.features) for r in segmentation.features(df, 45, 37, side).collect())
        got.append(np.array([f for _, f in rows]))
    assert got[0].shape == (37 * 45, segmentation.FEATURES) and np.allclose(got[0], got[1], rtol=1e-6)
    wide = np.pad(a, 16, mode="reflect")  # the plain sums at one place near the corner
    y, x = 1, 2
    for s, c in ((1, 1), (2, 4), (4, 7)):
        taps = np.exp(-0.5 * (np.arange(-4 * s, 4 * s + 1) / s) ** 2)
        taps /= taps.sum()
        blur = lambda y, x, s=s, taps=taps: taps @ wide[y + 16 - 4 * s : y + 17 + 4 * s, x + 16 - 4 * s : x + 17 + 4 * s] @ taps
        near = {(dy, dx): blur(y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)}
        gx = sum((2 - abs(dy)) * (near[dy, 1] - near[dy, -1]) for dy in (-1, 0, 1))
        gy = sum((2 - abs(dx)) * (near[1, dx] - near[-1, dx]) for dx in (-1, 0, 1))
        laplace = 2 * sum(near[dy, dx] for dy in (-1, 1) for dx in (-1, 1)) - 8 * near[0, 0]
        assert np.allclose(got[1][y * 45 + x, c : c + 3], [near[0, 0], math.hypot(gx, gy), laplace], rtol=1e-5, atol=1e-4)


def flood_plainly(guide, labels):
    """Marker flooding of a whole image with one heap."""
    lab, heap, order = labels.copy(), [], itertools.count()
    near = lambda y, x: ((y, x - 1), (y, x + 1), (y - 1, x), (y + 1, x))
    lab[[0, -1]] = -1
    lab[:, [0, -1]] = -1
    start = lab.copy()
    for y, x in np.argwhere(start == 0).tolist():
        if d := [abs(int(guide[y, x]) - int(guide[n])) for n in near(y, x) if start[n] > 0]:
            heapq.heappush(heap, (min(d), next(order), y, x))
            lab[y, x] = -2
    while heap:
        _, _, y, x = heapq.heappop(heap)
        around = {lab[n] for n in near(y, x) if lab[n] > 0}
        lab[y, x] = around.pop() if len(around) == 1 else -1
        if lab[y, x] > 0:
            for n in near(y, x):
                if lab[n] == 0:
                    heapq.heappush(heap, (abs(int(guide[y, x]) - int(guide[n])), next(order), *n))
                    lab[n] = -2
    return lab


def test_touching_bodies_are_split(spark):
    h, w = 40, 60
    y, x = np.mgrid[:h, :w]
    discs = [(14, 15, 9), (14, 31, 9), (29, 49, 7), (5, 55, 8)]
    deep = np.max([np.clip(r - np.hypot(y - cy, x - cx), 0, None) / r for cy, cx, r in discs], 0)
    mask = deep > 0
    guide = (deep / deep.max() * 255 * 0.7 + np.random.default_rng(4).integers(0, 40, (h, w))).astype(int)
    masks = rows_of(spark, [mask])
    df = spark.createDataFrame([(0, i, int(v)) for i, v in enumerate(guide.ravel())], "image int, pixel long, u8 int")
    got = np.full((h, w), -1)
    for r in segmentation.split(masks, df, w, h, 5).collect():
        got.ravel()[r.pixel] = r.region
    d2 = np.zeros((h, w), int)
    for py, px in np.argwhere(mask):
        d2[py, px] = ((np.argwhere(~mask) - [py, px]) ** 2).sum(1).min()
    wide = np.pad(d2, 2)
    top = np.max([wide[a : a + h, b : b + w] for a in range(5) for b in range(5)], 0)
    seeds = flood_fill((d2 == top) & (d2 > 0))
    labels = np.where(mask, 0, 1)
    for p, s in seeds.items():
        labels.ravel()[p] = s + 2
    want = flood_plainly(guide, labels)
    assert (got == np.where(mask & (want > 1), want - 2, -1)).all()
    first, second = got[14, 15], got[14, 31]
    assert first != second and min(first, second) > 0


def test_boundaries_and_shapes():
    y, x = np.mgrid[:30, :30]
    disc = (y - 15) ** 2 + (x - 14) ** 2 <= 81
    edge = contours.boundary(disc[6:]) + [0, 6]
    outside = np.pad(~disc, 1, constant_values=True)
    want = {(px, py) for py, px in np.argwhere(disc) if outside[py : py + 3, px : px + 3][[0, 1, 1, 2], [1, 0, 2, 1]].any()}
    assert {tuple(p) for p in edge.astype(int).tolist()} == want
    assert abs(contours.area(edge)) == disc.sum() - len(edge) / 2 - 1 and contours.centre(edge) == pytest.approx((14, 15))
    assert contours.enclosing_circle(edge) == pytest.approx((14, 15, 9))
    line = np.array([[1, 1, 1, 0, 1]], bool)
    assert contours.boundary(line).tolist() == [[0, 0], [1, 0], [2, 0], [1, 0]] and contours.area(contours.boundary(line)) == 0
    assert contours.boundary(np.array([[1]])).tolist() == [[0, 0]]
    ring = np.ones((5, 5), bool)
    ring[2, 2] = False
    assert len(contours.boundary(ring)) == 16 and abs(contours.area(contours.boundary(ring))) == 16


def test_enclosing_circle_and_polygon():
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 5, 9, 14):
        for _ in range(20):
            p = rng.integers(0, 9, (n, 2)).astype(float)
            cx, cy, r = contours.enclosing_circle(p)
            assert (np.hypot(*(p - [cx, cy]).T) <= r + 1e-6).all()
            fits = [0.0] if len(np.unique(p, axis=0)) == 1 else []
            for on in itertools.chain(itertools.combinations(np.unique(p, axis=0), 2), itertools.combinations(np.unique(p, axis=0), 3)):
                c = contours._circle(*on)
                if c and (np.hypot(*(p - c[0]).T) <= c[1] + 1e-6).all():
                    fits.append(c[1])
            assert r == pytest.approx(min(fits), abs=1e-6)
    blob = contours.boundary(np.hypot(*(np.mgrid[:41, :61] - np.array([20, 30])[:, None, None]) / np.array([19, 29])[:, None, None]) <= 1)
    for tolerance in (0.5, 1.0, 3.0):
        kept = contours.simplified(blob, tolerance)
        at = [int(np.flatnonzero((blob == k).all(1))[0]) for k in kept]
        assert len(kept) < len(blob) and sorted(np.diff(at) < 0).count(True) <= 1  # in order around
        for a, b in zip(at, at[1:] + at[:1], strict=True):
            own, line = blob[np.arange(a, a + (b - a) % len(blob)) % len(blob)], blob[b] - blob[a]
            far = np.abs(line[0] * (own - blob[a])[:, 1] - line[1] * (own - blob[a])[:, 0]) / np.hypot(*line)
            assert far.max() <= tolerance + 1e-9


def test_from_video_to_signals(spark):
    h = w = 48
    y, x = np.mgrid[:h, :w]
    rng = np.random.default_rng(6)
    places = [(10, 11), (11, 34), (33, 12), (35, 34)]
    soft = [np.clip(1.6 - np.hypot(y - cy, x - cx) / 5, 0, 1) for cy, cx in places]
    active = rng.random((30, 4)) < 0.4
    frames = [10 + rng.random((h, w)) + sum(60 * soft[k] * active[t, k] for k in range(4)) for t in range(30)]
    video = spark.createDataFrame([(t, f.ravel().tolist()) for t, f in enumerate(frames)], "frame long, px array<double>").repartition(3)
    inner = [(p,) for p in np.flatnonzero((np.hypot(y - 10, x - 11) < 4) | (np.hypot(y - 11, x - 34) < 4)).tolist()]
    outer = [(p,) for p in np.flatnonzero((np.abs(y - 23) < 4) | (x > 44)).tolist()]
    inner, outer = (spark.createDataFrame(m, "pixel long") for m in (inner, outer))
    given = {"generate_rois": {"frames": video, "width": w, "height": h, "inner": inner, "outer": outer}, "generate_signals": {"frames": video}}
    ctx, log = Context(), []
    assert execute(["generate_rois", "generate_signals"], modules.registry(), given, ctx, log=log.append), log
    found = ctx.get("generate_rois.bodies").orderBy("roi_id").collect()
    assert len(found) == 4 and all(abs(r.y - a) < 2 and abs(r.x - b) < 2 for r, (a, b) in zip(found, places, strict=True))  # reading order
    # bodies whose pixels the forest has not seen
    likely = {r.pixel: r.v for r in ctx.get("generate_rois.probability").collect()}
    truth = [(np.hypot(y - cy, x - cx) < 4).ravel() for cy, cx in places[2:]]
    far = (np.min([np.hypot(y - cy, x - cx) for cy, cx in places], 0) > 12).ravel()
    right = [likely[p] >= 0.5 for p in np.flatnonzero(truth[0] | truth[1])] + [likely[p] < 0.5 for p in np.flatnonzero(far)]
    assert np.mean(right) > 0.97
    traces = ctx.get("generate_signals.traces").where("trace like '%mean'").collect()
    for k in range(4):
        own = {r.frame: r.y for r in traces if r.trace == f"{k + 1}_mean"}
        on, off = [own[t] for t in range(30) if active[t, k]], [own[t] for t in range(30) if not active[t, k]]
        assert min(on) > max(off) + 10
    for shape, kind in (("rectangular", "rect"), ("polygonal", "polygon")):
        out = modules.generate_rois({"probability": ctx.get("generate_rois.probability"), "width": w, "height": h, "shape": shape, "separate": shape == "polygonal"})
        assert {r.kind for r in out["rois"].collect()} == {kind} and out["masks"].select("roi_id").distinct().count() == 4
    with pytest.raises(ValueError, match="inner"):
        modules.generate_rois({**given["generate_rois"], "inner": inner.limit(0)})
    with pytest.raises(ValueError, match="no cell bodies"):
        modules.generate_rois({"probability": ctx.get("generate_rois.probability").withColumn("v", F.lit(0.1)), "width": w, "height": h})


def test_samples_are_capped_and_seeded(spark):
    pixels = spark.range(500).select(F.lit(0).alias("image"), F.col("id").alias("pixel"), F.array(F.col("id").cast("float")).alias("features"))
    masks = pixels.select("image", "pixel")
    rows = [sorted(tuple(r) for r in segmentation.samples(p, masks.where("pixel < 300"), masks.where("pixel >= 200"), 50, 7).selectExpr("label", "features[0]").collect()) for p in (pixels, pixels.repartition(7))]
    assert rows[0] == rows[1] and [sum(r[0] == c for r in rows[0]) for c in (0.0, 1.0)] == [50, 50]
    assert all((v < 300) == (label == 1.0) for label, v in rows[0])

def test_groups_over_batches(spark):
    """Many groups share a batch, and a group may go over several; nothing is made of some."""
    from fluora.operators.tiles import by_group

    sizes = [1, 7, 2, 3, 1, 1, 12, 4]
    rows = [(f"g{k}", k % 2, v) for k, n in enumerate(sizes) for v in range(n)]
    df = spark.createDataFrame(rows, "image string, part int, v long")
    seen = lambda c: {"image": c["image"][:1], "n": np.array([len(c["v"])]), "half": np.array([np.nan if len(c["v"]) == 7 else c["v"].sum()]), "all": [c["v"].tolist()]} if len(c["v"]) != 2 else None
    for size in ("3", "1", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            got = {r.image: (r.n, r.half, sorted(r.all)) for r in by_group(df, ["image", "part"], seen, "image string, n long, half long, all array<long>").collect()}
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert got == {f"g{k}": (n, None if n == 7 else n * (n - 1) // 2, list(range(n))) for k, n in enumerate(sizes) if n != 2}
