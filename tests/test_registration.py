"""Registration of known movements, composition of steps, and filling of holes."""

import numpy as np
import pytest

from fluora.operators import inpainting, registration
from fluora.plans import modules


def scene(h=64, w=72, seed=0, m=registration.IDENTITY):
    """A field of soft spots, all over and beyond the image, as it lies after its places were mapped by m."""
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[:h, :w]
    back = registration.inverted(m)
    x, y = (r[0] * x + r[1] * y + r[2] for r in back)
    spots = zip(rng.uniform(1, 3, 120), rng.uniform(-h / 2, 1.5 * h, 120), rng.uniform(-w / 2, 1.5 * w, 120), rng.uniform(6, 60, 120), strict=True)
    return sum(a * np.exp(-((y - cy) ** 2 + (x - cx) ** 2) / s) for a, cy, cx, s in spots)


def turned(degrees, dx, dy, h=64, w=72):
    """The map of places that turns around the middle and moves."""
    a, cx, cy = np.radians(degrees), w / 2, h / 2
    c, s = np.cos(a), np.sin(a)
    return np.array([[c, -s, cx - c * cx + s * cy + dx], [s, c, cy - s * cx - c * cy + dy]])


@pytest.mark.parametrize("degrees,dx,dy", [(2.0, 1.5, -0.7), (-3.1, 0.2, 2.0), (0.0, 0.0, 0.0)])
def test_ecc_finds_rotations(degrees, dx, dy):
    a, m = scene(), turned(degrees, dx, dy)
    b = scene(m=m)  # b's places are m of a's
    for rigid in (True, False):
        found = registration.ecc(a, b, rigid)
        angle = np.degrees(np.arctan2(found[1, 0] - found[0, 1], found[0, 0] + found[1, 1]))
        assert abs(angle - degrees) < 0.1 and np.abs(found @ [36, 32, 1] - m @ [36, 32, 1]).max() < 0.1
    assert registration.ecc(a, np.ones_like(a), True) is None
    assert (registration.transform(a, np.ones_like(a), "affine") == registration.IDENTITY).all()


def test_affine_is_found():
    a, m = scene(seed=2), np.array([[1.02, 0.015, -1.0], [-0.01, 0.985, 0.8]])
    found = registration.ecc(a, scene(seed=2, m=m), False)
    assert np.abs(found[:, :2] - m[:, :2]).max() < 2e-3 and np.abs(found[:, 2] - m[:, 2]).max() < 0.1


def field(dx, dy, h=64, w=72):
    """A view of rough ground that is moved by whole or half pixels."""
    big = np.random.default_rng(3).random((h + 40, w + 40))
    big = big + np.roll(big, 1, 0) + np.roll(big, 1, 1) + np.roll(big, (1, 1), (0, 1))
    view = lambda x, y: big[20 - y : 20 - y + h, 20 - x : 20 - x + w]
    x, y = int(np.floor(dx)), int(np.floor(dy))
    return (view(x, y) + view(x + (dx > x), y + (dy > y))) / 2


def test_shift_in_parts_of_pixels():
    for dx, dy in ((3, -2), (0, 0), (-9, 7), (1.5, 0.5), (-4.5, 2.5)):
        got = registration.shift(field(0, 0), field(dx, dy))
        assert np.abs(np.subtract(got, (dx, dy))).max() < (0.35 if dx % 1 else 0.2)


def test_composed_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(registration, "STEPS", 4)
    rng = np.random.default_rng(4)
    steps = [np.column_stack([np.eye(2) + rng.normal(0, 0.05, (2, 2)), rng.normal(0, 1, 2)]) for _ in range(19)]
    rows = spark.createDataFrame([(i, m.ravel().tolist()) for i, m in enumerate(steps)], "frame long, m array<double>").repartition(3)
    got = {r.frame: np.reshape(r.m, (2, 3)) for r in registration.composed(rows).collect()}
    now = np.eye(3)
    for i, m in enumerate(steps):
        now = now @ np.vstack([m, [0, 0, 1]])
        assert np.allclose(got.pop(i), now[:2])
    assert not got


@pytest.mark.parametrize("kind", registration.KINDS)
def test_videos_with_gaps_in_their_numbers(spark, kind, monkeypatch):
    monkeypatch.setattr(registration, "STEPS", 3)
    a, numbers = scene(seed=5), [3, 4, 9, 11, 30]
    path = [turned(0 if kind == "translation" else k * 0.8, k * 1.0, -k * 1.0) for k in range(5)]
    frames = [scene(seed=5, m=m) for m in path]
    if kind == "translation":
        a, frames = field(0, 0), [field(*m[:, 2].astype(int)) for m in path]
    video = spark.createDataFrame([(n, f.ravel().tolist()) for n, f in zip(numbers, frames, strict=True)], "frame long, px array<double>").repartition(2)
    for reference in registration.REFERENCES if kind != "affine" else ["previous"]:
        out = modules.stackreg({"frames": video, "height": 64, "width": 72, "transformation": kind, "reference": reference})
        found = {r.frame: np.reshape(r.m, (2, 3)) for r in out["transforms"].collect()}
        assert (found[3] == registration.IDENTITY).all() and len(found) == 5
        if reference == "mean":
            continue  # the mean of moved frames has no place of its own
        for n, m in zip(numbers, path, strict=True):
            assert np.abs(found[n] @ [*(m @ [36, 32, 1]), 1] - [36, 32]).max() < 0.3
        back = np.reshape(out["frames"].where("frame = 30").first().px, (64, 72))
        assert np.abs(back - a)[16:48, 16:56].mean() < (0.2 if kind == "translation" else 0.06) * a.std()
    with pytest.raises(ValueError, match="no such"):
        registration.transforms(video, 64, 72, "similarity")


def test_holes_are_filled_from_around():
    y, x = np.mgrid[:16, :18].astype(float)
    hole = np.zeros((16, 18), bool)
    hole[4:9, 5:11] = hole[12, 3] = True
    ramp = 3 * x - 2 * y + 7
    assert np.allclose(inpainting.filled(np.where(hole, -99, ramp), hole), ramp)  # slopes are carried on exactly
    assert np.isnan(inpainting.filled(ramp, np.ones_like(hole))).all()
    rough = np.random.default_rng(6).random((16, 18))
    new = inpainting.filled(rough, hole)
    assert (new[~hole] == rough[~hole]).all() and np.isfinite(new).all()
    # one pixel: all distances around are alike on opposite sides, so only the weights of places are left
    one = np.zeros((9, 9), bool)
    one[4, 4] = True
    image = np.random.default_rng(7).random((9, 9))
    t = np.full((9, 9), np.inf)
    for (yy, xx), v in {(3, 4): 0, (5, 4): 0, (4, 3): 0, (4, 5): 0}.items():
        t[yy, xx] = v
    order = inpainting._outside(t == 0, one, 3)
    total = weights = 0.0
    for qy in range(1, 8):
        for qx in range(1, 8):
            far = (qy - 4) ** 2 + (qx - 4) ** 2
            if not 0 < far <= 9:
                continue
            slope = []
            for dy, dx in ((1, 0), (0, 1)):
                after, before = (qy + dy, qx + dx), (qy - dy, qx - dx)
                if one[after]:
                    slope.append(image[qy, qx] - image[before])
                elif one[before]:
                    slope.append(image[after] - image[qy, qx])
                else:
                    slope.append((image[after] - image[before]) / 2)
            weight = 1 / far / (1 + abs(-order[qy, qx] - np.sqrt(0.5)))
            total += weight * (image[qy, qx] + slope[0] * (4 - qy) + slope[1] * (4 - qx))
            weights += weight
    assert inpainting.filled(image, one)[4, 4] == pytest.approx(total / weights)


def test_holes_are_keys(spark):
    rng = np.random.default_rng(8)
    h, w = 30, 40
    images = [rng.random((h, w)) for _ in range(4)]
    masks = [rng.random((h, w)) < d for d in (0.01, 0.05)] + [np.zeros((h, w), bool), np.ones((h, w), bool)]
    masks[1][:6, :5] = masks[0][20:26, 30:] = True
    frames = spark.createDataFrame([(i, v.ravel().tolist()) for i, v in enumerate(images)], "frame long, px array<double>").repartition(2)
    rows = spark.createDataFrame([(i, int(p)) for i, m in enumerate(masks) for p in np.flatnonzero(m)], "image long, pixel long")
    out = {r.frame: np.reshape(r.px, (h, w)) for r in inpainting.inpainted(frames, rows, w, h).collect()}
    for i in range(2):
        assert np.allclose(out[i], inpainting.filled(images[i], masks[i]))
    assert (out[2] == images[2]).all() and (out[3] == images[3]).all()  # nothing to fill, nothing to fill from
    assert inpainting.holes(rows.where("image = 0"), w, h).select("hole").distinct().count() > 3
