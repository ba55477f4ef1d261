"""Shapes of regions of pixels: outer boundary, enclosing circle, simplified polygon. Points are (x, y) in pixels."""

from __future__ import annotations

import numpy as np

#: The eight neighbours of a pixel as (dy, dx), clockwise on a screen from the right one.
AROUND = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]


def boundary(inside: np.ndarray) -> np.ndarray:
    """The pixels of the outer boundary of the region that holds the first pixel, in order around it, each as often as it is passed."""
    mask = np.pad(inside.astype(bool), 1)
    start = tuple(int(v) for v in np.argwhere(mask)[0])

    def turn(at: tuple[int, int], first: int, way: int) -> int | None:
        for k in range(8):
            d = (first + way * k) % 8
            if mask[at[0] + AROUND[d][0], at[1] + AROUND[d][1]]:
                return d
        return None

    d = turn(start, 4, 1)  # from the left neighbour, which is outside
    if d is None:
        return np.array([[start[1] - 1, start[0] - 1]], float)
    last = (start[0] + AROUND[d][0], start[1] + AROUND[d][1])
    at, came, out = start, d, []
    while True:
        out.append((at[1] - 1, at[0] - 1))
        d = turn(at, came - 1, -1)
        to = (at[0] + AROUND[d][0], at[1] + AROUND[d][1])
        if to == start and at == last:
            return np.array(out, float)
        at, came = to, (d + 4) % 8


def area(points: np.ndarray) -> float:
    """The signed area of a closed polygon."""
    x, y = points.T
    return float(x @ np.roll(y, -1) - np.roll(x, -1) @ y) / 2


def perimeter(points: np.ndarray) -> float:
    return float(np.hypot(*(np.roll(points, -1, 0) - points).T).sum())


def centre(points: np.ndarray) -> tuple[float, float]:
    """The centre of mass of a closed polygon; its first corner if it has no area."""
    x, y = points.T
    cross = x * np.roll(y, -1) - np.roll(x, -1) * y
    if not cross.sum():
        return float(x[0]), float(y[0])
    return tuple(float(((v + np.roll(v, -1)) * cross).sum() / (3 * cross.sum())) for v in (x, y))


def _circle(*on: np.ndarray) -> tuple[np.ndarray, float]:
    """The smallest circle through two or three points; None for three on a line."""
    if len(on) == 2:
        return (on[0] + on[1]) / 2, float(np.hypot(*(on[0] - on[1]))) / 2
    (ax, ay), (bx, by) = on[1] - on[0], on[2] - on[0]
    d = 2 * (ax * by - ay * bx)
    if not d:
        return None
    a, b = ax * ax + ay * ay, bx * bx + by * by
    off = np.array([by * a - ay * b, ax * b - bx * a]) / d
    return on[0] + off, float(np.hypot(*off))


def enclosing_circle(points: np.ndarray) -> tuple[float, float, float]:
    """(x, y, radius) of the smallest circle around all points, which grows by the first point outside it, again and again."""
    points = np.unique(points, axis=0)
    outside = lambda c, p: np.flatnonzero(np.hypot(*(p - c[0]).T) > c[1] * (1 + 1e-12) + 1e-9)
    circle = points[0], 0.0
    while len(out := outside(circle, points)):
        i = out[0]
        circle = points[i], 0.0
        while len(out := outside(circle, points[:i])):
            j = out[0]
            circle = _circle(points[i], points[j])
            while len(out := outside(circle, points[:j])):
                circle = _circle(points[i], points[j], points[out[0]]) or max((_circle(p, q) for p, q in ((points[i], points[out[0]]), (points[j], points[out[0]]))), key=lambda c: c[1])
    return float(circle[0][0]), float(circle[0][1]), circle[1]


def simplified(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Corners of a closed polygon such that no left-out point is further than the tolerance from the line that replaces it."""

    def between(a: int, b: int) -> list[int]:
        """The corners kept after a, up to b, of the points from a on to b, around the end if need be."""
        n = (b - a) % len(points) or len(points)
        stack, kept = [(a, a + n)], []
        while stack:
            low, high = stack.pop()
            own = points[np.arange(low + 1, high) % len(points)]
            p, q = points[low % len(points)], points[high % len(points)]
            line, far = q - p, own - p
            length = np.hypot(*line)
            apart = np.abs(line[0] * far[:, 1] - line[1] * far[:, 0]) / length if length else np.hypot(*far.T)
            if len(own) and apart.max() > tolerance:
                mid = low + 1 + int(apart.argmax())
                stack += [(mid, high), (low, mid)]
            else:
                kept.append(high % len(points))
        return kept

    if len(points) < 3:
        return points
    a = 0
    for _ in range(3):  # two corners far from each other
        b, a = a, int(np.hypot(*(points - points[a]).T).argmax())
    if a == b:
        return points[:1]
    return points[[*between(a, b), *between(b, a)]]
