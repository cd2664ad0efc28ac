"""Whether a polygon, eroded by a tolerance, meets another one, pair by pair with NumPy: what the plan on rows of edges is tested against.

The eroded ``a`` is what lies inside ``a`` and at least ``t`` from its outline. The points closer than ``t`` to one edge are a
capsule, which is convex: along any straight line each edge of ``a`` rules out one interval. What the intervals leave of
an edge of ``b`` is on the eroded polygon or outside ``a`` as a whole, so one point of each gap decides. If no edge of ``b`` meets the
eroded polygon, each of its parts lies wholly in ``b`` or outside it, and one point of each part decides. A part has such a point on a
straight piece of its outline (an edge moved inwards by ``t``, again less the intervals), or, if it is bounded by
arcs alone, where circles around two corners meet. The work depends on the numbers of edges, not on lengths or on how close the
decision is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

HALVINGS = 20
#: Numbers in one work array.
HELD = 1 << 21


def _clean(e: np.ndarray) -> np.ndarray:
    return e[(e[:, 0] != e[:, 2]) | (e[:, 1] != e[:, 3])]


def _slack(e: np.ndarray, t: float) -> float:
    """What distances may miss ``t`` by, for rounding."""
    return 1e-9 * t + 1e-12 * float(np.abs(e).max(initial=0.0))


def _inside(points: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Whether points (n, 2) lie in the area that edges (m, 4) bound, holes being outside."""
    out = np.zeros(len(points), bool)
    step = max(1, HELD // max(1, len(e)))
    for low in range(0, len(points), step):
        x, y = (points[low : low + step, k, None] for k in (0, 1))
        spans = (e[None, :, 1] > y) != (e[None, :, 3] > y)
        with np.errstate(divide="ignore", invalid="ignore"):
            cross = e[None, :, 0] + (y - e[None, :, 1]) / (e[None, :, 3] - e[None, :, 1]) * (e[None, :, 2] - e[None, :, 0])
        out[low : low + step] = (spans & (x < cross)).sum(axis=1) % 2 == 1
    return out


def _ruled_out(p: np.ndarray, u: np.ndarray, e: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray]:
    """(low, high), both (lines, edges): the stretch of each line p + s u (u of length 1) closer than ``r`` to each edge; low > high: none."""
    low, high = np.full((len(p), len(e)), np.inf), np.full((len(p), len(e)), -np.inf)
    for corner in (e[None, :, :2], e[None, :, 2:]):  # the discs at its ends
        w = corner - p[:, None, :]
        middle = (w * u[:, None, :]).sum(axis=2)
        rest = r * r - ((w**2).sum(axis=2) - middle**2)
        half = np.sqrt(np.maximum(rest, 0))
        low, high = np.where(rest > 0, np.minimum(low, middle - half), low), np.where(rest > 0, np.maximum(high, middle + half), high)
    d = e[:, 2:] - e[:, :2]
    size = np.hypot(d[:, 0], d[:, 1])
    d = d / size[:, None]
    w = p[:, None, :] - e[None, :, :2]
    # the rectangle along it: 0 < position < size and |side| < r, each linear in s
    lo, hi = np.full(low.shape, -np.inf), np.full(low.shape, np.inf)
    along, across = (w * d[None]).sum(axis=2), w[:, :, 1] * d[None, :, 0] - w[:, :, 0] * d[None, :, 1]
    for value, slope, least, most in (
        (along, u @ d.T, 0.0, size[None, :]),
        (across, u[:, 1, None] * d[None, :, 0] - u[:, 0, None] * d[None, :, 1], -r, r),
    ):
        with np.errstate(divide="ignore", invalid="ignore"):
            one, two = (least - value) / slope, (most - value) / slope
        level, within = np.abs(slope) < 1e-15, (value > least) & (value < most)
        lo = np.where(level, np.where(within, lo, np.inf), np.maximum(lo, np.minimum(one, two)))
        hi = np.where(level, np.where(within, hi, -np.inf), np.minimum(hi, np.maximum(one, two)))
    met = lo < hi
    return np.where(met, np.minimum(low, lo), low), np.where(met, np.maximum(high, hi), high)


def _gaps(p: np.ndarray, q: np.ndarray, e: np.ndarray, r: float) -> Iterator[np.ndarray]:
    """Points (n, 2), in batches, on the segments p to q: one in each stretch that is nowhere closer than ``r`` to an edge of ``e``."""
    step = max(1, HELD // (8 * max(1, len(e))))
    for first in range(0, len(p), step):
        a, b = p[first : first + step], q[first : first + step]
        size = np.hypot(*(b - a).T)
        u = (b - a) / np.where(size > 0, size, 1)[:, None]
        low, high = _ruled_out(a, u, e, r)
        order = np.argsort(low, axis=1)
        low, high = np.take_along_axis(low, order, 1), np.take_along_axis(high, order, 1)
        till = np.maximum.accumulate(np.maximum(high, 0), axis=1)  # ruled out from the start to here
        start = np.concatenate([np.zeros((len(a), 1)), till], axis=1)
        end = np.minimum(np.concatenate([low, np.full((len(a), 1), np.inf)], axis=1), size[:, None])
        last = np.isfinite(low).sum(axis=1)  # what follows the last interval is one stretch
        row, column = np.nonzero((start <= end) & (start <= size[:, None]) & (np.arange(start.shape[1]) <= last[:, None]))
        s = (start[row, column] + end[row, column]) / 2
        yield a[row] + s[:, None] * u[row]


def _meetings(e: np.ndarray, t: float, r: float) -> np.ndarray:
    """Where circles of radius ``t`` around two corners meet, if no other corner is closer than ``r``."""
    corners = np.unique(np.concatenate([e[:, :2], e[:, 2:]]), axis=0)
    found = []
    step = max(1, HELD // (8 * max(1, len(corners))))
    for first in range(0, len(corners), step):
        own = corners[first : first + step]
        w = corners[None, :, :] - own[:, None, :]
        gap = np.hypot(w[:, :, 0], w[:, :, 1])
        near = (gap > 0) & (gap <= 2 * t)
        half = np.where(near, np.arccos(np.clip(gap / (2 * t), -1, 1)), 0)
        angle = np.arctan2(w[:, :, 1], w[:, :, 0])
        for row in np.flatnonzero(near.any(axis=1)):
            mid, wide = angle[row, near[row]], half[row, near[row]]
            ends = np.concatenate([mid - wide, mid + wide])
            points = own[row] + t * np.stack([np.cos(ends), np.sin(ends)], axis=1)
            # the ends that no other disc covers: sorted starts, furthest end so far, all turned into one round
            low, high = np.mod(mid - wide, 2 * np.pi), np.mod(mid - wide, 2 * np.pi) + 2 * wide
            low, high = np.concatenate([low, low - 2 * np.pi, low + 2 * np.pi]), np.concatenate([high, high - 2 * np.pi, high + 2 * np.pi])
            order = np.argsort(low)
            low, high = low[order], high[order]
            slip = 1e-6  # a point that is barely covered is judged by its distances
            at = np.mod(ends, 2 * np.pi)
            before = np.searchsorted(low, at - slip, "left")
            reach = np.maximum.accumulate(np.concatenate([[-np.inf], high]))[before]
            found.append(points[reach <= at + slip])
    points = np.concatenate(found) if found else np.zeros((0, 2))
    return points[_far(points, e, r)]


def _far(points: np.ndarray, e: np.ndarray, r: float) -> np.ndarray:
    """Whether points lie at least ``r`` from every edge."""
    out = np.ones(len(points), bool)
    d = e[:, 2:] - e[:, :2]
    step = max(1, HELD // (4 * max(1, len(e))))
    for first in range(0, len(points), step):
        w = points[first : first + step, None, :] - e[None, :, :2]
        along = np.clip((w * d[None]).sum(axis=2) / (d**2).sum(axis=1), 0, 1)
        out[first : first + step] = (((w - along[:, :, None] * d[None]) ** 2).sum(axis=2) >= r * r).all(axis=1)
    return out


def _parts(e: np.ndarray, t: float, r: float) -> Iterator[np.ndarray]:
    """Points of the eroded polygon, in batches; some batch has one of each of its parts."""
    d = e[:, 2:] - e[:, :2]
    side = t * np.stack([d[:, 1], -d[:, 0]], axis=1) / np.hypot(d[:, 0], d[:, 1])[:, None]
    for way in (side, -side):
        for found in _gaps(e[:, :2] + way, e[:, 2:] + way, e, r):
            yield found[_inside(found, e)]
    found = _meetings(e, t, r)
    yield found[_inside(found, e)]


def _touch(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two closed areas share a point."""
    if _inside(a[:1, :2], b).any() or _inside(b[:1, :2], a).any():
        return True

    def turn(p: np.ndarray, q: np.ndarray, x: np.ndarray) -> np.ndarray:
        return np.sign((q[..., 0] - p[..., 0]) * (x[..., 1] - p[..., 1]) - (q[..., 1] - p[..., 1]) * (x[..., 0] - p[..., 0]))

    step = max(1, HELD // (4 * len(b)))
    for first in range(0, len(a), step):
        p, q = a[first : first + step, None, :2], a[first : first + step, None, 2:]
        x, y = b[None, :, :2], b[None, :, 2:]
        boxes = ((np.minimum(p, q) <= np.maximum(x, y)) & (np.minimum(x, y) <= np.maximum(p, q))).all(axis=2)
        if (boxes & (turn(p, q, x) * turn(p, q, y) <= 0) & (turn(x, y, p) * turn(x, y, q) <= 0)).any():
            return True
    # all of one inside the other without touching, its first corner aside (parts of a multipolygon)
    return bool(_inside(a[:, :2], b).any() or _inside(b[:, :2], a).any())


def reaches(a: np.ndarray, t: float, b: np.ndarray | None = None) -> bool:
    """Whether some point is at least ``t`` inside ``a`` and (if given) in ``b``: the eroded ``a`` meets ``b``. Edges are (n, 4)."""
    a = _clean(np.asarray(a, float))
    b = None if b is None else _clean(np.asarray(b, float))
    if not len(a) or b is not None and not len(b):
        return False
    origin = np.tile(np.minimum(a[:, :2], a[:, 2:]).min(axis=0), 2)  # small numbers round less
    a = a - origin
    high = np.maximum(a[:, :2], a[:, 2:]).max(axis=0)
    if t <= 0:
        return b is None or _touch(a, b - origin)
    r = max(t - _slack(a, t), t / 2)
    if (high < 2 * r).any():
        return False
    if b is None:
        return any(len(found) for found in _parts(a, t, r))
    b = b - origin
    low_b, high_b = np.minimum(b[:, :2], b[:, 2:]), np.maximum(b[:, :2], b[:, 2:])
    if (high_b.max(axis=0) < r).any() or (low_b.min(axis=0) > high - r).any():
        return False
    close = ((high_b >= r) & (low_b <= high - r)).all(axis=1)
    some = np.concatenate([b[:: 1 + len(b) // 16, :2], [(np.maximum(low_b.min(axis=0), 0) + np.minimum(high_b.max(axis=0), high)) / 2]])
    some = some[_inside(some, a)]  # mostly one of these decides
    some = some[_far(some, a, r)]
    if _inside(some[-1:], b).any() or (some[:, None, :] == b[None, :, :2]).all(axis=2).any():
        return True
    if any(_inside(found, a).any() for found in _gaps(b[close, :2], b[close, 2:], a, r)):
        return True
    return any(_inside(found, b).any() for found in _parts(a, t, r))


def effective_tolerance(a: np.ndarray, t: float) -> float:
    """``t``, halved until the polygon isn't eroded away; an error after 20 times."""
    for k in range(HALVINGS + 1):
        if reaches(a, t / 2**k):
            return t / 2**k
    raise ValueError("a polygon vanishes at every tolerance")
