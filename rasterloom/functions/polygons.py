"""Polygon kernels in numpy. A polygon is a list of rings, the first its shell, the others holes; a ring is an (n, 2) array, closed or not."""

from __future__ import annotations

import numpy as np

Polygon = list[np.ndarray]


def open_ring(ring) -> np.ndarray:
    r = np.asarray(ring, float).reshape(-1, 2)
    return r[:-1] if len(r) > 1 and (r[0] == r[-1]).all() else r


def ring_area(ring: np.ndarray) -> float:
    """Signed: positive if the ring runs against the clock."""
    x, y = ring[:, 0] - ring[0, 0], ring[:, 1] - ring[0, 1]
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2)


def oriented(polygon) -> Polygon:
    """Open rings, the shell against the clock, holes with it."""
    out = []
    for k, ring in enumerate(polygon):
        r = open_ring(ring)
        if len(r) >= 3:
            out.append(r if (ring_area(r) > 0) == (k == 0) else r[::-1])
    return out


def edges(polygons: list[Polygon]) -> np.ndarray:
    """(m, 4): x1, y1, x2, y2 of every edge of oriented rings."""
    parts = [np.concatenate([r, np.roll(r, -1, axis=0)], axis=1) for p in polygons for r in p]
    return np.concatenate(parts) if parts else np.zeros((0, 4))


def area(polygons: list[Polygon]) -> float:
    return sum(ring_area(r) for p in polygons for r in p)


def bounds(polygons: list[Polygon]) -> tuple[float, float, float, float]:
    v = np.concatenate([r for p in polygons for r in p])
    return float(v[:, 0].min()), float(v[:, 1].min()), float(v[:, 0].max()), float(v[:, 1].max())


def _crossings(e: np.ndarray) -> np.ndarray:
    """Heights at which edges cross each other."""
    out = []
    d = e[:, 2:] - e[:, :2]
    for i in range(len(e) - 1):
        f, g = e[i + 1 :], d[i + 1 :]
        with np.errstate(divide="ignore", invalid="ignore"):
            det = d[i, 0] * g[:, 1] - d[i, 1] * g[:, 0]
            w = f[:, :2] - e[i, :2]
            t = (w[:, 0] * g[:, 1] - w[:, 1] * g[:, 0]) / det
            s = (w[:, 0] * d[i, 1] - w[:, 1] * d[i, 0]) / det
            ok = (det != 0) & (t > 0) & (t < 1) & (s > 0) & (s < 1)
        out.append(e[i, 1] + t[ok] * d[i, 1])
    return np.concatenate(out) if out else np.zeros(0)


def union(polygons: list[Polygon]) -> list[Polygon]:
    """Polygons with disjoint interiors that cover the same points. Sets whose boxes don't overlap stay as they are; what overlaps is cut into slabs between the heights of vertices and crossings, and the trapezoids of a slab are merged."""
    polygons = [q for p in polygons if (q := oriented(p))]
    group = list(range(len(polygons)))

    def find(k: int) -> int:
        while group[k] != k:
            group[k] = group[group[k]]
            k = group[k]
        return k

    # a sweep over x: only polygons whose boxes are open side by side are compared
    boxes = [bounds([p]) for p in polygons]
    active: list[int] = []
    for i in sorted(range(len(polygons)), key=lambda k: boxes[k][0]):
        active = [j for j in active if boxes[j][2] > boxes[i][0]]
        for j in active:
            if boxes[i][1] < boxes[j][3] and boxes[j][1] < boxes[i][3] and find(i) != find(j):
                group[find(i)] = find(j)
        active.append(i)
    sets: dict[int, list[Polygon]] = {}
    for k, p in enumerate(polygons):
        sets.setdefault(find(k), []).append(p)
    out: list[Polygon] = []
    for members in sets.values():
        out += members if len(members) == 1 else _slabs(members)
    return out


def _slabs(members: list[Polygon]) -> list[Polygon]:
    per = [edges([p]) for p in members]
    e = np.concatenate(per)
    own = np.repeat(np.arange(len(per)), [len(x) for x in per])
    ys = np.unique(np.concatenate([e[:, 1], e[:, 3], _crossings(e)]))
    out = []
    for lo, hi in zip(ys[:-1], ys[1:], strict=True):
        mid = (lo + hi) / 2
        on = (np.minimum(e[:, 1], e[:, 3]) <= lo) & (np.maximum(e[:, 1], e[:, 3]) >= hi) & (e[:, 1] != e[:, 3])
        f, who = e[on], own[on]
        slope = (f[:, 2] - f[:, 0]) / (f[:, 3] - f[:, 1])
        at = lambda y: f[:, 0] + (y - f[:, 1]) * slope  # noqa: B023, E731
        x, a, z = at(mid), at(lo), at(hi)
        spans = []
        for k in np.unique(who):
            order = np.flatnonzero(who == k)
            order = order[np.argsort(x[order], kind="stable")]
            spans += [(x[i], i, j) for i, j in zip(order[::2], order[1::2], strict=False)]
        spans.sort()
        merged: list[list[int]] = []
        for _, i, j in spans:
            if merged and x[i] <= x[merged[-1][1]]:
                if x[j] > x[merged[-1][1]]:
                    merged[-1][1] = j
            else:
                merged.append([i, j])
        out += [[np.array([(a[i], lo), (a[j], lo), (z[j], hi), (z[i], hi)])] for i, j in merged]
    return out


class EdgeIndex:
    """Edges in bands of height, so that a row of a grid looks at those near it and not at all. An edge stands in each band that it crosses; bands are as many as edges at most, and an edge that crosses more than 64 is looked at by every row."""

    def __init__(self, e: np.ndarray) -> None:
        self.e = e
        lo, hi = np.minimum(e[:, 1], e[:, 3]), np.maximum(e[:, 1], e[:, 3])
        self.lo, self.hi = lo, hi
        self.base = float(lo.min()) if len(e) else 0.0
        span = float(hi.max()) - self.base if len(e) else 0.0
        self.n = max(1, len(e))
        self.step = span / self.n or 1.0
        a, z = (np.clip(((v - self.base) / self.step).astype(np.int64), 0, self.n - 1) for v in (lo, hi))
        self.tall = np.flatnonzero(z - a >= 64)
        short = np.flatnonzero(z - a < 64)
        size = z[short] - a[short] + 1
        band = np.repeat(a[short], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        order = np.argsort(band, kind="stable")
        self.band, self.edge = band[order], np.repeat(short, size)[order]

    def between(self, y_lo: float, y_hi: float) -> np.ndarray:
        """Edges that meet [y_lo, y_hi], in their own order."""
        a, z = ((v - self.base) / self.step for v in (y_lo, y_hi))
        i, j = np.searchsorted(self.band, [np.floor(np.clip(a, 0, self.n - 1)), np.floor(np.clip(z, 0, self.n - 1)) + 1])
        near = np.unique(np.concatenate([self.edge[i:j], self.tall]))
        return self.e[near[(self.hi[near] >= y_lo) & (self.lo[near] <= y_hi)]]


def scan_runs(e: np.ndarray, ys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of the stretches of each horizontal line inside the edges (even-odd, half-open in y)."""
    row, lo, hi = [], [], []
    for k, y in enumerate(ys):
        on = (e[:, 1] <= y) != (e[:, 3] <= y)
        f = e[on]
        x = np.sort(f[:, 0] + (y - f[:, 1]) * (f[:, 2] - f[:, 0]) / (f[:, 3] - f[:, 1]))
        n = len(x) // 2
        row.append(np.full(n, k))
        lo.append(x[0 : 2 * n : 2])
        hi.append(x[1 : 2 * n : 2])
    return (np.concatenate(v) if v else np.zeros(0) for v in (row, lo, hi))


def row_coverage(e: np.ndarray, y_lo: float, y_hi: float, x_edges: np.ndarray) -> np.ndarray:
    """Area of each cell of one row (between ascending x_edges) within oriented, disjoint polygons: each edge adds the signed area to its right, so one pass over the edges that meet the row is exact."""
    n = len(x_edges) - 1
    width = np.diff(x_edges)
    cover = np.zeros(n)
    full = np.zeros(n + 1)
    on = (np.maximum(e[:, 1], e[:, 3]) > y_lo) & (np.minimum(e[:, 1], e[:, 3]) < y_hi)
    for x1, y1, x2, y2 in e[on]:
        a, b = np.clip((y1, y2), y_lo, y_hi)
        if a == b:
            continue
        slope = (x2 - x1) / (y2 - y1)
        xa, xb = x1 + (a - y1) * slope, x1 + (b - y1) * slope
        # in pieces between column bounds; a piece going down adds what is to its right
        left, right = min(xa, xb), max(xa, xb)
        i = int(np.searchsorted(x_edges, left, side="right")) - 1
        j = int(np.searchsorted(x_edges, right, side="left"))
        cuts = np.concatenate([[left], x_edges[max(i + 1, 0) : min(j, n + 1)], [right]]) if right > left else np.array([left, right])
        if right > left:
            dy = np.diff(cuts) / (right - left) * (a - b)
        else:
            dy = np.array([a - b])
        middle = (cuts[:-1] + cuts[1:]) / 2
        cell = np.searchsorted(x_edges, middle, side="right") - 1
        inside = (cell >= 0) & (cell < n)
        before = cell < 0
        full[0] += dy[before].sum()
        c = cell[inside]
        np.add.at(cover, c, dy[inside] * (x_edges[c + 1] - middle[inside]))
        np.add.at(full, c + 1, dy[inside])
    return cover + np.cumsum(full)[:n] * width
