"""Many keys' cut forests side by side: a step of all of them is a few operations on arrays.

The forests are those of ``forest.CutForest``, draw for draw; only the order of work differs. A series is one key's points.
"""

from __future__ import annotations

import numpy as np

from .forest import _ODD, CutForest, _mixed

#: Series that are worked on at once, and how many it takes for that to pay.
GROUP, FEW = 256, 8


def _columns(boxes: np.ndarray, v: np.ndarray) -> np.ndarray:
    """A column for each of the nodes; sums along short rows are slow."""
    return np.ascontiguousarray(boxes.take(v, axis=0).T)


class Bank:
    """Forests that each take one point a step, the first n of them."""

    def __init__(self, forests: int, width: int, points: int, trees: int = 10, size: int = 128, seed: int = 0):
        self.trees, self.size, self.steps = trees, size, 0
        slots, rows = 2 * (min(size, points) + 1), forests * trees
        n = rows * slots
        self.lo, self.hi, self.count = np.zeros((n, width)), np.zeros((n, width)), np.zeros(n, np.int64)
        self.dim, self.cut = np.full(n, -1, np.int64), np.zeros(n)
        self.child, self.parent = np.full((2, n), -1, np.int64), np.full(n, -1, np.int64)
        self.root = np.full(rows, -1, np.int64)
        self.free, self.top = np.arange(n).reshape(rows, slots), np.full(rows, slots)
        self.ring = np.zeros((slots // 2, rows), np.int64)
        with np.errstate(over="ignore"):
            h = _mixed(_ODD[3], np.asarray(seed).astype(np.uint64), _ODD[0])
            self.hash = _mixed(h, np.tile(np.arange(trees, dtype=np.uint64), forests), _ODD[1])

    def _pop(self, rows: np.ndarray) -> np.ndarray:
        self.top[rows] -= 1
        return self.free[rows, self.top[rows]]

    def _push(self, rows: np.ndarray, slots: np.ndarray) -> None:
        self.free[rows, self.top[rows]] = slots
        self.top[rows] += 1

    def add(self, points: np.ndarray) -> np.ndarray:
        """Put a point in each of the first forests and take their oldest out; displacements as ``CutForest.add`` has them."""
        n, width = len(points) * self.trees, points.shape[1]
        p, rows = np.repeat(points.T, self.trees, axis=1), np.arange(n)
        self.steps += 1
        if self.steps == 1:
            x = self._pop(rows)
            self.root[:n], self.ring[0, :n], self.count[x] = x, x, 1
            self.lo[x], self.hi[x] = p.T, p.T
            return np.zeros(len(points))
        with np.errstate(over="ignore"):
            h = _mixed(self.hash[:n], np.uint64(self.steps), _ODD[2])
        apart, leaf, where = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, -1, np.int64)
        axis, at, low_, high_ = np.zeros(n, np.int64), np.zeros(n), np.empty((n, width)), np.empty((n, width))
        go, v, q, depth = rows, self.root[:n], p, 0
        while len(go):
            k = self.dim.take(v)
            inner = k >= 0
            lo, hi = _columns(self.lo, v), _columns(self.hi, v)
            low, high = np.minimum(lo, q), np.maximum(hi, q)
            span = high - low
            outside = (span > hi - lo).any(axis=0) & inner  # a leaf has no other side
            down = self.child[(p[k, go] > self.cut.take(v)).astype(np.int64), v]
            held = self.count.take(v)
            apart[go] += np.where(outside, held - self.count.take(down), 0)
            mine = np.flatnonzero(where[go] < 0)
            if len(mine):
                if len(mine) < len(go):
                    span, low, high, lo, hi = span.take(mine, axis=1), low.take(mine, axis=1), high.take(mine, axis=1), lo.take(mine, axis=1), hi.take(mine, axis=1)
                f, x, i = go[mine], v[mine], np.arange(len(mine))
                ends = span.copy()
                for c in range(1, width):
                    ends[c] += ends[c - 1]
                with np.errstate(over="ignore"):
                    d = _mixed(h[f], np.uint64(depth), _ODD[3]) * _ODD[1]
                r = ((d ^ (d >> np.uint64(32))) >> np.uint64(11)) * 2.0**-53 * ends[-1]
                k = np.minimum((ends <= r).sum(axis=0), width - 1)
                base, mark = low[k, i], p[k, f]
                cut = base + (r - (ends[k, i] - span[k, i]))
                parted = ((mark <= cut) & (cut < lo[k, i])) | ((hi[k, i] <= cut) & (cut < mark))
                # At a leaf any cut but one rounded onto the upper value parts; that one goes to the lower value.
                stuck = ~parted & ~inner[mine] & (ends[-1] > 0)
                cut = np.where(stuck, base, cut)
                parted |= stuck
                yes, no = np.flatnonzero(parted), np.flatnonzero(~parted)
                y, g = f[yes], x[no]
                where[y], axis[y], at[y] = x[yes], k[yes], cut[yes]
                low_[y], high_[y] = low.take(yes, axis=1).T, high.take(yes, axis=1).T
                self.lo[g], self.hi[g] = low.take(no, axis=1).T, high.take(no, axis=1).T
                self.count[g] += 1
            last = ~inner
            if last.any():
                leaf[go[last]] = v[last]
                go, v = go[inner], down[inner]
                q = p.take(go, axis=1)
            else:
                v = down
            depth += 1
        new = np.flatnonzero(where >= 0)
        v, x, w, k, point = where[new], self._pop(new), self._pop(new), axis[new], p.T[new]
        g = self.parent[v]
        self.dim[x], self.count[x], self.parent[x] = -1, 1, w
        self.lo[x], self.hi[x] = point, point
        self.dim[w], self.cut[w], self.parent[w], self.parent[v] = k, at[new], g, w
        self.count[w] = self.count[v] + 1
        self.lo[w], self.hi[w] = low_[new], high_[new]
        right = (p[k, new] > at[new]).astype(np.int64)
        self.child[right, w], self.child[1 - right, w] = x, v
        self._hang(new, g, v, w)
        leaf[new] = x
        self.ring[(self.steps - 1) % len(self.ring), :n] = leaf
        if self.steps > self.size:
            self._remove(rows, self.ring[self.steps % len(self.ring), :n].copy())
        return 1.0 + apart.reshape(-1, self.trees).sum(axis=1) / self.trees

    def _hang(self, rows: np.ndarray, g: np.ndarray, old: np.ndarray, new: np.ndarray) -> None:
        """``new`` in the place of ``old`` below g, or as root."""
        top = g < 0
        self.root[rows[top]] = new[top]
        g, old, new = g[~top], old[~top], new[~top]
        self.child[(self.child[1, g] == old).astype(np.int64), g] = new

    def _remove(self, rows: np.ndarray, x: np.ndarray) -> None:
        w = self.parent[x]
        only = (self.count[x] == 1) & (w >= 0)
        self.count[x[~only]] -= 1
        r, x1, w1 = rows[only], x[only], w[only]
        s, g = self.child[(self.child[0, w1] == x1).astype(np.int64), w1], self.parent[w1]
        self.parent[s] = g
        self._hang(r, g, w1, s)
        self._push(r, x1)
        self._push(r, w1)
        up, shrinks = w.copy(), only.copy()
        up[only] = g
        while True:
            live = up >= 0
            up, shrinks = up[live], shrinks[live]
            if not len(up):
                return
            self.count[up] -= 1
            some = np.flatnonzero(shrinks)  # boxes shrink on the way up, until one stays
            if len(some):
                a = up[some]
                one, two = self.child[0, a], self.child[1, a]
                lo, hi = np.minimum(self.lo.take(one, axis=0), self.lo.take(two, axis=0)), np.maximum(self.hi.take(one, axis=0), self.hi.take(two, axis=0))
                shrinks[some] = ((lo != self.lo.take(a, axis=0)) | (hi != self.hi.take(a, axis=0))).any(axis=1)
                self.lo[a], self.hi[a] = lo, hi
            up = self.parent[up]


def raws(series: list[np.ndarray], trees: int = 10, size: int = 128, seed: int = 0) -> list[np.ndarray]:
    """Displacement of each point of each series (points in rows)."""
    out = [np.zeros(len(s)) for s in series]

    def alone(i: int) -> None:
        f = CutForest(trees, size, seed)
        out[i] = np.array([f.add(x) for x in series[i].tolist()])

    order = []
    for i, s in enumerate(series):
        if not np.isfinite(s).all():
            alone(i)
        elif len(s):
            order.append(i)
    order.sort(key=lambda i: -len(series[i]))
    while order:
        if len(order) < FEW or 2 * len(series[order[FEW - 1]]) < len(series[order[0]]):  # much longer than the others
            alone(order.pop(0))
            continue
        part, order = order[:GROUP], order[GROUP:]
        sizes = np.array([len(series[i]) for i in part])
        bank = Bank(len(part), series[part[0]].shape[1], int(sizes[0]), trees, size, seed)
        edges = np.append(0, np.cumsum(sizes)[:-1])
        flat, scores = np.concatenate([series[i] for i in part]), np.zeros(sizes.sum())
        live = len(part)
        for j in range(int(sizes[0])):
            while sizes[live - 1] <= j:
                live -= 1
            at = edges[:live] + j
            scores[at] = bank.add(flat[at])
        for i, e, n in zip(part, edges, sizes, strict=True):
            out[i] = scores[e : e + n]
    return out


class Given:
    """Stands for a cut forest whose displacements are known already."""

    def __init__(self, scores: np.ndarray):
        self.scores = iter(scores.tolist())

    def add(self, _point: list[float]) -> float:
        return next(self.scores)


def shingles(x: np.ndarray, n: int) -> np.ndarray:
    """The last n values at each value that has so many, in rows."""
    return np.lib.stride_tricks.sliding_window_view(x, n) if len(x) >= n else np.zeros((0, n))


def foretold(detectors: list, values: list[list[float]]) -> None:
    """Give new ``Rrcf`` detectors of one kind what their forests will say of their keys' values."""
    if detectors:
        one = detectors[0].forest.forest
        found = raws([shingles(np.array(v, np.float64), detectors[0].last.maxlen) for v in values], one.trees, one.size, one.seed)
        for d, r in zip(detectors, found, strict=True):
            d.forest.forest = Given(r)
