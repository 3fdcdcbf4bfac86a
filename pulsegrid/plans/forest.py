"""A random cut forest over a sliding window: points are put in and taken out one by one, with replayable draws.

Every tree holds the last ``size`` points. A node knows its points' box and number. A point is put in where the first
cut, drawn on the way down from the box stretched to hold it, parts it from what is there; the oldest point's leaf is
taken out and its sibling moves up. Draws are hashes of (seed, tree, sequence, depth), so any other form of the same
forest, one rebuilt from its points in each step say, must come to the same scores.

The trees are arrays, and a step over a path is one operation for all trees.
"""

from __future__ import annotations

from collections import deque

import numpy as np

#: Odd multipliers of the draw's hash, one for each part of its counter.
_ODD = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93], np.uint64)


def _mixed(h: np.ndarray, x: np.ndarray, odd: np.uint64) -> np.ndarray:
    h = (h ^ (x + odd)) * odd
    return h ^ (h >> np.uint64(29))


def draws(seed, tree, sequence, depth) -> np.ndarray:
    """Numbers in [0, 1) by counter; the arguments may be arrays of one length, or numbers."""
    with np.errstate(over="ignore"):
        h = _ODD[3]
        for x, odd in zip((seed, tree, sequence, depth), _ODD, strict=True):
            h = _mixed(h, np.asarray(x).astype(np.uint64), odd)
        h = h * _ODD[1]
        return ((h ^ (h >> np.uint64(32))) >> np.uint64(11)) * 2.0**-53


class CutForest:
    """``displacement`` and ``add`` for points of one length; leaves count equal points."""

    def __init__(self, trees: int = 10, size: int = 128, seed: int = 0, first: int = 0):
        self.trees, self.size, self.seed, self.sequence, self.first = trees, size, seed, 0, first
        self.lo = None

    def _start(self, width: int) -> None:
        slots = 2 * (self.size + 1)
        n = self.trees * slots
        self.lo, self.hi, self.count = np.zeros((n, width)), np.zeros((n, width)), np.zeros(n, np.int64)
        self.dim, self.cut, self.left, self.right, self.parent = [-1] * n, [0.0] * n, [-1] * n, [-1] * n, [-1] * n
        self.roots = [-1] * self.trees
        self.free = [list(range(t * slots + slots - 1, t * slots - 1, -1)) for t in range(self.trees)]
        self.leaves: deque = deque()

    def _paths(self, point: list[float]) -> tuple[list[int], list[int]]:
        """Nodes from root to leaf that the point would take, tree after tree, and where each tree's begin."""
        dim, cut, left, right = self.dim, self.cut, self.left, self.right
        nodes, begin = [], []
        for v in self.roots:
            begin.append(len(nodes))
            while dim[v] >= 0:
                nodes.append(v)
                v = left[v] if point[dim[v]] <= cut[v] else right[v]
            nodes.append(v)
        return nodes, begin

    def add(self, point: list[float]) -> float:
        """Put a point in and take the oldest out; the point's mean displacement before that (0 for the first).

        A tree's displacement is one more than the points on the other side of each cut on the way down at nodes whose
        box does not hold the point.
        """
        self.sequence += 1
        p = np.array(point, np.float64)
        if self.lo is None:
            self._start(len(point))
        if self.roots[0] < 0:
            self.leaves.append([self._leaf(t, p, -1) for t in range(self.trees)])
            self.roots = list(self.leaves[-1])
            return 0.0
        nodes, begin = self._paths(point)
        at, first = np.array(nodes), np.array(begin)
        sizes = np.diff(np.append(first, len(nodes)))
        lo, hi, held = self.lo[at], self.hi[at], self.count[at]
        low, high = np.minimum(lo, p), np.maximum(hi, p)
        span = high - low
        outside = (span > hi - lo).any(axis=1)
        apart = np.append(held[:-1] - held[1:], 0)
        last = first + sizes - 1
        outside[last] = False  # a leaf has no other side
        score = 1.0 + float(apart[outside].sum()) / self.trees

        tree = np.repeat(np.arange(self.trees), sizes)
        ends = span.cumsum(axis=1)
        r = draws(self.seed, self.first + tree, self.sequence, np.arange(len(nodes)) - np.repeat(first, sizes)) * ends[:, -1]
        row, k = np.arange(len(nodes)), np.minimum((ends <= r[:, None]).sum(axis=1), len(point) - 1)
        cut = low[row, k] + (r - (ends[row, k] - span[row, k]))
        below = (p[k] <= cut) & (cut < lo[row, k])
        above = (hi[row, k] <= cut) & (cut < p[k])
        parted = below | above
        # At a leaf any cut but one rounded onto the upper value parts; that one goes to the lower value.
        stuck = last[~parted[last] & (ends[last, -1] > 0)]
        cut[stuck] = low[stuck, k[stuck]]
        parted[stuck] = True
        self._insert(p, nodes, begin, parted.tolist(), k.tolist(), cut.tolist(), low, high)
        if len(self.leaves) > self.size:
            self._remove(self.leaves.popleft())
        return score

    def _leaf(self, tree: int, p: np.ndarray, parent: int) -> int:
        x = self.free[tree].pop()
        self.dim[x], self.parent[x], self.count[x], self.lo[x], self.hi[x] = -1, parent, 1, p, p
        return x

    def _insert(self, p, nodes, begin, parted, k, cut, low, high) -> None:
        leaves, grown, new = [], [], []
        for t, a in enumerate(begin):
            b = begin[t + 1] if t + 1 < len(begin) else len(nodes)
            try:
                i = parted.index(True, a, b)
            except ValueError:  # an equal point is there
                leaves.append(nodes[b - 1])
                grown += range(a, b)
                continue
            v, w = nodes[i], self.free[t].pop()
            g = self.parent[v]
            x = self._leaf(t, p, w)
            self.dim[w], self.cut[w], self.parent[w], self.parent[v] = k[i], cut[i], g, w
            self.left[w], self.right[w] = (x, v) if p[k[i]] <= cut[i] else (v, x)
            if g < 0:
                self.roots[t] = w
            elif self.left[g] == v:
                self.left[g] = w
            else:
                self.right[g] = w
            new.append((w, v, i))
            leaves.append(x)
            grown += range(a, i)
        if new:
            w, v, i = (np.array(x) for x in zip(*new, strict=True))
            self.count[w], self.lo[w], self.hi[w] = self.count[v] + 1, low[i], high[i]
        if grown:
            at = np.array(nodes)[grown]
            self.count[at] += 1
            self.lo[at], self.hi[at] = low[grown], high[grown]
        self.leaves.append(leaves)

    def _remove(self, leaves: list[int]) -> None:
        fewer, chains, ups = [], [], []
        for t, x in enumerate(leaves):
            w = self.parent[x]
            if self.count[x] > 1 or w < 0:
                fewer.append(x)
                while w >= 0:
                    fewer.append(w)
                    w = self.parent[w]
                continue
            s, g = self.right[w] if self.left[w] == x else self.left[w], self.parent[w]
            self.parent[s] = g
            self.free[t] += (x, w)
            if g < 0:
                self.roots[t] = s
                continue
            if self.left[g] == w:
                self.left[g] = s
            else:
                self.right[g] = s
            chain, up, v = [s], [], s
            while g >= 0:
                up.append(g)
                chain.append(self.right[g] if self.left[g] == v else self.left[g])
                v, g = g, self.parent[g]
            chains.append(chain)
            ups.append(up)
            fewer += up
        if fewer:
            self.count[np.array(fewer)] -= 1
        if chains:  # boxes shrink: a node's is that of the leaf's sibling and of all that hangs beside the way up
            most = max(map(len, chains))
            idx = np.array([c + c[-1:] * (most - len(c)) for c in chains])
            lo, hi = np.minimum.accumulate(self.lo[idx], axis=1), np.maximum.accumulate(self.hi[idx], axis=1)
            row = np.repeat(np.arange(len(ups)), [len(u) for u in ups])
            col = np.concatenate([np.arange(1, len(u) + 1) for u in ups])
            at = np.concatenate([np.array(u) for u in ups])
            self.lo[at], self.hi[at] = lo[row, col], hi[row, col]


class Forest:
    """Scores of points in a cut forest: displacement before insertion, held against its own slow mean."""

    SETTLED = 10

    def __init__(self, trees: int = 10, size: int = 128, seed: int = 0, least: float = 0.2):
        self.forest, self.usual, self.n, self.least = CutForest(trees, size, seed), None, 0, least

    def update(self, point) -> tuple[float, bool]:
        """Score 0 to 1 and whether it is an anomaly; the first ten points score 0."""
        return self.judge(self.forest.add([float(x) for x in point]))

    def judge(self, raw: float) -> tuple[float, bool]:
        """The same for a point whose displacement is known."""
        self.n += 1
        self.usual = raw if self.usual is None else self.usual + 0.01 * (raw - self.usual)
        if self.n <= self.SETTLED or self.usual <= 0.01:
            return 0.0, False
        score = min(max((raw / self.usual - 1) / 2, 0.0), 1.0)
        return score, score > self.least
