"""The cut forest against a naive one that keeps point lists and computes every box and number anew."""

import random

import pytest

from pulsegrid.plans import detectors
from pulsegrid.plans.forest import CutForest, Forest, draws


class Naive:
    """One tree as nested lists; a node is [dim, cut, left, right], a leaf the list of its points' sequences."""

    def __init__(self, tree, size, seed):
        self.tree, self.size, self.seed, self.root, self.points, self.n = tree, size, seed, None, {}, 0

    def ids(self, node):
        return node[1] if node[0] == "leaf" else self.ids(node[2]) + self.ids(node[3])

    def box(self, node):
        p = [self.points[i] for i in self.ids(node)]
        return [min(c) for c in zip(*p)], [max(c) for c in zip(*p)]

    def displacement(self, p):
        node, score = self.root, 1.0
        while node[0] != "leaf":
            lo, hi = self.box(node)
            mine, other = (node[2], node[3]) if p[node[0]] <= node[1] else (node[3], node[2])
            if any(x < a or x > b for x, a, b in zip(p, lo, hi)):
                score += len(self.ids(other))
            node = mine
        return score

    def put(self, node, p, depth):
        lo, hi = self.box(node)
        low, high = [min(a, x) for a, x in zip(lo, p)], [max(b, x) for b, x in zip(hi, p)]
        spans = [b - a for a, b in zip(low, high)]
        total = 0.0
        ends = [total := total + s for s in spans]
        r = float(draws(self.seed, self.tree, self.n, depth)) * ends[-1]
        k = min(sum(e <= r for e in ends), len(p) - 1)
        cut = low[k] + (r - (ends[k] - spans[k]))
        parted = p[k] <= cut < lo[k] or hi[k] <= cut < p[k]
        if node[0] == "leaf":
            if p == self.points[node[1][0]]:
                return ["leaf", node[1] + [self.n]]
            if not parted:
                cut, parted = low[k], True
        if parted:
            new = ["leaf", [self.n]]
            return [k, cut, new, node] if p[k] <= cut else [k, cut, node, new]
        if p[node[0]] <= node[1]:
            return [node[0], node[1], self.put(node[2], p, depth + 1), node[3]]
        return [node[0], node[1], node[2], self.put(node[3], p, depth + 1)]

    def take(self, node, i):
        if node[0] == "leaf":
            left = [x for x in node[1] if x != i]
            return ["leaf", left] if left else None
        a, b = self.take(node[2], i), self.take(node[3], i)
        return [node[0], node[1], a, b] if a and b else a or b

    def add(self, p):
        self.n += 1
        score = self.displacement(p) if self.root else 0.0
        node = self.put(self.root, p, 0) if self.root else ["leaf", [self.n]]
        self.points[self.n] = p
        self.root = node
        if len(self.points) > self.size:
            self.root = self.take(self.root, self.n - self.size)
            del self.points[self.n - self.size]
        return score


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("width", [1, 3])
def test_scores_are_those_of_a_naive_forest(seed, width):
    rnd = random.Random(seed)
    forest, naive = CutForest(trees=3, size=16, seed=seed), [Naive(t, 16, seed) for t in range(3)]
    for n in range(150):
        p = [float(rnd.randint(0, 6)) if seed % 2 else rnd.gauss(0, 1) for _ in range(width)]
        p = p if n % 40 else [50.0] * width
        got = forest.add(p)
        assert got == pytest.approx(sum(t.add(p) for t in naive) / 3, abs=1e-9), n


def test_numbers_and_boxes_stay_those_of_the_points():
    rnd, f = random.Random(9), CutForest(trees=2, size=32, seed=1)
    points = []
    for _ in range(400):
        points.append([float(rnd.randint(0, 9)), rnd.random()])
        f.add(points[-1])
    for root in f.roots:
        last = points[-32:]
        assert f.count[root] == 32
        assert f.lo[root].tolist() == [min(c) for c in zip(*last)] and f.hi[root].tolist() == [max(c) for c in zip(*last)]


def test_equal_points_only_and_a_window_of_one():
    f = Forest(trees=4, size=8)
    got = [f.update([3.0, 3.0]) for _ in range(400)]  # the slow mean starts at 0, so the first are far above it
    assert got[:10] == [(0.0, False)] * 10 and got[10][1] and not got[-1][1]
    f = CutForest(trees=2, size=1)
    assert [f.add([float(i % 3)]) for i in range(9)] == [0.0] + [1.0] * 8


def test_outliers_score_and_usual_points_do_not():
    f, r = Forest(), random.Random(4)
    for _ in range(300):
        f.update([r.gauss(0, 1) for _ in range(4)])
    assert not f.update([0.0] * 4)[1]
    score, odd = f.update([25.0] * 4)
    assert odd and score > 0.5
    d = detectors.Rrcf()
    answers = [d.update(i, 1, 10 + r.random(), False) for i in range(200)] + [d.update(200, 1, 500.0, False)]
    assert answers[-1] is not None and answers[-1][0] > 0.4
