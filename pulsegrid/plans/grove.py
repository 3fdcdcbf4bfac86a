"""Cut forests of few long keys: each tree of a key is a piece of work of its own, so a key's events keep as many cores busy.

A tree's part of a displacement is a whole number, so parts add up to what ``forest.CutForest`` has, draw for draw.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from .bank import shingles
from .fold import runs
from .forest import CutForest, Forest, draws

#: Depths whose draws are made for many points at once, and how many points.
DEPTHS, POINTS = 16, 2048
#: Events that travel as one row, and keys (the longest) whose trees have a partition each.
PART, LONG = 128, 50


class CutTree:
    """One tree of a ``CutForest``: how far each point displaces others, as a whole number.

    A point outside a node's box is outside all boxes below it, so its displacement is the points at the first such node less
    those at the leaf, and cuts need be drawn from there on only. A point taken out shrinks a box where it lies on its rim.
    """

    def __init__(self, tree: int, size: int = 128, seed: int = 0):
        self.tree, self.size, self.seed, self.sequence, self.many = tree, size, seed, 0, 0
        n = 2 * (size + 1)
        self.dim, self.cut, self.left, self.right, self.parent, self.count = [-1] * n, [0.0] * n, [-1] * n, [-1] * n, [-1] * n, [0] * n
        self.lo, self.hi = [None] * n, [None] * n
        self.root, self.free, self.ring = -1, list(range(n - 1, -1, -1)), [-1] * size
        self.last, self.plain = None, None

    def run(self, points: np.ndarray) -> np.ndarray:
        """Each point's displacement less 1 (0 for the first), before it is put in; points are rows."""
        if not len(points):
            return np.zeros(0, np.int16)
        near = points if self.last is None else np.concatenate([self.last, points])
        self.last = near[-self.size - 1 :]
        if self.plain is None and not _clear(near):
            self.plain = self._as_forest()
        if self.plain is not None:
            return np.array([max(self.plain.add(p) - 1.0, 0.0) for p in points.tolist()]).astype(np.int16)
        steps = np.arange(self.sequence + 1, self.sequence + len(points) + 1)
        u = draws(self.seed, self.tree, steps[:, None], np.arange(DEPTHS)[None, :])
        return np.array(self._run(points.tolist(), u.ravel().tolist()), np.int16)

    def _as_forest(self) -> CutForest:
        """The same tree as a forest of one, which also takes points that are no numbers, or too near for their spans."""
        f = CutForest(1, self.size, self.seed, self.tree)
        f.sequence = self.sequence
        if self.root >= 0:
            width = self.last.shape[1]
            f._start(width)
            f.dim, f.cut, f.left, f.right, f.parent, f.count = self.dim, self.cut, self.left, self.right, self.parent, np.array(self.count)
            for v in range(len(self.dim)):
                if self.lo[v] is not None:
                    f.lo[v], f.hi[v] = self.lo[v], self.hi[v]
            f.roots, f.free = [self.root], [self.free]
            n = self.sequence
            f.leaves.extend([self.ring[i % self.size]] for i in range(max(n - self.size, 0), n))
        return f

    def _run(self, points: list[list[float]], u: list[float]) -> list[int]:
        dim, cut, left, right, parent, count, lo, hi, free, ring = self.dim, self.cut, self.left, self.right, self.parent, self.count, self.lo, self.hi, self.free, self.ring
        root, size, n, many, out = self.root, self.size, self.sequence, self.many, []
        most, base, every = len(points[0]) - 1, 0, range(len(points[0]))
        for p in points:
            at = n % size
            old = ring[at] if n >= size else -1
            n += 1
            v, depth, k = root, 0, 0
            if v < 0:
                root = leaf = free.pop()
                dim[leaf], parent[leaf], count[leaf], lo[leaf], hi[leaf] = -1, -1, 1, p, p
                ring[at] = leaf
                out.append(0)
                base += DEPTHS
                continue
            while True:  # nodes whose box holds the point
                for a, x, b in zip(lo[v], p, hi[v]):
                    if x < a or x > b:
                        break
                else:
                    count[v] += 1
                    k = dim[v]
                    if k < 0:
                        break
                    v = left[v] if p[k] <= cut[v] else right[v]
                    depth += 1
                    continue
                break
            if k < 0:  # an equal point is there
                leaf = v
                many += count[v] == 2
                out.append(0)
            else:
                held = count[v]
                while True:
                    low, high = lo[v], hi[v]
                    spans = [(b if b > x else x) - (a if a < x else x) for a, x, b in zip(low, p, high)]
                    ends = list(accumulate(spans))
                    total = ends[-1]
                    r = (u[base + depth] if depth < DEPTHS else float(draws(self.seed, self.tree, n, depth))) * total
                    k = bisect_right(ends, r)
                    if k > most:
                        k = most
                    x, a, b = p[k], low[k], high[k]
                    c = (a if a < x else x) + (r - (ends[k] - spans[k]))
                    if x <= c < a or b <= c < x:
                        break
                    d = dim[v]
                    if d < 0:  # a leaf is always parted; a cut rounded onto the upper value goes to the lower one
                        c = a if a < x else x
                        break
                    count[v] += 1
                    for i in every:
                        x = p[i]
                        if x < low[i]:
                            low[i] = x
                        elif x > high[i]:
                            high[i] = x
                    v = left[v] if p[d] <= cut[v] else right[v]
                    depth += 1
                if many:
                    w = v
                    while dim[w] >= 0:
                        w = left[w] if p[dim[w]] <= cut[w] else right[w]
                    out.append(held - count[w])
                else:
                    out.append(held - 1)
                w, leaf, g = free.pop(), free.pop(), parent[v]
                dim[leaf], parent[leaf], count[leaf], lo[leaf], hi[leaf] = -1, w, 1, p, p
                dim[w], cut[w], parent[w], count[w], parent[v] = k, c, g, count[v] + 1, w
                lo[w], hi[w] = [a if a < x else x for a, x in zip(low, p)], [b if b > x else x for b, x in zip(high, p)]
                if p[k] <= c:
                    left[w], right[w] = leaf, v
                else:
                    left[w], right[w] = v, leaf
                if g < 0:
                    root = w
                elif left[g] == v:
                    left[g] = w
                else:
                    right[g] = w
            base += DEPTHS
            ring[at] = leaf
            if old < 0:
                continue
            w = parent[old]
            if count[old] > 1 or w < 0:
                count[old] -= 1
                many -= count[old] == 1
                while w >= 0:
                    count[w] -= 1
                    w = parent[w]
                continue
            v, g, gone, rim = right[w] if left[w] == old else left[w], parent[w], lo[old], every
            parent[v] = g
            free.append(old)
            free.append(w)
            if g < 0:
                root = v
                continue
            if left[g] == w:
                left[g] = v
            else:
                right[g] = v
            while rim:  # where the point was on the rim, the box is that of the children
                count[g] -= 1
                low, high, v, w = lo[g], hi[g], left[g], right[g]
                still = []
                for i in rim:
                    x = gone[i]
                    if x == low[i]:
                        a, b = lo[v][i], lo[w][i]
                        if b < a:
                            a = b
                        if a != x:
                            low[i] = a
                            still.append(i)
                    elif x == high[i]:
                        a, b = hi[v][i], hi[w][i]
                        if b > a:
                            a = b
                        if a != x:
                            high[i] = a
                            still.append(i)
                rim, g = still, parent[g]
                if g < 0:
                    break
            while g >= 0:
                count[g] -= 1
                g = parent[g]
        self.root, self.sequence, self.many = root, n, many
        return out


def _clear(points: np.ndarray) -> bool:
    """Whether all are numbers, and so far apart that no difference to a third hides which of two is larger."""
    if not np.isfinite(points).all():
        return False
    s = np.sort(points, axis=0)
    gaps = np.diff(s, axis=0)
    with np.errstate(over="ignore"):
        span = s[-1] - s[0]
    return bool((span < 1e300).all() and ((gaps == 0) | (gaps > span * 2.0**-50)).all())


def _dealt(rows: DataFrame, keys: list, pieces: int = 1) -> DataFrame:
    """Rows in a partition for each of the keys, or for each of a key's trees; what has another key is dealt by hash."""
    rest = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) if len(keys) == LONG else 1
    tree = F.col("tree") if pieces > 1 else F.lit(0)
    at = F.pmod(F.hash("_key", tree), F.lit(rest)) + len(keys) * pieces
    for i, k in enumerate(keys):
        at = F.when(F.col("_key").eqNullSafe(F.lit(k)), i * pieces + tree).otherwise(at)
    return rows.repartitionById(len(keys) * pieces + rest, at.cast("int"))


def _parts(points: DataFrame, keys: list, width: int) -> DataFrame:
    """Each key's events in order, PART in a row: ids, which of them have a point, and the points' values end to end."""
    fields = _parse_datatype_string(f"_key {dict(points.dtypes)['_key']}, part long, ids array<long>, there array<boolean>, x array<double>")
    schema = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, part = object(), 0
        for b in batches:
            keys, edges, parts = b["_key"].to_pylist(), [], []
            for i, j in runs(keys):
                if keys[i] != last:
                    last, part = keys[i], 0
                for at in range(i, j, PART):
                    edges.append(at)
                    parts.append(part)
                    part += 1
            at, there = np.array([*edges, len(keys)], np.int32), b["point"].is_valid()
            ends = np.append(0, np.cumsum(there.to_numpy(zero_copy_only=False)) * width).astype(np.int32)
            lists = (pa.ListArray.from_arrays(pa.array(o), x) for o, x in ((at, b["event_id"]), (at, there), (ends[at], b["point"].flatten())))
            columns = [b["_key"].take(pa.array(edges, pa.int64())), pa.array(parts, pa.int64()), *lists]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return _dealt(points, keys).sortWithinPartitions("_key", "t", "event_id").mapInArrow(run, fields)


def _lists(column: pa.ListArray) -> list[np.ndarray]:
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy() - column.offsets[0].as_py()
    return [flat[i:j] for i, j in zip(ends[:-1], ends[1:])]


def forest_fold(
    events: DataFrame, start: Callable[[], object], judge: Callable, fields: str, key: str, point: str = "array(value)", width: int = 1, shingle: int = 1,
    trees: int = 10, size: int = 128, seed: int = 0,
) -> DataFrame:
    """event_id and what ``judge(state, displacement)`` returns for each event, in the order of t and event_id within a key.

    The displacement is that of ``CutForest.add`` for the last ``shingle`` values (none before there are so many) or the event's
    point. An event without a point, or with a null in it, gets nulls and leaves the state alone.

    A key's events are put in order once and copied for each tree; trees are dealt to partitions one by one, and their
    parts come together again in the key's order. The longest keys are counted when the query is built.
    """
    whole = f"CASE WHEN forall({point}, x -> x IS NOT NULL) THEN {point} END AS point"
    points = events.selectExpr(f"{key} AS _key", "t", "event_id", whole)
    keys = [r[0] for r in points.groupBy("_key").count().orderBy(F.desc("count"), "_key").limit(LONG).collect()]
    parts = _parts(points, keys, width)
    copies = parts.select("*", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    first = F.col("tree") == 0  # ids travel with one of the trees
    copies = copies.select("_key", "tree", "part", *(F.when(first, F.col(c)).alias(c) for c in ("ids", "there")), "x")
    kind = dict(copies.dtypes)["_key"]
    middle = f"_key {kind}, tree int, part long, ids array<long>, there array<boolean>, apart array<short>"
    arrow, out = to_arrow_schema(_parse_datatype_string(middle)), _parse_datatype_string(f"event_id long, {fields}")
    final = to_arrow_schema(out)

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, tree, held = object(), None, None
        for b in batches:
            names, xs, done = list(zip(b["_key"].to_pylist(), b["tree"].to_pylist())), _lists(b["x"]), []
            for i, j in runs(names):
                if names[i] != last:
                    last, tree, held = names[i], CutTree(names[i][1], size, seed), np.zeros(0)
                x = np.concatenate([held, *xs[i:j]])
                if shingle > 1:
                    held = x[max(len(x) - shingle + 1, 0) :]
                p = shingles(x, shingle) if shingle > 1 else x.reshape(-1, width)
                done.append(np.zeros(sum(len(v) // width for v in xs[i:j]) - len(p), np.int16))  # the first values end no shingle
                done += [tree.run(p[k : k + POINTS]) for k in range(0, len(p), POINTS)]
            ends = np.append(0, np.cumsum([len(v) // width for v in xs])).astype(np.int32)
            apart = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(done), pa.int16())) if xs else pa.array([], arrow.field("apart").type)
            yield pa.RecordBatch.from_arrays([*(b[c] for c in arrow.names[:-1]), apart.cast(arrow.field("apart").type)], schema=arrow)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, seen = object(), None, 0
        ids, there, total = None, None, None
        none = (None,) * (len(final) - 1)
        for b in batches:
            made, rows = [], []
            for k, t, i, w, a in zip(b["_key"].to_pylist(), b["tree"].to_pylist(), b["ids"], b["there"], _lists(b["apart"]), strict=True):
                if t == 0:
                    ids, there, total = i.values, w.values.to_pylist(), np.zeros(len(a), np.int64)
                total += a
                if t < trees - 1:
                    continue
                if k != last:
                    last, state, seen = k, start(), 0
                raws = iter((total / trees + 1.0).tolist())
                for has in there:
                    if not has:
                        rows.append(none)
                        continue
                    raw, seen = next(raws), seen + 1
                    rows.append(judge(state, None if seen < shingle else 0.0 if seen == shingle else raw))
                made.append(ids)
            if made:
                cols = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(made), *(pa.array(list(c), f.type) for c, f in zip(cols, list(final)[1:], strict=True))], schema=final)

    grown = _dealt(copies, keys, trees).sortWithinPartitions("_key", "tree", "part").mapInArrow(grow, _parse_datatype_string(middle))
    return _dealt(grown, keys).sortWithinPartitions("_key", "part", "tree").mapInArrow(judged, out)


def scores(events: DataFrame, key: str, point: str = "array(value)", width: int = 1, shingle: int = 1, seed: int = 0) -> DataFrame:
    """Score of each event's last ``shingle`` values, or of its point, in a random cut forest, as ``steps.forest`` has it."""

    def judge(f: Forest, raw: float | None) -> tuple:
        return (0.0, False) if raw is None else f.judge(raw)

    return forest_fold(events, Forest, judge, "score double, anomaly boolean", key, point, width, shingle, seed=seed)
