"""Operator 12: documents linked by the Jaccard similarity of their word n-grams, through R-trees of count vectors.

A set of n-grams is a point: the numbers of its members in groups of hashes, finer groups for larger sets. The overlap
of two sets is at most the sum of their coordinates' minima, and of a set with anything in a box at most the sum of its
minima with the box's upper corner, so an R-tree search follows only boxes that can reach the overlap a link needs.
Boxes are of points folded to fewer groups; what a search finds is held against the bound by all groups. Texts of the
points that are left are sent to the same trees (of trees with the same points to one), and their pairs are verified on the sets themselves, so that no pair leaves
a task unless it is a link.

Points are dealt to trees by n-grams that a link must share: sets of similarity t share one of the n - ceil(tn) + 1 members
of each that have the smallest hashes. First, trees of the few smallest alone link copies to each other, star by star,
so that groups of copies become components. Then trees of all those n-grams look for links between different
components only; an n-gram within one component, or of sets whose sizes can't match, is left out. A few points are a single
leaf, and all leaves of a batch are searched at once. What a tree may hold is bounded: larger ones are cut
into blocks by size and hash, and every pair of blocks whose sizes can match is a tree of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_key, discard, table, written
from .simhash import components, shingles

WORDS, PERCENT = 4, 85
#: Smallest hashes that deal sets to the first trees.
FIRST = 6
#: Points of a tree's leaf, children of a box, groups of a point that are one coordinate of a box.
LEAF, FAN, FOLD = 32, 16, 8
#: Sets, and members of sets (8 bytes each), that a block of the first trees and of the others holds.
BLOCK, MEMBERS, COUNTED = 4096, 1_000_000, 2_000_000
#: Rows (some 40 bytes each) that are broadcast after counting; with more, both sides are shuffled.
ROWS = 1_000_000
#: Cells of a step of the search; few enough to stay in a core's cache.
STEP = 1 << 19


def prefix(n: int, percent: int = PERCENT) -> int:
    """How many smallest members of a set of ``n`` must hold one that any linked set's smallest hold too."""
    return n + (-percent * n) // 100 + 1


def groups(n: int) -> int:
    """Groups of a set of ``n``: two to four members each on average, a power of two."""
    return max(64, 1 << (n // 4).bit_length())


def point(members: np.ndarray) -> np.ndarray:
    """Numbers of members in each group, as bytes if they fit."""
    g = groups(len(members))
    counts = np.bincount((members & np.uint64(g - 1)).astype(np.int64), minlength=g)
    return counts.astype("u1" if counts.max(initial=0) < 256 else "<u2")


def packed(own: np.ndarray) -> bytes:
    """A point as half a byte a group if its numbers fit, else as it is."""
    return (own[::2] | own[1::2] << 4).tobytes() if own.max(initial=0) < 16 else own.tobytes()


def unpacked(raw: bytes, n: int) -> np.ndarray:
    g = groups(n)
    own = np.frombuffer(raw, "<u2" if len(raw) == 2 * g else "u1")
    return np.stack([own & 15, own >> 4], axis=1).ravel() if 2 * len(raw) == g else own


def folded(points: np.ndarray, width: int) -> np.ndarray:
    """Points of fewer groups: a group's number is the low end of its members' hashes."""
    return points.reshape(len(points), -1, width).sum(axis=1, dtype="<u2" if points.dtype == np.uint8 else "<u4") if width < points.shape[1] else points


def reach(overlap: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of sizes a and b that share ``overlap`` members are linked."""
    return (100 + percent) * overlap.astype(np.int64) >= percent * (a + b)


class RTree:
    """Points packed into boxes, level by level; a box is its upper corner and the sizes of its sets."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, percent: int):
        self.percent, self.width = percent, max(64, points.shape[1] // FOLD)
        coarse = folded(points, self.width)
        self.order = np.concatenate([np.zeros(0, np.int64), *self._packed(coarse, sizes, np.argsort(sizes, kind="stable"))])
        self.points, self.coarse, self.sizes = points[self.order], coarse[self.order], sizes[self.order]
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]] = []
        hi, low, high, fan = self.coarse, self.sizes, self.sizes, LEAF
        while len(hi) > 1 and (len(hi) > LEAF or not self.levels):
            cuts = np.arange(0, len(hi), fan)
            hi, low, high = np.maximum.reduceat(hi, cuts), np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts)
            self.levels.append((hi, low, high, fan))
            fan = FAN

    def _packed(self, points: np.ndarray, sizes: np.ndarray, own: np.ndarray) -> Iterator[np.ndarray]:
        """``own`` in an order in which neighbours are alike: halves by size while that differs much, then by the widest coordinate."""
        stack = [own]
        while stack:
            own = stack.pop()
            if len(own) <= LEAF:
                yield own
                continue
            half = (len(own) // 2 + LEAF - 1) // LEAF * LEAF
            if self.percent * sizes[own].max() <= 100 * sizes[own].min():
                some = points[own[:: max(1, len(own) // 256)]].astype(np.float32)
                own = own[np.argsort(points[own, some.var(axis=0).argmax()], kind="stable")]
            else:
                own = own[np.argsort(sizes[own], kind="stable")]
            stack += [own[half:], own[:half]]

    def _pass(self, q: np.ndarray, nq: np.ndarray, qi: np.ndarray, boxes: np.ndarray, low: np.ndarray, high: np.ndarray, at: np.ndarray) -> np.ndarray:
        n, keep = nq[qi], np.zeros(len(qi), bool)
        likely = np.nonzero((self.percent * low[at] <= 100 * n) & (100 * high[at] >= self.percent * n))[0]
        step = max(1, STEP // q.shape[1])
        for k in range(0, len(likely), step):
            r = likely[k : k + step]
            bound = np.minimum(q[qi[r]], boxes[at[r]]).sum(axis=1, dtype=np.int64)
            least = np.maximum(low[at[r]], -(-self.percent * n[r] // 100))
            keep[r] = reach(bound, n[r], least, self.percent)
        return keep

    def search(self, q: np.ndarray, nq: np.ndarray, skip=None) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, point) whose bound reaches a link; ``skip`` (of both) leaves pairs of points out."""
        top = len(self.levels[-1][0]) if self.levels else len(self.order)
        qi, at, near = np.repeat(np.arange(len(q)), top), np.tile(np.arange(top), len(q)), folded(q, self.width)
        for depth in range(len(self.levels) - 1, -1, -1):
            hi, low, high, fan = self.levels[depth]
            keep = self._pass(near, nq, qi, hi, low, high, at)
            below = len(self.levels[depth - 1][0]) if depth else len(self.order)
            qi, at = np.repeat(qi[keep], fan), (at[keep][:, None] * fan + np.arange(fan)[None, :]).ravel()
            inside = at < below
            qi, at = qi[inside], at[inside]
        if skip is not None:
            left = ~skip(qi, self.order[at])
            qi, at = qi[left], at[left]
        for a, b in ((near, self.coarse), (q, self.points)):
            keep = self._pass(a, nq, qi, b, self.sizes, self.sizes, at)
            qi, at = qi[keep], at[keep]
        return qi, self.order[at]


def classes(points: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each number of groups: its points' indexes and matrix, and those of the next finer points, folded to it."""
    width = np.array([len(p) for p in points])
    for g in np.unique(width):
        own, finer = np.nonzero(width == g)[0], np.nonzero(width == 2 * g)[0]
        below = folded(np.stack([points[i] for i in finer]), g) if len(finer) else np.zeros((0, g), "u1")
        yield own, np.stack([points[i] for i in own]), finer, below


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Members of two sorted sets in common."""
    if len(a) > len(b):
        a, b = b, a
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())


def stars(nodes: np.ndarray, sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links (a, b) that connect the given sets exactly as all links among them do."""
    out: list[tuple[int, int]] = []
    for own, matrix, finer, below in classes([point(s) for s in sets]):
        items, points = np.concatenate([own, finer]), np.concatenate([matrix, below])
        sizes = np.array([len(sets[i]) for i in items])
        alive, held = np.ones(len(items), bool), np.zeros(0, np.int64)
        tree = None
        for first in range(len(items)):
            if not alive[first]:
                continue
            alive[first], front = False, [first]
            while front:
                at = front.pop()
                left = np.count_nonzero(alive)
                if not left:
                    break
                if tree is None or 2 * left < len(held):  # what is linked need not be searched
                    held = np.nonzero(alive)[0]
                    tree = RTree(points[held], sizes[held], percent)
                _, found = tree.search(points[at : at + 1], sizes[at : at + 1])
                for i in held[found].tolist():
                    if alive[i] and reach(np.int64(overlap(sets[items[at]], sets[items[i]])), sizes[at], sizes[i], percent):
                        alive[i] = False
                        front.append(i)
                        out.append((int(nodes[items[i]]), int(nodes[items[at]])))
    return out


def candidates(
    nodes: np.ndarray, comps: np.ndarray, sizes: np.ndarray, places: np.ndarray, points: list[np.ndarray], side: np.ndarray, percent: int = PERCENT
) -> np.ndarray:
    """Pairs of nodes of different components whose bound reaches a link: those of side 0 (or 2) with side 1 (or 2).

    ``places`` tells how many members of each set come before the one that the tree stands for. If that is the first in
    common, these can't be, and pairs that then can't reach a link are left to the tree of their own first one.
    """
    out = []

    def skipped(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        least = -(-percent * (sizes[x] + sizes[y]) // (100 + percent))
        return (comps[x] == comps[y]) | (places[x] > sizes[x] - least) | (places[y] > sizes[y] - least)

    def pairs(qi: np.ndarray, q: np.ndarray, pi: np.ndarray, p: np.ndarray) -> None:
        asked, there = side[qi] != 1, side[pi] != 0
        qi, q, pi, p = qi[asked], q[asked], pi[there], p[there]
        if len(qi) and len(pi):
            tree = RTree(p, sizes[pi], percent)
            for k in range(0, len(qi), 64):
                own = qi[k : k + 64]
                a, b = tree.search(q[k : k + 64], sizes[own], lambda x, y, own=own: skipped(own[x], pi[y]))
                a, b = nodes[own[a]], nodes[pi[b]]
                out.append(np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], axis=1), axis=0))

    for own, matrix, finer, below in classes(points):
        pairs(own, matrix, own, matrix)
        pairs(finer, below, own, matrix)
        pairs(own, matrix, finer, below)
    return np.unique(np.concatenate([np.zeros((0, 2), np.int64), *out]), axis=0)


def in_leaves(
    key: np.ndarray, comp: np.ndarray, n: np.ndarray, place: np.ndarray, points: list[np.ndarray], side: np.ndarray, percent: int = PERCENT
) -> np.ndarray:
    """``candidates`` of many keys (in order) of few points each, all at once, as pairs of rows."""
    coarse = np.zeros((len(n), 64), "<u4")
    width = np.array([len(p) for p in points])
    for g in np.unique(width):
        at = np.nonzero(width == g)[0]
        coarse[at] = folded(np.stack([points[i] for i in at]), 64)
    cuts = np.append(np.nonzero(np.append(True, key[1:] != key[:-1]))[0], len(key))
    rest = np.repeat(cuts[1:], np.diff(cuts)) - np.arange(len(key)) - 1
    x = np.repeat(np.arange(len(key)), rest)
    y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(rest) - rest, rest)
    a, b = n[x], n[y]
    least = -(-percent * (a + b) // (100 + percent))
    keep = (comp[x] != comp[y]) & (np.minimum(a, b) * 100 >= percent * np.maximum(a, b)) & (place[x] <= a - least) & (place[y] <= b - least)
    keep &= ((side[x] != 1) & (side[y] != 0)) | ((side[y] != 1) & (side[x] != 0))
    x, y, least = x[keep], y[keep], least[keep]
    keep = np.concatenate([np.zeros(0, bool), *(np.minimum(coarse[x[k : k + STEP // 64]], coarse[y[k : k + STEP // 64]]).sum(axis=1) >= least[k : k + STEP // 64] for k in range(0, len(x), STEP // 64))])
    out = []
    for i, j, most in zip(x[keep].tolist(), y[keep].tolist(), least[keep].tolist(), strict=True):
        g = min(len(points[i]), len(points[j]))
        p, q = (folded(points[k][None, :], g)[0] for k in (i, j))
        if np.minimum(p, q).sum(dtype=np.int64) >= most:
            out.append((i, j))
    return np.array(out, np.int64).reshape(-1, 2)


#: What a block knows of a set besides its point.
_ROW = ["key", "node", "comp", "n", "place", "side"]


def _searched(percent: int):
    """For mapInArrow over rows of blocks sorted by key: those that have a candidate, without their points."""

    def of(rows: pa.RecordBatch) -> pa.RecordBatch:
        key, node, comp, n, place, side = (rows[c].to_numpy() for c in ("key", "node", "comp", "n", "place", "side"))
        place, met = place.astype(np.int64), np.zeros(len(rows), bool)
        points = [unpacked(x, size) for x, size in zip(rows["point"].to_pylist(), n.tolist(), strict=True)]
        cuts = np.append(np.nonzero(np.append(True, key[1:] != key[:-1]))[0], len(key))
        m = np.diff(cuts)
        for a, b in zip(cuts[:-1][m > 2 * LEAF].tolist(), cuts[1:][m > 2 * LEAF].tolist(), strict=True):
            met[a:b] = np.isin(node[a:b], candidates(node[a:b], comp[a:b], n[a:b], place[a:b], points[a:b], side[a:b], percent))
        few = np.nonzero(np.repeat((m > 1) & (m <= 2 * LEAF), m))[0]
        if len(few):
            met[few[in_leaves(key[few], comp[few], n[few], place[few], [points[i] for i in few], side[few], percent).ravel()]] = True
        return rows.select(_ROW).filter(pa.array(met))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not len(b):
                continue
            last = b["key"][-1].as_py()
            keys = b["key"].to_numpy()
            if held and keys[0] == keys[-1] == held[-1]["key"][-1].as_py():
                held.append(b)  # a key that goes on
                continue
            at = int(np.nonzero(keys == last)[0][0])
            rows = pa.concat_batches([*held, b.slice(0, at)])
            held = [b.slice(at)]
            if len(rows):
                yield of(rows)
        if held:
            yield of(pa.concat_batches(held))

    return run


def zipped(text: str | None) -> bytes:
    """A text to travel: its length and its bytes by zstd."""
    raw = (text or "").encode("utf-8", "replace")
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def unzipped(raw: bytes) -> str:
    return pa.Codec("zstd").decompress(raw[8:], int.from_bytes(raw[:8], "little"), asbytes=True).decode()


def _marked(words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, digests, tokens, points = [], [], [], []
            for text in b["text"].to_pylist():
                own = np.unique(shingles(text, words))
                n.append(len(own))
                digests.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None)
                tokens.append(own[: prefix(len(own), percent)].view(np.int64) if len(own) else None)
                points.append(packed(point(own)) if len(own) else None)
            texts = pa.array(map(zipped, b["text"].to_pylist()), pa.binary())
            added = [texts, pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(tokens, pa.list_(pa.int64())), pa.array(points, pa.binary())]
            yield pa.RecordBatch.from_arrays([b["doc_id"], *added], names=["doc_id", "text", "n", "digest", "tokens", "point"])

    return run


def _small(df: DataFrame, rows: int = ROWS) -> DataFrame:
    """A written table, broadcast if it is small enough."""
    return F.broadcast(df) if df.count() <= rows else df


def _nodes_of(*more: str) -> list[Column]:
    """Sums that tell which nodes (and what more of them) a key has."""
    return [F.sum(F.xxhash64(F.lit(i), "node", *more).cast("decimal(20,0)")).alias(f"s{i}") for i in (0, 1)]


def close_copies(nodes: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links among the sets that share one of their few smallest members."""
    members = written(nodes.select("node", "n", F.explode(F.slice("tokens", 1, FIRST)).alias("key")), "smallest")
    keys = members.groupBy("key").agg(F.count("*").alias("m"), F.sum("n").alias("n"), *_nodes_of()).where("m > 1")
    keys = written(keys.groupBy("m", "n", "s0", "s1").agg(F.min("key").alias("key")), "keys")  # keys of the same nodes once
    parts = F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("n") / MEMBERS)).alias("parts")
    part = F.pmod(F.xxhash64("node"), F.col("parts"))
    held = members.join(keys.select("key", parts), "key").select("node", F.xxhash64("key", part).alias("key"))
    held = written(held, "held")
    dealt = texts.join(_small(held), "node").repartition("key").sortWithinPartitions("key")

    def found(node: pa.Array, text: pa.Array) -> list[tuple[int, int]]:
        return stars(node.to_numpy(), [np.unique(shingles(unzipped(t), words)) for t in text.to_pylist()], percent)

    out = written(dealt.mapInArrow(by_key(["node", "text"], found), "a long, b long"), "stars")
    discard(members, keys, held)
    return out


def _blocks(held: DataFrame, percent: int) -> DataFrame:
    """node, place, key and side of all blocks a node of a key is in: bands of the key, or of large ones pairs of parts.

    Sizes are cut into bands so that linked sets are in one or in neighbours. A block is a band with the one above
    (side 1); one is left out if all its nodes are of one component or no pair can be linked by this key.
    A part is a band's share of hashes.
    """
    keys = held.groupBy("key").agg(F.count("*").alias("m"), F.sum("n").alias("n"))
    large = written(keys.where((F.col("m") > BLOCK) | (F.col("n") > COUNTED)).select("key"), "large")
    crowded = not large.isEmpty()
    light = held.join(_small(large), "key", "left_anti") if crowded else held
    band = F.col("band")
    both = F.array(*[F.struct(F.xxhash64("key", b).alias("key"), F.lit(s).alias("side")) for b, s in ((band, 2), (band - 1, 1))])
    each = light.select("node", "comp", "n", "place", F.explode(both).alias("x")).select("node", "comp", "n", "place", "x.*")
    # The smaller set of a pair must have its first member in common among so few.
    early = F.col("place") <= F.col("n") - F.ceil(2 * percent * F.col("n") / (100 + percent))
    live = each.groupBy("key").agg(
        F.count("*").alias("m"), F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.max("side").alias("own"), F.min(F.when(early, F.col("n"))).alias("least"), *_nodes_of()
    )
    live = live.where("m > 1 AND c0 != c1 AND own = 2 AND least IS NOT NULL")
    live = live.groupBy("m", "s0", "s1").agg(F.min_by(F.struct("key", "least"), "key").alias("k"), (F.count("*") > 1).alias("many"))
    live = written(live.select("k.*", "many"), "live")  # keys of the same nodes once, and for all of them: places no longer tell
    light = each.join(_small(live), "key").where(F.col("many") | early | (F.col("n") >= F.col("least")))
    light = light.select("node", F.when(F.col("many"), 0).otherwise(F.col("place")).alias("place"), "key", "side")
    if not crowded:
        return light
    rows = held.join(_small(large), "key")
    bands = rows.groupBy("key", "band").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / COUNTED)).cast("int").alias("parts"))
    bands = written(bands.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("band", "parts"))).alias("parts")), "bands")
    rows = rows.join(_small(bands), "key")
    upto = lambda b: F.coalesce(F.try_element_at("parts", b), F.lit(0))
    each = lambda n, body: F.transform(F.filter(F.sequence(F.lit(0), n), lambda j: j < n), body)
    own, at = F.pmod(F.xxhash64("node"), upto(band)).cast("int"), F.col("own")
    block = lambda low, high, i, j, side: F.struct(F.xxhash64("key", low, high, i, j).alias("key"), side.alias("side"))
    same = each(upto(band), lambda j: block(band, band, F.least(at, j), F.greatest(at, j), F.when(j == at, 2).when(at < j, 0).otherwise(1)))
    above = each(upto(band + 1), lambda j: block(band, band + 1, at, j, F.lit(0)))
    below = each(upto(band - 1), lambda j: block(band - 1, band, j, at, F.lit(1)))
    dealt = rows.withColumn("own", own).select("node", "place", F.explode(F.concat(same, above, below)).alias("x"))
    return light.unionByName(dealt.select("node", "place", "x.key", "x.side"))


def across(nodes: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links between sets of different components (column comp of nodes)."""
    postings = nodes.select("node", "comp", "n", F.posexplode("tokens").alias("place", "key"))
    mixed = postings.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x != y").select("key")
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(-np.log(percent / 100 - 0.01)))).cast("int").alias("band")
    held = written(postings.join(_small(written(mixed, "mixed")), "key").select("node", "comp", "n", "place", "key", band), "postings")
    blocks = written(_blocks(held, percent), "blocks")
    some = _small(written(blocks.select("node").distinct(), "some"))
    points = nodes.select("node", "comp", "n", "point").join(some, "node", "left_semi")

    dealt = blocks.join(points, "node").repartition("key").sortWithinPartitions("key")
    hits = written(dealt.mapInArrow(_searched(percent), "key long, node long, comp long, n long, place int, side int"), "hits")
    same = hits.groupBy("key").agg(F.count("*").alias("m"), *_nodes_of("side")).groupBy("m", "s0", "s1").agg(F.min("key").alias("key"), (F.count("*") > 1).alias("many"))
    once = hits.join(_small(written(same.select("key", "many"), "once")), "key")  # pairs that many keys found travel once
    once = written(once.withColumn("place", F.when(F.col("many"), 0).otherwise(F.col("place"))).drop("many"), "kept")
    dealt = texts.join(_small(once), "node").repartition("key").sortWithinPartitions("key")

    def found(node: pa.Array, comp: pa.Array, n: pa.Array, place: pa.Array, side: pa.Array, text: pa.Array) -> list[np.ndarray]:
        node, comp, n, place, side = (x.to_numpy() for x in (node, comp, n, place, side))
        sets = dict(zip(node.tolist(), (np.unique(shingles(unzipped(t), words)) for t in text.to_pylist()), strict=True))
        pairs = candidates(node, comp, n, place.astype(np.int64), [point(sets[k]) for k in node.tolist()], side, percent)
        linked = [reach(np.int64(overlap(x, y)), len(x), len(y), percent) for x, y in ((sets[a], sets[b]) for a, b in pairs.tolist())]
        return pairs[np.array(linked, bool)]

    out = written(dealt.mapInArrow(by_key(["node", "comp", "n", "place", "side", "text"], found), "a long, b long").distinct(), "verified")
    discard(held, blocks, hits, once)
    return out


def similar_documents(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links reach) of every row.

    A link joins sets of which 100 times the intersection is at least ``percent`` times the union. Equal sets are one
    node, so copies are linked without pairs. A null text, or one without words, has an empty set and is linked with nothing;
    a text of fewer words is one shingle. Rows may repeat ids and texts; a null doc_id gets a row but names no component
    (null for a component of such rows alone). Texts of any length are read whole. An empty table gives no rows; other
    columns are ignored, whatever their names.
    """
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, text binary, n long, digest binary, tokens array<long>, point binary"
    marked = docs.select("doc_id", "text").mapInArrow(_marked(words, percent), schema).withColumn("row", F.monotonically_increasing_id())
    marked = written(marked, "marked")
    named = written(marked.where("digest IS NOT NULL").groupBy("digest").agg(F.min("row").alias("node"), F.min("doc_id").alias("least")), "named")
    one = _small(named.select("node"))
    texts = marked.withColumnRenamed("row", "node").select("node", "text").join(one, "node", "left_semi")
    nodes = marked.withColumnRenamed("row", "node").select("node", "n", "tokens", "point").join(one, "node", "left_semi")
    links = close_copies(nodes, texts, words, percent)
    roots = components(links)
    known = nodes.join(_small(written(roots, "roots")), "node", "left").withColumn("comp", F.coalesce("root", "node"))
    more = across(known, texts, words, percent)
    if not more.isEmpty():
        roots = components(links.unionByName(more))
    rooted = named.join(roots, "node", "left").select("digest", "least", F.coalesce("root", "node").alias("root"))
    first = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = written(rooted.join(first, "root").select("digest", "component_id"), "ids")  # a digest of many rows can be split
    full = marked.where("digest IS NOT NULL").join(ids, "digest").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    empty = marked.where("digest IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return full.unionByName(empty)


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles and component of every row of ``documents`` (see ``similar_documents``)."""
    return similar_documents(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(w[i:i + 3], ' '))) AS g FROM d WHERE len(w) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
i AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r(id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT l.b, r.c FROM r JOIN l ON r.id = l.a WHERE r.c < l.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT id, min(c) AS c FROM r GROUP BY 1) m ON m.id = d.doc_id
"""
