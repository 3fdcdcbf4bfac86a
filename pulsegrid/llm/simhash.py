"""Operator 4: SimHash near-duplicates with BK-trees.

Fingerprints at most ``radius`` bits apart agree on some of the blocks their bits are cut into
(pigeonhole), so each choice of agreeing blocks deals the distinct fingerprints into shards, and a link
shows up in at least one. A shard is searched with a BK-tree: children hang at their integer Hamming
distance from the parent, and a search follows only edges within the radius. Shard trees are dealt by a
shuffle, not broadcast, as their number grows with the input. Links make components in Spark.

The pipeline's stage (``one_of_each``) links texts by the Jaccard similarity of their shingles. Blocks that
reach its radius would be a few bits long, so its shards are dealt by bands of MinHashes; what a shard's
BK-tree finds within the radius is held against the exact similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from .common import by_key, discard, table, written

BITS = 64
#: Items of a tree's leaf, compared at once; fingerprints of a shard beyond which it is cut by more blocks.
LEAF, SHARD = 64, 8192
#: Agreeing blocks up to which shards are cut. Of 16 blocks 12 fix 48 bits, so a shard of distinct fingerprints then
#: holds 65,536 at most (512 kB), whatever the input.
MOST_AGREEING = 12
#: The stage's least Jaccard similarity, and the bits up to which fingerprints are compared exactly. Texts at 0.8 lie
#: some 10 bits apart (12 with four shingles against five), with a deviation of 3: beyond 28 is one pair in a million.
LEAST, WIDE = 0.8, 28
#: Shards of the stage: bands of so many MinHashes each. A pair at 0.8 shares none with a chance of (1 - 0.8^4)^24 = 3e-6.
BANDS, ROWS = 24, 4
#: Sets, and shingles of sets (8 bytes each), that a shard of the stage holds at most; larger ones are cut.
SETS, SHINGLES = 8192, 1_500_000
#: Row numbers (some 40 bytes each) that are broadcast, so that texts stay where they are; with more, texts are shuffled.
ROW_IDS = 2_000_000
_SALTS = np.random.default_rng(42).integers(0, 1 << 63, (2, BANDS * ROWS), np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingles(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``words`` words, of the whole text if it has fewer."""
    found = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not found:
        return np.zeros(0, "<u8")
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1]).tolist()
    ends = ends.tolist()[words - 1 :] or [len(joined)]
    return np.array([xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, ends, strict=False)], "<u8")


def fingerprint(text: str | None, words: int = 4) -> int:
    """SimHash of a text's shingles, as an unsigned number; 0 for a text without words."""
    return simhash(shingles(text, words))


def simhash(hashes: np.ndarray) -> int:
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, words) for t in b["text"].to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(fp)], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, fp long")


def block_masks(radius: int, agreeing: int) -> list[int]:
    """Masks of every choice of ``agreeing`` blocks out of as many as guarantee that some choice agrees."""
    n = radius + agreeing
    edges = [BITS * i // n for i in range(n + 1)]
    blocks = [((1 << b) - (1 << a)) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(blocks, agreeing)]


def _keyed(fps: DataFrame, masks: list[int], *within: str) -> DataFrame:
    signed = lambda m: m - (1 << BITS) if m >> (BITS - 1) else m
    keys = [F.xxhash64(*within, F.lit(i), F.col("fp").bitwiseAND(F.lit(signed(m)))) for i, m in enumerate(masks)]
    return fps.select("fp", F.explode(F.array(*keys)).alias("key"))


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


class BKTree:
    """A BK-tree over distinct fingerprints, searched for many queries at once."""

    def __init__(self, items: np.ndarray, radius: int):
        self.items, self.radius = items, radius
        self.nodes: list[tuple[int, dict[int, int], np.ndarray]] = []
        self.root = self._build(np.arange(len(items)))

    def _build(self, own: np.ndarray) -> int:
        at = len(self.nodes)
        if len(own) <= LEAF:
            self.nodes.append((-1, {}, own))
            return at
        self.nodes.append((0, {}, own[:0]))
        pivot, rest = int(own[0]), own[1:]
        d = _distance(self.items[rest], self.items[pivot])
        edges = {int(k): self._build(rest[d == k]) for k in np.unique(d)}
        self.nodes[at] = (pivot, edges, own[:0])
        return at

    def near(self, queries: np.ndarray, alive: np.ndarray) -> np.ndarray:
        """Alive items within the radius of any query; they are no longer alive."""
        found, stack = [], [(self.root, self.items[queries])]
        while stack:
            at, q = stack.pop()
            pivot, edges, leaf = self.nodes[at]
            if pivot < 0:
                leaf = leaf[alive[leaf]]
                for k in range(0, len(q) if len(leaf) else 0, 4096):
                    hit = leaf[(_distance(q[k : k + 4096, None], self.items[leaf][None, :]) <= self.radius).any(axis=0)]
                    alive[hit] = False
                    found.append(hit)
                    leaf = leaf[alive[leaf]]
                continue
            d = _distance(q, self.items[pivot]).astype(int)
            if alive[pivot] and (d <= self.radius).any():
                alive[pivot] = False
                found.append(np.array([pivot]))
            for edge, child in edges.items():
                near = np.abs(d - edge) <= self.radius
                if near.any():
                    stack.append((child, q[near]))
        return np.concatenate(found) if found else np.zeros(0, np.int64)


def shard_links(items: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """(fingerprint, smallest fingerprint of its component within the shard), for others than that one."""
    items = np.unique(items)
    u = items.view(np.uint64)
    if len(items) == 2:
        return [(int(items[1]), int(items[0]))] if _distance(u[0], u[1]) <= radius else []
    tree, alive, out = BKTree(u, radius), np.ones(len(items), bool), []
    for first in range(len(items)):
        if not alive[first]:
            continue
        alive[first] = False
        front = np.array([first])
        while len(front):
            front = tree.near(front, alive)
            out += [(int(items[i]), int(items[first])) for i in front]
    return out


def _shards(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            out: list[tuple[int, int]] = []
            keys, fps = batch["key"].to_numpy(), batch["fp"].to_numpy()
            cuts = [0, *(np.nonzero(np.diff(keys))[0] + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if key is not None and keys[a] != key:
                    if sum(map(len, held)) > 1:
                        out += shard_links(np.concatenate(held), radius)
                    held = []
                key = keys[a]
                held.append(fps[a:b])
            if out:
                yield _link_batch(out)
        if sum(map(len, held)) > 1 and (out := shard_links(np.concatenate(held), radius)):
            yield _link_batch(out)

    return run


def _link_batch(out: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*out, strict=True)
    return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """Rows (a, b), b < a, that connect distinct fingerprints (column fp) exactly as links within the radius do."""
    n = fps.count()
    agreeing = next((k for k in (1, 2, 3) if n >> (BITS * k // (radius + k)) <= 64), 4)
    keyed, out = _keyed(fps, block_masks(radius, agreeing)), None
    while True:
        keyed = written(keyed, "shards")
        heavy = keyed.groupBy("key").count().where(F.col("count") > SHARD)
        heavy = None if agreeing >= MOST_AGREEING else written(heavy, "heavy")
        if heavy is not None and heavy.isEmpty():
            heavy = None
        light = keyed if heavy is None else keyed.join(heavy, "key", "left_anti")
        found = light.repartition("key").sortWithinPartitions("key").mapInArrow(_shards(radius), "a long, b long")
        out = found if out is None else out.unionByName(found)
        if heavy is None:
            return written(out.distinct(), "links")
        agreeing = min(agreeing + 2, MOST_AGREEING)  # crowded shards are cut once more, by more blocks within them
        keyed = _keyed(keyed.join(heavy, "key", "left_semi"), block_masks(radius, agreeing), "key").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b) but the roots: root is the component's smallest node.

    Alternates large-star and small-star steps until nothing changes; every step is written to the
    shared folder.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    state = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "stars")
        now = tuple(e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("v", "u").cast("decimal(20,0)"))).first())
        if now == state:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fp and component_id (smallest doc_id that links reach) of every row.

    Null and empty texts have fingerprint zero and link like any other; rows may repeat ids and texts; a
    null doc_id gets a row but names no component (null for a component of such rows alone). Texts of any length are read
    whole. An empty table gives no rows. Other columns are ignored.
    """
    fps = written(fingerprints(docs, words), "fingerprints")
    distinct = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(distinct.select("fp"), radius))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    # Written, so that both sides of the join are plain shuffles and a fingerprint of very many rows can be split.
    known = written(rooted.join(named, "root").select("fp", "component_id"), "named")
    return fps.join(known, "fp").select("doc_id", "fp", "component_id")


def bands(hashes: np.ndarray) -> np.ndarray:
    """A key for each band of MinHashes of a set of shingles."""
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(hashes), 2048):
        part = hashes[at : at + 2048, None]
        np.minimum(least, ((part ^ _SALTS[0]) * _SALTS[1]).min(axis=0), out=least)
    rows = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), k) for k, r in enumerate(rows)], np.uint64).view(np.int64)


def _marked(words: int):
    """Adds to each row a key of its set of shingles (0 for none), the set's fingerprint, bands and size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, fp, keys, sizes = [], [], [], []
            for text in b["text"].to_pylist():
                own = np.unique(shingles(text, words))
                node.append(xxhash.xxh64_intdigest(own.tobytes(), 42) if len(own) else 0)
                fp.append(simhash(own) if len(own) else 0)
                keys.append(bands(own) if len(own) else None)
                sizes.append(len(own))
            added = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (node, fp)]
            added += [pa.array(keys, pa.list_(pa.int64())), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays([*b.columns, *added], names=["row", "id", "text", "node", "fp", "bands", "n"])

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(shingles(t, words)).tobytes() for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["node"], b["fp"], pa.array(sets, pa.binary())], names=["node", "fp", "set"])

    return run


def jaccard_links(nodes: np.ndarray, fps: np.ndarray, sets: list[np.ndarray], least: float = LEAST) -> list[tuple[int, int]]:
    """(node, smallest node of its component within the shard), for others than that one.

    Shingles are numbered within the shard, so that a set is held against thousands of others in one lookup.
    """
    order = np.argsort(nodes)
    nodes, fps = nodes[order], fps[order].view(np.uint64)
    sizes = np.array([len(sets[i]) for i in order])
    ends, ids = np.cumsum(sizes), np.concatenate([sets[i] for i in order])
    known = np.unique(ids)
    ids, marked = np.searchsorted(known, ids).astype(np.int32), np.zeros(len(known), bool)
    items, place = np.unique(fps, return_inverse=True)
    tree, alive, out = BKTree(items, WIDE), np.ones(len(nodes), bool), []

    def linked(at: int, others: np.ndarray) -> np.ndarray:
        """Those of ``others`` that reach the least similarity to ``at``."""
        upto = np.cumsum(sizes[others])
        cells = np.arange(upto[-1]) + np.repeat(ends[others] - upto, sizes[others])
        both = np.diff(np.concatenate([[0], np.cumsum(marked[ids[cells]])[upto - 1]]))
        return others[both >= least * (sizes[at] + sizes[others] - both) - 1e-9]

    for first in range(len(nodes)):
        if not alive[first]:
            continue
        alive[first], front = False, [first]
        while front and alive.any():
            at = front.pop()
            live, within = np.zeros(len(items), bool), np.zeros(len(items), bool)
            live[place[alive]] = True
            within[tree.near(place[at : at + 1], live)] = True
            likely = np.nonzero(alive & within[place] & (np.minimum(sizes, sizes[at]) >= least * np.maximum(sizes, sizes[at]) - 1e-9))[0]
            own = ids[ends[at] - sizes[at] : ends[at]]
            marked[own] = True
            for k in range(0, len(likely), 1024):
                found = linked(at, likely[k : k + 1024])
                alive[found] = False
                front += found.tolist()
                out += [(int(nodes[i]), int(nodes[first])) for i in found]
            marked[own] = False
    return out


def _listed(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """``rows`` with (left_semi) or without (left_anti) those whose number ``at`` is listed."""
    ids = written(ids.select("at"), "rows")
    return rows.join(F.broadcast(ids) if ids.count() <= ROW_IDS else ids, "at", how)


def similar_links(marked: DataFrame, words: int, least: float) -> DataFrame:
    """Rows (a, b), b < a, that connect sets of shingles (column node) as pairs of the least similarity do.

    A shard whose sets are more than a task should hold is cut into parts by hash, and each pair of parts is a shard, so that
    all pairs still meet.
    """
    sets = marked.where("bands IS NOT NULL").groupBy("node").agg(F.min("at").alias("at"), F.first("bands").alias("bands"), F.first("n").alias("n"))
    members = written(sets.select("node", "at", "n", F.explode("bands").alias("key")), "bands")
    signed = [F.sum(F.xxhash64(F.lit(i), "node").cast("decimal(20,0)")).alias(f"s{i}") for i in (0, 1)]
    parts = F.greatest(F.ceil(F.count("*") / SETS), F.ceil(F.sum("n") / SHINGLES)).cast("int").alias("parts")
    shards = members.groupBy("key").agg(F.count("*").alias("m"), parts, *signed).where("m > 1")
    shards = written(shards.groupBy("m", "s0", "s1").agg(F.min_by(F.struct("key", "parts"), "key").alias("k")).select("k.*"), "shards")  # equal shards once
    own = F.pmod(F.xxhash64("node", "key"), F.col("parts")).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.xxhash64("key", F.least(own, j), F.greatest(own, j)))
    held = written(members.join(shards, "key").select("node", "at", F.explode(blocks).alias("key")), "held")
    texts = _listed(marked, held.select("at").distinct(), "left_semi").select("node", "fp", "text")
    found = held.select("node", "key").join(texts.mapInArrow(_sets(words), "node long, fp long, set binary"), "node")
    dealt = found.repartition("key").sortWithinPartitions("key")

    def linked(node: pa.Array, fp: pa.Array, own: pa.Array) -> list[tuple[int, int]]:
        return jaccard_links(node.to_numpy(), fp.to_numpy(), [np.frombuffer(x, "<u8") for x in own.to_pylist()], least)

    out = written(dealt.mapInArrow(by_key(["node", "fp", "set"], linked), "a long, b long").distinct(), "links")
    discard(members, shards, held)
    return out


def one_of_each(docs: DataFrame, words: int = 5, least: float = LEAST) -> DataFrame:
    """One row of each group of near copies, all columns kept: the smallest doc_id (nulls last), then the smallest
    hash of the text.

    Near copies are what pairs with a Jaccard similarity of their shingles of ``least`` or more reach; texts
    without words are copies of each other. Rows without an id are rows like others. An empty table gives none. All
    columns but the text travel in one struct, so that columns of any name stay as they are.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"), F.col("doc_id").alias("id"), "text")
    schema = packed.select("*").schema.add("node", "long").add("fp", "long").add("bands", ArrayType(LongType())).add("n", "long")
    marked = packed.mapInArrow(_marked(words), schema).withColumn("at", F.monotonically_increasing_id())
    marked = written(marked.withColumn("h", F.xxhash64("text")), "marked")
    roots = components(similar_links(marked, words, least)).withColumnRenamed("node", "of")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "h", "at")
    nodes = marked.groupBy("node").agg(F.min(order).alias("first"))  # copies first, so that no group is crowded
    firsts = nodes.join(roots, F.col("node") == F.col("of"), "left").groupBy(F.coalesce("root", "node")).agg(F.min("first").alias("first"))
    # What goes is mostly less than what stays, so the rows that go are listed.
    gone = marked.select("at").join(firsts.select("first.at"), "at", "left_anti")
    kept = _listed(marked, gone, "left_anti")
    return kept.select(*[F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every row of ``documents`` (see ``near_duplicates``)."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
