"""Operator 13: how five quality filters interact, with a counting-Bloom prepass for exact duplicates.

Each task counts hashes of its texts in a counting Bloom sketch (counters 0, 1, and 2 for more), cut into blocks; the
blocks of all tasks are merged. A text with a counter of 1 is met once: it is surely unique. Only texts that the sketch
can't clear are shuffled, whole, for the smallest id of equal texts. Each document then is a mask of the filters
it fails, and counts of masks add up to every figure of every order.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

LETTERS = "ABCDE"
#: Counters a text sets, counters for each row, and the bounds of their number, a power of two: two bits a counter, so
#: that a sketch has 32 MB at most and can be broadcast. Beyond 2^24 rows it clears fewer texts and more are shuffled.
HASHES, PER_ROW, LEAST, MOST = 3, 8, 1 << 16, 1 << 27
#: Counters of a block.
BLOCK = 1 << 16
_SIGNS = "#$%&*|"
_UPPER = bytes(range(65, 91))
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def cells(hashes: np.ndarray, size: int) -> np.ndarray:
    """The counters of each hash (one row a counter) in a sketch of ``size``, a power of two."""
    h = hashes.view(np.uint64)
    shift = np.uint64(64 - (size.bit_length() - 1))
    return np.stack([((h ^ (h >> np.uint64(29))) * odd) >> shift for odd in _ODD[:HASHES]]).astype(np.int64)


def sized(rows: int) -> int:
    return min(max(1 << max(rows * PER_ROW - 1, 1).bit_length(), LEAST), MOST)


def _counted(size: int):
    """(block, once, more) of the blocks a task has counted in, as bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(size, np.uint8)
        for b in batches:
            at = cells(b["h"].to_numpy(), size)
            # The counters of one text are added once each, though two of its hashes may agree.
            at = np.sort(at, axis=0)
            fresh = np.concatenate([np.ones((1, at.shape[1]), bool), at[1:] != at[:-1]])
            where, n = np.unique(at[fresh], return_counts=True)
            counters[where] = np.minimum(2, counters[where] + np.minimum(n, 2))
        blocks = counters.reshape(-1, BLOCK)
        for k in np.nonzero(blocks.any(axis=1))[0].tolist():
            once, more = (np.packbits(blocks[k] >= least).tobytes() for least in (1, 2))
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([once]), pa.array([more])], names=["block", "once", "more"])

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the sketches of each block; only the bits of counters above one are needed further on."""

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([more.tobytes()])], names=["block", "more"])

    block, once, more = None, None, None
    for b in batches:
        for k, o, m in zip(*(b[c].to_pylist() for c in ("block", "once", "more")), strict=True):
            o, m = np.frombuffer(o, np.uint8), np.frombuffer(m, np.uint8)
            if k != block:
                if block is not None:
                    yield done()
                block, once, more = k, o, m
            else:
                once, more = once | o, more | m | (once & o)
    if block is not None:
        yield done()


def repeated_counters(docs: DataFrame) -> tuple[int, np.ndarray]:
    """The sketch's size and the bits of its counters above one, over all texts (null: empty)."""
    spark = docs.sparkSession
    size = sized(docs.count())
    hashes = docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    # A task makes one sketch, so there are no more tasks than can run at once, four times over.
    hashes = hashes.coalesce(4 * spark.sparkContext.defaultParallelism)
    blocks = hashes.mapInArrow(_counted(size), "block long, once binary, more binary")
    merged = blocks.repartition("block").sortWithinPartitions("block").mapInArrow(_merged, "block long, more binary")
    bits = np.zeros(size // 8, np.uint8)
    for k, more in merged.toLocalIterator():  # size / 8 bytes in all, 16 MB at most
        bits[k * BLOCK // 8 : (k + 1) * BLOCK // 8] = np.frombuffer(more, np.uint8)
    return size, bits


def failed(text: str) -> int:
    """Mask of the filters A to D that a text fails (A is 1)."""
    raw = text.encode()
    words = raw.split()
    return (
        (len(words) < 50)
        + 2 * (100 * len(set(words)) < 65 * len(words))
        + 4 * (100 * (len(raw) - len(raw.translate(None, _UPPER))) > 5 * len(text))
        + 8 * any(sign in text for sign in _SIGNS)
    )


def _flagged(size: int, sketch: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sketch.value
        for b in batches:
            at = cells(b["h"].to_numpy(), size)
            unsure = (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).all(axis=0)
            masks = pa.array([failed(t) for t in b["text"].to_pylist()], pa.int32())
            kept = pc.if_else(pa.array(unsure), b["text"], pa.scalar(None, pa.string()))
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["part"], masks, kept], names=["doc_id", "part", "mask", "repeat"])

    return run


def masks(docs: DataFrame) -> DataFrame:
    """doc_id, part and mask (the filters failed, A is 1 and E is 16) of every row.

    A null text is empty and a null source the empty part. A row fails E if a smaller doc_id has the same text; a null
    doc_id counts as larger than any other, and rows of one id are no duplicates of each other. An empty table gives no
    rows; other columns are ignored, whatever their names.
    """
    kind = dict(docs.dtypes)["doc_id"]
    docs = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    size, bits = repeated_counters(docs)
    rows = docs.withColumn("h", F.xxhash64("text")).mapInArrow(
        _flagged(size, docs.sparkSession.sparkContext.broadcast(bits)), f"doc_id {kind}, part string, mask int, repeat string"
    )
    rows = written(rows, "flagged")
    unsure = rows.where("repeat IS NOT NULL")
    # Equal texts meet after a combine in each task, so a text of very many rows is one row a task.
    least = unsure.groupBy("repeat").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1 AND least IS NOT NULL")
    least = written(least.drop("n"), "least")  # so that the join reads plain shuffles and a text of many rows can be split
    again = F.coalesce(F.col("doc_id") > F.col("least"), F.col("least").isNotNull())
    found = unsure.join(least, "repeat", "left").select("doc_id", "part", (F.col("mask") + F.when(again, 16).otherwise(0)).alias("mask"))
    return rows.where("repeat IS NULL").select("doc_id", "part", "mask").unionByName(found)


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good and toxic: numbers of rows by the filters they fail.

    A document is good (toxic) if any of its labels says so; one without labels is neither.
    """
    labels = labels.where("doc_id IS NOT NULL").groupBy("doc_id")
    labels = labels.agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    found = masks(docs).join(labels, "doc_id", "left").groupBy("part", "mask")
    return found.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("good", "toxic")])


def _steps() -> Column:
    """Order o, step s, the step's filter f and those before it, p, as masks, for all orders."""
    steps = []
    for order in map("".join, permutations(LETTERS)):
        bits = [1 << LETTERS.index(c) for c in order]
        steps += [{"o": order, "s": k + 1, "f": b, "p": sum(bits[:k])} for k, b in enumerate(bits)]
    return F.from_json(F.lit(json.dumps(steps)), "array<struct<o string, s int, f int, p int>>")


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts of every part, filter order and step (see ``masks`` for the rows and their edge cases).

    A part's masks are at most 32 rows; they are gathered and every figure is a sum over them.
    """
    counts = written(mask_counts(docs, labels), "masks")
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("m"))
    rows = parts.select("part", "m", F.explode(_steps()).alias("at")).select("part", "m", "at.*")

    def total(what: str, where) -> Column:
        return F.aggregate(F.filter("m", where), F.lit(0).cast("long"), lambda s, x: s + x[what])

    own = lambda x: x["mask"].bitwiseAND(F.col("f")) != 0
    before = lambda x: x["mask"].bitwiseAND(F.col("p")) != 0
    share = lambda x: F.lit(120) / F.bit_count(x["mask"])  # noqa: E731  orders in which a filter comes first of those that fail
    return rows.select(
        "part",
        F.col("o").alias("filter_order"),
        F.col("s").alias("step"),
        total("n", lambda x: ~own(x) & ~before(x)).alias("kept"),
        total("n", lambda x: own(x) & ~before(x)).alias("removed"),
        total("n", lambda x: own(x) & before(x)).alias("redundant"),
        total("n", lambda x: x["mask"] == F.col("f")).alias("unique_fails"),
        total("good", lambda x: own(x) & ~before(x)).alias("good_lost"),
        total("toxic", lambda x: own(x) & ~before(x)).alias("toxic_lost"),
        F.aggregate(F.filter("m", own), F.lit(0).cast("long"), lambda s, x: s + x["n"] * share(x).cast("long")).alias("shapley"),
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the five filters interact over ``documents`` and their ``labels`` (see ``interactions``)."""
    return interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP13_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
k AS (SELECT doc_id, part, (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT
  + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t))::INT
  + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * (doc_id > least)::INT AS mask FROM w),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY 1),
m AS (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM k LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
o(ord, step, f, p) AS (
  SELECT c, 1, 1 << (ascii(c) - 65), 0 FROM (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c)
  UNION ALL SELECT ord || c, step + 1, 1 << (ascii(c) - 65), p | f FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c) WHERE NOT contains(ord, c)),
s AS (SELECT full_.ord, o.step, o.f, o.p FROM o AS full_, o WHERE full_.step = 5 AND starts_with(full_.ord, o.ord))
SELECT part, ord AS filter_order, step::INT AS step, coalesce(sum(n) FILTER (mask & (f | p) = 0), 0)::BIGINT AS kept,
  coalesce(sum(n) FILTER (mask & f <> 0 AND mask & p = 0), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (mask & f <> 0 AND mask & p <> 0), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (mask = f), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (mask & f <> 0 AND mask & p = 0), 0)::BIGINT AS good_lost,
  coalesce(sum(toxic) FILTER (mask & f <> 0 AND mask & p = 0), 0)::BIGINT AS toxic_lost,
  coalesce(sum(n * (120 // greatest(bit_count(mask::INT), 1))) FILTER (mask & f <> 0), 0)::BIGINT AS shapley
FROM m, s GROUP BY part, ord, step, f, p
"""
