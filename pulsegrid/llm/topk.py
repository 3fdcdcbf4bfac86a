"""Operator 2: exact top-k by inner product, block at a time.

A task sorts its documents by the nearest of some fixed vectors and cuts them into blocks of such neighbours; a block
keeps its vectors (the forward index) and the largest and smallest value of every component. For a query the block
bound is the sum over components of the larger product. Blocks are scored in order of falling bounds until the bound
is below the k-th score so far, which starts at the k-th best of a small sample of the documents and is carried from
group to group. Queries go to the tasks in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import scratch, table, written

#: Rows of a block, blocks ordered together, and bytes of the queries that are broadcast at once.
BLOCK, GROUP, QUERY_BYTES = 128, 256, 32 << 20
#: Vectors that neighbours are told by, and documents whose scores give each query its first k-th score (a lower bound
#: only: these documents are scored again in their blocks).
PIVOTS, FIRST = 64, 2048


def quantised(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id and floor(1024 * x) of every component; vectors null or with null or non-finite components go."""
    x = F.col(embedding)
    ok = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    return vectors.where(F.col(vec_id).isNotNull() & x.isNotNull() & ok).select(
        F.col(vec_id).cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v.cast("double") * 1024)).alias("v")
    )


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b of integers, exact: in floating point where no sum can leave its exact range."""
    if not len(a) or not b.size:
        return np.zeros((len(a), b.shape[1]), np.int64)
    if float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2**53:
        return (a.astype(float) @ b.astype(float)).astype(np.int64)
    return a @ b


def search_blocks(q_id: np.ndarray, q: np.ndarray, blocks: list[tuple[np.ndarray, np.ndarray]], k: int, kth: np.ndarray | None = None):
    """The best k of the blocks per query, by falling score and rising id, as (query row, vec_id, score); the number of (query, block) scored.

    Scores below ``kth``, each query's k-th score so far, are left out.
    """
    least = np.iinfo(np.int64).min
    kth = np.full(len(q), least) if kth is None else kth
    best_s, best_i = np.full((len(q), k), least), np.full((len(q), k), np.iinfo(np.int64).max)
    high = np.array([b.max(axis=0) for _, b in blocks]).T
    low = np.array([b.min(axis=0) for _, b in blocks]).T
    bound = _product(np.maximum(q, 0), high) + _product(np.minimum(q, 0), low)
    order = np.argsort(-bound, axis=1, kind="stable")
    rows, scored = np.arange(len(q)), 0
    for r in range(len(blocks)):
        own = order[:, r]
        open_ = bound[rows, own] >= np.maximum(best_s[:, -1], kth)  # an equal score can still win by its id
        if not open_.any():
            break
        scored += int(open_.sum())
        for j in np.unique(own[open_]):
            at = rows[open_ & (own == j)]
            ids, vecs = blocks[j]
            s = _product(q[at], vecs.T)
            s[ids[None, :] == q_id[at, None]] = least
            hit = (s >= np.maximum(best_s[at, -1:], kth[at, None])).any(axis=1) & (s > least).any(axis=1)
            at, s = at[hit], s[hit]
            all_s = np.hstack([best_s[at], s])
            all_i = np.hstack([best_i[at], np.where(s == least, np.iinfo(np.int64).max, ids[None, :])])
            pick = np.lexsort((all_i, -all_s.clip(least + 1)), axis=1)[:, :k]
            best_s[at], best_i[at] = np.take_along_axis(all_s, pick, 1), np.take_along_axis(all_i, pick, 1)
    row, col = np.nonzero((best_i != np.iinfo(np.int64).max) & (best_s >= kth[:, None]))
    return (row, best_i[row, col], best_s[row, col]), scored


def first_kth(q_id: np.ndarray, q: np.ndarray, ids: np.ndarray, vecs: np.ndarray, k: int) -> np.ndarray:
    """Each query's k-th best score among some documents other than itself; the least number where those are fewer."""
    least = np.iinfo(np.int64).min
    out = np.full(len(q), least)
    for at in range(0, len(q) if len(ids) > k else 0, 4096):
        s = _product(q[at : at + 4096], vecs.T)
        s[ids[None, :] == q_id[at : at + 4096, None]] = least
        out[at : at + 4096] = np.partition(s, -k, axis=1)[:, -k]
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k best other rows.

    Vectors of one width are compared with each other (a query has no score with another width); empty
    vectors take no part. Repeated ids are rows of their own, and no row of the query's own id is a
    candidate; equal rows take consecutive ranks, and ties go to the smaller id. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = written(vectors.withColumn("width", F.size("v")).where("width > 0").select("vec_id", "width", "v", is_query.alias("q")), "vectors")
    shapes = rows.where("q").groupBy("width").agg(F.count("*").alias("n")).orderBy("width").collect()
    path = scratch(spark, "found")
    schema = "query_id long, vec_id long, score long"
    spark.createDataFrame([], schema).write.parquet(path)
    for width, n in shapes:
        per = max(1, QUERY_BYTES // (8 * width))
        parts = max(1, -(-n // per))
        same = rows.where(F.col("width") == width)
        sample = same.select("vec_id", "v").limit(FIRST).toArrow()
        some = sample["vec_id"].to_numpy(), _matrix(sample["v"].combine_chunks(), width)
        for part in range(parts):  # a pass over the vectors for each block of queries; each writes, so that no plan grows
            block = same.where(F.col("q") & (F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == part)).select("vec_id", "v").distinct().toArrow()
            if block.num_rows:
                q_id, q = block["vec_id"].to_numpy(), _matrix(block["v"].combine_chunks(), width)
                _pass(same, q_id, q, some, k).write.mode("append").parquet(path)
    found = spark.read.schema(schema).parquet(path)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _pass(rows: DataFrame, q_id: np.ndarray, q: np.ndarray, some: tuple[np.ndarray, np.ndarray], k: int) -> DataFrame:
    kth = first_kth(q_id, q, *some, k)
    shared = rows.sparkSession.sparkContext.broadcast((q_id, q, kth, some[1][:: max(1, len(some[1]) // PIVOTS)]))
    width = q.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vecs, kth, pivots = shared.value
        kth = kth.copy()
        best: list[tuple] = []
        for group in _groups(batches, width, pivots):
            best.append(search_blocks(ids, vecs, group, k, kth)[0])
            # Merge what the groups gave to k rows a query, and carry the k-th score on.
            row, i, s = (np.concatenate(x) for x in zip(*best, strict=True))
            order = np.lexsort((i, -s, row))
            row, i, s = row[order], i[order], s[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            kth[row[place == k - 1]] = s[place == k - 1]
            best = [(row[place < k], i[place < k], s[place < k])]
        for row, i, s in best:
            yield pa.RecordBatch.from_pydict({"query_id": ids[row], "vec_id": i, "score": s})

    return rows.select("vec_id", "v").mapInArrow(run, "query_id long, vec_id long, score long")


def blocks_of(ids: np.ndarray, vecs: np.ndarray, pivots: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Blocks of neighbours: rows sorted by their nearest pivot."""
    if len(pivots):
        norms = (pivots.astype(float) ** 2).sum(axis=1)
        near = np.argmin(norms - 2.0 * (vecs.astype(float) @ pivots.T.astype(float)), axis=1)
        order = np.argsort(near, kind="stable")
        ids, vecs, near = ids[order], vecs[order], near[order]
        cuts = [0, *(np.nonzero(np.diff(near))[0] + 1).tolist(), len(ids)]
    else:
        cuts = [0, len(ids)]
    return [(ids[at : min(at + BLOCK, b)], vecs[at : min(at + BLOCK, b)]) for a, b in zip(cuts, cuts[1:], strict=False) for at in range(a, b, BLOCK)]


def _groups(batches: Iterator[pa.RecordBatch], width: int, pivots: np.ndarray) -> Iterator[list[tuple[np.ndarray, np.ndarray]]]:
    """Blocks of some BLOCK * GROUP rows at a time: what a task holds besides the queries."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        held.append((batch["vec_id"].to_numpy(), _matrix(batch["v"], width)))
        if sum(len(x[0]) for x in held) >= BLOCK * GROUP:
            yield blocks_of(*map(np.concatenate, zip(*held, strict=True)), pivots)
            held = []
    if sum(len(x[0]) for x in held):
        yield blocks_of(*map(np.concatenate, zip(*held, strict=True)), pivots)


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best other rows of ``embeddings`` for each query among them (see ``top_k``)."""
    vectors = quantised(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, F.col("vec_id") % 100 == 0)


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, d.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * d.v[i])) AS BIGINT) AS score
  FROM v AS q JOIN v AS d ON q.vec_id <> d.vec_id AND len(q.v) = len(d.v) AND q.vec_id % 100 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
