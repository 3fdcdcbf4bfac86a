"""Operator 11: vectors as short codes, by product quantisation with active-entry Lloyd rounds.

A table of whole-number vectors carries each part's entry and exact distance from round to round. A part whose
entry stayed where it was is held only against the entries that moved, as all others are no nearer than before; a
part whose entry moved is held against all. Every task adds up its parts by entry in one extra row, so a round is one pass
over the table and one small sum. Codebooks are few numbers, whatever the input.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, table, written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Whole components are held within this bound, so that squared distances fit a long.
BOUND = 1 << 27
#: Labels whose sums are broadcast (some 30 bytes each); with more they are joined by a shuffle.
LABELS = 500_000


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of each row of ``x`` to each entry."""
    return ((x[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)


def assign(vecs: np.ndarray, codes: np.ndarray, dists: np.ndarray, books: np.ndarray, moved: np.ndarray) -> int:
    """Bring ``codes`` and ``dists`` (a row a vector, a column a part) up to date with the codebooks, in place.

    ``moved`` tells which entries of each part differ from those that codes and distances stand for; where all did,
    nothing of before is used. Ties go to the lower index. Returns the number of distances computed.
    """
    done = 0
    for p in range(vecs.shape[1]):
        x, code, dist = vecs[:, p], codes[:, p], dists[:, p]
        again = moved[p][code]
        rows, active = np.nonzero(~again)[0], np.nonzero(moved[p])[0]
        if len(rows) and len(active):
            d = distances(x[rows], books[p][active])
            best = d.argmin(axis=1)
            least, entry = d[np.arange(len(rows)), best], active[best]
            nearer = (least < dist[rows]) | ((least == dist[rows]) & (entry < code[rows]))
            code[rows[nearer]], dist[rows[nearer]] = entry[nearer], least[nearer]
            done += d.size
        rows = np.nonzero(again)[0]
        if len(rows):
            d = distances(x[rows], books[p])
            code[rows], dist[rows] = d.argmin(axis=1), d.min(axis=1)
            done += d.size
    return done


def sums(vecs: np.ndarray, codes: np.ndarray, entries: int) -> np.ndarray:
    """Number and component sums of the parts of each entry: (part, entry, 1 + width)."""
    n, parts, width = vecs.shape
    out = np.zeros((parts, entries, 1 + width), np.int64)
    for p in range(parts):
        for e in range(entries):
            own = vecs[codes[:, p] == e, p]
            out[p, e, 0], out[p, e, 1:] = len(own), own.sum(axis=0)
    return out


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list for each row of ``values``; there may be none, as a batch can hold only what is dropped."""
    ends = np.arange(len(values) + 1, dtype=np.int32) * math.prod(values.shape[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.reshape(-1), kind))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def whole(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows hold ``width`` finite components, and these rows' components as whole numbers."""
    sizes = column.value_lengths().fill_null(0).to_numpy()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    bad = np.bincount(np.repeat(np.arange(len(sizes)), sizes), ~np.isfinite(flat), len(sizes)) > 0
    kept = (sizes == width) & ~bad
    values = flat[np.repeat(kept, sizes)].reshape(-1, width)
    return kept, np.clip(np.floor(values * SCALE), -BOUND, BOUND).astype(np.int64)


class _Round:
    """One pass: assigns every row anew and ends with a row of the task's sums."""

    def __init__(self, books: np.ndarray, moved: np.ndarray, first: bool, names: list[str]):
        self.books, self.moved, self.first, self.names = books, moved, first, names

    def state(self, b: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]:
        parts, _, width = self.books.shape
        if self.first:
            kept, vecs = whole(b["vector"], parts * width)
            b = b.filter(pa.array(kept))
            codes, dists = (np.zeros((len(vecs), parts), np.int64) for _ in range(2))
        else:
            vecs, codes, dists = _matrix(b["vec"], parts * width), _matrix(b["codes"], parts), _matrix(b["dists"], parts)
        vecs = vecs.reshape(-1, parts, width)
        assign(vecs, codes, dists, self.books, self.moved)
        return b, vecs, codes, dists

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, row = 0, None
        for b in batches:
            b, vecs, codes, dists = self.state(b)
            total = total + sums(vecs, codes, self.books.shape[1])
            lists = [_lists(vecs, pa.int32()), _lists(codes, pa.int32()), _lists(dists, pa.int64())]
            out = [b["vec_id"], b["label"], *lists, pa.nulls(len(b), pa.list_(pa.int64()))]
            row = row or [x.type for x in out]
            yield pa.RecordBatch.from_arrays(out, names=self.names)
        if row:
            none = [pa.nulls(1, kind) for kind in row[:-1]]
            yield pa.RecordBatch.from_arrays([*none, pa.array([np.ravel(total).tolist()], row[-1])], names=self.names)


class _Last(_Round):
    """The pass after the last round: codes as text and errors."""

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b, _, codes, dists = self.state(b)
            text = pa.array([bytes(c).hex() for c in codes.astype(np.uint8)], pa.string())
            yield pa.RecordBatch.from_arrays([b["vec_id"], b["label"], text, pa.array(dists.sum(axis=1))], names=self.names)


def seeds(rows: DataFrame, parts: int, entries: int) -> np.ndarray | None:
    """The codebooks that the smallest kept vec_ids start (part, entry, component); None without any kept row."""
    x = F.col("vector")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    good = rows.where(x.isNotNull() & (F.size(x) > 0) & (F.size(x) % parts == 0)).where(finite)
    order = [F.col("vec_id").asc_nulls_last(), F.col("vector")]
    first = good.orderBy(*order).select("vector").first()
    if first is None:
        return None
    width = len(first[0])
    found = good.where(F.size(x) == width).orderBy(*order).limit(entries).select("vector").collect()
    values = np.array([np.clip(np.floor(np.array(r[0], np.float64) * SCALE), -BOUND, BOUND) for r in found]).astype(np.int64)
    return values.reshape(len(found), parts, -1).transpose(1, 0, 2).copy()


def compressed(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every kept row of vec_id, vector and label.

    Null vectors and those holding null or non-finite components are dropped, and so are vectors whose length is not
    that of the kept row with the smallest vec_id, or which can't be cut into equal parts (that row is the first with a
    length that can). Rows may repeat ids and vectors: each gets a row, and equal smallest ids are taken in the order of
    their vectors; null ids come last. Components beyond 2^27 / 4096 are held at that bound. With fewer rows than
    entries the codebooks are that much smaller. An empty table gives no rows; other columns are ignored.
    """
    rows = vectors.select("vec_id", "label", "vector")
    kinds = dict(rows.dtypes)
    ids = f"vec_id {kinds['vec_id']}, label {kinds['label']}"
    books = seeds(rows, parts, entries)
    if books is None:
        return rows.sparkSession.createDataFrame([], f"vec_id {kinds['vec_id']}, code string, error long, label_error long, codebooks_sha256 string")
    names = ["vec_id", "label", "vec", "codes", "dists", "sums"]
    schema = f"{ids}, vec array<int>, codes array<int>, dists array<long>, sums array<long>"
    state, moved = None, np.ones(books.shape[:2], bool)

    def vectors_of(state: DataFrame | None) -> DataFrame:
        # Without sums: for each row, Spark's Arrow writer goes over all nulls of a batch at the end of a list column.
        return rows if state is None else state.where("sums IS NULL").drop("sums")

    for _ in range(rounds):
        before = state
        state = written(vectors_of(state).mapInArrow(_Round(books, moved, state is None, names), schema), "lloyd")
        if before is not None:
            discard(before)
        # A row a task; the sums have parts x entries x (1 + width) numbers.
        each = state.where("sums IS NOT NULL").select(F.posexplode("sums").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x"))
        total = np.zeros(books.shape[0] * books.shape[1] * (1 + books.shape[2]), np.int64)
        for at, x in each.collect():
            total[at] = x
        total = total.reshape(*books.shape[:2], -1)
        new = np.where(total[..., :1] > 0, total[..., 1:] // np.maximum(total[..., :1], 1), books)
        moved, books = (new != books).any(axis=2), new
    last = vectors_of(state).mapInArrow(
        _Last(books, moved, state is None, ["vec_id", "label", "code", "error"]), f"{ids}, code string, error long"
    )
    coded = written(last, "coded")
    if state is not None:
        discard(state)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    totals = written(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of"), "labels")
    small = totals.count() <= LABELS
    out = coded.join(F.broadcast(totals) if small else totals, F.col("label").eqNullSafe(F.col("of")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of every kept row of ``embeddings`` (see ``compressed``)."""
    return compressed(table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").alias("vector")))


def _sql() -> str:
    """The rounds unrolled: a_r assigns by codebook c_r, which holds part, entry and components."""
    finite = "embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)), false)"
    out = [
        f"q AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v, row_number() OVER (ORDER BY vec_id) AS nr FROM embeddings WHERE {finite})",
        f"p AS MATERIALIZED (SELECT vec_id, nr, part, v[part * (len(v) // {PARTS}) + 1:(part + 1) * (len(v) // {PARTS})] AS v FROM q, range({PARTS}) AS r(part))",
        f"c0 AS MATERIALIZED (SELECT part, nr - 1 AS entry, v FROM p WHERE nr <= {ENTRIES})",
    ]
    for r in range(ROUNDS + 1):
        out.append(
            f"a{r} AS MATERIALIZED (SELECT nr, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (SELECT nr, p.part, entry, list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM p JOIN c{r} c ON p.part = c.part) GROUP BY 1, 2)"
        )
        if r < ROUNDS:
            out.append(
                f"c{r + 1} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(n.v, c.v) AS v FROM c{r} c LEFT JOIN (SELECT part, entry, list(m ORDER BY i) AS v FROM (SELECT part, entry, i, floor(sum(x) / count(*))::BIGINT AS m FROM (SELECT p.part, a.entry, unnest(p.v) AS x, unnest(range(len(p.v))) AS i FROM p JOIN a{r} a ON p.nr = a.nr AND p.part = a.part) GROUP BY 1, 2, 3) GROUP BY 1, 2) n ON c.part = n.part AND c.entry = n.entry)"
            )
    return (
        "WITH " + ",\n".join(out) + ",\n"
        f"e AS (SELECT nr, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY 1)\n"
        f"SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) FROM c{ROUNDS}) AS codebooks_sha256 FROM e JOIN q USING (nr)"
    )


OP11_SQL = _sql()
