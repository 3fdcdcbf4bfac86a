"""Operator 3: language identification by nearest centroids.

Texts become TF-IDF vectors of hashed character bigrams and trigrams, normalised to length one. Each
language has several centroids (spherical k-means); a text takes the language of the centroid with the
largest cosine and is rejected where even that one is further away than the language's texts ever are.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remainder, table, written

DIMS = 8192
#: Texts sampled per language to place its centroids (a hash of the id keeps this share of the language's count, so the
#: number varies by a few square roots), and centroids per language.
SAMPLE, CENTROIDS, ROUNDS = 1500, 4, 8
#: A text is rejected below this part of the cosine that all but a thousandth of its language's sample reach.
SLACK, QUANTILE = 0.5, 0.001
#: Texts with fewer letters have fewer n-grams in common with anything: their limit falls in proportion.
FULL_LETTERS = 200
#: Languages whose centroids are broadcast at once (some 130 kB each); with more, texts are scored in several passes.
PER_PASS = 256
#: Characters handled at once in a task; longer texts are cut into such pieces and their counts added.
CHUNK = 1 << 20


@functools.cache
def _letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((unicodedata.category(chr(i))[0] == "L" for i in range(0x110000)), bool, 0x110000)


def _add_counts(text: str, row: np.ndarray) -> int:
    """Add the hashed bigrams and trigrams of a text to ``row``; the number of its letters."""
    letters, n = _letters(), 0
    for at in range(0, len(text), CHUNK):
        c = np.frombuffer(text[max(0, at - 2) : at + CHUNK].lower().encode("utf-32-le", "replace"), np.uint32)
        is_letter = letters[c]
        n += int(is_letter.sum())
        c = np.where(is_letter, c, np.uint32(32))
        c = np.concatenate([[np.uint32(32)], c, [np.uint32(32)]]).astype(np.uint32)
        two = c[:-1] * np.uint32(0x9E3779B1) + c[1:] * np.uint32(0x85EBCA77)
        three = two[:-1] * np.uint32(0xC2B2AE3D) + c[2:] * np.uint32(0x27D4EB2F)
        for h, known in ((two, (c[:-1] != 32) | (c[1:] != 32)), (three, c[1:-1] != 32)):
            row += np.bincount(((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(19))[known], minlength=DIMS)
    return n


def _count_matrix(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    m = np.zeros((len(texts), DIMS), np.int64)
    return m, np.array([_add_counts(t, m[i]) if t else 0 for i, t in enumerate(texts)], np.int64)


def _vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts, dtype=np.float32) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def _pieces(batch: pa.RecordBatch, n: int = 64) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, n):
        yield batch.slice(at, n)


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen, n = np.zeros(DIMS, np.int64), 0
    for batch in batches:
        for b in _pieces(batch):
            counts, _ = _count_matrix(b["text"].to_pylist())
            seen += (counts > 0).sum(axis=0)
            n += b.num_rows
    yield pa.RecordBatch.from_pydict({"dim": np.arange(-1, DIMS, dtype=np.int32), "n": np.concatenate([[n], seen])})


def _kmeans(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means from spread-out starts; deterministic."""
    centres = x[:1].copy()
    while len(centres) < min(k, len(x)):
        centres = np.vstack([centres, x[np.argmin((x @ centres.T).max(axis=1))]])
    for _ in range(ROUNDS):
        own = (x @ centres.T).argmax(axis=1)
        for j in range(len(centres)):
            if (own == j).any():
                mean = x[own == j].mean(axis=0)
                centres[j] = mean / max(float(np.linalg.norm(mean)), 1e-9)
    return centres


class Model:
    """A table of languages with their centroids and limits, in blocks of some PER_PASS languages, and the weights of dimensions."""

    def __init__(self, idf: np.ndarray, table: DataFrame, blocks: int):
        self.idf, self.table, self.blocks = idf, table, blocks

    def block(self, i: int) -> tuple[np.ndarray, list[str], np.ndarray, list[float]]:
        """Weights, and for each centroid of a block its language, place and limit; languages in order."""
        langs, centres, least = [], [], []
        for r in sorted(self.table.where(F.col("block") == i).drop("block").collect()):
            m = np.frombuffer(r.centres, np.float32).reshape(-1, DIMS)
            centres.append(m)
            langs += [r.lang] * len(m)
            least += [r.least] * len(m)
        return self.idf, langs, np.vstack(centres) if centres else np.zeros((0, DIMS), np.float32), least


def fit(docs: DataFrame) -> Model:
    """Learn from rows with a text and a language; document frequencies come from all of them.

    Texts without a letter teach nothing; rows may repeat ids and texts, and each counts. An empty table gives a model
    without languages. Columns other than doc_id, text and lang are ignored.
    """
    spark = docs.sparkSession
    known = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "lang", "text")
    df = np.zeros(DIMS + 1)
    parts = known.select("text").mapInArrow(_document_frequencies, "dim int, n long")
    for dim, n in parts.groupBy("dim").agg(F.sum("n")).collect():  # DIMS + 1 rows
        df[dim + 1] = n
    idf = (np.log((1 + df[0]) / (1 + df[1:])) + 1).astype(np.float32)
    shared = spark.sparkContext.broadcast(idf)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in _pieces(batch):
                counts, letters = _count_matrix(b["text"].to_pylist())
                x, ok = _vectors(counts, shared.value), letters > 0
                yield pa.RecordBatch.from_pydict(
                    {"lang": b["lang"].filter(pa.array(ok)), "x": pa.array([v.tobytes() for v in x[ok]], pa.binary())}
                )

    counts = written(known.groupBy("lang").count(), "languages")
    n = counts.count()
    if n <= PER_PASS:
        counts = F.broadcast(counts)
    share = F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(1 << 40)) < F.least(F.lit(1.0), SAMPLE / F.col("count")) * float(1 << 40)
    sample = known.join(counts, "lang").where(share).select("lang", "text")

    def place(key, rows):
        x = np.frombuffer(b"".join(sorted(rows["x"].to_pylist())), np.float32).reshape(-1, DIMS)  # in an order of their own
        centres = _kmeans(x, CENTROIDS)
        least = float(np.quantile((x @ centres.T).max(axis=1), QUANTILE)) * SLACK
        return pa.table({"lang": [key[0].as_py()], "centres": [centres.astype(np.float32).tobytes()], "least": [least]})

    placed = sample.mapInArrow(vectors, "lang string, x binary").groupBy("lang").applyInArrow(place, "lang string, centres binary, least double")
    blocks = max(1, -(-n // PER_PASS))
    return Model(idf, written(placed.withColumn("block", F.pmod(F.xxhash64("lang"), F.lit(blocks))), "centroids"), blocks)


def predict(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``keep`` columns with lang_pred, score (the cosine) and rejected.

    Null texts and texts without a letter are ``und`` with score 0 and rejected, as is everything when no language could
    be learned. Ties go to the language that sorts first. Texts of any length are read whole, in chunks; repeated rows
    each get a row; columns of other names are not looked at.
    """
    schema = docs.select(*keep).schema.add("_text", "string").add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    out = docs.select(*keep, F.col("text").alias("_text"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    for i in range(model.blocks):
        out = out.mapInArrow(_pass(docs.sparkSession.sparkContext.broadcast(model.block(i)), [f.name for f in schema]), schema)
    return out.drop("_text")


def _pass(shared, names: list[str]):
    """Hold texts against one block of languages; what an earlier block found stays unless this one is nearer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, langs, centres, least = shared.value
        for batch in batches:
            for b in _pieces(batch):
                if not langs:
                    yield b
                    continue
                text, pred, score, out = (c.to_pylist() for c in b.columns[-4:])
                counts, letters = _count_matrix(text)
                sims = _vectors(counts, idf) @ centres.T
                for i in np.flatnonzero(letters).tolist():
                    j = int(sims[i].argmax())
                    s = round(min(1.0, max(0.0, float(sims[i, j]))), 6)  # products of one text differ in their last bits by its place
                    if pred[i] == "und" or (-s, langs[j]) < (-score[i], pred[i]):
                        pred[i], score[i], out[i] = langs[j], s, s < least[j] * min(1.0, letters[i] / FULL_LETTERS)
                cols = [*b.columns[:-3], pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(out, pa.bool_())]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def keep_known(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that lie near a language learned from ``docs``, all columns kept.

    Null texts and those without a letter go, as do texts far from every language; rows with a null id or language stay
    if their text is near one.
    """
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "text")
    return predict(row, fit(docs), ["_row"]).where("NOT rejected").select("_row.*")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every row of ``documents``, learned from the rows that are not held out (see ``predict``)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(remainder("doc_id", 3) != 1))
    marked = docs.select("doc_id", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "text")
    return predict(marked, model, ["doc_id", "held_out"])
