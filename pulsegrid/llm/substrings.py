"""Operator 10: repeated passages, found with prefix-partitioned suffix trees.

Only suffixes that can repeat are gathered. Every window of WINDOW words is dealt by its seed, the
sequence of SEED words in it with the smallest hash: equal windows have equal seeds at equal places,
and neighbouring windows mostly share theirs, so a run of them travels as one segment. Seeds that occur
once are dropped. A seed is the prefix that a group of suffixes is dealt by; groups too large for a
task get a longer one, the whole window, where only the earliest place matters and sums do the rest.
In a group, the sorted suffixes and their common prefixes are the subtree: internal nodes at least
WINDOW words deep are the repeats, and all their leaves but the earliest are covered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WS, discard, let, table, written

WINDOW, SEED = 20, 8
#: Segments of one seed (some 250 bytes each) that a task holds at most.
GROUP = 20_000
#: Ids that are broadcast to read only the texts concerned; with more, texts are shuffled without that.
IDS = 4_000_000
#: Null ids come last.
_LAST = (1 << 63) - 1
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _seeds(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the seed at every word, and for every window the place of its seed."""
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = len(h) - SEED + 1
    s = np.zeros(n, np.uint64)
    for i in range(SEED):
        s = s * _MIX + h[i : i + n]
    s ^= s >> np.uint64(32)
    s *= np.uint64(0xD6E8FEB86659FD93)
    s ^= s >> np.uint64(29)
    wide = np.lib.stride_tricks.sliding_window_view(s, WINDOW - SEED + 1)
    at = np.concatenate([wide[i : i + 65536].argmin(axis=1) for i in range(0, len(wide), 65536)])
    return s.view(np.int64), at + np.arange(len(wide))


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def _keyed(docs: DataFrame, *more: str) -> DataFrame:
    """doc (id, null last), part (0, or a number that tells rows of one id but different texts apart) and text.

    Only ids that have several texts need a part, and null ids: their texts are numbered in the order of 128 bits of
    hash. The numbers are written, so that all uses see the same.
    """
    hashes = [F.xxhash64(F.lit(i), "text").alias(f"h{i}") for i in (0, 1)]
    id_ = F.col("doc_id").cast("long")
    rows = docs.select(F.coalesce(id_, F.lit(_LAST)).alias("doc"), id_.isNull().alias("none"), *hashes, "text", *more)
    texts = F.struct("h0", "h1")
    several = rows.groupBy("doc", "none").agg(F.min(texts).alias("x"), F.max(texts).alias("y")).where("none OR x != y").select("doc", "none")
    several = written(several, "several")
    columns = ["doc", "part", "text", *more]
    if several.isEmpty():
        return rows.withColumn("part", F.lit(0).cast("long")).select(*columns)
    by = ["doc", "none", "h0", "h1"]
    held = rows.select(*by).join(_small(several), ["doc", "none"], "left_semi").distinct()
    numbers = written(held.orderBy(*by).withColumn("part", F.monotonically_increasing_id() + 1), "numbers")
    return rows.join(_small(numbers), by, "left").withColumn("part", F.coalesce("part", F.lit(0).cast("long"))).select(*columns)


def _small(ids: DataFrame) -> DataFrame:
    """A written table of ids, broadcast unless it is too large for that."""
    return F.broadcast(ids) if ids.limit(IDS + 1).count() <= IDS else ids


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(seed, doc, part, at) of the seeds of all windows, at the word's number."""
    for batch in batches:
        seeds, docs, parts, places = [], [], [], []
        for doc, part, text in zip(batch["doc"].to_pylist(), batch["part"].to_pylist(), batch["text"].to_pylist(), strict=True):
            words = _words(text)
            if len(words) >= WINDOW:
                s, at = _seeds(words)
                at = np.unique(at)
                seeds.append(s[at])
                docs.append(np.full(len(at), doc))
                parts.append(np.full(len(at), part))
                places.append(at)
        none = np.zeros(0, np.int64)
        seed, doc, part, at = (np.concatenate([none, *x]) for x in (seeds, docs, parts, places))
        yield pa.RecordBatch.from_pydict({"seed": seed, "doc": doc, "part": part, "at": at.astype(np.int32)})


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of windows with a repeated seed: (seed, doc, part, at of the first, number, words, whether the group is large)."""
    for batch in batches:
        out: list[tuple] = []
        cols = [batch[c].to_pylist() for c in ("doc", "part", "text", "places", "large")]
        for doc, part, text, places, large in zip(*cols, strict=True):
            words = _words(text)
            s, own = _seeds(words)
            repeated = np.zeros(len(s), np.int8)
            repeated[places] = 1
            repeated[np.array(places)[np.array(large, bool)]] = 2
            cuts = np.nonzero(np.diff(own))[0] + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(own)], strict=True):
                if kind := int(repeated[own[a]]):
                    out.append((int(s[own[a]]), doc, part, a, b - a, b" ".join(words[a : b + WINDOW - 1]), kind == 2))
        rows = list(zip(*out, strict=True)) if out else [[]] * 7
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.bool_())
        names = ["seed", "doc", "part", "at", "n", "words", "large"]
        yield pa.RecordBatch.from_arrays([pa.array(list(r), t) for r, t in zip(rows, types, strict=True)], names=names)


def deep_nodes(suffixes: list[tuple[tuple, tuple]], depth: int) -> Iterator[tuple[int, list[tuple]]]:
    """Topmost internal nodes at least ``depth`` words deep of the tree of (suffix, leaf): their depth and leaves."""
    suffixes.sort()
    shared, leaves = 0, []
    for (a, leaf), (b, other) in zip(suffixes, suffixes[1:], strict=False):
        if a[:depth] == b[:depth] and len(a) >= depth:
            common = depth
            while common < min(len(a), len(b)) and a[common] == b[common]:
                common += 1
            shared, leaves = (min(shared, common), leaves) if leaves else (common, [leaf])
            leaves.append(other)
        elif leaves:
            yield shared, leaves
            leaves = []
    if leaves:
        yield shared, leaves


def covered_in_group(segments: list[tuple[int, int, int, int, bytes]]) -> list[tuple[int, int, int, int]]:
    """(doc, part, at, number) runs of windows that occur earlier, of segments (doc, part, at, number, words)."""
    out, distinct = [], {}
    for doc, part, at, n, words in segments:
        first = distinct.get(words)
        if first is None or (doc, part, at) < first[:3]:
            distinct[words], (doc, part, at) = (doc, part, at, n), first[:3] if first else (None, None, None)
            if first is None:
                continue
            first = distinct[words]
        if (doc, part, at) != first[:3]:  # a row of the same id and text is the same document
            out.append((doc, part, at, n))
    if len(distinct) > 1:
        number: dict[bytes, int] = {}
        suffixes = []
        for words, (doc, part, at, n) in distinct.items():
            ids = tuple(number.setdefault(w, len(number)) for w in words.split(b" "))
            suffixes += [(ids[i:], (doc, part, at + i)) for i in range(n)]
        for _, leaves in deep_nodes(suffixes, WINDOW):
            first = min(leaves)
            out += [(*leaf, 1) for leaf in leaves if leaf != first]
    return out


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def batch_of(out):
        rows = list(zip(*out, strict=True)) if out else [[]] * 4
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(list(r), t) for r, t in zip(rows, types, strict=True)], names=["doc", "part", "at", "n"])

    seed, held = None, []
    for batch in batches:
        out: list[tuple] = []
        for s, *segment in zip(*(batch[c].to_pylist() for c in ("seed", "doc", "part", "at", "n", "words")), strict=True):
            if s != seed:
                if len(held) > 1:
                    out += covered_in_group(held)
                seed, held = s, []
            held.append(segment)
        yield batch_of(out)
    if len(held) > 1:
        yield batch_of(covered_in_group(held))


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id is among ``ids``; all of them where those are too many to broadcast."""
    ids = ids.select("doc").distinct()
    if ids.limit(IDS + 1).count() > IDS:
        return docs
    return docs.join(F.broadcast(ids), "doc", "left_semi")


def covered_runs(docs: DataFrame) -> DataFrame:
    """(doc, part, at, n): runs of windows whose word sequence starts earlier too; docs as of _keyed."""
    anchors = written(docs.mapInArrow(_anchors, "seed long, doc long, part long, at int"), "anchors")
    # Written, so that the join reads plain shuffles on both sides and a hot seed's rows can be split.
    repeated = written(anchors.groupBy("seed").count().where("count > 1").select("seed", (F.col("count") > GROUP).alias("large")), "repeated")
    found = anchors.join(repeated, "seed").select("doc", "part", "at", "large")
    # A document's own seeds: no more of them than it has words.
    places = written(found.groupBy("doc", "part").agg(F.collect_set(F.struct("at", "large")).alias("s")), "places")
    discard(anchors, repeated)
    texts = _only(docs, places)
    there = texts.join(places, ["doc", "part"]).select("doc", "part", "text", F.col("s.at").alias("places"), F.col("s.large").alias("large"))
    segments = written(there.mapInArrow(_segments, "seed long, doc long, part long, at int, n int, words binary, large boolean"), "segments")
    discard(places)
    covered = "doc long, part long, at int, n int"
    small = segments.where("NOT large").repartition("seed").sortWithinPartitions("seed").mapInArrow(_trees, covered)
    # Large groups: equal segments first, the earliest of each then by its windows; sums find the earliest place.
    whole = segments.where("large").select("words", "n", F.struct("doc", "part", "at").alias("at"))
    first = written(whole.groupBy("words").agg(F.min("at").alias("first")), "firsts")
    later = whole.join(first, "words").where("at != first").select("at.doc", "at.part", "at.at", "n")
    split = F.split(F.col("words").cast("string"), " ")
    windows = let(split, lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.array_join(F.slice(w, i + 1, WINDOW), " ")))
    place = F.struct(F.col("first.doc").alias("doc"), F.col("first.part").alias("part"), (F.col("first.at") + F.col("i")).alias("at"))
    each = first.select("first", F.posexplode(windows).alias("i", "window")).select("window", place.alias("at"))
    earliest = written(each.groupBy("window").agg(F.min("at").alias("first"), F.count("*").alias("c")).where("c > 1").drop("c"), "earliest")
    again = each.join(earliest, "window").where("at != first").select("at.doc", "at.part", "at.at", F.lit(1).alias("n"))
    return small.unionByName(later).unionByName(again)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        removed, digests, texts = [], [], []
        for text, runs in zip(batch["text"].to_pylist(), batch["runs"].to_pylist(), strict=True):
            words = _words(text)
            edge = np.zeros(len(words) + 1, np.int32)
            for r in runs:
                edge[r["at"]] += 1
                edge[min(len(words), r["at"] + r["n"] + WINDOW - 1)] -= 1
            gone = np.cumsum(edge[:-1]) > 0
            kept = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)
            removed.append(int(gone.sum())), digests.append(hashlib.sha256(kept).hexdigest()), texts.append(kept.decode("utf-8", "surrogatepass"))
        yield pa.RecordBatch.from_arrays(
            [batch["doc"], batch["part"], pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.string())],
            names=["doc", "part", "n_removed", "kept_sha256", "kept_text"],
        )


def _dedup(docs: DataFrame) -> DataFrame:
    runs = covered_runs(docs)
    by_doc = written(runs.groupBy("doc", "part").agg(F.collect_set(F.struct("at", "n")).alias("runs")), "covered")
    # Rows of one doc and part have one text, so it does not matter which of them stays.
    texts = _only(docs, by_doc).join(by_doc, ["doc", "part"]).dropDuplicates(["doc", "part"])
    return texts.select("doc", "part", "text", "runs").mapInArrow(
        _kept, "doc long, part long, n_removed long, kept_sha256 string, kept_text string"
    )


def dedup(docs: DataFrame) -> DataFrame:
    """The documents in which words are removed: doc, part, n_removed, kept_sha256 and kept_text.

    Null and short texts have no window and are never there. Rows with the same id and text are one
    document; those with the same id and other texts are ordered by a hash of the text; null ids come
    last. An empty table gives no rows; other columns are ignored, whatever their names. Texts of any length are read whole.
    """
    return _dedup(_keyed(docs))


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated words gone from its texts, all rows and columns kept.

    A changed text is its kept words joined by spaces (n_chars, if there, follows); others stay as they are. Rows with a
    null id or text stay; repeated rows keep the same words. An empty table gives none.
    """
    # All columns but the text travel in one struct, whatever they are called.
    keyed = _keyed(docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row")), "row")
    changed = written(_dedup(keyed.drop("row")), "changed").select("doc", "part", "kept_text")
    new = keyed.drop("text").join(changed.withColumnRenamed("kept_text", "text"), ["doc", "part"])
    same = keyed.join(_small(changed.select("doc", "part")), ["doc", "part"], "left_anti")
    out = same.unionByName(new).select("row", "text")
    fields = {c: F.col("text") if c == "text" else F.col("row").getField(c) for c in docs.columns}
    if "n_chars" in fields:
        fields["n_chars"] = F.when(F.col("text").isNull(), fields["n_chars"]).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[x.alias(c) for c, x in fields.items()])


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every row of ``documents`` (see ``dedup``); repeated rows each get a row."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), WS), "")
    keyed = _keyed(docs, "doc_id")
    all_ = keyed.select(
        "doc_id", "doc", "part", F.size(words).cast("long").alias("n_words"), F.sha2(F.array_join(words, " ").cast("binary"), 256).alias("whole")
    )
    return all_.join(_dedup(keyed.drop("doc_id")).drop("kept_text"), ["doc", "part"], "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("kept_sha256", "whole").alias("kept_sha256"),
    )


OP10_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
g AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 18), lambda i: md5(array_to_string(w[i:i + 19], ' ')))) AS k, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20),
c AS (SELECT doc_id, i FROM g QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1),
r AS (SELECT doc_id, list(DISTINCT i + o) AS gone FROM c, range(20) AS q(o) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""
