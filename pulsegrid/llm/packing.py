"""Operator 8: packing token sequences by patterns fitted with non-negative least squares.

The plan works on the histogram of lengths (at most as many bins as a sequence has tokens), so its size
does not depend on the number of documents. Patterns that fill a sequence exactly are enumerated by need: for every
length the fillings of the rest that the histogram holds most of, and pairs. Their repeat counts are fitted to the
histogram by non-negative least squares and rounded down; what is left is the histogram of the next round, until
patterns place little more. The last rest goes best-fit into the emptiest fitting space, again on counts. Tasks number
documents within their length, and what earlier tasks hold of it is added; a number looks its place up in the plan.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table, written

SIZE = 4096
#: Steps of the least-squares fit, rounds of patterns at most, the share of the tokens left that one of two rounds must
#: place, and tables of fillings in a round at most, with so many lengths drawn for each.
FIT, ROUNDS, LEAST_SHARE, TABLES, FILLERS = 100, 8, 0.1, 40, 128
#: Documents of a length for each pattern of a round that holds it, and documents a sequence that count as many.
SPREAD, MANY = 8, 8
#: Pieces whose ids a task remembers; the memory is emptied when it is full.
MEMORY = 400_000


@functools.cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True  # their strings in a text are ordinary text
    return t


#: The tokenizer's own split of lower-case Latin-1 text, spelled out: contractions, letters, one digit, other signs.
_LETTER, _DIGIT, _SPACE = "a-zªµºß-öø-ÿ", "0-9²³¹¼-¾", r"\t-\r \x85\xa0"
_OTHER = re.compile("[^\x00-\xff]")
_PIECE = re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{_LETTER}]+|[{_DIGIT}]|[^{_SPACE}{_LETTER}{_DIGIT}]+")


#: Texts on which pieces and the whole must give the same ids; a tokenizer that fails one is asked for whole texts.
_PROBES = (
    "Don't they'll we've I'm he'd it's you're O'Neil 'S 'x", "a1b22c 3.5 x-y (z)!? a,b...", "  two  blanks\ttab\nline\r\n end ", "É Ü ß µ ª º ² ½ × ÷ ¿ ¡ \x85 \xa0",
    "<|endoftext|> <s> [CLS] </w>", "".join(map(chr, range(1, 256))), " ".join(map(chr, range(1, 256))), "aB" * 40 + " " + "x" * 90, "日本 語 x\u0301 ﬁ Ω", "",
)


class _Ids(dict):
    """Ids of pieces of text as bytes, remembered, where no token of the vocabulary spans two pieces (``known``)."""

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that end a piece
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known = True
        self.known = bool(self.last.any()) and all(np.array_equal(token_ids(t, self), self.encoded(t)) for t in _PROBES)
        self.clear()

    def encoded(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def learn(self, pieces: list[str]) -> None:
        """Remember pieces, encoded side by side and cut after the tokens that end one."""
        new = [p for p in set(pieces) if p not in self]
        if len(self) + len(new) > MEMORY:
            self.clear()
            new = list(set(pieces))
        for at in range(0, len(new), 4096):
            some = new[at : at + 4096]
            ids = self.encoded(" ".join(some))
            data, ends = ids.tobytes(), (4 * np.flatnonzero(self.last[ids]) + 4).tolist()
            self.update(zip(some, (data[i:j] for i, j in zip([0, *ends], ends, strict=False)), strict=True))

    def __missing__(self, word: str) -> bytes:
        return self.encoded(word).tobytes()


@functools.cache
def _memory(path: str) -> _Ids:
    """One memory a Python worker."""
    return _Ids(path)


def token_ids(text: str | None, memory: _Ids) -> np.ndarray:
    text = text or ""
    if not memory.known:
        return memory.encoded(text)
    if _OTHER.search(text):
        # str.split() also splits at 1C to 1F, which are no white space to the tokenizer.
        pieces = [text] if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()
    else:
        pieces = _PIECE.findall(text.lower())
        memory.learn(pieces)
    return np.frombuffer(b"".join(map(memory.__getitem__, pieces)), "<u4")


class _Numbers:
    """Numbers the rows of a task within their length, from 0."""

    def __init__(self):
        from pyspark import TaskContext

        context = TaskContext.get()
        self.task, self.next = context.partitionId() if context else 0, np.zeros(0, np.int64)

    def of(self, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(lengths) and lengths.max() >= len(self.next):
            self.next = np.concatenate([self.next, np.zeros(int(lengths.max()) + 1 - len(self.next), np.int64)])
        order = np.argsort(lengths, kind="stable")
        same, own = lengths[order], np.empty(len(lengths), np.int64)
        own[order] = np.arange(len(same)) - np.searchsorted(same, same) + self.next[same]
        self.next += np.bincount(lengths, minlength=len(self.next))
        return np.full(len(lengths), self.task, np.int32), own


def tokenized(docs: DataFrame, path: str, size: int = SIZE, end_id: int = 1) -> DataFrame:
    """Pieces of at most ``size`` ids per document row, an end id after each document; null counts as empty.

    task and own number the pieces of one length, as ``numbered`` does.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        memory, numbers = _memory(path), _Numbers()
        for batch in batches:
            out: list[tuple] = []
            for k, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                ids = np.append(token_ids(text, memory), np.uint32(end_id)).astype("<u4")
                for j, at in enumerate(range(0, len(ids), size)):
                    part = ids[at : at + size]
                    out.append((k, j, at, len(part), zlib.crc32(part.tobytes())))
            cols = zip(*out, strict=True) if out else [[]] * 5
            cols = [pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([*cols, *map(pa.array, numbers.of(cols[3].to_numpy()))], names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "own"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long, task int, own long"
    )


def numbered(pieces: DataFrame) -> DataFrame:
    """``pieces`` with task (the number of the task that saw them) and own (their number within task and length)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = _Numbers()
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, numbers.of(b["length"].to_numpy()))], names=[*b.schema.names, "task", "own"])

    return pieces.mapInArrow(run, pieces.select("*").schema.add("task", "integer").add("own", "long"))


def nnls(rows: np.ndarray, cols: np.ndarray, p: int, counts: np.ndarray, rounds: int = FIT) -> np.ndarray:
    """Non-negative least squares by accelerated projected gradients.

    Entry e says that pattern ``cols[e]`` of ``p`` holds a document of length ``rows[e]`` (once more for each entry).
    """
    n = len(counts)
    a = lambda x: np.bincount(rows, x[cols], n)
    at = lambda r: np.bincount(cols, r[rows], p)
    v = np.ones(p)
    for _ in range(20):  # the largest singular value bounds the step
        v = at(a(v))
        v /= max(np.linalg.norm(v), 1e-12)
    step = 1 / max(1e-9, 1.05 * np.linalg.norm(at(a(v))))
    x = y = np.zeros(p)
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * at(a(y) - counts))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def _fillings(firsts: np.ndarray, have: np.ndarray, worth: np.ndarray, size: int) -> list[np.ndarray]:
    """For each of the first lengths that can start one, a sequence filled exactly: the rest by lengths of ``have``, each once.

    The fillings of all rests come from one table of a knapsack.
    """
    best = np.full(size + 1, -np.inf)
    best[0] = 0
    taken = np.zeros((len(have), size + 1), bool)
    for i, length in enumerate(have.tolist()):
        ways = best[: size + 1 - length] + worth[i]
        better = ways > best[length:]
        taken[i, length:] = better
        best[length:][better] = ways[better]
    first = firsts[np.isfinite(best[size - firsts])]
    if not len(first):
        return []
    rest, entries = size - first, [(np.arange(len(first)), first)]
    for i in range(len(have) - 1, -1, -1):
        own = np.flatnonzero(taken[i, rest])
        if len(own):
            rest[own] -= have[i]
            entries.append((own, np.full(len(own), have[i])))
    which, lengths = (np.concatenate(x) for x in zip(*entries, strict=True))
    ends = np.cumsum(np.bincount(which, minlength=len(first)))
    return np.split(lengths[np.argsort(which, kind="stable")], ends[:-1])


def enumerate_patterns(counts: np.ndarray, size: int, turn: int = 0) -> list[list[int]]:
    """Patterns of present lengths that fill a sequence exactly, as many as the histogram can use often.

    Each table of fillings takes some lengths, drawn by ``turn``, common ones first. Patterns start from the lengths with
    most tokens left, or, unless a sequence holds MANY documents, in every other turn from the longest. A length that is in as many patterns
    as it has SPREADs of documents is taken no more, and the rest of the lengths make further patterns.
    """
    used, most, out = np.zeros(size + 1, np.int64), np.maximum(1, counts // SPREAD) * (counts > 0), []
    random, barren = np.random.default_rng(turn), 0
    many = MANY * int((counts * np.arange(size + 1)).sum()) < size * int(counts.sum())
    long_first, power = turn % 2 == 0 and not many, 1.0 if many else 1.5
    for _ in range(TABLES):
        have = np.flatnonzero(used < most)
        found, refused = len(out), 0
        first = have[::-1] if long_first else have[np.argsort(-have * counts[have], kind="stable")]
        some = np.sort(random.choice(have, min(len(have), FILLERS), replace=False))
        for lengths in _fillings(first, some, some**power * np.log1p(counts[some]), size):
            pattern, times = np.unique(lengths, return_counts=True)
            if (used[pattern] + times <= most[pattern]).all():
                used[pattern] += times
                out.append(lengths.tolist())
                refused = 0
            elif (refused := refused + 1) == 50:
                break
        barren = barren + 1 if len(out) == found else 0
        if barren == 3:
            break
    return out


def fitted(counts: np.ndarray, size: int) -> Iterator[tuple[list[tuple[int, int]], int]]:
    """Patterns, as lengths with their number, and how often each is used; ``counts`` falls to what is left."""
    small = 0
    for turn in range(ROUNDS):
        before = int((counts * np.arange(size + 1)).sum())
        patterns = enumerate_patterns(counts, size, turn) if before else []
        if not patterns:
            return
        rows = np.concatenate([np.array(p) for p in patterns])
        cols = np.repeat(np.arange(len(patterns)), [len(p) for p in patterns])
        wanted = np.floor(nnls(rows, cols, len(patterns), counts.astype(float)) + 1e-6).astype(np.int64)
        for j in np.argsort(-wanted, kind="stable"):
            parts = sorted(Counter(patterns[j]).items(), reverse=True)
            n = min([int(wanted[j]), *(int(counts[x]) // m for x, m in parts)])
            if n <= 0:
                continue
            for x, m in parts:
                counts[x] -= n * m
            yield parts, n
        left = int((counts * np.arange(size + 1)).sum())
        small = small + 1 if before - left < LEAST_SHARE * before else 0
        if small == 2:
            return


def plan(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int, int]]:
    """Places for all pieces: (length, first rank, first sequence, sequences, pieces a sequence, offset) runs.

    Rank r of a length, counted from a run's first, is piece ``(r - first) % pieces`` of sequence
    ``(r - first) // pieces`` of the run.
    """
    counts = np.zeros(size + 1, np.int64)
    for k, n in histogram.items():
        counts[k] = n
    groups: list[tuple[list[tuple[int, int]], int]] = []  # lengths with their number, and repeats
    groups += fitted(counts, size)
    # Best fit for the rest, longest first: spaces[s] holds groups of sequences with s tokens free.
    spaces: dict[int, list[tuple[list[tuple[int, int]], int]]] = {}
    free: list[int] = []
    for length in range(size, 0, -1):
        left = int(counts[length])
        while left:
            fit = next((s for s in free if s >= length), None)
            if fit is None:
                per = 1
                spaces.setdefault(size - length, []).append(([(length, per)], left))
                if size - length and size - length not in free:
                    free = sorted([*free, size - length])
                left = 0
                continue
            parts, n = spaces[fit].pop()
            if not spaces[fit]:
                free.remove(fit)
                del spaces[fit]
            m = min(fit // length, max(1, left // n))
            used = min(n, left // m)
            if n > used:
                spaces.setdefault(fit, []).append((parts, n - used))
                free = sorted({*free, fit})
            rest = fit - m * length
            spaces.setdefault(rest, []).append(([*parts, (length, m)], used))
            if rest:
                free = sorted({*free, rest})
            left -= used * m
    for found in spaces.values():
        groups += found
    ranks, first, runs = dict.fromkeys(histogram, 0), 0, []
    for parts, n in groups:
        offset = 0
        for length, m in parts:
            runs.append((length, ranks[length], first, n, m, offset))
            ranks[length] += n * m
            offset += m * length
        first += n
    return runs


def placed(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """sequence_id and offset for rows with length (1 to ``size``) and their numbers task and own (see ``numbered``).

    ``pieces`` must give the same rows each time it is read, as a written table does. Rows may repeat.
    """
    spark = pieces.sparkSession
    # Rank within a length without gathering a length: what earlier tasks hold of it, and the own number.
    sizes = written(pieces.groupBy("length", "task").count(), "sizes")  # at most ``size`` rows a task
    histogram = {r[0]: r[1] for r in sizes.groupBy("length").agg(F.sum("count")).collect()}  # at most ``size`` rows
    runs = np.array(sorted(plan(histogram, size)), np.int64).reshape(-1, 6)
    shared = spark.sparkContext.broadcast(runs)  # bounded by the lengths in a sequence and the patterns
    before = F.sum("count").over(W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1))
    sizes = written(sizes.select("length", "task", F.coalesce(before, F.lit(0)).alias("before")), "before")
    ranked = pieces.join(sizes, ["length", "task"]).withColumn("rank", F.col("before") + F.col("own"))
    names = [c for c in pieces.columns if c not in ("task", "own")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = shared.value
        key = r[:, 0] * (1 << 48) + r[:, 1]
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            i = np.searchsorted(key, length * (1 << 48) + rank, side="right") - 1
            at, per = rank - r[i, 1], r[i, 4]
            cols = [batch[c] for c in names]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(r[i, 2] + at // per), pa.array(r[i, 5] + at % per * length)], names=[*names, "sequence_id", "offset"]
            )

    schema = pieces.select(*names).schema.add("sequence_id", "long").add("offset", "long")
    return ranked.select(*names, "rank").mapInArrow(run, schema)


def pack(docs: DataFrame, path: str, size: int = SIZE) -> DataFrame:
    """Every document row's pieces with their sequences.

    Null and empty texts are their end id alone; a null id stays one. Repeated rows are packed each; texts of any length are
    tokenized whole; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    return placed(written(tokenized(docs, path, size), "pieces"), size)


def op8_packing(spark: SparkSession, sf_dir: str, path: Callable[[str], str] | None = None) -> DataFrame:
    """The pieces of all ``documents`` in their sequences (see ``pack``)."""
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), (path or public_tokenizers.path)("word_bpe_49k.json"))
