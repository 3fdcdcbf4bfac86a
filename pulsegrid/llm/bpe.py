"""Operator 7: byte-level BPE, encoding and decoding.

A word is folded: of its pieces, single bytes at first, the neighbouring pair with the smallest rank is
joined, over and over, until no pair has a rank. Tasks fold each distinct word once and remember it;
the memory is emptied when it is full. Decoding joins the pieces' bytes. (The README says why the fold
is not made of Spark's higher-order functions.)
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import table

#: Words whose ids a task remembers; bytes from which on a word's pairs wait in a heap.
MEMORY, LONG = 400_000, 256


def fold(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a word: the leftmost pair of the smallest rank is joined first."""
    if word in ranks:
        return [ranks[word]]
    if len(word) >= LONG:
        return _fold_long(word, ranks)
    parts = [word[i : i + 1] for i in range(len(word))]
    pairs = [ranks.get(word[i : i + 2]) for i in range(len(word) - 1)]
    while True:
        best = min((r for r in pairs if r is not None), default=None)
        if best is None:
            return [ranks[p] for p in parts]
        i = pairs.index(best)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i:
            pairs[i - 1] = ranks.get(parts[i - 1] + parts[i])
        if i < len(pairs):
            pairs[i] = ranks.get(parts[i] + parts[i + 1])


def _fold_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same fold in n log n steps: pairs wait in a heap by rank and place, and are checked when they come out."""
    parts: list[bytes | None] = [word[i : i + 1] for i in range(len(word))]
    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    heap: list[tuple[int, int, bytes]] = []

    def offer(i: int) -> None:
        if i >= 0 and after[i] < len(parts):
            pair = parts[i] + parts[after[i]]
            if (rank := ranks.get(pair)) is not None:
                heapq.heappush(heap, (rank, i, pair))

    for i in range(len(parts)):
        offer(i)
    while heap:
        _, i, pair = heapq.heappop(heap)
        j = after[i]
        if parts[i] is None or j >= len(parts) or parts[i] + parts[j] != pair:
            continue
        parts[i], parts[j], after[i] = pair, None, after[j]
        if after[i] < len(parts):
            before[after[i]] = i
        offer(before[i])
        offer(i)
    return [ranks[p] for p in parts if p is not None]


class Codec(dict):
    """Words with their ids as bytes (four each, little-endian), folded when first asked for."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.pieces = {v: k for k, v in self.ranks.items()}
        self.words = regex.compile(pattern).findall

    def __missing__(self, word: str) -> bytes:
        if len(self) >= MEMORY:
            self.clear()
        ids = np.array(fold(word.encode("utf-8", "replace"), self.ranks), "<u4").tobytes()
        if len(word) < 64:
            self[word] = ids
        return ids

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, self.words(text or ""))), "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids.tolist()))


@functools.cache
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids of every row's whole text; a null text counts as empty, other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            ids = [c.encode(t).astype(np.int32) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the bytes of every row's ids (null: none); an id that the vocabulary lacks is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            out = [c.decode(np.array(ids or [], np.int64)) for ids in b["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(out, pa.binary())], names=["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {dict(encoded.dtypes)['doc_id']}, data binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Number of ids of every row, and the digests of the ids and of what they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            n, a, d = [], [], []
            for text in b["text"].to_pylist():
                ids = c.encode(text)
                n.append(len(ids))
                a.append(hashlib.sha256(",".join(map(str, ids.tolist())).encode()).hexdigest())
                d.append(hashlib.sha256(c.decode(ids)).hexdigest())
            cols = [b["doc_id"], pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def op7_bpe(spark: SparkSession, sf_dir: str, path: Callable[[str], str] | None = None) -> DataFrame:
    import public_tokenizers

    file = (path or public_tokenizers.path)("byte_bpe_multi_50k.tiktoken")
    return digests(table(spark, sf_dir, "documents"), file, public_tokenizers.PATTERN)
