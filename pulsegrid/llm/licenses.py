"""Operator 6: license notices, exact and with edits.

A text becomes its words joined by single spaces. Base notices are exact word sequences. For the fuzzy
search every notice is cut into one piece more than the edits it may have: a notice with so few edits
holds one piece unchanged (pigeonhole), so exact finds of the pieces give all candidates, and the regex
library's bounded-error matching verifies each and reports its span.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import table

#: The exact phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Short notices for the fuzzy search and their labels.
NOTICES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license version 2 0": "apache-2",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "mozilla public license version 2 0": "mpl-2",
    "redistribution and use in source and binary forms": "bsd",
    "all rights reserved": "proprietary",
    "this is free and unencumbered software released into the public domain": "unlicense",
}
#: One edit for so many characters of a notice, two at the least.
CHARS_PER_EDIT = 12

# Everything but digits, letters and bytes from 80 on parts words; capital letters become small ones.
_TO_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


#: Windows of text whose verification is remembered in a task.
MEMORY = 100_000


class Notices:
    """Notices compiled for the search: for each its label, length, edits, pieces with their places, and pattern."""

    def __init__(self, notices: dict[str, str]):
        self.compiled, self.memo = [], {}
        for phrase, label in notices.items():
            p = phrase.encode()
            k = max(2, len(p) // CHARS_PER_EDIT)
            cuts = [len(p) * i // (k + 1) for i in range(k + 2)]
            pieces = [(a, p[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
            pattern = regex.compile(rb"(?b)(?<= )(?:" + regex.escape(p, literal_spaces=True) + rb"){e<=" + str(k).encode() + rb"}(?= )")
            self.compiled.append((label, len(p), k, pieces, pattern))

    def _verified(self, i: int, window: bytes) -> tuple[int, int, int] | None:
        """Start, end and edits of the best match inside a candidate's window; equal windows are verified once."""
        if (i, window) not in self.memo:
            if len(self.memo) >= MEMORY:
                self.memo.clear()
            m = self.compiled[i][-1].search(window)
            self.memo[i, window] = m and (m.start(), m.end(), sum(m.fuzzy_counts))
        return self.memo[i, window]

    def spans(self, text: bytes) -> list[tuple[str, int, int, int]]:
        """(label, first byte, end byte, edits) of notices in a text of words with a space at either end.

        Each candidate is verified in a window of its own, so neighbours don't hide each other; of spans of one
        notice that overlap, the one with the fewest edits stays (the first, if equal).
        """
        out = []
        for i, (label, n, k, pieces, _) in enumerate(self.compiled):
            starts = {max(0, at - a - k - 1) for a, piece in pieces for at in _finds(text, piece)}
            last = None
            for a in sorted(starts):
                if (m := self._verified(i, text[a : a + n + 2 * k + 2])) is None:
                    continue
                span = (label, a + m[0], a + m[1], m[2])
                if last is None or span[1] >= last[2]:
                    out += [last] if last else []
                    last = span
                elif span[3] < last[3]:
                    last = span
            out += [last] if last else []
        return sorted(set(out))


def _finds(text: bytes, piece: bytes) -> Iterator[int]:
    at = text.find(piece)
    while at >= 0:
        yield at
        at = text.find(piece, at + 1)


def scan_text(text: str | None, notices: Notices) -> tuple:
    words = (text or "").encode("utf-8", "replace").translate(_TO_WORDS).split()
    joined = b" " + b" ".join(words) + b" "
    blanks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    word_at = lambda byte: int(np.searchsorted(blanks, byte)) - 1
    starts, base = [], set()
    for phrase, label in BASE.items():
        found = [word_at(at + 1) for at in _finds(joined, b" " + phrase.encode() + b" ")]
        starts += found
        base |= {label} if found else set()
    spans = notices.spans(joined)
    best = 1.0 if starts else max((1 - e / (b - a) for _, a, b, e in spans), default=0.0)
    return (
        len(words), len(starts), min(starts, default=None), max(starts, default=None),
        ",".join(sorted(base)), ",".join(sorted(base | {s[0] for s in spans})), max(0.0, best),
        [{"label": s[0], "first_word": word_at(s[1]), "end_word": word_at(s[2]) + 1, "edits": s[3]} for s in spans],
    )


_SPANS = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("edits", pa.int64())]))
_FIELDS = [
    ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
    ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", _SPANS),
]


def scan(docs: DataFrame, notices: dict[str, str] | None = None) -> DataFrame:
    """Licenses of every row's whole text: counts, labels and spans.

    ``notices`` are phrases of small letters, digits and single spaces with their labels (NOTICES, if none are given).
    Null and empty texts have no words and no labels (score 0); repeated rows each get their result; an empty table gives
    none; other columns of ``docs`` are ignored. Time grows with a text's length, however many notices it holds.
    """
    phrases = NOTICES if notices is None else notices

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Notices(phrases)
        for batch in batches:
            rows = list(zip(*(scan_text(t, known) for t in batch["text"].to_pylist()), strict=True)) or [[]] * len(_FIELDS)
            cols = [pa.array(list(r), kind) for r, (_, kind) in zip(rows, _FIELDS, strict=True)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *cols], names=["doc_id", *(f[0] for f in _FIELDS)])

    schema = (
        f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, n_base long, first_word long, last_word long, base_labels string, "
        "labels string, score double, spans array<struct<label: string, first_word: long, end_word: long, edits: long>>"
    )
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses of every row of ``documents`` (see ``scan``)."""
    return scan(table(spark, sf_dir, "documents"))
