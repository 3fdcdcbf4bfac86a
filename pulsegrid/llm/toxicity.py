"""Operator 5: toxicity of text restored by a noisy-channel decoder.

Disguised words (leetspeak, s p a c e d letters, repeeeated letters) span a lattice: every symbol can
stand for itself or for some letters, a run of one letter for one or two of them. Viterbi's algorithm
takes the path that a character trigram model of the whole corpus finds likeliest, less what each
substitution costs. The score is a logistic model over learned word weights of the restored text: its plain words and
the readings of its disguised ones.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remainder, table, written

#: Letters that a symbol can stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "(": "c", "*": "aeiou", "#": "h",
}
#: Log cost of reading a symbol as a letter, of dropping it, of a double letter in place of a longer run, and of
#: a single letter in place of a double one.
READ_COST, DROP_COST, DOUBLE_COST, SINGLE_COST = 0.2, 9.0, 0.0, 4.0
#: Common words that spelled runs are cut into, and the log cost of another word and of each of its letters.
COMMON, RARE_COST, UNKNOWN_COST = 20_000, 10.0, 2.3
#: Labelled rows of either class that the classifier learns from (all, if fewer): a hash of the id keeps this share
#: of the class's count, so the number varies by a few square roots.
SAMPLE = 20_000
#: How much more often than others toxic texts must hold a word, and by what likelihood-ratio statistic (24: one chance
#: in a million a word), for it to get a weight.
LEAST_RATIO, LEAST_G = 8.0, 24.0
#: Tokens that a task remembers, and the length up to which it does.
MEMORY, SHORT = 200_000, 64

N = 28  # boundary, a to z, any other letter
_CODE = np.zeros(256, np.int64)
_CODE[128:] = 27
for _i in range(26):
    _CODE[97 + _i] = _CODE[65 + _i] = 1 + _i

# Each of these is tried at the start of a word only and never goes back, so a text is scanned in one go.
_MIXED = re.compile(r"(?<!\w)(?<![@$!|+(*#])[a-zA-Z]*+[0-9@$!|+(*#][a-zA-Z0-9@$!|+(*#]*+")
_SPELLED = re.compile(r"(?<!\w)[a-zA-Z0-9@$!|+(#](?:[^\w@$!|+(#]++[a-zA-Z0-9@$!|+(#]){2,}+(?!\w)")
_GAPS, _EDGES = re.compile(r"[^\w@$!|+(#]+"), re.compile(r"[!|+(*#]*")
_WORD = re.compile(r"\w+")
_LETTER, _TRIPLE = re.compile(r"[a-zA-Z]"), re.compile(r"([a-z])\1\1")


def trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the letter trigrams of all texts of a task."""
    counts = np.zeros(N**3, np.int64)
    for batch in batches:
        for text in batch["text"].to_pylist():
            if text:
                data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
                for at in range(0, len(data), 1 << 20):
                    c = np.concatenate([[0], _CODE[data[max(0, at - 2) : at + (1 << 20)]], [0]])
                    counts += np.bincount(c[:-2] * N * N + c[1:-1] * N + c[2:], minlength=N**3)
    yield pa.RecordBatch.from_pydict({"gram": np.arange(N**3, dtype=np.int32), "n": counts})


def log_model(counts: np.ndarray) -> np.ndarray:
    """log P(letter | two before), interpolated with shorter contexts."""
    c3 = counts.reshape(N, N, N).astype(float)
    c2, c1 = c3.sum(axis=0), c3.sum(axis=(0, 1))
    p1 = (c1 + 1) / (c1.sum() + N)
    p2 = (c2 + 5 * p1) / (c2.sum(axis=1, keepdims=True) + 5)
    p3 = (c3 + 5 * p2[None]) / (c3.sum(axis=2, keepdims=True) + 5)
    return np.log(p3)


def _lattice(token: str) -> list[list[tuple[str, float]]]:
    """For each run of one character its readings with their costs."""
    out: list[list[tuple[str, float]]] = []
    i, token = 0, token.lower()
    while i < len(token):
        j = i
        while j < len(token) and token[j] == token[i]:
            j += 1
        ch, run = token[i], j - i
        if ch in LEET:
            costs = {1: SINGLE_COST if run == 2 else 0.0, 2: DOUBLE_COST}
            options = [(x * m, READ_COST + costs[m]) for x in LEET[ch] for m in range(1, min(run, 2) + 1)]
            out.append([*options, ("", DROP_COST)])
        elif "a" <= ch <= "z":
            out.append([(ch, 0.0)] if run == 1 else [(ch, SINGLE_COST if run == 2 else 0.0), (ch * 2, 0.0 if run == 2 else DOUBLE_COST)])
        i = j
    return out


def decode(token: str, model: list) -> str:
    """The likeliest letters behind a token; model[a][b][c] is the log probability of c after a and b."""
    states: dict = {(0, 0): (0.0, None)}  # score, and the way back: (letters, the way before)
    for options in [*_lattice(token), [("\0", 0.0)]]:
        after: dict = {}
        for (a, b), (score, way) in states.items():
            for letters, cost in options:
                p, q, s = a, b, score - cost
                for ch in letters:
                    k = 0 if ch == "\0" else ord(ch) - 96
                    s += model[p][q][k]
                    p, q = q, k
                if (p, q) not in after or s > after[p, q][0]:
                    after[p, q] = (s, (letters, way))
        states = after
    way, said = max(states.values(), key=lambda x: x[0])[1], []
    while way:
        said.append(way[0])
        way = way[1]
    return "".join(reversed(said)).replace("\0", "")


def segmented(letters: str, common: dict[str, float]) -> list[str]:
    """The likeliest words of a run of letters; common has log probabilities of words, others cost by their length."""
    best = [(0.0, 0)]
    for end in range(1, len(letters) + 1):
        ways = ((best[at][0] + common.get(letters[at:end], UNKNOWN_COST * (at - end) - RARE_COST), at) for at in range(max(0, end - 24), end))
        best.append(max(ways))
    out, end = [], len(letters)
    while end:
        out.append(letters[best[end][1] : end])
        end = best[end][1]
    return out[::-1]


class Restorer:
    def __init__(self, model: np.ndarray, common: dict[str, float] | None = None):
        self.model, self.common, self.memo = model.tolist(), common or {}, {}

    def _readings(self, token: str, spelled: bool) -> list[list[str]]:
        """Words of each reading, likeliest first: punctuation at the ends as such or as letters."""
        head = _EDGES.match(token)[0]
        tail = "" if len(head) == len(token) else _EDGES.match(token[::-1])[0]
        cores = [token[a : len(token) - b] for a in {len(head), 0} for b in {len(tail), 0}] if not spelled else [token]
        out, plain = [], None
        for core in sorted(set(cores), key=len):
            if core.isalpha() and not spelled and not re.search(r"(.)\1\1", core.lower()):
                plain = core.lower()  # counted as it stands
                out.append([])
            elif spelled:
                out.append(segmented(decode(core, self.model), self.common))
            else:
                word = decode(core, self.model)
                out.append([word] if word != plain else [])
        return out

    def _remembered(self, token: str, spelled: bool) -> list[list[str]]:
        if (found := self.memo.get((token, spelled))) is None:
            found = self._readings(token, spelled)
            if len(token) <= SHORT:
                if len(self.memo) > MEMORY:
                    self.memo.clear()
                self.memo[token, spelled] = found
        return found

    def restored(self, text: str, known: dict[str, float] | None = None) -> list[str]:
        """The readings of the text's disguised tokens: the first that holds a known word, or else the first.

        Disguised are words that hold a letter and a symbol (at their ends as well), letters spelled one by one with any
        separators, and words with a letter three times in a row.
        """
        return self._disguised(text.replace("_", " "), known or {})

    def _disguised(self, text: str, known: dict[str, float]) -> list[str]:
        out: list[str] = []
        found = [(m[0], False) for m in _MIXED.finditer(text)] + [(_GAPS.sub("", m[0]), True) for m in _SPELLED.finditer(text)]
        found += [(w, False) for w in _WORD.findall(text) if w.isascii() and w.isalpha() and _TRIPLE.search(w.lower())] if _TRIPLE.search(text.lower()) else []
        for token, spelled in found:
            if _LETTER.search(token):
                readings = self._remembered(token, spelled)
                out += next((r for r in readings if known and any(w in known for w in r)), readings[0])
        return out

    def words(self, text: str, known: dict[str, float] | None = None) -> list[str]:
        """The words of the restored text: plain ones in small letters, then the readings of disguised ones."""
        text = text.replace("_", " ")
        return _WORD.findall(text.lower()) + self._disguised(text, known or {})


def _shout(text: str) -> float:
    capitals = sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    small = sum(map(text.count, "abcdefghijklmnopqrstuvwxyz"))
    return capitals / max(1, capitals + small)


def _features(text: str, restorer: Restorer, weights: dict[str, float]) -> list[float]:
    """Weighted and plain number of learned words in the restored text, their share of it, and how loud the text is."""
    words = restorer.words(text, weights)
    hits = [weights[w] for w in words if w in weights]
    return [math.log1p(sum(hits)), math.log1p(len(hits)), min(1.0, 20 * len(hits) / (1 + len(words))), _shout(text)]


NAMES = ("weight", "hits", "density", "capitals")


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weighted logistic regression with a small ridge, by Newton's method."""
    x = np.hstack([np.ones((len(x), 1)), x])
    b = np.zeros(x.shape[1])
    ridge = np.eye(len(b)) * 0.5
    ridge[0, 0] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (w * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge, x.T @ (w * (y - p)) - ridge @ b)
        b += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return b


class Model:
    def __init__(self, grams: np.ndarray, weights: dict[str, float], coefs: np.ndarray, common: dict[str, float] | None = None):
        self.grams, self.weights, self.coefs, self.common = grams, weights, coefs, common or {}


def fit(docs: DataFrame, truth: DataFrame) -> Model:
    """Character model of all ``docs``; word weights and the classifier from the rows of ``truth`` (doc_id, toxic).

    A repeated id is toxic if any of its labels says so; null ids, labels and texts take no part, and equal texts count
    once. With labels of one kind only, every text gets that kind's score; with none, a low one. What reaches the driver
    is bounded by the sample: 28^3 counts, the words that some 2 x SAMPLE texts hold often enough, and their features.
    """
    spark = docs.sparkSession
    counts = np.zeros(N**3, np.int64)
    for k, n in docs.select("text").mapInArrow(trigrams, "gram int, n long").groupBy("gram").agg(F.sum("n")).collect():
        counts[k] = n
    grams = log_model(counts)
    truth = truth.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    totals = {r[0]: r[1] for r in truth.groupBy("toxic").count().collect()}
    share = {k: int(min(1.0, SAMPLE / totals.get(k, 1)) * (1 << 40)) for k in (True, False)}
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    some = truth.where(drawn < F.when(F.col("toxic"), F.lit(share[True])).otherwise(F.lit(share[False])))
    sample = written(docs.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(some), "doc_id").dropDuplicates(["text"]), "toxic-sample")
    n = {r[0]: r[1] for r in sample.groupBy("toxic").count().collect()}
    if not n.get(True) or not n.get(False):
        prior = 0.0 if not n else 1.0 if n.get(True) else -1.0
        return Model(grams, {}, np.array([4 * prior - (not n) * 4] + [0.0] * len(NAMES)))
    shared = spark.sparkContext.broadcast(grams)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(shared.value)
        for batch in batches:
            for text, toxic in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist(), strict=True):
                found = sorted(set(restorer.words(text)))
                yield pa.RecordBatch.from_pydict({"word": pa.array(found, pa.string()), "toxic": pa.array([toxic] * len(found), pa.bool_())})

    by_word = sample.mapInArrow(words, "word string, toxic boolean").where("length(word) > 2").groupBy("word")
    share = written(by_word.agg(F.count_if("toxic").alias("t"), F.count_if(~F.col("toxic")).alias("f")), "toxic-words")
    often = share.select("word", (F.col("t") + F.col("f")).alias("n")).where("n > 1").orderBy(F.desc("n"), "word").limit(COMMON).collect()
    common = {r.word: math.log(r.n / sum(n.values()) / 100) for r in often}  # texts that hold it; a hundred words a text
    t, f, part = F.col("t"), F.col("f"), n[True] / (n[True] + n[False])
    part_of = lambda c, p: F.when(c > 0, c * F.log(c / ((t + f) * p))).otherwise(0.0)
    share = share.select("word", ((t + 0.5) / (n[True] + 1)).alias("pt"), ((f + 0.5) / (n[False] + 1)).alias("pf"), (2 * (part_of(t, part) + part_of(f, 1 - part))).alias("g"))
    rows = share.where((F.col("g") >= LEAST_G) & (F.col("pt") >= LEAST_RATIO * F.col("pf"))).collect()
    weights = {r.word: math.log(r.pt / r.pf) for r in sorted(rows)}

    spoken = spark.sparkContext.broadcast(common)

    def rated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(shared.value, spoken.value)
        for batch in batches:
            x = np.array([_features(t, restorer, weights) for t in batch["text"].to_pylist()]).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch["toxic"], *map(pa.array, x.T)], names=["toxic", *NAMES])

    seen = sample.mapInArrow(rated, "toxic boolean, " + ", ".join(f"{c} double" for c in NAMES)).toPandas()
    y = seen["toxic"].to_numpy(float)
    scale = {k: totals[k] / n[k] for k in n}
    w = np.where(y > 0, scale[True], scale[False])
    return Model(grams, weights, _logistic(seen[list(NAMES)].to_numpy(float), y, w * len(w) / w.sum()), common)


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``keep`` columns with score and predicted.

    Null and empty texts get the score of a text without findings. Repeated rows each get a row, an empty table gives none,
    columns of other names are not looked at. Texts of any length are read whole, in time that grows with it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        restorer = Restorer(m.grams, m.common)
        for batch in batches:
            x = np.array([_features(t or "", restorer, m.weights) for t in batch["_text"].to_pylist()]).reshape(-1, len(NAMES))
            p = 1 / (1 + np.exp(-np.clip(m.coefs[0] + x @ m.coefs[1:], -30, 30)))
            cols = [batch[i] for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=[*keep, "score", "predicted"])

    schema = docs.select(*keep).schema.add("score", "double").add("predicted", "integer")
    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(run, schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every row of ``documents``, learned from the labels that are not held out (see ``score``)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(remainder("doc_id", 5) != 0))
    marked = docs.select("doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "text")
    return score(marked, model, ["doc_id", "held_out"])
