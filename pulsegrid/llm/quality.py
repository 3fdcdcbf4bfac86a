"""Operator 9: quality rules with risk-controlled thresholds, in DataFrame functions only.

Every rule scores a text; a text is rejected where any rule's score reaches its cutoff. Labelled texts are split in
two by a hash of their id. The first half proposes: per stratum a cutoff for each rule and an order of the rules, the
surest first. The second half certifies: of the union of the first j rules' cutoffs the exact binomial probability of
at most so few false rejections under the allowed rate is the p-value of "these rules reject too many good texts".
Unions only grow, so they are tested in their order and the first that can't be certified ends it (a fixed sequence
needs no correction); across strata the level is split (Bonferroni). What acts is one certified union a stratum, so
the guarantee holds for the joint verdict.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WS, let, table, written

#: Bands of text length in words: the strata. Their number is fixed, so their thresholds can be broadcast.
BANDS = (0, 50, 200, 1000)
#: Rules: name and cutoffs from the most lenient to the strictest.
RULES = {
    "symbol_ratio": (0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1),
    "dup_line_ratio": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3),
    "repeat_ratio": (0.2, 0.15, 0.1),
    "mean_word_chars": (40.0, 30.0, 20.0, 15.0),
}
#: Largest certified rate of false rejections in a stratum, and the chance that any certificate is wrong.
MAX_FALSE_RATE, DELTA = 0.05, 0.05
#: A wrongly rejected text weighs so many rightly rejected ones when one of the certified cutoffs is picked.
FALSE_WEIGHT = 4
#: Deviations of the binomial beyond which terms no longer show in a sum of doubles.
FAR = 12


def _repeated_words(words: Column) -> Column:
    """Words inside 5-word windows that occur at least twice in the text."""

    def covered(h: Column) -> Column:
        ranked = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def count(s: Column) -> Column:
            twice = F.filter(
                F.transform(
                    s,
                    lambda x, j: F.when(
                        x["h"].eqNullSafe(F.get(s, j - 1)["h"]) | x["h"].eqNullSafe(F.get(s, j + 1)["h"]), x["i"]
                    ),
                ),
                lambda p: p.isNotNull(),
            )
            return let(
                F.sort_array(twice),
                lambda p: F.aggregate(
                    F.transform(p, lambda x, j: F.least(F.lit(5), F.coalesce(F.get(p, j + 1) - x, F.lit(5)))),
                    F.lit(0),
                    lambda a, b: a + b,
                ),
            )

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(ranked, count))

    hashes = F.transform(
        F.sequence(F.lit(0), F.size(words) - 5), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(5)])
    )
    return F.when(F.size(words) < 6, F.lit(0)).otherwise(let(hashes, covered))


def features(docs: DataFrame, text: str = "text", row: bool = False) -> DataFrame:
    """One row per document: its id, base features, rule scores and stratum; null text counts as empty.

    ``row`` keeps the whole row too, as a struct that no feature's name can clash with.
    """
    whole = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")] if row else []
    t = F.coalesce(F.col(text), F.lit(""))
    symbols = F.char_length(t) - F.char_length(F.translate(t, "#*$%&|<>", ""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    f = docs.select(
        *whole,
        "doc_id",
        let(
            F.array_remove(F.split(t, WS), ""),
            lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeated_words(w).cast("long").alias("n_repeat_words")),
        ).alias("w"),
        F.char_length(F.regexp_replace(t, WS, "")).cast("long").alias("word_chars"),
        symbols.cast("long").alias("n_symbols"),
        let(
            lines,
            lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")),
        ).alias("l"),
    ).select(*["_row"] * row, "doc_id", "w.n_words", "word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "l.n_lines")
    one = F.lit(1)
    return f.select(
        "*",
        ((F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).alias("base_failed"),
        (F.col("n_symbols") / F.greatest("word_chars", one)).alias("symbol_ratio"),
        (F.col("n_dup_lines") / F.greatest("n_lines", one)).alias("dup_line_ratio"),
        (F.col("n_repeat_words") / F.greatest("n_words", one)).alias("repeat_ratio"),
        (F.col("word_chars") / F.greatest("n_words", one)).alias("mean_word_chars"),
        sum((F.col("n_words") >= b).cast("int") for b in BANDS[1:]).alias("band"),
    )


def log_gamma(z: Column) -> Column:
    """ln of the gamma function from 1 on, by Stirling's series at z + 10."""
    y = z + 10
    series = 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    risen = sum((F.log(z + i) for i in range(10)), F.lit(0.0))
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - risen


def binomial_tail(k: Column, n: Column, rate: float) -> Column:
    """P(X <= k) for X binomial(n, rate), at every size.

    The term at k (or k + 1, for the complement above the mean) comes from log-gammas, the others by their ratios
    away from the mean, until they vanish: some FAR deviations of them.
    """
    k, n = k.cast("double"), n.cast("double")
    below = k <= n * rate
    start = F.when(below, k).otherwise(k + 1)
    at = log_gamma(n + 1) - log_gamma(start + 1) - log_gamma(n - start + 1) + start * math.log(rate) + (n - start) * math.log1p(-rate)
    steps = F.least(F.when(below, start).otherwise(n - start), F.ceil(FAR * F.sqrt(n * rate * (1 - rate))) + 40).cast("long")
    odds = rate / (1 - rate)

    def add(acc: Column, i: Column) -> Column:
        down, up = (start - i + 1) / (n - start + i) / odds, (n - start - i + 1) / (start + i) * odds
        t = acc["t"] * F.when(below, down).otherwise(up)
        return F.struct(t.alias("t"), (acc["s"] + t).alias("s"))

    terms = F.when(steps >= 1, F.sequence(F.lit(1).cast("long"), steps)).otherwise(F.array().cast("array<long>"))
    total = F.aggregate(terms, F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")), add, lambda a: a["s"])
    part = F.exp(at) * total
    return F.when(k >= n, 1.0).otherwise(F.least(F.lit(1.0), F.when(below, part).otherwise(1 - part)))


def _half(doc_id: str) -> Column:
    """0 or 1 by a hash of the id."""
    return F.conv(F.substring(F.md5(F.col(doc_id).cast("string")), 1, 8), 16, 10).cast("long") % 2


def _proposed(half: DataFrame) -> DataFrame:
    """Per band and rule the cutoff that gains most on the first half, and its place among the band's rules."""
    level = lambda name, cuts: sum((F.col(name) >= c).cast("int") for c in cuts)  # noqa: E731
    long = half.select(
        "band", "good", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), level(r, c).alias("level")) for r, c in RULES.items()])).alias("r")
    )
    counts = long.groupBy("band", "r.rule", "r.level").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    # A text that reaches so many of a rule's cutoffs reaches the most lenient of them: cutoff i (from 1) rejects levels i and up.
    up = W.partitionBy("band", "rule").orderBy(F.desc("level")).rowsBetween(W.unboundedPreceding, 0)  # a dozen levels
    sums = counts.select("band", "rule", "level", F.sum("good").over(up).alias("wrong"), F.sum("bad").over(up).alias("right")).where("level > 0")
    gain = F.col("right") - FALSE_WEIGHT * F.col("wrong")
    best = sums.where(gain > 0).groupBy("band", "rule").agg(F.max_by(F.struct("level", "wrong", "right"), F.struct(gain, -F.col("level"))).alias("b"))
    cut = F.coalesce(*[F.when(F.col("rule") == r, F.get(F.array(*map(F.lit, sorted(c))), F.col("b.level") - 1)) for r, c in RULES.items()])
    sure = W.partitionBy("band").orderBy(F.col("b.wrong") / (F.col("b.wrong") + F.col("b.right")), F.desc("b.right"), "rule")
    return best.select("band", "rule", cut.alias("cut"), F.row_number().over(sure).alias("place"))


def thresholds(scored: DataFrame, labels: DataFrame) -> DataFrame:
    """Per band one row with a cutoff for each rule (null: the rule does not act there).

    A repeated id's label is the smallest one, and null ids and labels take no part. Bands without a certified union have no row.
    """
    truth = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg((F.min("quality") > 0).alias("good"))
    held = scored.where("NOT base_failed").select("doc_id", "band", *RULES).join(truth, "doc_id")
    held = written(held.withColumn("half", _half("doc_id")), "holdouts")
    proposed = _proposed(held.where("half = 0"))
    wide = proposed.groupBy("band").agg(
        *[F.max(F.when(F.col("rule") == r, F.col(c))).alias(f"{c}_{r}") for r in RULES for c in ("cut", "place")]
    )
    wide = written(wide, "proposed")  # a row a band at most
    # The place of the first rule that rejects a text: the union of the first j rules rejects those with a place up to j.
    first = F.array_min(F.array(*[F.when(F.col(r) >= F.col(f"cut_{r}"), F.col(f"place_{r}")) for r in RULES]))
    tested = held.where("half = 1 AND good").join(F.broadcast(wide), "band").groupBy("band").agg(
        F.count("*").alias("n"), *[F.count_if(first <= j).alias(f"wrong_{j}") for j in range(1, len(RULES) + 1)]
    )
    level = DELTA / len(BANDS)
    passes = [binomial_tail(F.col(f"wrong_{j}"), F.col("n"), MAX_FALSE_RATE) <= level for j in range(1, len(RULES) + 1)]
    certified = F.lit(0)
    for j in range(len(RULES), 0, -1):
        certified = F.when(passes[j - 1], F.lit(1) + certified).otherwise(F.lit(0))
    certified = tested.select("band", certified.alias("certified")).where("certified > 0")
    acts = lambda r: F.when(F.col(f"place_{r}") <= F.col("certified"), F.col(f"cut_{r}"))  # noqa: E731
    return wide.join(certified, "band").select("band", *[acts(r).alias(f"cut_{r}") for r in RULES])


def _judged(scored: DataFrame, cuts: DataFrame) -> DataFrame:
    # One row a band at most, and the bands are fixed: small enough to broadcast at any input size.
    out = scored.join(F.broadcast(cuts), "band", "left")
    rejected = F.lit(False)
    for r in RULES:
        rejected = rejected | F.coalesce(F.col(r) >= F.col(f"cut_{r}"), F.lit(False))
    return out.withColumn("kept", ~F.col("base_failed") & ~rejected)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns (see ``assess``).

    Rows with a null id are judged like any other. The rows are written once with their scores, then judged.
    """
    scored = written(features(docs, row=True), "quality")
    return _judged(scored, written(thresholds(scored, labels), "cuts")).where("kept").select("_row.*")


def assess(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Quality verdict per document row.

    Null and empty texts have no words and fail the base rule. Repeated ids and rows each get a row; an empty table gives
    none. With no (or too few) labelled texts in a band, nothing is certified there and only the base rule rejects.
    Texts of any length are read whole; a text's windows are held at once. Extra columns are ignored, whatever their names.
    """
    scored = written(features(docs), "quality")
    return _judged(scored, written(thresholds(scored, labels), "cuts")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "band", *RULES,
        *[f"cut_{r}" for r in RULES],
    )  # fmt: skip


def op9_quality(spark, sf_dir: str) -> DataFrame:
    """The contract's columns and the band of every row of ``documents`` (see ``assess``)."""
    found = assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "band")


_LEVELS = "UNION ALL ".join(
    f"SELECT doc_id, band, good, '{r}' AS rule, unnest([{', '.join(map(str, sorted(c)))}]::DOUBLE[]) AS cut, {r} AS score FROM held WHERE half = 0 "
    for r, c in RULES.items()
)
_FIRSTS = ", ".join(f"CASE WHEN {r} >= max(cut) FILTER (rule = '{r}') THEN max(place) FILTER (rule = '{r}') END" for r in RULES)
#: Values of the rules that are fixed here: see the constants above.
OP9_SQL = rf"""
WITH t AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^ 	-]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ 	-]')) AS l FROM t),
g AS (SELECT row, unnest(list_transform(range(1, greatest(len(w) - 3, 1)), lambda i: [w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4]])) AS gram, unnest(range(1, greatest(len(w) - 3, 1))) AS i FROM w),
r AS (SELECT row, count(DISTINCT i + o) AS n FROM (SELECT row, i, count(*) OVER (PARTITION BY row, gram) AS c FROM g) AS x, range(5) AS q(o) WHERE c > 1 GROUP BY 1),
f AS (SELECT row, doc_id, len(w)::BIGINT AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, len(l) AS n_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN r USING (row)),
s AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, n_symbols / greatest(word_chars, 1) AS symbol_ratio, n_dup_lines / greatest(n_lines, 1) AS dup_line_ratio,
  n_repeat_words / greatest(n_words, 1) AS repeat_ratio, word_chars / greatest(n_words, 1) AS mean_word_chars, {' + '.join(f'CAST(n_words >= {b} AS INT)' for b in BANDS[1:])} AS band FROM f),
truth AS (SELECT doc_id, min(quality) > 0 AS good FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY 1),
held AS (SELECT s.*, good, CAST('0x' || left(md5(CAST(s.doc_id AS VARCHAR)), 8) AS BIGINT) % 2 AS half FROM s JOIN truth USING (doc_id) WHERE NOT base_failed),
tried AS (SELECT band, rule, cut, count(*) FILTER (good) AS wrong, count(*) FILTER (NOT good) AS rgt FROM ({_LEVELS}) AS y WHERE score >= cut GROUP BY ALL),
best AS (SELECT * FROM tried WHERE rgt > {FALSE_WEIGHT} * wrong QUALIFY row_number() OVER (PARTITION BY band, rule ORDER BY rgt - {FALSE_WEIGHT} * wrong DESC, cut) = 1),
proposed AS (SELECT *, row_number() OVER (PARTITION BY band ORDER BY wrong / (wrong + rgt), rgt DESC, rule) AS place FROM best),
firsts AS (SELECT row, band, list_min(list_filter([{_FIRSTS}], lambda x: x IS NOT NULL)) AS first FROM held JOIN proposed USING (band) WHERE half = 1 AND good GROUP BY row, band, {', '.join(RULES)}),
tested AS (SELECT band, j, count(*) AS n, count(*) FILTER (first <= j) AS k FROM firsts, range(1, {len(RULES) + 1}) AS q(j) GROUP BY 1, 2),
p AS (SELECT band, j, list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({MAX_FALSE_RATE}::DOUBLE) + (n - i) * ln(1 - {MAX_FALSE_RATE}::DOUBLE)))) AS p FROM tested),
certified AS (SELECT band, count(*) FILTER (worst <= {DELTA / len(BANDS)}) AS j FROM (SELECT band, j, max(p) OVER (PARTITION BY band ORDER BY j) AS worst FROM p) AS z GROUP BY 1),
acts AS (SELECT band, {', '.join(f"max(cut) FILTER (rule = '{r}') AS cut_{r}" for r in RULES)} FROM proposed JOIN certified USING (band) WHERE place <= j GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT ({' OR '.join(f'coalesce({r} >= cut_{r}, FALSE)' for r in RULES)}) AS kept, band
FROM s LEFT JOIN acts USING (band)
"""
