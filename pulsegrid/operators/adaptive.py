"""Adaptive thresholds, rarity, spectra, drift and behaviour that have a closed form over an entity's ordered events."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scoring import log_bin


def _key(*more: str):
    return W.partitionBy("entity", *more).orderBy("t", "event_id")


def _numbered(e: DataFrame) -> DataFrame:
    return e.withColumn("n", F.row_number().over(_key()) - 1)


def _last_sorted(column: str, size: int) -> Column:
    return F.array_sort(F.collect_list(column).over(_key().rowsBetween(1 - size, 0)))


def rolling_percentile(e: DataFrame, size: int = 50, p: float = 0.95, least: int = 10) -> DataFrame:
    """The value at rank int(p (n - 1)) of the last ``size`` ones; null below ``least`` of them (the fold has a substitute there)."""
    s = e.select("event_id", _last_sorted("value", size).alias("s"))
    rank = F.floor(F.lit(p) * (F.size("s") - 1)).cast("int")
    return s.select("event_id", F.when(F.size("s") >= least, F.get("s", rank)).alias("threshold"))


def rolling_mad(e: DataFrame, size: int = 50, k: float = 3.0, least: int = 10) -> DataFrame:
    """Median plus k scaled median deviations; each deviation is from the median at its own time."""

    def middle(s: Column) -> Column:
        at = lambda i: F.get(s, i.cast("int"))
        return (at(F.floor((F.size(s) - 1) / 2)) + at(F.floor(F.size(s) / 2))) / 2

    m = e.withColumn("s", _last_sorted("value", size)).withColumn("median", middle(F.col("s"))).withColumn("far", F.abs(F.col("value") - F.col("median")))
    limit = F.col("median") + k * 1.4826 * middle(_last_sorted("far", size))
    return m.select("event_id", F.when(F.size("s") >= least, limit).alias("threshold"))


def fading_rarity(e: DataFrame, bins: int = 50, low: float = 0.1, high: float = 10_000.0, decay: float = 0.999, block: int = 100_000) -> DataFrame:
    """1 / p of a value's logarithmic bin in the decayed history before it; 1 at first, 100 where p < 0.001.

    Decay cancels in the ratio, so a row weighs decay ** -(its number). Numbers start again in each block,
    and only the block before still counts (decay ** block vanishes), so that weights stay finite.
    """
    rows = _numbered(e).withColumn("bin", log_bin(F.col("value"), bins, low, high))
    rows = rows.withColumn("block", F.floor(F.col("n") / block)).withColumn("w", F.pow(F.lit(decay), -(F.col("n") % block)))

    def history(*by: str) -> Column:
        same = F.sum("w").over(W.partitionBy("entity", *by, "block").orderBy("n").rowsBetween(W.unboundedPreceding, -1))
        former = F.sum("w").over(W.partitionBy("entity", *by).orderBy("block").rangeBetween(-1, -1))
        return F.coalesce(same, F.lit(0.0)) + F.lit(decay**block) * F.coalesce(former, F.lit(0.0))

    p = F.when(F.col("all") > 0, F.col("own") / F.col("all")).otherwise(1.0)
    seen = rows.withColumn("own", history("bin")).withColumn("all", history()).select("event_id", p.alias("p"))
    return seen.select("event_id", F.round(F.when(F.col("p") < 0.001, 100.0).otherwise(1 / F.col("p")), 4).alias("rarity"))


def shingles(e: DataFrame, k: int = 10) -> DataFrame:
    """The last k values as a vector, from the k-th event on."""
    s = e.select("event_id", F.collect_list("value").over(_key().rowsBetween(1 - k, 0)).alias("shingle"))
    return s.where(F.size("shingle") == k)


def spectra(e: DataFrame, size: int = 24, frequencies: int = 8, scale: int = 100) -> DataFrame:
    """Magnitudes of the first coefficients of each full block of ``size`` values, in one aggregate.

    Values and the waves' heights are whole numbers (of 1 / scale, and of a millionth), so the sums are exact.
    """
    rows = _numbered(e).withColumn("block", F.floor(F.col("n") / size)).withColumn("x", F.round(F.col("value") * scale).cast("long"))
    wave = lambda f, k: F.get(F.array(*[F.lit(round(1e6 * f(2 * math.pi * k * i / size))) for i in range(size)]), (F.col("n") % size).cast("int"))
    parts = [F.sum(F.col("x") * wave(f, k)).alias(f"{name}{k}") for k in range(frequencies) for name, f in (("re", math.cos), ("im", math.sin))]
    sums = rows.groupBy("entity", "block").agg(F.count("x").alias("c"), *parts).where(F.col("c") == size)
    d = lambda c: F.col(c).cast("double")
    each = [F.struct(F.lit(k).alias("k"), (F.sqrt(d(f"re{k}") * d(f"re{k}") + d(f"im{k}") * d(f"im{k}")) / size / (scale * 1e6)).alias("magnitude")) for k in range(frequencies)]
    return sums.select("entity", "block", F.inline(F.array(*each)))


def seasonality(e: DataFrame, size: int = 24, share: float = 0.4) -> DataFrame:
    """Whether one coefficient of an entity's first full block holds more than a share of the magnitudes' sum."""
    first = spectra(e, size).where("block = 0").groupBy("entity").agg(F.max("magnitude").alias("top"), F.sum("magnitude").alias("all"))
    return first.select("entity", (F.col("top") > share * F.col("all")).alias("seasonal"))


def rolling_drift(e: DataFrame, size: int = 20, least: int = 10, delta: float = 0.002) -> DataFrame:
    """Two adjacent windows before and up to each event: difference of means against its bound (no reset)."""
    now, before = _key().rowsBetween(1 - size, 0), _key().rowsBetween(1 - 2 * size, -size)
    s = e.select("event_id", *[f("value").over(w).alias(f"{n}{i}") for i, w in enumerate((now, before)) for n, f in (("c", F.count), ("m", F.avg), ("v", F.var_pop))])
    c0, c1, log = F.col("c0"), F.col("c1"), math.log(2 / delta)
    variance = F.greatest((c0 * F.col("v0") + c1 * F.col("v1")) / (c0 + c1), F.lit(0.0001))
    m = F.sqrt(1 / c0 + 1 / c1)
    bound = F.sqrt(2 * variance * m * log) + 2 / 3 * m * log
    return s.where((c0 >= least) & (c1 >= least)).select("event_id", F.round(F.abs(F.col("m0") - F.col("m1")) / bound, 4).alias("drift"))


def block_divergence(e: DataFrame, size: int = 20, width: float = 50.0) -> DataFrame:
    """Kullback-Leibler divergence of each full block's histogram from the block's before, over bins in both."""
    rows = _numbered(e).select("entity", F.floor(F.col("n") / size).alias("block"), F.floor(F.col("value") / width).alias("bin"))
    bins = rows.groupBy("entity", "block", "bin").agg(F.count("*").alias("c"))
    p = bins.withColumn("n", F.sum("c").over(W.partitionBy("entity", "block"))).where(F.col("n") == size)
    before = F.lag("c").over(W.partitionBy("entity", "bin").orderBy("block"))
    last = F.lag("block").over(W.partitionBy("entity", "bin").orderBy("block"))
    both = p.select("entity", "block", "c", before.alias("b"), last.alias("last")).where(F.col("last") == F.col("block") - 1)
    return both.groupBy("entity", "block").agg(F.round(F.sum(F.col("b") / size * F.log(F.col("b") / F.col("c"))), 4).alias("divergence"))


def decomposition(e: DataFrame, period: int = 8, periods: int = 3, k: float = 2.0, least: int = 10, scale: int = 100) -> DataFrame:
    """Trend (centred mean), season (mean by position) and residual of an entity's last periods, and outliers among those.

    Means are whole numbers of a millionth of 1 / scale, so no sum depends on the order of rows.
    """
    last = e.withColumn("back", F.row_number().over(W.partitionBy("entity").orderBy(F.desc("t"), F.desc("event_id")))).where(F.col("back") <= period * periods)
    half, unit = period // 2, 10**6
    x = F.round(F.col("value") * scale).cast("long") * unit
    mean = lambda c, w: F.round(F.sum(c).over(w) / F.count(c).over(w)).cast("long")
    d = last.withColumn("x", x).withColumn("trend", mean("x", _key().rowsBetween(-half, half))).withColumn("position", F.col("back") % period)
    d = d.withColumn("off", F.col("x") - F.col("trend")).withColumn("season", mean("off", W.partitionBy("entity", "position")))
    d = d.withColumn("rest", F.col("off") - F.col("season"))
    whole, n = W.partitionBy("entity"), F.count("rest").over(W.partitionBy("entity"))
    s, q = (F.sum(c.cast("decimal(38,0)")).over(whole) for c in (F.col("rest"), F.col("rest").cast("decimal(18,0)") * F.col("rest").cast("decimal(18,0)")))
    d = d.select("event_id", "trend", "season", "rest", n.alias("n"), s.cast("double").alias("s"), q.cast("double").alias("q"))
    spread = F.sqrt(F.greatest(F.col("q") / F.col("n") - F.col("s") / F.col("n") * (F.col("s") / F.col("n")), F.lit(0.0)))
    out = (F.col("n") >= least) & (F.abs(F.col("rest") - F.col("s") / F.col("n")) > k * spread)
    return d.select("event_id", *[(F.col(c) / (scale * unit)).alias(c) for c in ("trend", "season", "rest")], out.alias("outlier"))


def behaviour(e: DataFrame, mature: int = 50, width: float = 25.0) -> DataFrame:
    """Deviation of an event from its entity's profile before it: the largest of its parts, 0 before maturity.

    Parts: an unusual hour 0.3, a detector never seen 0.3, 0.3 and 0.2 times the rarity (above 0.8) of the gap and the value.
    """
    gap = F.coalesce(F.col("t") - F.lag("t").over(_key()), F.lit(0))
    rows = _numbered(e).select(
        "*", (F.floor(F.col("t") / 3600) % 24).alias("hour"), F.floor(F.log2(gap + 1)).alias("gap_bin"), F.floor(F.col("value") / width).alias("bin")
    )
    before = lambda *by: F.count("*").over(W.partitionBy("entity", *by).orderBy("n").rowsBetween(W.unboundedPreceding, -1))
    rows = rows.select("event_id", "n", *[before(c).alias(c) for c in ("hour", "gap_bin", "bin", "detector")])
    rare = lambda c, weight: F.when(5 * F.col(c) < F.col("n"), weight * (1 - F.col(c) / F.col("n"))).otherwise(0.0)
    parts = F.greatest(
        F.when(F.col("hour") < F.floor(F.floor(F.col("n") / 24) / 2), 0.3).otherwise(0.0),
        F.when(F.col("detector") == 0, 0.3).otherwise(0.0),
        rare("gap_bin", 0.3),
        rare("bin", 0.2),
    )
    return rows.select("event_id", F.when(F.col("n") >= mature, parts).otherwise(0.0).alias("deviation"))


def ensemble(outputs: DataFrame) -> DataFrame:
    """Combined score and confidence, and the two detectors that give most, of ``outputs`` (name, score, weight, confidence) arrays.

    Score: sum of score weight confidence over sum of weight confidence. Confidence: 0.6 times the share of scores
    above 0.5, and 0.4 times the weighted mean confidence. Equal contributions keep the array's order.
    """
    total = lambda f: F.aggregate("outputs", F.lit(0.0), lambda acc, x: acc + f(x))
    weight, share = total(lambda x: x["weight"] * x["confidence"]), F.size(F.filter("outputs", lambda x: x["score"] > 0.5)) / F.size("outputs")
    given = F.transform("outputs", lambda x, i: F.struct((-x["score"] * x["weight"] * x["confidence"]).alias("c"), i.alias("i"), x["name"].alias("name")))
    return outputs.select(
        "event_id",
        F.coalesce(F.try_divide(total(lambda x: x["score"] * x["weight"] * x["confidence"]), weight), F.lit(0.0)).alias("score"),
        (0.6 * share + 0.4 * F.coalesce(F.try_divide(weight, total(lambda x: x["weight"])), F.lit(0.5))).alias("confidence"),
        F.slice(F.array_sort(given), 1, 2)["name"].alias("top"),
    ).select("event_id", "score", "confidence", F.array_join("top", ",").alias("top"))
