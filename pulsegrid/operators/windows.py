"""Per-entity window operators: everything closed-form over an entity's ordered events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.fold import keyed_fold


def _key():
    return W.partitionBy("entity").orderBy("t", "event_id")


def _past():
    return _key().rowsBetween(W.unboundedPreceding, 0)


def running_baseline(e: DataFrame, scale: int = 100) -> DataFrame:
    """Count, mean and population deviation of an entity's events so far, from exact sums of values in steps of 1 / scale."""
    x = e.withColumn("_x", F.round(F.col("value") * scale).cast("long"))
    s = x.select(
        "event_id", F.count("_x").over(_past()).alias("n"), F.sum("_x").over(_past()).alias("s"), F.sum(F.col("_x") * F.col("_x")).over(_past()).alias("q")
    )
    n, double = F.col("n"), lambda c: c.cast("double")
    spread = F.sqrt(F.greatest(double(n * F.col("q") - F.col("s") * F.col("s")), F.lit(0.0)))
    return s.select("event_id", "n", (double(F.col("s")) / double(n) / scale).alias("mean"), (spread / double(n) / scale).alias("std"))


def interarrival(e: DataFrame) -> DataFrame:
    """Seconds since the entity's event before, and the rate they mean."""
    gap = F.col("t") - F.lag("t").over(_key())
    return e.select("event_id", gap.alias("gap_s"), F.when(gap > 0, F.round(1 / gap, 8)).alias("rate"))


def gaps(e: DataFrame) -> DataFrame:
    """Milliseconds since the entity's event before, and the rate they mean; no time or a step back counts as a nanosecond."""
    gap = F.greatest(F.col("t_ns") - F.lag("t_ns").over(_key()), F.lit(0))
    return e.select("event_id", (gap / 1e6).alias("gap_ms"), (1e9 / F.greatest(gap, F.lit(1))).alias("rate")).where("gap_ms IS NOT NULL")


def trend_word(e: DataFrame, size: int = 5) -> DataFrame:
    """Whether the last values end above where they began (spike) or not (drop); anomaly for a first event."""
    w = _key().rowsBetween(1 - size, 0)
    word = F.when(F.count("*").over(w) < 2, "anomaly").when(F.last("value").over(w) > F.first("value").over(w), "spike").otherwise("drop")
    return e.select("event_id", word.alias("trend"))


def distinct_velocity(e: DataFrame, column: str = "trace_id") -> DataFrame:
    """Running number of distinct values per entity and its increase; firsts are counted, so no set is kept."""
    seen = F.row_number().over(W.partitionBy("entity", column).orderBy("t", "event_id"))
    new = e.withColumn("new", F.when(F.col(column).isNotNull() & (seen == 1), 1).otherwise(0))
    return new.select("event_id", F.sum("new").over(_past()).alias("distinct_so_far"), F.col("new").cast("long").alias("velocity"))


def moving_average(e: DataFrame, before: int = 2, after: int = 2) -> DataFrame:
    """Centred moving average with truncated ends."""
    w = _key().rowsBetween(-before, after)
    return e.select("event_id", (F.sum(F.round(F.col("value") * 100).cast("long")).over(w) / F.count("value").over(w) / 100).alias("smoothed"))


def first_difference(e: DataFrame) -> DataFrame:
    return e.select("event_id", F.round(F.col("value") - F.lag("value").over(_key()), 4).alias("step"))


def rollup(e: DataFrame, seconds: int) -> DataFrame:
    """Mean, extremes and count per entity and window of so many seconds."""
    start = (F.floor(F.col("t") / seconds) * seconds).cast("long")
    return e.groupBy("entity", start.alias("start")).agg(
        F.count("*").alias("n"), (F.sum(F.round(F.col("value") * 100).cast("long")) / F.count("value") / 100).alias("mean"), F.min("value").alias("low"), F.max("value").alias("high")
    )


def typical_hours(e: DataFrame) -> DataFrame:
    """Hours of the day that hold more than a 24th of an entity's events."""
    hour = (F.floor(F.col("t") / 3600) % 24).cast("long")
    by_hour = e.groupBy("entity", hour.alias("hour")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(W.partitionBy("entity"))
    return by_hour.select("entity", "hour", "n", (F.col("n") * 24 > total).alias("typical"))


def linear_bin(e: DataFrame, low: float = 0.0, high: float = 500.0, bins: int = 50) -> DataFrame:
    """The bin of each value on a linear scale, clamped at both ends."""
    place = F.floor((F.col("value") - low) / (high - low) * bins)
    return e.select("event_id", F.least(F.greatest(place, F.lit(0)), F.lit(bins - 1)).cast("int").alias("bin"))


def bin_rarity(e: DataFrame, width: float = 25.0) -> DataFrame:
    """One minus the share of an entity's events in a value's bin."""
    bins = e.groupBy("entity", F.floor(F.col("value") / width).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    return bins.select("entity", "bin", "n", F.round(1 - F.col("n") / F.sum("n").over(W.partitionBy("entity")), 6).alias("rarity"))


def duplicates_removed(e: DataFrame, seconds: int = 900) -> DataFrame:
    """Events without those that follow an accepted one of the same entity, detector and trace within a time.

    What was dropped does not prolong the time, so the events are folded.
    """

    def step(s: dict, t: int, _entity: int) -> tuple:
        new = "last" not in s or t - s["last"] >= seconds
        if new:
            s["last"] = t
        return (new,)

    known = e.where("entity IS NOT NULL")
    kept = keyed_fold(known, dict, step, "kept boolean", "struct(entity, detector, trace_id)", ("t", "entity")).where("kept").select("event_id")
    return e.join(kept, "event_id", "left_semi").select("event_id", "entity", "t")
