"""Canonical events of stage 2, their incidents' decisions, and the small rules about ids, times and percents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import plain_text
from ..sources.wire import day_bucket


def seconds(t: Column, now: Column, relative: Column | None = None) -> Column:
    """Seconds of a time in ns, ms or s, told apart by size; nothing, text that is no number and times up to 0 are ``now``.

    Where ``relative``, times below 10^12 are nanoseconds since now.
    """
    t = t.try_cast("double")
    whole = lambda x: F.floor(x).cast("long")
    out = F.when((t > 1e15) | ((t > 1e10) & (t <= 1e12)), whole(t / 1e9)).when(t > 1e12, whole(t / 1e3)).otherwise(whole(t))
    if relative is not None:
        out = F.when(relative & (t < 1e12), now + whole(t / 1e9)).otherwise(out)
    return F.when(t.isNull() | F.isnan(t) | (t <= 0), now).otherwise(out)


def severity_of(severity: Column, version: Column) -> Column:
    """Severity in [0, 1]: of format 1 the whole levels 0 to 4 are quarters; others up to 1 stay, and above it are quarters."""
    level = (version == 1) & (severity == F.floor(severity)) & (severity <= 4)
    return (
        F.when(severity.isNull() | F.isnan(severity) | (severity <= 0), 0.0).when(level, severity / 4).when(severity <= 1, severity)
        .otherwise(F.least(F.lit(1.0), severity / 4))
    )


def event_id(given: Column, entity: Column, t: Column, detector: Column, score: Column, severity: Column) -> Column:
    """The id given, or a hash of what the signal says."""
    seed = F.format_string("%s:%d:%d:%.6f:%.6f", entity, t, detector, score, severity)
    return F.coalesce(F.nullif(given, F.lit("")), F.substring(F.md5(seed.cast("binary")), 1, 16))


def canonical(signals: DataFrame, now: int) -> DataFrame:
    """Canonical rows of wire signals: id, time in seconds, severity share, rhythm, group key and context.

    Signals of a benchmark's run may give their times relative to ``now``.
    """
    a = lambda k: F.nullif(F.col("attributes")[k], F.lit(""))
    t = seconds(F.col("timestamp"), F.lit(now).cast("long"), a("benchmark_run_id").isNotNull())
    s = signals.withColumn("t", t).withColumn("severity", severity_of(F.col("severity"), F.col("schema_version")))
    s = s.withColumn("event_id", event_id(F.col("event_id"), F.col("entity_hash"), F.col("t"), F.col("primary_detector"), F.col("score"), F.col("severity")))
    rhythm = F.coalesce(a("rhythm_hash"), F.substring("entity_hash", 1, 16))
    return s.select(
        "event_id", "entity_hash", F.concat(F.lit("hash:"), F.col("entity_hash")).alias("entity_id"), "t", "score", "severity", F.col("primary_detector").alias("detector"),
        F.col("detectors_fired").alias("fired"), "confidence", "detector_scores", rhythm.alias("rhythm"),
        F.concat_ws(":", rhythm, F.col("primary_detector").cast("string")).alias("group_key"),
        F.concat(F.lit("rhythm="), rhythm, F.lit(" det="), F.col("primary_detector").cast("string")).alias("context"),
        a("trace_id").alias("trace_id"), a("benchmark_run_id").alias("run_id"), a("ground_truth_anomaly_id").alias("truth_id"), day_bucket(F.col("t")).alias("day"),
    )


def batch_id(rows: DataFrame, *by: str) -> DataFrame:
    """For each batch a hash of its events' ids and times, whatever their order: of their number and two sums of hashes."""
    each = F.md5(F.concat_ws(":", "event_id", F.col("t").cast("string")).cast("binary"))
    sums = [F.sum(F.conv(F.substring(each, i, 15), 16, 10).cast("decimal(38,0)")).cast("string") for i in (1, 16)]
    whole = F.concat_ws(":", F.count("*").cast("string"), *sums)
    return rows.groupBy(*by).agg(F.md5(whole.cast("binary")).alias("batch_id"), F.count("*").alias("events"))



def percent(x: Column) -> Column:
    """A share as a whole percent, halves up."""
    return F.floor(x * 100 + 0.5).cast("int")


def entity_of_key(key: Column) -> Column:
    """The number behind ``hash:``, if it is a whole one up to 2^53 - 1."""
    n = F.nullif(F.regexp_extract(key, r"^hash:\s*(\d+)\s*$", 1), F.lit("")).try_cast("bigint")
    return F.when(n <= 2**53 - 1, n)


def entity_text(key: Column, evidence: Column) -> Column:
    """The digits behind ``hash:``, else those of the evidence, else nothing."""
    digits = lambda x, p: F.nullif(F.regexp_extract(x, p, 1), F.lit(""))
    return F.coalesce(digits(key, r"^hash:(\d+)$"), digits(evidence, r"^(\d+)$"))


def payload_time(start: Column, stamp: Column) -> Column:
    """The start of a payload, else its time; 0 where it is no number."""
    return F.coalesce(F.coalesce(start, stamp).try_cast("double"), F.lit(0.0))


def run_length(shift: Column, slack: Column, limit: Column) -> Column:
    """Siegmund's expected number of events until the cumulative sums alarm."""
    d = shift - slack
    far = F.greatest((F.exp(-2 * d * limit) + 2 * d * limit - 1) / (2 * d * d), F.lit(1.0))
    return F.when(F.abs(d) < 0.001, F.exp(limit * limit / 2)).otherwise(far)


def normalised(text: Column) -> Column:
    return plain_text(text)
