"""What travels between the two stages: wire signals, slim rows, JSON batches, dead letters, and logs' attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import severity_level

#: Attribute keys of a metric, the most telling first.
METRIC_PRIORITY = ("http.duration_ms", "latency_ms", "process.memory.usage", "process.cpu.utilization", "http.status_code")
EVENT = "struct<u:string,v:double,t:bigint>"
SIGNAL = (
    "struct<event_id:string,schema_version:int,entity_hash:string,timestamp:string,score:double,severity:double,primary_detector:int,"
    "detectors_fired:int,confidence:double,detector_scores:array<double>,attributes:map<string,string>>"
)
#: Fields that a wire signal must have.
REQUIRED = ("schema_version", "entity_hash", "timestamp", "score", "severity", "primary_detector", "detectors_fired", "confidence", "detector_scores")


def wire_signals(e: DataFrame) -> DataFrame:
    """Events as signals of wire format 1, with detector scores, attributes and time units of several kinds (derived from the event alone).

    Some signals of a run give their times relative to now, in nanoseconds.
    """
    e, i = e.withColumnRenamed("event_id", "_i"), F.col("_i")
    score = F.least(F.lit(1.0), F.col("value") / 200)
    unit = F.when(i % 3 == 0, F.lit(10**9)).when(i % 3 == 1, F.lit(1000)).otherwise(F.lit(1))
    scores = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.when((i + k) % 3 == 0, ((i * 7 + k * 13) % 100) / 100))
    attributes = F.map_filter(
        F.create_map(
            F.lit("rhythm_hash"), F.when(i % 5 == 0, F.concat(F.lit("r"), (F.col("entity") % 7).cast("string"))),
            F.lit("trace_id"), F.col("trace_id").cast("string"), F.lit("benchmark_run_id"), F.when(i % 3 != 2, F.concat(F.lit("run"), (i % 3).cast("string"))),
            F.lit("ground_truth_anomaly_id"), F.when(F.col("value") > 150, F.concat(F.lit("a"), F.floor(F.col("t") / 86400).cast("string"))),
        ),
        lambda _k, v: v.isNotNull(),
    )
    return e.select(
        F.when(i % 4 != 0, F.concat(F.lit("e"), i.cast("string"))).alias("event_id"), F.lit(1).alias("schema_version"), F.col("entity").cast("string").alias("entity_hash"),
        F.when(i % 30 == 1, F.col("t") % 86400 * 10**6).otherwise(F.col("t") * unit).cast("string").alias("timestamp"), score.alias("score"), severity_level(score).cast("double").alias("severity"),
        (i % 10).cast("int").alias("primary_detector"), F.size(F.filter(scores, lambda s: s.isNotNull())).alias("detectors_fired"),
        ((30 + i % 71) / 100).alias("confidence"), F.transform(scores, lambda s: F.coalesce(s, F.lit(0.0))).alias("detector_scores"), attributes.alias("attributes"),
    )


def parsed_events(batches: DataFrame, column: str = "body") -> DataFrame:
    """One row per element of a JSON array of events (u, v, t); a body that is no such array gives none."""
    return batches.select(F.inline(F.from_json(column, f"array<{EVENT}>"))).toDF("entity", "value", "t_ns")


def split_signals(batches: DataFrame, column: str = "body") -> tuple[DataFrame, DataFrame]:
    """Valid signals of JSON bodies ``{"signals": [...]}``, and dead letters (event_id, reason, payload).

    A signal lacks a field if it is absent, null or of another type. A body without signals is a letter of its own.
    """
    body = batches.select(F.col(column).alias("payload"), F.from_json(column, f"signals array<{SIGNAL}>")["signals"].alias("s"))
    each = body.where(F.size("s") > 0).select(F.explode("s").alias("s"))
    lacks = F.filter(F.array(*[F.when(F.col(f"s.{c}").isNull(), F.lit(c)) for c in REQUIRED]), lambda c: c.isNotNull())
    judged = each.withColumn("lacks", lacks)
    bad = judged.where(F.size("lacks") > 0).select(
        F.col("s.event_id").alias("event_id"), F.concat(F.lit("missing:"), F.array_join("lacks", ",")).alias("reason"), F.to_json("s").alias("payload")
    )
    none = body.where(F.coalesce(F.size("s"), F.lit(0)) <= 0).select(F.lit(None).cast("string").alias("event_id"), F.lit("no_signals").alias("reason"), "payload")
    return judged.where(F.size("lacks") == 0).select("s.*"), bad.unionByName(none)


def latest(rows: DataFrame, n: int, *by: str) -> DataFrame:
    """The n rows that come last by the given columns."""
    return rows.orderBy(*[F.desc(c) for c in by]).limit(n)


def attribute(attributes: Column, key: str) -> Column:
    """The value of the first attribute with a key (a struct), or null."""
    return F.get(F.filter(attributes, lambda a: a["key"] == key), F.lit(0))["value"]


def number(value: Column) -> Column:
    """A number of an attribute's value: double, integer, or text that is a number."""
    return F.coalesce(value["doubleValue"], value["intValue"].cast("double"), value["stringValue"].try_cast("double"))


def service_name(attributes: Column) -> Column:
    return attribute(attributes, "service.name")["stringValue"]


def metric(attributes: Column) -> Column:
    """The number of the attribute that comes first in METRIC_PRIORITY (not in the array), 1 without any."""
    found = [attribute(attributes, k) for k in METRIC_PRIORITY]
    return F.coalesce(*map(number, found), F.lit(1.0))


def slim(signals: DataFrame) -> DataFrame:
    """Nine columns of a profile's signal, for the anomaly log."""
    return signals.select(
        F.lit(1).alias("schema_version"), F.col("entity").cast("string").alias("entity_hash"), F.col("t_ns").alias("timestamp"), "score", "severity", "confidence",
        F.col("attribution.primary").alias("primary_detector"), F.col("attribution.fired").alias("detectors_fired"), F.transform("detector_scores", lambda d: d["score"]).alias("detector_scores"),
    )


def wire(signals: DataFrame) -> DataFrame:
    """Wire format 1 of a profile's signals; the id is the hash in hexadecimal, the time and the sequence number."""
    event_id = F.concat_ws("-", F.lower(F.lpad(F.hex("entity"), 16, "0")), F.col("t_ns").cast("string"), F.col("sequence").cast("string"))
    return signals.select(
        event_id.alias("event_id"), F.lit(1).alias("schema_version"), F.col("entity").cast("string").alias("entity_hash"), F.col("t_ns").alias("timestamp"), "score",
        F.col("severity").alias("severity"), F.col("attribution.primary").alias("primary_detector"), F.col("attribution.fired").alias("detectors_fired"), "confidence",
        F.transform("detector_scores", lambda d: d["score"]).alias("detector_scores"),
    )


def legacy(signals: DataFrame) -> DataFrame:
    """The minimal result row: whether, how much, by whom."""
    return signals.select("event_id", "anomaly", "score", "severity", F.col("attribution.primary").alias("detector"))


def day_bucket(t: Column) -> Column:
    """The day of a time in seconds, in UTC, as the partition's name."""
    return F.date_format(F.timestamp_seconds(t), "yyyy_MM_dd")


def days_between(first: Column, last: Column) -> Column:
    """Names of all days of a window."""
    day = lambda t: F.to_date(F.timestamp_seconds(t))
    return F.transform(F.sequence(day(first), day(last)), lambda d: F.date_format(d, "yyyy_MM_dd"))
