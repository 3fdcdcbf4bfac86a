"""Event and signal sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scoring import severity_level

_VALUE = "struct<stringValue:string,boolValue:boolean,intValue:bigint,doubleValue:double>"
_ATTRIBUTES = f"array<struct<key:string,value:{_VALUE}>>"
OTEL_BATCH = (
    f"resourceLogs array<struct<resource:struct<attributes:{_ATTRIBUTES}>,"
    f"scopeLogs:array<struct<logRecords:array<struct<timeUnixNano:string,traceId:string,severityNumber:int,attributes:{_ATTRIBUTES}>>>>>>"
)
#: Attribute keys that name an entity, and that hold a metric.
ENTITY_KEYS = ("service.name", "entity.id")
METRIC_KEYS = ("http.duration_ms", "http.status_code", "value", "latency_ms", "process.memory.usage", "process.cpu.utilization")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, entity, detector, trace_id, value, whole seconds t and nanoseconds t_ns of each event."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(
        "event_id",
        F.col("user_id").alias("entity"),
        F.col("event_type").alias("detector"),
        F.get_json_object("props", "$.k").cast("long").alias("trace_id"),
        "value",
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"),
        (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("t_ns"),
    )


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a score in [0, 1] from their value alone, and its severity; ``operators.profile`` has those of the detectors."""
    s = events(spark, sf_dir).withColumn("score", F.least(F.lit(1.0), F.col("value") / 200))
    return s.withColumn("severity", severity_level(F.col("score")) / 4)


def flatten_otel(batches: DataFrame, column: str = "batch") -> DataFrame:
    """One row per log record of nested JSON batches: entity, value, t_ns, trace_id.

    The entity is the first attribute with an entity key, if a string, else ``unknown``; the value is the
    first metric attribute's number, else 0; a time that is no number is 0.
    """
    parsed = batches.select(F.from_json(column, OTEL_BATCH).alias("b"))
    records = (
        parsed.select(F.explode("b.resourceLogs").alias("r"))
        .select(F.col("r.resource.attributes").alias("ra"), F.explode("r.scopeLogs").alias("s"))
        .select("ra", F.explode("s.logRecords").alias("l"))
        .select(F.concat(F.coalesce("ra", F.array()), F.coalesce("l.attributes", F.array())).alias("a"), "l")
    )
    first = lambda keys: F.get(F.filter("a", lambda x: x["key"].isin(*keys)), F.lit(0))["value"]
    metric = first(METRIC_KEYS)
    number = F.coalesce(metric["doubleValue"], metric["intValue"].cast("double"), F.expr("try_cast(m.stringValue as double)"), F.lit(0.0))
    return records.withColumn("m", metric).select(
        F.coalesce(first(ENTITY_KEYS)["stringValue"], F.lit("unknown")).alias("entity"),
        number.alias("value"),
        F.coalesce(F.expr("try_cast(l.timeUnixNano as bigint)"), F.lit(0).cast("long")).alias("t_ns"),
        F.col("l.traceId").alias("trace_id"),
    )
