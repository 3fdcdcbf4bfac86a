"""Sinks of signals, dead letters, reports and evaluations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def _hour():
    return F.date_format(F.timestamp_seconds("t"), "yyyy-MM-dd-HH")


def write_hourly(signals: DataFrame, path: str) -> None:
    """JSON lines, appended to one folder per hour of event time."""
    signals.withColumn("hour", _hour()).write.mode("append").partitionBy("hour").json(path)


def stream_hourly(signals: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """``write_hourly`` of a stream, each row in exactly one file; ``once`` stops when what is there is written."""
    out = signals.withColumn("hour", _hour()).writeStream.format("json").partitionBy("hour").option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start(path)


def append_letters(letters: DataFrame, path: str, now: int) -> None:
    """Dead letters (event_id, reason, payload) with the time they came, in a folder per day."""
    at = F.lit(now).cast("long")
    rows = letters.withColumn("at", at).withColumn("day", F.date_format(F.timestamp_seconds(at), "yyyy_MM_dd"))
    rows.write.mode("append").partitionBy("day").json(path)


def latest_letters(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The n letters that came last (by id, if at one time)."""
    schema = "event_id string, reason string, payload string, at long, day string"
    return spark.read.schema(schema).json(path).orderBy(F.desc("at"), "event_id", "payload").limit(n)


def write_report(rows: DataFrame, path: str) -> None:
    """Rows as CSV with a header; what was there is replaced."""
    rows.write.mode("overwrite").option("header", True).csv(path)


def append_evaluation(rows: DataFrame, path: str) -> None:
    """Rows of ``operators.evaluation.windowed`` added to the history."""
    rows.write.mode("append").parquet(path)


def evaluations(spark: SparkSession, path: str, n: int = 50, scenario: str | None = None) -> DataFrame:
    """The latest n evaluations, newest first, of all scenarios or one."""
    rows = spark.read.parquet(path)
    rows = rows if scenario is None else rows.where(F.col("scenario") == scenario)
    return rows.orderBy(F.desc("at"), "scenario").limit(n)
