"""Truths and detections of two streams, matched within a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_matches(truths: DataFrame, detections: DataFrame, seconds: int = 1, late: str = "10 minutes") -> DataFrame:
    """id, t and anomaly of each truth of a stream (id, t, anomaly), and the detections (event_id, t) of another at most so many
    seconds away: a row a pair, and one without a detection for a truth that none came near.

    Rows that are later than the watermark are dropped. A detection waits under each second it may match, so the join is by
    equal seconds; both sides' states are dropped once the other's watermark has passed them, and a truth without a match
    is given out then.
    """
    a = truths.select("id", "t", "anomaly", F.timestamp_seconds("t").alias("at")).withWatermark("at", late)
    b = detections.select(F.col("event_id").alias("detected"), F.col("t").alias("seen_t"), F.timestamp_seconds("t").alias("seen")).withWatermark("seen", late)
    b = b.withColumn("second", F.explode(F.sequence(F.col("seen_t") - seconds, F.col("seen_t") + seconds)))
    near = F.expr(f"t = second AND seen >= at - INTERVAL {seconds} SECONDS AND seen <= at + INTERVAL {seconds} SECONDS")
    return a.join(b, near, "left_outer").select("id", "t", "anomaly", "detected", "seen_t")
