"""Incidents: candidates from signals, their status, policies and their use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .policy import bounded

#: Fixed value: least score of a signal that can make an incident.
HIGH = 0.2


def candidates(s: DataFrame, key: Column, reason: str, confidence: float) -> DataFrame:
    """Groups of at least two distinct signals of one key that are high by score or severity."""
    high = s.where((F.col("score") >= HIGH) | (F.col("severity") >= HIGH)).withColumn("key", key.cast("string")).where("key IS NOT NULL")
    return (
        high.groupBy("key")
        .agg(
            F.countDistinct("event_id").alias("members"), F.min("t").alias("first_seen"),
            F.max("t").alias("last_seen"), F.max("score").alias("score_max"), F.max("severity").alias("severity_max"),
        )
        .where("members >= 2")
        .select(F.lit(reason).alias("reason"), "*", F.lit(confidence).alias("confidence"))
    )


def by_trace(s: DataFrame) -> DataFrame:
    return candidates(s, F.col("trace_id"), "trace", 1.0)


def by_rhythm(s: DataFrame) -> DataFrame:
    return candidates(s, F.concat_ws(":", "entity", "detector"), "semantic", 0.85)


def by_time(s: DataFrame) -> DataFrame:
    return candidates(s, F.floor(F.col("t") / 60), "temporal", 0.8)


def all_candidates(s: DataFrame) -> DataFrame:
    return by_trace(s).unionByName(by_rhythm(s)).unionByName(by_time(s))


def with_status(c: DataFrame) -> DataFrame:
    """Escalated if severe or high, merged if several and sure enough, else new."""
    status = F.when((F.col("severity_max") >= 0.5) | (F.col("score_max") >= 0.6), "escalated").when((F.col("members") >= 2) & (F.col("confidence") >= 0.3), "merged")
    return c.select("reason", "key", "members", "confidence", status.otherwise("new").alias("status"))


def compiled_policy(s: DataFrame, n: int = 200, least: float = 0.6, dismissed: float = 0.35) -> DataFrame:
    """The latest incidents by entity and detector as rules: suppressed ones suppress, escalated and merged ones boost, unsure ones give none.

    Incidents whose highest score is below ``dismissed`` stand for those that an analyst has suppressed.
    """
    c = by_rhythm(s)
    status = F.when(F.col("score_max") < dismissed, "suppressed").when((F.col("severity_max") >= 0.5) | (F.col("score_max") >= 0.6), "escalated").otherwise("merged")
    latest = c.withColumn("status", status).orderBy(F.desc("last_seen"), "key").limit(n).where(F.col("confidence") >= least)
    boost = F.col("status") != "suppressed"
    return latest.select(
        F.split("key", ":")[0].cast("long").alias("entity"), F.split("key", ":")[1].alias("detector"), F.when(boost, "boost").otherwise("suppress").alias("action"),
        F.when(boost, 1.1).otherwise(1.0).alias("score_scale"), F.col("last_seen").alias("created"), F.when(boost, 1800).otherwise(3600).cast("long").alias("ttl"),
    )


def with_policy(s: DataFrame, rules: DataFrame) -> DataFrame:
    """Signals rescaled by the rule of their entity and detector while it lives."""
    j = s.join(bounded(rules), ["entity", "detector"], "left")
    lives = F.coalesce((F.col("t") >= F.col("created")) & (F.col("t") <= F.col("created") + F.col("ttl")), F.lit(False))
    return j.select(
        "event_id",
        F.when(lives, F.least(F.lit(1.0), F.col("score") * F.col("score_scale"))).otherwise(F.col("score")).alias("score"),
        F.when(lives, F.col("action")).otherwise("none").alias("action"),
    )


def clusters(s: DataFrame, per_group: int = 3) -> DataFrame:
    """Per day, entity and detector the best hits and their number."""
    day = F.floor(F.col("t") / 86400).cast("long")
    order = W.partitionBy("day", "entity", "detector").orderBy(F.desc("score"), "event_id")
    hits = s.where(F.col("score") >= 0.15).withColumn("day", day)
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_group)
    return ranked.select("day", "entity", "detector", "rank", "event_id", "score")


def worklist(c: DataFrame, n: int = 50) -> DataFrame:
    """Critical candidates first, then the oldest."""
    critical = F.col("score_max") >= 0.85
    return c.orderBy(F.desc(critical), "first_seen", "reason", "key").limit(n).select("reason", "key", "first_seen", "score_max")


def without_suppressed(s: DataFrame, rules: DataFrame) -> DataFrame:
    """Signals that no living rule of their entity and detector suppresses."""
    r = bounded(rules.where("action = 'suppress'").select("entity", "detector", "created", (F.col("created") + F.col("ttl")).alias("ends")).distinct())
    met = (s["entity"] == r["entity"]) & (s["detector"] == r["detector"]) & s["t"].between(r["created"], r["ends"])
    return s.join(r, met, "left_anti").select("event_id", "entity", "detector")
