"""Incidents as cases: candidates with their members, decisions, upserts, edges, feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scoring import incident_id
from .canonical import entity_text, percent

#: Least score or severity of a hit; least confidence, severity and score of a seed.
HIGH, SEED_CONFIDENCE, SEED = 0.2, 0.6, 0.5


def _ids(column: str) -> Column:
    return F.array_sort(F.collect_set(column))


def _grouped(hits: DataFrame, key: Column, reason: str, confidence: float, prefix: str, bucket: Column | None = None) -> DataFrame:
    high = hits.where((F.col("score") >= HIGH) | (F.col("severity") >= HIGH)).withColumn("key", key.cast("string")).where("key IS NOT NULL")
    members = high.groupBy("key").agg(
        _ids("event_id").alias("members"), _ids("truth_id").alias("truth_ids"), _ids("run_id").alias("run_ids"), F.min("t").alias("first_seen"),
        F.max("t").alias("last_seen"), F.max("severity").alias("severity_max"), F.max("score").alias("score_max"),
    )
    at = F.lit(0) if bucket is None else bucket
    return members.where(F.size("members") >= 2).select(
        incident_id(F.lit(reason), F.col("key"), at).alias("incident_id"), F.lit(reason).alias("reason"), F.lit(confidence).alias("confidence"),
        F.concat(F.lit(prefix), F.col("key")).alias("entity_key"), "members", "truth_ids", "run_ids", "first_seen", "last_seen", "severity_max", "score_max",
        F.lit(None).cast("string").alias("evidence_entity"), F.lit(0).alias("apply_group"),
    )


def from_hits(hits: DataFrame) -> DataFrame:
    """Candidates by trace, rhythm and minute: at least two distinct high hits of a key, with members, truth and run ids."""
    by_trace = _grouped(hits, F.col("trace_id"), "trace", 1.0, "trace:")
    by_rhythm = _grouped(hits, F.col("rhythm"), "semantic", 0.85, "rhythm:")
    by_minute = _grouped(hits, F.floor(F.col("t") / 60), "temporal", 0.8, "bucket:", F.col("key").cast("long") * 60)
    return by_trace.unionByName(by_rhythm).unionByName(by_minute)


def from_seeds(events: DataFrame) -> DataFrame:
    """Candidates of single events that are sure, severe or high enough; those of one truth share an id."""
    good = events.where((F.col("confidence") >= SEED_CONFIDENCE) | (F.col("severity") >= SEED) | (F.col("score") >= SEED))
    one = lambda c: F.when(F.col(c).isNotNull(), F.array(c)).otherwise(F.array().cast("array<string>"))
    return good.select(
        F.when(F.col("truth_id").isNotNull(), F.concat(F.lit("gt_"), F.col("truth_id"))).otherwise(F.concat(F.lit("evt_"), F.col("event_id"))).alias("incident_id"),
        F.lit("temporal").alias("reason"), F.greatest(F.lit(0.4), F.least(F.lit(1.0), F.col("confidence"))).alias("confidence"), F.col("entity_id").alias("entity_key"),
        F.array("event_id").alias("members"), one("truth_id").alias("truth_ids"), one("run_id").alias("run_ids"), F.col("t").alias("first_seen"), F.col("t").alias("last_seen"),
        F.col("severity").alias("severity_max"), F.col("score").alias("score_max"), F.lit(None).cast("string").alias("evidence_entity"), F.lit(1).alias("apply_group"),
    )


def derived(hits: DataFrame, events: DataFrame) -> DataFrame:
    """Candidates of clusters, then of seeds: apply_group and apply_seq say in what order they are applied."""
    return from_hits(hits).unionByName(from_seeds(events)).withColumn("apply_seq", F.struct("apply_group", "first_seen", F.col("members")[0].alias("member")))


def decided(c: DataFrame, policy: str = "policy-v1") -> DataFrame:
    """Candidates with status, the decision's reason and whole percents."""
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence")))
    status = F.when((F.col("severity_max") >= 0.5) | (F.col("score_max") >= 0.6), "escalated").when((F.size("members") >= 2) & (sure >= 0.3), "merged")
    reason = F.format_string("reason=%s;members=%d;severity_max=%.3f;score_max=%.3f", "reason", F.size("members"), "severity_max", "score_max")
    return c.withColumn("status", status.otherwise("new")).withColumn("why", reason).withColumn("policy", F.lit(policy)).select(
        "*", percent(sure).alias("confidence_pct"), percent(F.col("severity_max")).alias("severity_pct"), percent(F.col("score_max")).alias("score_pct")
    )


_INCIDENT = ("incident_id", "status", "entity_key", "first_seen", "last_seen", "severity_pct", "score_pct", "confidence_pct", "members", "truth_ids", "run_ids", "reason")


def incidents(decisions: DataFrame, merge: bool = False) -> DataFrame:
    """One row an incident: what was applied last, whole, or (``merge``) its widest times and all members."""
    last = decisions.withColumn("_r", F.row_number().over(W.partitionBy("incident_id").orderBy(F.desc("apply_seq")))).where("_r = 1").select(*_INCIDENT)
    if not merge:
        return last
    all_ = decisions.groupBy("incident_id").agg(
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.max("severity_pct").alias("severity_pct"), F.max("score_pct").alias("score_pct"),
        *[F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("members", "truth_ids", "run_ids")],
    )
    return last.select("incident_id", "status", "entity_key", "confidence_pct", "reason").join(all_, "incident_id").select(*_INCIDENT)


def edges(c: DataFrame) -> DataFrame:
    """An edge from each incident to each member, with how they are linked and how surely."""
    return c.select("incident_id", F.explode("members").alias("point_id"), F.col("reason").alias("link_type"), percent(F.col("confidence")).alias("confidence"))


def graph_of(edges_: DataFrame, incident: str) -> DataFrame:
    return edges_.where(F.col("incident_id") == incident)


def feedback(decisions: DataFrame, now: int) -> DataFrame:
    """What stage 1 is told of decided candidates; new ones tell nothing. Latency is from the last time seen to ``now``."""
    true = F.when(F.col("status") == "suppressed", False).when(F.col("status").isin("escalated", "merged"), True)
    return decisions.withColumn("true_positive", true).where("true_positive IS NOT NULL").select(
        F.col("incident_id").alias("pattern_id"), entity_text(F.col("entity_key"), F.col("evidence_entity")).alias("entity_hash_text"), F.col("entity_key").alias("entity_id"),
        F.col("last_seen").alias("signal_t"), "true_positive", F.when(F.col("true_positive"), "true_positive").otherwise("false_positive").alias("label"), "confidence",
        F.greatest(F.lit(0), F.lit(now).cast("long") * 1000 - F.col("last_seen") * 1000).cast("long").alias("latency_ms"), F.col("members"),
    )


def with_decisions(incidents_: DataFrame, decisions: DataFrame, n: int = 50) -> DataFrame:
    """Each incident with its latest n decisions, newest first."""
    latest = decisions.withColumn("_r", F.row_number().over(W.partitionBy("incident_id").orderBy(F.desc("apply_seq")))).where(F.col("_r") <= n)
    kept = latest.groupBy("incident_id").agg(F.array_sort(F.collect_list(F.struct("_r", "status", "why"))).alias("d"))
    return incidents_.join(kept, "incident_id", "left").withColumn("decisions", F.transform("d", lambda x: F.struct(x["status"].alias("status"), x["why"].alias("why")))).drop("d")


def of_run(incidents_: DataFrame, run: str, n: int | None = None) -> DataFrame:
    """Incidents of a run, latest first."""
    found = incidents_.where(F.array_contains("run_ids", run)).orderBy(F.desc("last_seen"), "incident_id")
    return found if n is None else found.limit(n)


def quality(incidents_: DataFrame, truths: DataFrame, run: str | None = None) -> DataFrame:
    """Precision, recall and F1 of incidents against truths (truth_id), merge and split errors, quality of escalations; one row."""
    i = incidents_ if run is None else of_run(incidents_, run)
    counts = i.agg(
        F.count_if(F.size("truth_ids") > 0).alias("tp"), F.count_if(F.size("truth_ids") == 0).alias("fp"), F.count_if(F.size("truth_ids") > 1).alias("merged"),
        F.count_if(F.col("status") == "escalated").alias("escalated"), F.count_if((F.col("status") == "escalated") & (F.size("truth_ids") > 0)).alias("escalated_true"),
    )
    per_truth = i.select("incident_id", F.explode("truth_ids").alias("truth_id")).distinct().groupBy("truth_id").agg(F.count("*").alias("n"))
    covered = per_truth.agg(F.count("*").alias("covered"), F.count_if(F.col("n") > 1).alias("split"))
    all_ = truths.agg(F.countDistinct("truth_id").alias("truths"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    fn = F.greatest(F.col("truths") - F.col("covered"), F.lit(0))
    rows = counts.join(covered).join(all_).withColumn("fn", fn)  # three rows of totals
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return rows.select(
        "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"), ratio(F.col("merged"), F.col("tp")).alias("merge_error"),
        ratio(F.col("split"), F.col("truths")).alias("split_error"), ratio(F.col("escalated_true"), F.col("escalated")).alias("escalation_quality"),
    )
