"""Policies: rules from incidents, their use on signals, versions of the registry, suppressions and patches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .canonical import entity_of_key

#: Least confidence of a rule; seconds that suppressions and boosts live; scales of a boost.
LEAST, SUPPRESS_TTL, BOOST_TTL, SCORE_SCALE, CONFIDENCE_SCALE = 0.6, 3600, 1800, 1.1, 1.05
#: Rows of a rule table that are broadcast; larger ones are joined by a shuffle.
SMALL = 100_000


def bounded(df: DataFrame, most: int = SMALL) -> DataFrame:
    """``df``, marked for broadcast if it has at most so many rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def latest(incidents: DataFrame, n: int = 250) -> DataFrame:
    """What rules need of the latest n incidents."""
    return incidents.select("incident_id", "status", "entity_key", "last_seen", "confidence_pct").orderBy(F.desc("last_seen"), "incident_id").limit(n)


def rules_of(incidents: DataFrame, created: Column, n: int = 250, allow_wildcard: bool = False) -> DataFrame:
    """Rules of the latest n incidents: suppressed ones suppress, escalated and merged ones boost; unsure ones give none.

    The entities are the incident's, if its key names one. A rule without a target would hold for everyone, so it is
    left out unless ``allow_wildcard``.
    """
    found = latest(incidents, n)
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence_pct") / 100))
    entity = entity_of_key(F.col("entity_key"))
    boost = F.col("status").isin("escalated", "merged")
    found = found.where((sure >= LEAST) & (boost | (F.col("status") == "suppressed"))).select(
        F.col("incident_id").alias("pattern_id"), F.when(boost, "boost").otherwise("suppress").alias("action"),
        F.when(entity.isNotNull(), F.array(entity)).otherwise(F.array().cast("array<bigint>")).alias("entities"), F.lit(None).cast("int").alias("detector"),
        sure.alias("min_confidence"), F.when(boost, SCORE_SCALE).alias("score_scale"), F.when(boost, CONFIDENCE_SCALE).alias("confidence_scale"),
        F.when(boost, BOOST_TTL).otherwise(SUPPRESS_TTL).cast("long").alias("ttl"), created.cast("long").alias("created"), "last_seen",
    )
    found = found if allow_wildcard else found.where(F.size("entities") > 0)
    # At most n rows: the window over all of them is small at any size.
    return found.withColumn("rule", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc("last_seen"), "pattern_id"))).drop("last_seen")


def rule_index(rules: DataFrame, strict: bool = True) -> DataFrame:
    """Rules by what finds them: an entity, a detector, or any signal; and when they end.

    A rule with entities and a detector is found by entity alone (``strict``), or by its detector for any entity as well.
    """
    ends = F.when((F.col("ttl") > 0) & (F.col("created") > 0), F.col("created") + F.col("ttl"))
    r = rules.withColumn("ends", ends)
    by_entity = r.where(F.size("entities") > 0).select("*", F.explode("entities").alias("entity"), F.lit("entity").alias("found_by"))
    targeted = F.col("detector").isNotNull() & ((F.size("entities") == 0) if strict else F.lit(True))
    none = F.lit(None).cast("bigint").alias("entity")
    by_detector = r.where(targeted).select("*", none, F.lit("detector").alias("found_by"))
    any_ = r.where(F.col("detector").isNull() & (F.size("entities") == 0)).select("*", none, F.lit("any").alias("found_by"))
    return by_entity.unionByName(by_detector).unionByName(any_)


def effects(signals: DataFrame, rules: DataFrame, now: Column | None = None, combine: str = "product", strict: bool = True) -> DataFrame:
    """What the rules do to each signal that one matches: event_id, score_scale, confidence_scale, suppress.

    A rule matches by entity or detector (or any signal), the detector if it names one, the signal's confidence and its
    time (``now``, or the signal's own). ``product`` multiplies scales and any suppression holds; ``last`` takes the last
    match, those by entity before those by detector before those for all. Three equi-joins instead of one with OR.
    """
    index = rule_index(rules, strict)
    s = signals.select("event_id", F.col("entity").alias("_e"), F.col("detector").alias("_d"), F.col("confidence").alias("_c"), (F.col("t") if now is None else now).alias("_now"))
    part = lambda kind: bounded(index.where(F.col("found_by") == kind).drop("found_by"))
    pick = ["event_id", "_d", "_c", "_now", "rule", "action", "detector", "min_confidence", "score_scale", "confidence_scale", "ends"]
    e, d, a = part("entity"), part("detector").drop("entity"), part("any").drop("entity")
    met = [
        s.join(e, s["_e"] == e["entity"]).select(F.lit(0).alias("probe"), *pick),
        s.join(d, s["_d"] == d["detector"]).select(F.lit(1).alias("probe"), *pick),
        s.withColumn("_one", F.lit(1)).join(a.withColumn("_one", F.lit(1)), "_one").select(F.lit(2).alias("probe"), *pick),  # rules of a policy only
    ]
    hits = met[0].unionByName(met[1]).unionByName(met[2])
    hits = hits.where(
        (F.col("detector").isNull() | (F.col("detector") == F.col("_d"))) & (F.col("min_confidence").isNull() | (F.col("_c") >= F.col("min_confidence")))
        & (F.col("ends").isNull() | (F.col("_now") <= F.col("ends")))
    )
    hits = hits.groupBy("event_id", "rule").agg(F.min("probe").alias("probe"), *[F.first(c).alias(c) for c in ("action", "score_scale", "confidence_scale")])
    scale = lambda c: F.when(F.col("action") == "boost", F.greatest(F.coalesce(F.col(c), F.lit(1.0)), F.lit(0.0))).otherwise(1.0)
    hits = hits.select("event_id", "rule", "probe", scale("score_scale").alias("s"), scale("confidence_scale").alias("c"), (F.col("action") == "suppress").alias("x"))
    if combine == "last":
        return hits.groupBy("event_id").agg(F.max_by(F.struct("s", "c", "x"), F.struct("probe", "rule")).alias("b")).select(
            "event_id", F.col("b.s").alias("score_scale"), F.col("b.c").alias("confidence_scale"), F.col("b.x").alias("suppress")
        )
    return hits.groupBy("event_id").agg(F.product("s").alias("score_scale"), F.product("c").alias("confidence_scale"), F.bool_or("x").alias("suppress"))


def artifact(rules: DataFrame, version: str, now: int) -> DataFrame:
    """The rules as one document of the registry, a draft, with its flags."""
    doc = rules.agg(F.array_sort(F.collect_list(F.struct("rule", "pattern_id", "action", "entities", "min_confidence", "score_scale", "confidence_scale", "ttl"))).alias("r"))
    return doc.select(
        F.lit(version).alias("version"), F.lit("draft").alias("status"), F.to_json(F.struct(F.lit(now).alias("created"), F.col("r").alias("rules"))).alias("document"),
        F.size("r").alias("rule_count"), F.lit(now).cast("long").alias("compiled"), F.lit(None).cast("string").alias("rollback_of"),
    )


def upserted(table: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """``table`` with the rows of ``new`` put over those of the same key; of several the one with the largest order, whole."""
    both = table.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return both.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(F.desc("_new"), F.desc(order)))).where("_r = 1").drop("_r", "_new")


def published(registry: DataFrame, version: str) -> DataFrame:
    """The registry with one version active and the one before a draft again; an unknown version is an error."""
    if registry.where(F.col("version") == version).isEmpty():
        raise ValueError(f"policy not found: {version}")
    now = F.when(F.col("version") == version, "active").when(F.col("status") == "active", "draft").otherwise(F.col("status"))
    return registry.withColumn("status", now)


def rolled_back(registry: DataFrame, version: str, now: int) -> DataFrame:
    """The registry with a copy of a version, under a name of its own, active."""
    name = f"{version}-rollback-{now}"
    copy = registry.where(F.col("version") == version).withColumn("rollback_of", F.col("version")).withColumn("version", F.lit(name)).withColumn("compiled", F.lit(now).cast("long"))
    return published(upserted(registry, copy, "version", "compiled"), name)


def current(registry: DataFrame) -> DataFrame:
    return registry.where("status = 'active'").orderBy(F.desc("compiled"), F.desc("version")).limit(1)


def history(registry: DataFrame, n: int = 16) -> DataFrame:
    """The latest versions, newest first."""
    return registry.orderBy(F.desc("compiled"), F.desc("version")).limit(n)


def active_rules(log: DataFrame, now: Column) -> DataFrame:
    """What holds of a log of suppressions and patches (rhythm, kind, change, at, seconds): each rhythm's and kind's last entry.

    A ``lift`` ends it; suppressions end after their seconds, patches do not. Of entries of one time the one appended last
    holds (column ``seq``, where the log has it), else one that sets before one that lifts, and of those the longest.
    """
    later = [F.desc("seq")] if "seq" in log.columns else []
    order = [F.desc("at"), *later, F.desc("change"), F.desc_nulls_first("seconds")]
    last = log.withColumn("_r", F.row_number().over(W.partitionBy("rhythm", "kind").orderBy(*order))).where("_r = 1")
    ends = F.when(F.col("kind") == "suppress", F.col("at") + F.col("seconds"))
    return last.where("change = 'set'").select("rhythm", "kind", ends.alias("expires")).where(F.col("expires").isNull() | (F.col("expires") > now))


def without_ruled(signals: DataFrame, rules: DataFrame, now: Column | None = None) -> DataFrame:
    """Signals whose rhythm is neither patched nor suppressed at their time (or ``now``)."""
    r = bounded(rules.select(F.col("rhythm").alias("_rhythm"), "expires"))
    at = F.col("t") if now is None else now
    return signals.join(r, (F.col("rhythm") == F.col("_rhythm")) & (F.col("expires").isNull() | (at < F.col("expires"))), "left_anti")
