"""Learning from labelled results: detector weights, choice of detector, incident quality, profiles to keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scoring import keep_score
from ..plans.fold import keyed_fold


def detector_weights(labelled: DataFrame, cut: float = 0.5) -> DataFrame:
    """Expected weight of each detector from its right and wrong verdicts (a uniform prior), normalised."""
    right = F.count_if((F.col("score") >= cut) == F.col("truth"))
    n = labelled.groupBy("detector").agg((1 + right).alias("alpha"), (1 + F.count("*") - right).alias("beta"))
    expected = F.col("alpha") / (F.col("alpha") + F.col("beta"))
    # One row a detector: the window over all of them is small at any size.
    return n.select("detector", "alpha", "beta", F.round(expected / F.sum(expected).over(W.partitionBy(F.lit(0))), 6).alias("weight"))


def upper_bounds(labelled: DataFrame, cut: float = 0.5) -> DataFrame:
    """Mean success of each detector plus its exploration bonus sqrt(2 ln N / n)."""
    n = labelled.groupBy("detector").agg(F.count("*").alias("n"), F.avg(((F.col("score") >= cut) == F.col("truth")).cast("double")).alias("mean"))
    total = F.sum("n").over(W.partitionBy(F.lit(0)))
    return n.select("detector", "n", F.round(F.col("mean") + F.sqrt(2 * F.log(total) / F.col("n")), 6).alias("bound"))


def incident_quality(labelled: DataFrame, high: float = 0.2) -> DataFrame:
    """Incidents by entity and detector against the anomalies: true and false ones, merges, splits and anomalies found."""
    members = labelled.where(F.col("score") >= high)
    pairs = members.groupBy("entity", "detector", "anomaly_id").agg(F.count("*").alias("c"))
    of_incident = pairs.groupBy("entity", "detector").agg(F.sum("c").alias("c"), F.count("anomaly_id").alias("a")).where("c >= 2")
    of_anomaly = pairs.where("anomaly_id IS NOT NULL").join(of_incident.select("entity", "detector"), ["entity", "detector"])
    of_anomaly = of_anomaly.groupBy("anomaly_id").agg(F.count("*").alias("i"))
    incidents = of_incident.select(F.lit("incidents").alias("of"), F.lit(1).alias("all"), (F.col("a") > 0).cast("int").alias("found"), (F.col("a") > 1).cast("int").alias("several"))
    anomalies = of_anomaly.select(F.lit("anomalies").alias("of"), F.lit(1).alias("all"), F.lit(1).alias("found"), (F.col("i") > 1).cast("int").alias("several"))
    return incidents.unionByName(anomalies).groupBy("of").agg(*[F.sum(c).cast("long").alias(c) for c in ("all", "found", "several")])


def incident_edges(signals: DataFrame, candidates: DataFrame) -> DataFrame:
    """An edge from each incident to each of its signals."""
    keys = (("trace", F.col("trace_id")), ("semantic", F.concat_ws(":", "entity", "detector")), ("temporal", F.floor(F.col("t") / 60)))
    each = F.array(*[F.struct(F.lit(r).alias("reason"), k.cast("string").alias("key")) for r, k in keys])
    s = signals.where(F.col("score") >= 0.2).select("event_id", F.explode(each).alias("x")).select("x.reason", "x.key", "event_id")
    return s.join(candidates.select("reason", "key"), ["reason", "key"], "left_semi").distinct()


def corroborated(signals: DataFrame, cut: float = 0.5) -> DataFrame:
    """Whether another detector fired less than two seconds from each signal; per second at most every detector is held."""
    fired = signals.where(F.col("score") >= cut).select("t", "detector").distinct()
    near = fired.select(F.explode(F.sequence(F.col("t") - 1, F.col("t") + 1)).alias("t"), "detector").groupBy("t").agg(F.collect_set("detector").alias("d"))
    other = F.size(F.array_except("d", F.array("detector"))) > 0
    return signals.join(near, "t", "left").select("event_id", F.coalesce(other, F.lit(False)).alias("corroborated"))


def kept_profiles(e: DataFrame, n: int = 100, mature: int = 10) -> DataFrame:
    """The n profiles most worth keeping, mature ones first, those not mature by when they were last seen."""
    p = e.groupBy("entity").agg(F.count("*").alias("events"), F.max("t").alias("last"))
    now = p.agg(F.max("last").alias("now"))
    score = F.round(keep_score(F.col("events"), F.lit(0), (F.col("now") - F.col("last")) / 86400), 6)
    rows = p.join(F.broadcast(now)).select("entity", "events", "last", score.alias("score"))  # now is one row
    order = [F.desc(F.col("events") >= mature), F.desc(F.when(F.col("events") >= mature, F.col("score"))), F.desc("last"), "entity"]
    return rows.orderBy(*order).limit(n).select("entity", "events", "score")


def dead_letters(e: DataFrame) -> DataFrame:
    """Rows that lack a required field, with the fields' names."""
    lacks = F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in ("entity", "detector", "trace_id", "value", "t")]), lambda x: x.isNotNull())
    return e.select("event_id", F.array_join(lacks, ",").alias("missing")).where("missing != ''")


def entity_of(feedback: DataFrame) -> DataFrame:
    """Feedback with the entity it is about: its hash, else the text's, else the id's digits; and whether one was found."""
    found = F.coalesce(F.col("entity_hash"), F.col("entity_hash_text").try_cast("bigint"), F.regexp_extract("entity_id", r"^hash:(\d+)$", 1).try_cast("bigint"))
    return feedback.withColumn("entity", found).withColumn("accepted", found.isNotNull())


def with_scores(feedback: DataFrame, signals: DataFrame) -> DataFrame:
    """Feedback of patterns with their members' original detector scores and decision, a row a member that is known."""
    each = feedback.select("pattern_id", "true_positive", "confidence", "signal_t", F.explode("members").alias("event_id"))
    return each.join(signals.select("event_id", "entity", "detector_scores", "anomaly"), "event_id")


def matched(feedback: DataFrame, profiles: DataFrame) -> DataFrame:
    """How much feedback meets a profile of its entity and how much does not."""
    known = profiles.select("entity").distinct().withColumn("known", F.lit(True))
    j = feedback.join(known, "entity", "left")
    return j.agg(F.count_if("known").alias("matched"), F.count_if(F.col("known").isNull()).alias("missed"))


def feedback_stats(feedback: DataFrame) -> DataFrame:
    """True and false positives and false negatives of labelled decisions, with precision, recall (1 where undefined) and F1."""
    t, d = F.col("true_positive"), F.col("anomaly")
    c = feedback.agg(F.count("*").alias("processed"), F.count_if(t & d).alias("tp"), F.count_if(~t & d).alias("fp"), F.count_if(t & ~d).alias("fn"))
    p = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(1.0))
    r = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), F.lit(1.0))
    return c.withColumn("precision", p).withColumn("recall", r).withColumn("f1", F.coalesce(F.try_divide(2 * (F.col("precision") * F.col("recall")), F.col("precision") + F.col("recall")), F.lit(0.0)))


def correct_detectors(scores: Column, true_positive: Column, cut: float = 0.5) -> Column:
    """For each detector whether its score spoke as the label does."""
    return F.transform(scores, lambda s: (s >= cut) == true_positive)


def learning_totals(feedback: DataFrame, *by: str) -> DataFrame:
    """Per detector the confidence-weighted number of right and wrong verdicts (a weight of ten times the confidence, 1 at least)."""
    weight = F.greatest(F.col("confidence") * 10, F.lit(1.0)).cast("long")
    each = feedback.select(*by, weight.alias("w"), F.posexplode(correct_detectors(F.col("detector_scores"), F.col("true_positive"))).alias("detector", "right"))
    return each.groupBy(*by, "detector").agg(F.sum(F.when(F.col("right"), F.col("w")).otherwise(0)).alias("success"), F.sum(F.when(~F.col("right"), F.col("w")).otherwise(0)).alias("failure"))


def significant(feedback: DataFrame, *by: str) -> DataFrame:
    """Confidence-weighted true and false positives and false negatives, and whether they say anything."""
    w = F.greatest(F.col("confidence") * 10, F.lit(1.0)).cast("long")
    t, d = F.col("true_positive"), F.col("anomaly")
    c = feedback.groupBy(*by).agg(*[F.sum(F.when(x, w).otherwise(0)).alias(n) for n, x in (("tp", t & d), ("fp", ~t & d), ("fn", t & ~d))])
    return c.withColumn("significant", F.col("tp") + F.col("fp") + F.col("fn") > 0)


def by_detector(feedback: DataFrame) -> DataFrame:
    """Feedback as a row a detector: entity, detector, seq, score, detected (above 0.5), label."""
    return feedback.select("entity", "event_id", "signal_t", "true_positive", F.posexplode("detector_scores").alias("detector", "score")).withColumn("detected", F.col("score") > 0.5)


def performance(rows: DataFrame, kept: int = 100) -> DataFrame:
    """Per entity and detector precision and recall (0.5 where undefined), F1, and the variance of its last scores (1 below two)."""
    t, d = F.col("true_positive"), F.col("detected")
    last = W.partitionBy("entity", "detector").orderBy(F.desc("signal_t"), F.desc("event_id"))
    # Hundredths are whole, so the variance comes from exact sums.
    r = rows.withColumn("_r", F.row_number().over(last)).withColumn("_x", F.when(F.col("_r") <= kept, F.round(F.col("score") * 100).cast("long")))
    c = r.groupBy("entity", "detector").agg(
        F.count_if(t & d).alias("tp"), F.count_if(~t & d).alias("fp"), F.count_if(t & ~d).alias("fn"), F.count_if(~t & ~d).alias("tn"),
        F.count("_x").alias("n"), F.sum("_x").alias("s"), F.sum(F.col("_x") * F.col("_x")).alias("q"),
    )
    p, rec = (F.coalesce(F.try_divide("tp", F.col("tp") + F.col(x)), F.lit(0.5)) for x in ("fp", "fn"))
    variance = (F.col("n") * F.col("q") - F.col("s") * F.col("s")) / (F.col("n") * F.col("n")) / 10_000
    return c.withColumn("precision", p).withColumn("recall", rec).select(
        "entity", "detector", "tp", "fp", "fn", "tn", "precision", "recall",
        F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)).alias("f1"),
        F.when(F.col("n") < 2, 1.0).otherwise(F.greatest(variance, F.lit(0.001))).alias("score_variance"),
    )


def beta_updates(rows: DataFrame, decay: float = 0.98) -> DataFrame:
    """Alpha and beta of each entity and detector after each feedback: both fade, to 1 at least, then the right one grows by 1."""

    def step(s: dict, _t: int, entity: int, detector: int, success: bool) -> tuple:
        a, b = (max(s.get(k, 1.0) * decay, 1.0) for k in ("a", "b"))
        s |= {"a": a + success, "b": b + (not success), "n": s.get("n", 0) + 1}
        return entity, detector, s["n"], s["a"], s["b"]

    r = rows.select("entity", "detector", "event_id", F.col("signal_t").alias("t"), (F.col("detected") == F.col("true_positive")).alias("success"))
    return keyed_fold(r, dict, step, "entity long, detector int, n long, alpha double, beta double", "struct(entity, detector)", ("t", "entity", "detector", "success"))


def beta_states(rows: DataFrame, decay: float = 0.98) -> DataFrame:
    """Alpha and beta of each entity and detector after all its feedback (event_id a number), in its order."""
    last = F.max_by(F.struct("alpha", "beta"), "n").alias("s")
    return beta_updates(rows, decay).groupBy("entity", "detector").agg(F.max("n").alias("n"), last).select("entity", "detector", "n", "s.alpha", "s.beta")


def _of_entity(x: Column) -> Column:
    return x / F.sum(x).over(W.partitionBy("entity"))  # ten rows an entity


def expected_weights(states: DataFrame) -> DataFrame:
    """The mean of each detector's beta distribution, as a share of its entity's."""
    mean = F.col("alpha") / (F.col("alpha") + F.col("beta"))
    return states.select("entity", "detector", _of_entity(mean).alias("weight"))


def sampled_weights(states: DataFrame, seed: int = 0) -> DataFrame:
    """A draw from each detector's beta distribution (seeded by entity and detector), as a share of its entity's."""
    from collections.abc import Iterator

    import numpy as np
    import pyarrow as pa

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b[c].to_pylist() for c in ("entity", "detector", "alpha", "beta")), strict=True)
            x = [float(np.random.default_rng([seed, abs(e or 0), d]).beta(max(p, 0.01), max(q, 0.01))) for e, d, p, q in rows]
            yield pa.RecordBatch.from_arrays([b["entity"], b["detector"], pa.array(x, pa.float64())], names=["entity", "detector", "x"])

    drawn = states.select("entity", "detector", "alpha", "beta").mapInArrow(draw, "entity long, detector int, x double")
    return drawn.select("entity", "detector", _of_entity(F.col("x")).alias("weight"))


def refreshed_weights(weights: DataFrame, performance_: DataFrame) -> DataFrame:
    """Half the bandit's weights, half each detector's share of F1 (equal shares where all are 0), as shares again."""
    j = weights.join(performance_.select("entity", "detector", "f1"), ["entity", "detector"])
    whole = W.partitionBy("entity")
    f1 = F.coalesce(F.try_divide("f1", F.sum("f1").over(whole)), 1 / F.count("*").over(whole))
    half = j.select("entity", "detector", (0.5 * F.col("weight") + 0.5 * f1).alias("w"))
    return half.select("entity", "detector", _of_entity(F.col("w")).alias("weight"))


def chosen_arm(labelled: DataFrame, cut: float = 0.5) -> DataFrame:
    """The detector that the upper confidence bounds choose (the first by name, if equal)."""
    return upper_bounds(labelled, cut).orderBy(F.desc("bound"), "detector").limit(1)


def snapshot(states: DataFrame, weights: DataFrame, policy: str, version: int = 1) -> DataFrame:
    """A profile's weights and betas as one row an entity, with a checksum; ``restored`` gives them back."""
    j = states.join(weights, ["entity", "detector"])
    packed = j.groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("detector", "weight", "alpha", "beta", "n"))).alias("detectors"))
    return packed.withColumn("version", F.lit(version)).withColumn("policy", F.lit(policy)).withColumn("checksum", F.crc32(F.to_json("detectors").cast("binary")))


def restored(snapshots: DataFrame, version: int = 1) -> DataFrame:
    """A row an entity and detector of snapshots of this version whose checksum holds; others are left out."""
    good = snapshots.where((F.col("version") == version) & (F.col("checksum") == F.crc32(F.to_json("detectors").cast("binary"))))
    return good.select("entity", F.inline("detectors"))
