"""The profile of a key: ten detectors in one pass, then ensemble, attribution, policy, severity and decision as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import severity_level
from ..plans import bank, grove
from ..plans import detectors as det
from ..plans.fold import keyed_fold

#: Names of the severities 0 to 4.
SEVERITIES = ("NONE", "LOW", "MEDIUM", "HIGH", "CRITICAL")


def outputs(events: DataFrame, key: str = "entity", unique_id: str = "entity", config: det.Config | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Raw outputs of all ten detectors for each event (t_ns, value), one shuffle and one sorted pass a key.

    Columns to ``carry`` come along, so that nothing is joined back. scores, expected and confidences are arrays by detector id, null where it is silent.
    """
    rows = events.withColumn("_uid", F.expr(unique_id))

    def ahead(values: list[list[float]]) -> list[det.Profile]:
        made = [det.Profile(config) for _ in values]
        bank.foretold([p.rrcf for p in made], values)
        return made

    return keyed_fold(rows, lambda: det.Profile(config), det.Profile.step, det.FIELDS, key, ("t_ns", "_uid", "value"), carry, ahead)


def one_detector(events: DataFrame, make, key: str = "entity", unique_id: str = "entity", warmup: int = 100) -> DataFrame:
    """The events at which one detector fires, with score, expected value and confidence."""

    def step(s: dict, t: int, uid, x: float) -> tuple:
        if not s:
            s |= {"n": 0, "detector": make()}
        s["n"] += 1
        return s["detector"].update(t, uid, x, s["n"] < warmup) or (None,) * 3

    rows = events.withColumn("_uid", F.expr(unique_id))
    found = keyed_fold(rows, dict, step, "score double, expected double, confidence double", key, ("t_ns", "_uid", "value"))
    return found.where("score IS NOT NULL")


def forest_detector(events: DataFrame, key: str = "entity") -> DataFrame:
    """``one_detector`` for the forest, for keys of many events: each tree is worked on by itself."""

    def judge(d: det.Rrcf, raw: float | None) -> tuple:
        return d.judge(raw) or (None,) * 3

    one = det.Rrcf()
    cuts = one.forest.forest
    found = grove.forest_fold(
        events, det.Rrcf, judge, "score double, expected double, confidence double", key, shingle=one.last.maxlen, trees=cuts.trees, size=cuts.size, seed=cuts.seed
    )
    return found.where("score IS NOT NULL")


def detector_scores(scores: Column, confidences: Column, expected: Column, observed: Column) -> Column:
    """An array of (score, confidence, fired, expected, observed) by detector; a silent one has zeros."""
    zero = F.lit(0.0)
    return F.transform(
        scores,
        lambda s, i: F.struct(
            F.coalesce(s, zero).alias("score"), F.when(s.isNull(), 0.0).otherwise(F.get(confidences, i)).alias("confidence"), s.isNotNull().alias("fired"),
            F.when(s.isNull(), 0.0).otherwise(F.get(expected, i)).alias("expected"), F.when(s.isNull(), 0.0).otherwise(observed).alias("observed"),
        ),
    )


def _sum(array: Column, f) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda acc, x: acc + f(x))


def combined(scores: Column, weights: Column) -> Column:
    """Ensemble score: sum of score weight confidence over sum of weight confidence; a silent detector has score 0, confidence 1."""
    parts = F.zip_with(scores, weights, lambda s, w: F.struct(s["score"].alias("s"), F.when(s["fired"], s["confidence"]).otherwise(1.0).alias("c"), w.alias("w")))
    total = _sum(parts, lambda p: p["w"] * p["c"])
    return F.when(total > 0, F.try_divide(_sum(parts, lambda p: p["s"] * p["w"] * p["c"]), total)).otherwise(0.0)


def confidence(scores: Column, weights: Column) -> Column:
    """0.6 times the share of scores above 0.5 and 0.4 times the weighted mean confidence (0.5 without weights)."""
    parts = F.zip_with(scores, weights, lambda s, w: F.struct(F.when(s["fired"], s["confidence"]).otherwise(1.0).alias("c"), w.alias("w")))
    total = _sum(parts, lambda p: p["w"])
    mean = F.when(total > 0, F.try_divide(_sum(parts, lambda p: p["c"] * p["w"]), total)).otherwise(0.5)
    return 0.6 * (F.size(F.filter(scores, lambda s: s["score"] > 0.5)) / F.size(scores)) + 0.4 * mean


def attribution(scores: Column, weights: Column) -> Column:
    """The two detectors that give most (the first, if equal), their shares of the total, and how many fired."""
    given = F.zip_with(scores, weights, lambda s, w: s["score"] * s["confidence"] * w)
    order = F.array_sort(F.transform(given, lambda c, i: F.struct((-c).alias("c"), i.alias("i"))))
    total = _sum(given, lambda c: c)
    share = lambda k: F.when(total > 0, F.try_divide(-order[k]["c"], total)).otherwise(-order[k]["c"])
    return F.struct(
        order[0]["i"].alias("primary"), order[1]["i"].alias("secondary"), share(0).alias("primary_share"), share(1).alias("secondary_share"),
        F.size(F.filter(scores, lambda s: s["fired"])).alias("fired"),
    )


def detector_name(i: Column) -> Column:
    """Name of a detector id, null for others."""
    return F.get(F.array(*map(F.lit, det.NAMES)), i.cast("int"))


def detector_id(name: Column) -> Column:
    """Id of a detector's name, null for others."""
    at = F.array_position(F.array(*map(F.lit, det.NAMES)), name)
    return F.when(at > 0, (at - 1).cast("int"))


def decided(scores: Column, score: Column, sure: Column, limit: Column, suppress: Column, c: det.Config = det.Config()) -> Column:
    """Whether an event is an anomaly: not suppressed, and a detector fired high enough, or the score is above its limits."""
    fired = F.exists(scores, lambda s: s["fired"] & (s["score"] >= c.least_detector_score))
    adaptive = (score > limit) & (sure >= c.least_confidence) if c.adaptive else F.lit(False)
    return ~suppress & (fired | adaptive | (score >= c.least_score))


def built(scores: Column, score: Column, least_fired: float = 0.3, least_score: float = 0.2) -> Column:
    """The builder's decision: a detector fired with some score, or the ensemble is high enough."""
    return F.exists(scores, lambda s: s["fired"] & (s["score"] >= least_fired)) | (score >= least_score)


def reason(anomaly: Column, severity: Column, score: Column, sure: Column, a: Column) -> Column:
    """A sentence for people; ``a`` is the attribution."""
    level = F.get(F.array(*map(F.lit, SEVERITIES)), severity)
    text = F.format_string(
        "%s anomaly (score: %.2f, confidence: %.0f%%) - Primary: %s (%.0f%%), Secondary: %s (%.0f%%), %d detectors triggered",
        level, score, sure * 100, detector_name(a["primary"]), a["primary_share"] * 100, detector_name(a["secondary"]), a["secondary_share"] * 100, a["fired"],
    )
    return F.when(anomaly, text).otherwise("Normal behavior")


def with_ensemble(rows: DataFrame, weights: Column | None = None) -> DataFrame:
    """Adds score, confidence and attribution to rows with detector_scores."""
    w = F.array(*[F.lit(0.1)] * len(det.NAMES)) if weights is None else weights
    d = F.col("detector_scores")
    return rows.withColumn("score", combined(d, w)).withColumn("confidence", confidence(d, w)).withColumn("attribution", attribution(d, w))


def profiled(events: DataFrame, key: str = "entity", unique_id: str = "entity", config: det.Config | None = None, effect: DataFrame | None = None) -> DataFrame:
    """An anomaly signal for each event: baseline, detector scores, ensemble, attribution, severity and decision.

    ``effect`` may hold what a policy does to an event (event_id, score_scale, confidence_scale, suppress); others are as they are.
    """
    c = config or det.Config()
    raw = outputs(events, key, unique_id, c, ("entity", "trace_id", "t_ns", "t", "value")).where("sequence IS NOT NULL")
    return signals_of(raw, c, effect=effect)


def signals_of(raw: DataFrame, c: det.Config, weights: Column | None = None, effect: DataFrame | None = None) -> DataFrame:
    """Anomaly signals of the detectors' raw outputs, with the ensemble's weights (equal ones, if none are given)."""
    scores = detector_scores(F.col("scores"), F.col("confidences"), F.col("expected"), F.col("value"))
    found = with_ensemble(raw.withColumn("detector_scores", scores), weights)
    if effect is not None:
        found = found.join(effect, "event_id", "left")
        scaled = lambda x, by: F.least(F.greatest(F.col(x) * F.coalesce(F.col(by), F.lit(1.0)), F.lit(0.0)), F.lit(1.0))
        found = found.withColumn("score", scaled("score", "score_scale")).withColumn("confidence", scaled("confidence", "confidence_scale"))
    suppress = F.coalesce(F.col("suppress"), F.lit(False)) if effect is not None else F.lit(False)
    anomaly = decided(F.col("detector_scores"), F.col("score"), F.col("confidence"), F.col("score_limit"), suppress, c)
    return found.select(
        "event_id", "entity", "trace_id", "t", "t_ns", "sequence", "value", anomaly.alias("anomaly"), severity_level(F.col("score")).alias("severity"),
        "score", "confidence", "detector_scores", "attribution", F.struct("mean", "std", "rate", F.col("sequence").alias("age"), "warmup").alias("baseline"),
    )
