"""Queries of the engine's operators over the events table, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions.scoring import excess_score, incident_id, keep_score, log_bin, plain_text, severity_level, severity_share, uncertainty, unix_seconds
from .operators import adaptive as ad
from .operators import evaluation as ev
from .operators import incidents as inc
from .operators import learning as learn
from .operators import windows as win
from .plans import fold, steps
from .sources.events import events, flatten_otel, signals


def otel_batches(e):
    """Events as nested JSON batches (column batch): an hour each, of at most a thousand event ids."""
    value = lambda kind, col: F.struct(col.alias(kind))
    attributes = F.array(
        F.struct(F.lit("entity.id").alias("key"), value("stringValue", F.col("entity").cast("string")).alias("value")),
        F.struct(F.lit("value").alias("key"), value("stringValue", F.col("value").cast("string")).alias("value")),
    )
    record = F.struct((F.col("t") * 10**9).cast("string").alias("timeUnixNano"), F.col("trace_id").cast("string").alias("traceId"), attributes.alias("attributes"))
    logs = e.groupBy(F.floor(F.col("t") / 3600).alias("h"), F.floor(F.col("event_id") / 1000).alias("part")).agg(F.collect_list(record).alias("logRecords"))
    batch = F.to_json(F.struct(F.array(F.struct(F.array(F.struct("logRecords")).alias("scopeLogs"))).alias("resourceLogs")))
    return logs.select(batch.alias("batch"))


def _otel(spark, d):
    """Events as nested batches and flattened again."""
    return flatten_otel(otel_batches(events(spark, d)))


def _holed(e):
    """Events that lack a field here and there: the value of every seventh, the detector of every eleventh, the entity of every thirteenth."""
    out = e
    for n, c in ((7, "value"), (11, "detector"), (13, "entity")):
        out = out.withColumn(c, F.when(F.col("event_id") % n != 0, F.col(c)))
    return out


def _labelled(spark, d):
    return ev.labelled(signals(spark, d), ev.truth_windows(events(spark, d)))


def _outputs(spark, d):
    """Three detectors' outputs per event: the value's own score, its rarity and the entity's behaviour."""
    s = signals(spark, d).select("event_id", "score")
    s = s.join(ad.fading_rarity(events(spark, d)), "event_id").join(ad.behaviour(events(spark, d)), "event_id")
    one = lambda name, score, weight, sure: F.struct(F.lit(name).alias("name"), score.alias("score"), F.lit(weight).alias("weight"), F.lit(sure).alias("confidence"))
    rare = one("rarity", F.col("rarity") / 100, 0.8, 0.75)
    return s.select("event_id", F.array(one("value", F.col("score"), 1.0, 0.9), rare, one("behaviour", F.col("deviation"), 0.6, 0.7)).alias("outputs"))


def _fold(step):
    return lambda s, d: fold.keyed_fold(events(s, d), dict, *step)


def _scalars(e):
    v = F.col("value")
    return e.select(
        "event_id", plain_text(F.concat(F.lit("  A "), F.upper("detector"), F.lit("  b "))).alias("text"), severity_share(v / 50).alias("severity"),
        log_bin(v, 20, 1.0, 1000.0).alias("bin"), F.round(uncertainty(v, F.lit(50.0), F.lit(30.0), v / 100), 6).alias("uncertainty"),
        F.round(keep_score(v + 1, F.lit(1), F.lit(2)), 6).alias("keep"), (F.floor(F.col("t") / 3600) % 24).alias("hour"),
    )


QUERIES = {
    "signals": lambda s, d: signals(s, d).select("event_id", "entity", "score", severity_level(F.col("score")).alias("severity"), F.round(excess_score(F.col("value"), F.lit(50.0)), 6).alias("excess")),
    "time_units": lambda s, d: events(s, d).select("event_id", unix_seconds(F.col("t") * F.when(F.col("event_id") % 3 == 0, F.lit(10**9)).when(F.col("event_id") % 3 == 1, 1000).otherwise(1), F.lit(0)).alias("t")),
    "otel_flatten": _otel,
    "running_baseline": lambda s, d: win.running_baseline(events(s, d)),
    "interarrival": lambda s, d: win.interarrival(events(s, d)),
    "distinct_velocity": lambda s, d: win.distinct_velocity(events(s, d)),
    "moving_average": lambda s, d: win.moving_average(events(s, d)),
    "first_difference": lambda s, d: win.first_difference(events(s, d)),
    "rollup_minute": lambda s, d: win.rollup(events(s, d), 60),
    "rollup_hour": lambda s, d: win.rollup(events(s, d), 3600),
    "typical_hours": lambda s, d: win.typical_hours(events(s, d)),
    "bin_rarity": lambda s, d: win.bin_rarity(events(s, d)),
    "duplicates_removed": lambda s, d: win.duplicates_removed(events(s, d)),
    "ewma_threshold": lambda s, d: fold.ewma(events(s, d)),
    "page_hinkley": lambda s, d: fold.page_hinkley(events(s, d)),
    "holt_winters": _fold(steps.holt_winters()),
    "cusum": lambda s, d: _fold(steps.cusum(50.0, 5.0, 100.0))(s, d).withColumn("severity", F.round("severity", 6)),
    "spectral_residual": lambda s, d: _fold(steps.spectral_residual())(s, d).withColumn("score", F.round("score", 6)),
    "adwin": lambda s, d: _fold(steps.adwin(60, 15))(s, d).withColumn("strength", F.round("strength", 6)),
    "level_and_drift": lambda s, d: _fold(steps.both(steps.holt_winters(), steps.adwin(60, 15)))(s, d).withColumn("strength", F.round("strength", 6)),
    "scalar_functions": lambda s, d: _scalars(events(s, d)),
    "rolling_percentile": lambda s, d: ad.rolling_percentile(events(s, d)),
    "rolling_mad": lambda s, d: ad.rolling_mad(events(s, d)),
    "fading_rarity": lambda s, d: ad.fading_rarity(events(s, d)),
    "shingles": lambda s, d: ad.shingles(events(s, d)).select("event_id", F.array_join(F.transform("shingle", lambda x: x.cast("string")), " ").alias("shingle")),
    "spectra": lambda s, d: ad.spectra(events(s, d)),
    "seasonality": lambda s, d: ad.seasonality(events(s, d)),
    "rolling_drift": lambda s, d: ad.rolling_drift(events(s, d)),
    "block_divergence": lambda s, d: ad.block_divergence(events(s, d)),
    "decomposition": lambda s, d: ad.decomposition(events(s, d)),
    "behaviour": lambda s, d: ad.behaviour(events(s, d)),
    "ensemble": lambda s, d: ad.ensemble(_outputs(s, d)),
    "detector_weights": lambda s, d: learn.detector_weights(_labelled(s, d)),
    "upper_bounds": lambda s, d: learn.upper_bounds(_labelled(s, d)),
    "incident_quality": lambda s, d: learn.incident_quality(_labelled(s, d)),
    "incident_edges": lambda s, d: learn.incident_edges(signals(s, d), inc.all_candidates(signals(s, d))),
    "incident_ids": lambda s, d: inc.all_candidates(signals(s, d)).select("reason", "key", incident_id(F.col("reason"), F.col("key"), F.floor(F.col("first_seen") / 60)).alias("id")),
    "corroborated": lambda s, d: learn.corroborated(signals(s, d)),
    "kept_profiles": lambda s, d: learn.kept_profiles(events(s, d)),
    "dead_letters": lambda s, d: learn.dead_letters(_holed(events(s, d))),
    "candidates": lambda s, d: inc.all_candidates(signals(s, d)),
    "incident_status": lambda s, d: inc.with_status(inc.all_candidates(signals(s, d))),
    "policy": lambda s, d: inc.compiled_policy(signals(s, d)),
    "policy_applied": lambda s, d: inc.with_policy(signals(s, d), inc.compiled_policy(signals(s, d))),
    "not_suppressed": lambda s, d: inc.without_suppressed(signals(s, d), inc.compiled_policy(signals(s, d))),
    "clusters": lambda s, d: inc.clusters(signals(s, d)),
    "worklist": lambda s, d: inc.worklist(inc.all_candidates(signals(s, d))),
    "truth_labels": lambda s, d: _labelled(s, d).select("event_id", "truth", "anomaly_id"),
    "confusion": lambda s, d: ev.confusion(_labelled(s, d)),
    "confusion_by_detector": lambda s, d: ev.confusion(_labelled(s, d), "detector"),
    "recall_by_anomaly": lambda s, d: ev.recall_by_anomaly(_labelled(s, d)),
    "per_second": lambda s, d: ev.per_second(_labelled(s, d)),
    "percentiles": lambda s, d: ev.percentiles(events(s, d)),
    "throughput": lambda s, d: ev.throughput(events(s, d), 0.0005),
}

_E = """e AS (SELECT event_id, user_id AS entity, event_type AS detector, CAST(json_extract_string(props, '$.k') AS BIGINT) AS trace_id, value,
 CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events)"""
_S = _E + """, s0 AS (SELECT *, least(1.0, value / 200) AS score FROM e),
 s AS (SELECT *, CASE WHEN score >= 0.9 THEN 1.0 WHEN score >= 0.75 THEN 0.75 WHEN score >= 0.6 THEN 0.5 WHEN score >= 0.4 THEN 0.25 ELSE 0.0 END::DOUBLE AS severity FROM s0)"""
_KEY = "(PARTITION BY entity ORDER BY t, event_id"
_PAST = _KEY + " ROWS UNBOUNDED PRECEDING)"
_GROUP = """SELECT '{r}' AS reason, CAST({k} AS VARCHAR) AS key, count(DISTINCT event_id) AS members, min(t) AS first_seen, max(t) AS last_seen, max(score) AS score_max, max(severity) AS severity_max,
 CAST({c} AS DOUBLE) AS confidence FROM s WHERE (score >= 0.2 OR severity >= 0.2) AND {k} IS NOT NULL GROUP BY 2 HAVING count(DISTINCT event_id) >= 2"""
_RHYTHM = _GROUP.format(r="semantic", k="entity || ':' || detector", c=0.85)
_C = _S + ", c AS (" + " UNION ALL ".join([_GROUP.format(r="trace", k="trace_id", c=1.0), _RHYTHM, _GROUP.format(r="temporal", k="CAST(floor(t / 60) AS BIGINT)", c=0.8)]) + ")"
_P = _S + f""", p AS (SELECT CAST(split_part(key, ':', 1) AS BIGINT) AS entity, split_part(key, ':', 2) AS detector,
 CASE WHEN score_max < 0.35 THEN 'suppress' ELSE 'boost' END AS action, CASE WHEN score_max < 0.35 THEN 1.0 ELSE 1.1 END::DOUBLE AS score_scale, last_seen AS created,
 CASE WHEN score_max < 0.35 THEN 3600 ELSE 1800 END::BIGINT AS ttl FROM ({_RHYTHM}) AS r ORDER BY last_seen DESC, key LIMIT 200)"""
_L = _S + """, w AS (SELECT t // 86400 AS anomaly_id, arg_max(t, (value, event_id)) - 3600 AS a, arg_max(t, (value, event_id)) + 3600 AS b FROM e GROUP BY 1),
 l AS (SELECT event_id, detector, score, t, (SELECT min(anomaly_id) FROM w WHERE s.t BETWEEN w.a AND w.b) AS anomaly_id, score >= 0.5 AS flagged FROM s),
 x AS (SELECT *, anomaly_id IS NOT NULL AS truth FROM l)"""
_F = """count(*) FILTER (truth AND flagged) AS tp, count(*) FILTER (NOT truth AND flagged) AS fp, count(*) FILTER (truth AND NOT flagged) AS fn,
 count(*) FILTER (NOT truth AND NOT flagged) AS tn FROM x"""
_PRF = """tp, fp, fn, tn, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 6) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 6) ELSE 0.0 END AS recall,
 CASE WHEN 2 * tp + fp + fn > 0 THEN round(2 * tp / (2 * tp + fp + fn), 6) ELSE 0.0 END AS f1"""
_ROLL = "SELECT entity, t // {n} * {n} AS start, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / count(value) / 100 AS mean, min(value) AS low, max(value) AS high FROM e GROUP BY 1, 2"
_N = _E + f", n AS (SELECT *, row_number() OVER {_KEY}) - 1 AS n FROM e)"
_BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_LAST50 = "FILTER (value IS NOT NULL) OVER " + _KEY + " ROWS 49 PRECEDING)"
_RARE = f"""r0 AS (SELECT *, power(0.999::DOUBLE, -n) AS w, CASE WHEN value <= 0.1 THEN 0 WHEN value >= 10000 THEN 49 ELSE least(floor(ln(value / 0.1) / ln(10000 / 0.1::DOUBLE) * 50), 49) END AS bin FROM n),
 r1 AS (SELECT event_id, coalesce(sum(w) OVER (PARTITION BY entity, bin ORDER BY n {_BEFORE}, 0) AS own, coalesce(sum(w) OVER (PARTITION BY entity ORDER BY n {_BEFORE}, 0) AS total FROM r0),
 rare AS (SELECT event_id, CASE WHEN total = 0 THEN 1.0::DOUBLE WHEN own / total < 0.001 THEN 100.0 ELSE round(total / own, 4) END AS rarity FROM r1)"""
_PRIOR = "count(*) OVER (PARTITION BY entity, {c} ORDER BY n " + _BEFORE + " AS {c}"
_BEHAVE = f"""b0 AS (SELECT event_id, entity, detector, n, t // 3600 % 24 AS hour, floor(log2(coalesce(t - lag(t) OVER {_KEY}), 0) + 1)) AS gap_bin, floor(value / 25) AS bin FROM n),
 b1 AS (SELECT event_id, n, {', '.join(_PRIOR.format(c=c) for c in ('hour', 'gap_bin', 'bin', 'detector'))} FROM b0),
 behave AS (SELECT event_id, CASE WHEN n < 50 THEN 0.0::DOUBLE ELSE greatest(CASE WHEN hour < n // 24 // 2 THEN 0.3::DOUBLE ELSE 0 END, CASE WHEN detector = 0 THEN 0.3::DOUBLE ELSE 0 END,
 CASE WHEN 5 * gap_bin < n THEN 0.3::DOUBLE * (1 - gap_bin / n) ELSE 0 END, CASE WHEN 5 * bin < n THEN 0.2::DOUBLE * (1 - bin / n) ELSE 0 END) END AS deviation FROM b1)"""
_WAVE = lambda f: "CAST(list_transform(range(24), lambda i: round(1e6 * " + f + "(2 * pi() * k * i / 24)))[n % 24 + 1] AS BIGINT)"
_SPECTRA = f"""f AS (SELECT entity, n // 24 AS block, CAST(k AS INTEGER) AS k, count(*) AS c, CAST(sum(CAST(round(value * 100) AS BIGINT) * {_WAVE('cos')}) AS DOUBLE) AS re,
 CAST(sum(CAST(round(value * 100) AS BIGINT) * {_WAVE('sin')}) AS DOUBLE) AS im FROM n, range(8) AS q(k) GROUP BY 1, 2, 3),
 m AS (SELECT entity, block, k, sqrt(re * re + im * im) / 24 / 1e8 AS magnitude FROM f WHERE c = 24)"""
_DRIFT = f"""SELECT event_id, count(value) OVER a AS c0, avg(value) OVER a AS m0, var_pop(value) OVER a AS v0, count(value) OVER b AS c1, avg(value) OVER b AS m1, var_pop(value) OVER b AS v1
 FROM e WINDOW a AS {_KEY} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), b AS {_KEY} ROWS BETWEEN 39 PRECEDING AND 20 PRECEDING)"""
_QUALITY = """, i AS (SELECT entity, detector, count(*) AS c, count(DISTINCT anomaly_id) AS a FROM x JOIN (SELECT event_id, entity FROM s) USING (event_id) WHERE score >= 0.2 GROUP BY 1, 2 HAVING count(*) >= 2)"""

SQL = {
    "scalar_functions": f"""WITH {_E} SELECT event_id, 'a ' || lower(detector) || ' b' AS text, CASE WHEN value IS NULL OR value <= 0 THEN 0.0 WHEN value / 50 <= 1 THEN value / 50 ELSE least(value / 200, 1.0) END AS severity,
 CAST(CASE WHEN value <= 1 THEN 0 WHEN value >= 1000 THEN 19 ELSE least(19, floor(ln(value) / ln(1000::DOUBLE) * 20)) END AS BIGINT) AS bin,
 round((CASE WHEN abs(value - 50) / 30 > 3 THEN 0.8::DOUBLE WHEN abs(value - 50) / 30 > 2 THEN 0.5 WHEN abs(value - 50) / 30 > 1 THEN 0.2 ELSE 0 END + value / 100 / (value / 100 + 1)) / 2, 6) AS uncertainty,
 round(ln(value + 1) * 1.5::DOUBLE / 3, 6) AS keep, t // 3600 % 24 AS hour FROM e""",
    "rolling_percentile": f"WITH {_E}, w AS (SELECT event_id, list_sort(list(value) {_LAST50}) AS s FROM e) SELECT event_id, CASE WHEN len(s) >= 10 THEN s[1 + CAST(floor(0.95::DOUBLE * (len(s) - 1)) AS BIGINT)] END AS threshold FROM w",
    "rolling_mad": f"""WITH {_E}, w AS (SELECT *, list_sort(list(value) {_LAST50}) AS s FROM e), m AS (SELECT *, (s[(len(s) + 1) // 2] + s[len(s) // 2 + 1]) / 2 AS median FROM w),
 f AS (SELECT *, list_sort(list(abs(value - median)) {_LAST50}) AS far FROM m)
 SELECT event_id, CASE WHEN len(s) >= 10 THEN median + 3e0 * 1.4826e0 * ((far[(len(far) + 1) // 2] + far[len(far) // 2 + 1]) / 2) END AS threshold FROM f""",
    "fading_rarity": f"WITH {_N}, {_RARE} SELECT event_id, rarity FROM rare",
    "shingles": f"WITH {_E}, l AS (SELECT event_id, list(value) {_LAST50.replace('49', '9')} AS s FROM e) SELECT event_id, array_to_string(s, ' ') AS shingle FROM l WHERE len(s) = 10",
    "spectra": f"WITH {_N}, {_SPECTRA} SELECT entity, block, k, magnitude FROM m",
    "seasonality": f"WITH {_N}, {_SPECTRA} SELECT entity, max(magnitude) > 0.4::DOUBLE * sum(magnitude) AS seasonal FROM m WHERE block = 0 GROUP BY 1",
    "rolling_drift": f"""WITH {_E}, d AS ({_DRIFT}), g AS (SELECT *, sqrt(1 / c0 + 1 / c1) AS m, greatest((c0 * v0 + c1 * v1) / (c0 + c1), 0.0001) AS var FROM d WHERE c0 >= 10 AND c1 >= 10)
 SELECT event_id, round(abs(m0 - m1) / (sqrt(2 * var * m * ln(1000::DOUBLE)) + 2::DOUBLE / 3 * m * ln(1000::DOUBLE)), 4) AS drift FROM g""",
    "block_divergence": f"""WITH {_N}, h AS (SELECT entity, n // 20 AS block, floor(value / 50) AS bin, count(*) AS c FROM n GROUP BY 1, 2, 3), p AS (SELECT * FROM h QUALIFY sum(c) OVER (PARTITION BY entity, block) = 20)
 SELECT a.entity, a.block, round(sum(b.c / 20 * ln(b.c / a.c)), 4) AS divergence FROM p AS a JOIN p AS b ON a.entity = b.entity AND a.bin = b.bin AND b.block = a.block - 1 GROUP BY 1, 2""",
    "decomposition": f"""WITH {_E}, l AS (SELECT *, CAST(round(value * 100) AS BIGINT) * 1000000 AS x, row_number() OVER (PARTITION BY entity ORDER BY t DESC, event_id DESC) AS back FROM e QUALIFY back <= 24),
 a AS (SELECT *, CAST(round(CAST(sum(x) OVER w AS DOUBLE) / count(x) OVER w) AS BIGINT) AS trend FROM l WINDOW w AS {_KEY} ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)),
 o AS (SELECT *, x - trend AS off FROM a), b AS (SELECT *, CAST(round(CAST(sum(off) OVER w AS DOUBLE) / count(off) OVER w) AS BIGINT) AS season FROM o WINDOW w AS (PARTITION BY entity, back % 8)),
 c AS (SELECT *, off - season AS rest FROM b), d AS (SELECT *, count(rest) OVER z AS n, CAST(sum(rest) OVER z AS DOUBLE) AS s, CAST(sum(CAST(rest AS HUGEINT) * rest) OVER z AS DOUBLE) AS q FROM c WINDOW z AS (PARTITION BY entity))
 SELECT event_id, trend / 1e8 AS trend, season / 1e8 AS season, rest / 1e8 AS rest, n >= 10 AND abs(rest - s / n) > 2 * sqrt(greatest(q / n - s / n * (s / n), 0)) AS outlier FROM d""",
    "behaviour": f"WITH {_N}, {_BEHAVE} SELECT event_id, deviation FROM behave",
    "ensemble": f"""WITH {_N}, {_RARE}, {_BEHAVE}, o AS (SELECT event_id, least(1.0, value / 200) AS v, rarity / 100 AS r, deviation AS d FROM e JOIN rare USING (event_id) JOIN behave USING (event_id)),
 g AS (SELECT *, v * 1e0 * 0.9e0 AS cv, r * 0.8e0 * 0.75e0 AS cr, d * 0.6e0 * 0.7e0 AS cd, 1e0 * 0.9e0 + 0.8e0 * 0.75e0 + 0.6e0 * 0.7e0 AS w FROM o)
 SELECT event_id, (cv + cr + cd) / w AS score, 0.6e0 * (CAST(CAST(v > 0.5 AS INT) + CAST(r > 0.5 AS INT) + CAST(d > 0.5 AS INT) AS DOUBLE) / 3) + 0.4e0 * (w / (1e0 + 0.8e0 + 0.6e0)) AS confidence,
 array_to_string(list_transform(list_sort([{{'c': -cv, 'i': 0, 'n': 'value'}}, {{'c': -cr, 'i': 1, 'n': 'rarity'}}, {{'c': -cd, 'i': 2, 'n': 'behaviour'}}])[1:2], lambda q: q.n), ',') AS top FROM g""",
    "detector_weights": f"""WITH {_L}, a AS (SELECT detector, 1 + count(*) FILTER (flagged = truth) AS alpha, 1 + count(*) FILTER (flagged != truth) AS beta FROM x GROUP BY 1)
 SELECT detector, alpha, beta, round(alpha / (alpha + beta) / sum(alpha / (alpha + beta)) OVER (), 6) AS weight FROM a""",
    "upper_bounds": f"WITH {_L}, a AS (SELECT detector, count(*) AS n, avg(CAST(flagged = truth AS INT)) AS mean FROM x GROUP BY 1) SELECT detector, n, round(mean + sqrt(2 * ln(sum(n) OVER ()) / n), 6) AS bound FROM a",
    "incident_quality": f"""WITH {_L}{_QUALITY}, y AS (SELECT anomaly_id, count(DISTINCT (entity, detector)) AS i FROM x JOIN (SELECT event_id, entity FROM s) USING (event_id) SEMI JOIN i USING (entity, detector) WHERE score >= 0.2 AND anomaly_id IS NOT NULL GROUP BY 1)
 SELECT 'incidents' AS "of", count(*) AS "all", count(*) FILTER (a > 0) AS found, count(*) FILTER (a > 1) AS several FROM i HAVING count(*) > 0 UNION ALL SELECT 'anomalies', count(*), count(*), count(*) FILTER (i > 1) FROM y HAVING count(*) > 0""",
    "incident_edges": f"""WITH {_C}, k AS (SELECT event_id, unnest(['trace', 'semantic', 'temporal']) AS reason, unnest([CAST(trace_id AS VARCHAR), entity || ':' || detector, CAST(t // 60 AS VARCHAR)]) AS key FROM s WHERE score >= 0.2)
 SELECT DISTINCT reason, key, event_id FROM k SEMI JOIN c USING (reason, key)""",
    "incident_ids": f"WITH {_C} SELECT reason, key, 'inc_' || left(sha256(reason || ':' || key || ':' || CAST(first_seen // 60 AS VARCHAR)), 16) AS id FROM c",
    "corroborated": f"WITH {_S}, f AS (SELECT DISTINCT t, detector FROM s WHERE score >= 0.5) SELECT event_id, EXISTS (SELECT 1 FROM f WHERE f.detector != s.detector AND f.t >= s.t - 1 AND f.t <= s.t + 1) AS corroborated FROM s",
    "kept_profiles": f"""WITH {_E}, p AS (SELECT entity, count(*) AS events, max(t) AS last FROM e GROUP BY 1), q AS (SELECT entity, events, last, round(ln(events) / (((SELECT max(t) FROM e) - last) / 86400 + 1), 6) AS score FROM p)
 SELECT entity, events, score FROM q ORDER BY events >= 10 DESC, CASE WHEN events >= 10 THEN score END DESC NULLS LAST, last DESC, entity LIMIT 100""",
    "dead_letters": f"WITH {_E}, h AS (SELECT event_id, trace_id, t, CASE WHEN event_id % 7 != 0 THEN value END AS value, CASE WHEN event_id % 11 != 0 THEN detector END AS detector, CASE WHEN event_id % 13 != 0 THEN entity END AS entity FROM e), m AS (SELECT event_id, concat_ws(',', CASE WHEN entity IS NULL THEN 'entity' END, CASE WHEN detector IS NULL THEN 'detector' END, CASE WHEN trace_id IS NULL THEN 'trace_id' END, CASE WHEN value IS NULL THEN 'value' END, CASE WHEN t IS NULL THEN 't' END) AS missing FROM h) SELECT * FROM m WHERE missing != ''",
    "signals": f"WITH {_S} SELECT event_id, entity, score, CASE WHEN score >= 0.9 THEN 4 WHEN score >= 0.75 THEN 3 WHEN score >= 0.6 THEN 2 WHEN score >= 0.4 THEN 1 ELSE 0 END AS severity, round(CASE WHEN value <= 50 THEN 0.0 ELSE least(value / 50 - 1, 2.0) / 2 END, 6) AS excess FROM s",
    "time_units": f"WITH {_E} SELECT event_id, t FROM e",
    "otel_flatten": f"WITH {_E} SELECT CAST(entity AS VARCHAR) AS entity, value, t * 1000000000 AS t_ns, CAST(trace_id AS VARCHAR) AS trace_id FROM e",
    "running_baseline": f"""WITH {_E}, x AS (SELECT *, CAST(round(value * 100) AS BIGINT) AS x FROM e),
 s AS (SELECT event_id, count(x) OVER {_PAST} AS n, sum(x) OVER {_PAST} AS s, sum(x * x) OVER {_PAST} AS q FROM x)
 SELECT event_id, n, CAST(s AS DOUBLE) / n / 100 AS mean, sqrt(greatest(CAST(n * q - s * s AS DOUBLE), 0)) / n / 100 AS std FROM s""",
    "interarrival": f"WITH {_E}, g AS (SELECT event_id, t - lag(t) OVER {_KEY}) AS gap_s FROM e) SELECT event_id, gap_s, CASE WHEN gap_s > 0 THEN round(1 / gap_s, 8) END AS rate FROM g",
    "distinct_velocity": f"WITH {_E}, n AS (SELECT *, CASE WHEN trace_id IS NOT NULL AND row_number() OVER (PARTITION BY entity, trace_id ORDER BY t, event_id) = 1 THEN 1 ELSE 0 END AS new FROM e) SELECT event_id, CAST(sum(new) OVER {_PAST} AS BIGINT) AS distinct_so_far, CAST(new AS BIGINT) AS velocity FROM n",
    "moving_average": f"WITH {_E} SELECT event_id, CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER w AS DOUBLE) / count(value) OVER w / 100 AS smoothed FROM e WINDOW w AS {_KEY} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)",
    "first_difference": f"WITH {_E} SELECT event_id, round(value - lag(value) OVER {_KEY}), 4) AS step FROM e",
    "rollup_minute": f"WITH {_E} " + _ROLL.format(n=60),
    "rollup_hour": f"WITH {_E} " + _ROLL.format(n=3600),
    "typical_hours": f"WITH {_E}, h AS (SELECT entity, t // 3600 % 24 AS hour, count(*) AS n FROM e GROUP BY 1, 2) SELECT entity, hour, n, n * 24 > sum(n) OVER (PARTITION BY entity) AS typical FROM h",
    "bin_rarity": f"WITH {_E}, h AS (SELECT entity, CAST(floor(value / 25) AS BIGINT) AS bin, count(*) AS n FROM e GROUP BY 1, 2) SELECT entity, bin, n, round(1 - n / sum(n) OVER (PARTITION BY entity), 6) AS rarity FROM h",
    "duplicates_removed": f"""WITH RECURSIVE {_E}, n AS (SELECT *, row_number() OVER (PARTITION BY entity, detector, trace_id ORDER BY t, event_id) AS rn FROM e),
 r AS (SELECT entity, detector, trace_id, rn, event_id, t, t AS last, TRUE AS kept FROM n WHERE rn = 1 UNION ALL
 SELECT n.entity, n.detector, n.trace_id, n.rn, n.event_id, n.t, CASE WHEN n.t - r.last >= 900 THEN n.t ELSE r.last END, n.t - r.last >= 900
 FROM r JOIN n ON n.entity = r.entity AND n.detector = r.detector AND n.trace_id IS NOT DISTINCT FROM r.trace_id AND n.rn = r.rn + 1) SELECT event_id, entity, t FROM r WHERE kept""",
    "candidates": f"WITH {_C} SELECT reason, key, members, first_seen, last_seen, score_max, severity_max, confidence FROM c",
    "incident_status": f"WITH {_C} SELECT reason, key, members, confidence, CASE WHEN severity_max >= 0.5 OR score_max >= 0.6 THEN 'escalated' WHEN members >= 2 AND confidence >= 0.3 THEN 'merged' ELSE 'new' END AS status FROM c",
    "policy": f"WITH {_P} SELECT * FROM p",
    "policy_applied": f"WITH {_P}, j AS (SELECT event_id, score, score_scale, action, coalesce(t >= created AND t <= created + ttl, FALSE) AS lives FROM s LEFT JOIN p USING (entity, detector)) SELECT event_id, CASE WHEN lives THEN least(1.0, score * score_scale) ELSE score END AS score, CASE WHEN lives THEN action ELSE 'none' END AS action FROM j",
    "not_suppressed": f"WITH {_P} SELECT event_id, entity, detector FROM s WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.action = 'suppress' AND p.entity = s.entity AND p.detector = s.detector AND s.t BETWEEN p.created AND p.created + p.ttl)",
    "clusters": f"WITH {_S}, r AS (SELECT t // 86400 AS day, entity, detector, CAST(row_number() OVER (PARTITION BY t // 86400, entity, detector ORDER BY score DESC, event_id) AS INTEGER) AS rank, event_id, score FROM s WHERE score >= 0.15) SELECT * FROM r WHERE rank <= 3",
    "worklist": f"WITH {_C} SELECT reason, key, first_seen, score_max FROM c ORDER BY score_max >= 0.85 DESC, first_seen, reason, key LIMIT 50",
    "truth_labels": f"WITH {_L} SELECT event_id, truth, anomaly_id FROM x",
    "confusion": f"WITH {_L}, c AS (SELECT {_F}) SELECT {_PRF} FROM c",
    "confusion_by_detector": f"WITH {_L}, c AS (SELECT detector, {_F} GROUP BY 1) SELECT detector, {_PRF} FROM c",
    "recall_by_anomaly": f"WITH {_L} SELECT anomaly_id, count(*) AS events, count(*) FILTER (flagged) AS found FROM x WHERE truth GROUP BY 1",
    "per_second": f"WITH {_L}, y AS (SELECT t, bool_or(truth) AS truth, bool_or(flagged) AS flagged FROM x GROUP BY 1) SELECT count(*) FILTER (truth) AS truth_s, count(*) FILTER (flagged) AS flagged_s, count(*) FILTER (truth AND flagged) AS both_s FROM y",
    "percentiles": f"WITH {_E}, r AS (SELECT detector, value, row_number() OVER (PARTITION BY detector ORDER BY value, event_id) - 1 AS r, count(*) OVER (PARTITION BY detector) AS n FROM e) SELECT detector, max(value) FILTER (r = n * 50 // 100) AS p50, max(value) FILTER (r = n * 95 // 100) AS p95, max(value) FILTER (r = n * 99 // 100) AS p99 FROM r GROUP BY 1",
    "throughput": f"WITH {_E} SELECT detector, count(*) AS events, max(t) - min(t) AS seconds, round(count(*) / (max(t) - min(t)), 8) AS per_second, round(5e0 / (count(*) / (max(t) - min(t))), 6) AS cost_10k FROM e GROUP BY 1",
}

from .catalog import folds as _folds  # noqa: E402
from .catalog import stage2 as _stage2  # noqa: E402

for _part in (_folds, _stage2):
    QUERIES |= _part.QUERIES
    SQL |= _part.SQL
