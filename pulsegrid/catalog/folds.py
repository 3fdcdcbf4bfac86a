"""Folds and single detectors, each with the recurrence as SQL."""

from __future__ import annotations

import math
import re

from pyspark.sql import functions as F

from ..operators import profile as prof
from ..operators import sketches as sk
from ..plans import detectors as det
from ..plans import fold, grove, scan, steps
from ..sources.events import events
from ..streaming import scoring
from .common import numbered, real, recursion, EVENTS

#: Keys of the detectors' queries: eight groups of users, so that warm-ups end; the unique id is the user.
GROUP = "entity % 8"


def _half_life(h: float) -> str:
    return real(1 - math.exp(-math.log(2) / h))


def _ewma(x: str, mean: str, var: str | None, alpha: str) -> dict[str, str]:
    """The next mean (and variance) of an exponentially weighted mean that may not have begun."""
    out = {f"{mean}_": f"CASE WHEN {mean} IS NULL THEN {x} ELSE {mean} + {alpha} * ({x} - {mean}) END"}
    if var:
        out[f"{var}_"] = f"CASE WHEN {mean} IS NULL THEN 0e0 ELSE (1 - {alpha}) * ({var} + {alpha} * ({x} - {mean}) * ({x} - {mean})) END"
    return out


def _above(x: str, limit: str) -> str:
    return f"greatest(0e0, least({x} / {limit} - 1, 2e0)) / 2"


def _cusum(x: str, limit: float, slack: float, lead: int, target: float = 0.0, live: str = "TRUE") -> list[dict[str, str]]:
    """Layers of the two-sided sums; state: up, down, n, age, sums, adapted, side, severity."""
    slope = real(math.tan(math.atan(slack / 2)))
    l0, k, t = real(limit), real(max(slack, 0.1)), real(target)
    far = " OR ".join(f"(len(s1) > {i} AND abs(s1[-1] - s1[{-1 - i}]) > {real(float(i))} * {slope})" for i in range(1, lead + 1))
    return [
        {"head": f"CASE WHEN n < 10 THEN {real(limit * 0.5)} ELSE 0e0 END"},
        {"up1": f"greatest(up + ({x} - {t}) - {k}, head)", "down1": f"greatest(down - ({x} - {t}) - {k}, head)"},
        {"s1": "list_append(sums, greatest(up1, down1))[-20:]"},
        {"m1": "list_sum(s1) / len(s1)"},
        {"adapted1": f"CASE WHEN len(s1) >= 10 THEN greatest(m1 + 3e0 * sqrt(list_sum(list_transform(s1, lambda y: (y - m1) * (y - m1))) / len(s1)), {l0}) ELSE adapted END"},
        {"cut": f"CASE WHEN n > 40 THEN adapted1 ELSE {l0} END", "turned": f"len(s1) >= {lead} AND ({far})"},
        {"rise": "up1 > cut OR (turned AND up1 >= down1 AND up1 > 0)"},
        {"fall": "NOT rise AND (down1 > cut OR (turned AND up1 < down1))", "again": "age >= 1000"},
        {
            "side_": f"CASE WHEN NOT ({live}) THEN 0 WHEN rise THEN 1 WHEN fall THEN -1 ELSE 0 END",
            "severity_": f"CASE WHEN NOT ({live}) THEN 0e0 WHEN rise THEN least(up1 / cut, 2e0) / 2 WHEN fall THEN least(down1 / cut, 2e0) / 2 ELSE 0e0 END",
            "up_": f"CASE WHEN NOT ({live}) THEN up WHEN rise OR again THEN 0e0 ELSE up1 END",
            "down_": f"CASE WHEN NOT ({live}) THEN down WHEN fall OR again THEN 0e0 ELSE down1 END",
            "n_": f"CASE WHEN NOT ({live}) THEN n WHEN again THEN 0 ELSE n + 1 END",
            "age_": f"CASE WHEN NOT ({live}) THEN age WHEN again THEN 0 ELSE age + 1 END",
            "sums_": f"CASE WHEN {live} THEN s1 ELSE sums END",
            "adapted_": f"CASE WHEN {live} THEN adapted1 ELSE adapted END",
        },
    ]


def _cusum_start(limit: float) -> dict[str, str]:
    return {
        "up": "0e0", "down": "0e0", "n": "0", "age": "0", "sums": "[]::DOUBLE[]", "adapted": real(limit), "side": "0", "severity": "0e0",
    }


def _cusum_first(x: str, limit: float, slack: float, target: float) -> dict[str, str]:
    """The state after the first value, of sums that start with it: the head start (or more), no alarm below the limit."""
    head, l0 = real(limit * 0.5), real(limit)
    up, down = f"greatest({x} - {real(target)} - {real(slack)}, {head})", f"greatest(-({x} - {real(target)}) - {real(slack)}, {head})"
    return {
        "up": f"CASE WHEN {up} > {l0} THEN 0e0 ELSE {up} END", "down": f"CASE WHEN {up} <= {l0} AND {down} > {l0} THEN 0e0 ELSE {down} END", "n": "1", "age": "1",
        "sums": f"[greatest({up}, {down})]", "adapted": l0, "side": f"CASE WHEN {up} > {l0} THEN 1 WHEN {down} > {l0} THEN -1 ELSE 0 END",
        "severity": f"CASE WHEN {up} > {l0} THEN least({up} / {l0}, 2e0) / 2 WHEN {down} > {l0} THEN least({down} / {l0}, 2e0) / 2 ELSE 0e0 END",
    }


def _winters(x: str, period: int, live: str = "TRUE") -> list[dict[str, str]]:
    """Layers of the additive forecast (0.3, 0.1, 0.1); state: hn, level, trend, season, expected, off."""
    i = f"(hn % {period}) + 1"
    return [
        {"seas": f"season[{i}]", "warm": f"hn <= {period}"},
        {"level1": f"CASE WHEN warm THEN {x} ELSE 0.3e0 * ({x} - seas) + 0.7e0 * (level + trend) END"},
        {"trend1": f"CASE WHEN hn = 0 THEN 0e0 WHEN warm THEN 0.5e0 * trend + 0.5e0 * ({x} - level) ELSE 0.1e0 * (level1 - level) + 0.9e0 * trend END"},
        {
            "expected_": f"CASE WHEN NOT ({live}) THEN expected WHEN warm THEN {x} ELSE level + trend + seas END",
            "off_": f"CASE WHEN NOT ({live}) THEN off WHEN warm THEN 0e0 ELSE {x} - (level + trend + seas) END",
            "season_": f"CASE WHEN NOT ({live}) OR warm THEN season ELSE list_concat(season[:{i} - 1], [0.1e0 * ({x} - level1) + 0.9e0 * seas], season[{i} + 1:]) END",
            "level_": f"CASE WHEN {live} THEN level1 ELSE level END", "trend_": f"CASE WHEN {live} THEN trend1 ELSE trend END", "hn_": f"CASE WHEN {live} THEN hn + 1 ELSE hn END",
        },
    ]


def _adwin(x: str, half: int, least: int, live: str = "TRUE") -> list[dict[str, str]]:
    """Layers of the adjacent windows; state: w (both, the newer half last), drift, strength."""
    log = real(math.log(2 / 0.002))
    var = lambda w, m: f"(list_sum(list_transform({w}, lambda y: y * y)) / len({w}) - {m} * {m})"
    return [
        {"w1": f"list_append(w, {x})[-{2 * half}:]"},
        {"new1": f"w1[-{half}:]", "old1": f"w1[:greatest(len(w1) - {half}, 0)]"},
        {"whole1": f"{live} AND len(new1) >= {least} AND len(old1) >= {least}"},
        {"m0": "CASE WHEN whole1 THEN list_sum(old1) / len(old1) END", "m2": "CASE WHEN whole1 THEN list_sum(new1) / len(new1) END"},
        {
            "variance": f"CASE WHEN whole1 THEN greatest((len(old1) * {var('old1', 'm0')} + len(new1) * {var('new1', 'm2')}) / len(w1), 0.0001e0) END",
            "m3": "CASE WHEN whole1 THEN sqrt(1e0 / len(old1) + 1e0 / len(new1)) END",
        },
        {"bound": f"sqrt(2e0 * variance * m3 * {log}) + {real(2 / 3)} * m3 * {log}", "apart": "abs(m0 - m2)"},
        {"hit": "coalesce(apart > bound, FALSE)"},
        {
            "drift_": "hit", "strength_": "CASE WHEN NOT whole1 THEN 0e0 WHEN hit THEN apart ELSE apart / bound END",
            "w_": f"CASE WHEN NOT ({live}) THEN w WHEN hit THEN []::DOUBLE[] ELSE w1 END",
        },
    ]


def _hinkley(x: str, limit: float, slack: float, live: str = "TRUE") -> list[dict[str, str]]:
    """Layers of the cumulative deviation; state: pm, ps, pl, rise, alarm."""
    return [
        {"pm1": f"CASE WHEN pm IS NULL THEN {x} ELSE 0.01e0 * {x} + 0.99e0 * pm END"},
        {"ps1": f"ps + ({x} - pm1 - {real(slack)})"},
        {"pl1": "least(pl, ps1)"},
        {"hit2": f"{live} AND ps1 - pl1 > {real(limit)}"},
        {
            "rise_": f"CASE WHEN {live} THEN ps1 - pl1 ELSE 0e0 END", "alarm_": "hit2", "pm_": f"CASE WHEN NOT ({live}) THEN pm WHEN hit2 THEN {x} ELSE pm1 END",
            "ps_": f"CASE WHEN NOT ({live}) THEN ps WHEN hit2 THEN 0e0 ELSE ps1 END", "pl_": f"CASE WHEN NOT ({live}) THEN pl WHEN hit2 THEN 0e0 ELSE pl1 END",
        },
    ]


def _kl(x: str, bins: int, high: float, limit: float, target: int, live: str = "TRUE") -> list[dict[str, str]]:
    """Layers of the histograms' divergence; state: before, now, kn, kdrift, kstrength."""
    place = f"least(greatest(CAST(trunc({x} / {real(high / bins)}) AS INT), 0), {bins - 1}) + 1"
    div = (
        f"list_sum(list_transform(range(1, {bins + 1}), lambda i: CASE WHEN before[i] > 0 AND now1[i] > 0 THEN before[i] / list_sum(before) "
        "* ln((before[i] / list_sum(before)) / (now1[i] / list_sum(now1))) ELSE 0e0 END))"
    )
    empty = f"list_transform(range({bins}), lambda i: 0::BIGINT)"
    return [
        {"spot": place},
        {"now1": "list_concat(now[:spot - 1], [now[spot] + 1], now[spot + 1:])", "kn1": "kn + 1"},
        {"test": f"{live} AND kn1 >= {target}"},
        {"kd": f"CASE WHEN test AND before IS NOT NULL THEN {div} END"},
        {"khit": f"coalesce(kd > {real(limit)}, FALSE)", "fresh": "test AND before IS NULL"},
        {
            "kdrift_": "khit", "kstrength_": f"CASE WHEN kd IS NULL THEN 0e0 WHEN khit THEN kd ELSE kd / {real(limit)} END",
            "before_": f"CASE WHEN khit OR fresh THEN now1 WHEN test AND kn1 >= {2 * target} THEN list_transform(range(1, {bins + 1}), lambda i: before[i] // 2 + now1[i] // 2) ELSE before END",
            "now_": f"CASE WHEN NOT ({live}) THEN now WHEN khit OR fresh OR (test AND kn1 >= {2 * target}) THEN {empty} ELSE now1 END",
            "kn_": f"CASE WHEN NOT ({live}) THEN kn WHEN khit OR fresh OR (test AND kn1 >= {2 * target}) THEN 0 ELSE kn1 END",
        },
    ]


def _kl_start(bins: int) -> dict[str, str]:
    return {"before": "NULL::BIGINT[]", "now": f"list_transform(range({bins}), lambda i: 0::BIGINT)", "kn": "0", "kdrift": "FALSE", "kstrength": "0e0"}


def _put(bins: int, high: float) -> str:
    place = f"least(greatest(CAST(trunc(v / {real(high / bins)}) AS INT), 0), {bins - 1}) + 1"
    return f"list_transform(range(1, {bins + 1}), lambda i: CASE WHEN i = {place} THEN 1::BIGINT ELSE 0::BIGINT END)"


def _limit(x: str, alpha: float, k: float, low: float = 0.001, live: str = "TRUE") -> list[dict[str, str]]:
    """Layers of mean and k deviations; state: lm, lv, lim (after the value) and, from them, over."""
    a = real(alpha)
    return [
        {"lm1": f"CASE WHEN lm IS NULL THEN {x} ELSE lm + {a} * ({x} - lm) END", "lv1": f"CASE WHEN lm IS NULL THEN 0e0 ELSE (1 - {a}) * (lv + {a} * ({x} - lm) * ({x} - lm)) END"},
        {"lim1": f"greatest(lm1 + {real(k)} * greatest(sqrt(lv1), {real(low)}), {real(low)})"},
        {
            "lm_": f"CASE WHEN {live} THEN lm1 ELSE lm END", "lv_": f"CASE WHEN {live} THEN lv1 ELSE lv END", "lim_": f"CASE WHEN {live} THEN lim1 ELSE lim END",
            "over_": f"CASE WHEN {live} THEN {_above(x, 'lim1')} ELSE 0e0 END",
        },
    ]


def _round(df, *names: str, digits: int = 6):
    return df.select(*[F.round(c, digits).alias(c) if c in names else F.col(c) for c in df.columns])


def _detector(make, *names: str):
    return lambda s, d: _round(prof.one_detector(events(s, d), make, GROUP), "score", "expected", "confidence")


def _stepped(step, *names: str, key: str = "entity", columns=("t", "value")):
    return lambda s, d: _round(fold.keyed_fold(events(s, d), dict, *step, key=key, columns=columns), *names)


def _loop(s, d):
    """Events scored day by day, each day after feedback on the one before: right where a value is high."""
    e = events(s, d)
    day = F.floor(F.col("t") / 86400).cast("int")
    first = prof.profiled(e, "entity", "trace_id")
    scores = F.transform("detector_scores", lambda x: x["score"])
    told = first.select("entity", "t_ns", "event_id", scores.alias("scores"), F.col("anomaly").alias("decision"), (F.col("value") > 100).alias("truth"))
    rows = scoring.tagged(e, told, "trace_id")
    rows = rows.withColumn("round", F.floor(F.col("t_ns") / (86400 * 10**9)).cast("int") + F.when(F.col("kind") == 0, 1).otherwise(0))
    out = scoring.replayed(rows, every=10)
    found = prof.with_ensemble(out.withColumn("detector_scores", prof.detector_scores(F.col("scores"), F.col("confidences"), F.col("expected"), F.col("value"))), F.col("weights"))
    return found.select("event_id", "entity", "sequence", F.round("score", 6).alias("score"), F.round("confidence", 6).alias("confidence"), F.transform("weights", lambda w: F.round(w, 6)).alias("weights"))


_C = det.Config()
QUERIES = {
    "ewma_blocks": lambda s, d: _round(scan.ewma(events(s, d), key="detector", hot=1000, blocks=16), "mean", "std", "threshold", digits=5),
    "cusum_default": _stepped(steps.cusum(50.0, 5.0, 100.0), "severity", key=GROUP),
    "kl_drift": _stepped(steps.divergence(20, 0.0, 500.0, 0.05, 100), "strength", key=GROUP),
    "drift_vote": _stepped(steps.drift_vote(), "score", key=GROUP),
    "limit_volume": _stepped(steps.limit("volume"), "threshold", "score"),
    "limit_cardinality": _stepped(steps.limit("cardinality")),
    "limit_burst": _stepped(steps.limit("burst")),
    "limit_conservative": _stepped(steps.limit("conservative")),
    "scale_hours": lambda s, d: _stepped(steps.scale(3600), "mean", "score", "expected", key=GROUP, columns=("t_ns", "value"))(s, d).where("mean IS NOT NULL").drop("seasonal"),
    "faded_histogram": _stepped(steps.rarity(), "rarity", "mean"),
    "distinct_sketches": lambda s, d: _round(sk.estimates(sk.registers(events(s, d), "detector", "entity", 10), "detector", 10), "distinct"),
    "scoring_loop": _loop,
    "quantile_markers": _stepped(steps.quantile(), "quantile", key=GROUP),
    "forest": lambda s, d: _round(grove.scores(events(s, d), GROUP, shingle=10), "score"),
    "forest_points": lambda s, d: grove.scores(events(s, d), GROUP, "array(value, CAST(trace_id AS double), CAST(t % 86400 AS double))", 3),
    "volume": _detector(lambda: det.Volume(_C)),
    "distribution": _detector(lambda: det.Distribution(_C)),
    "cardinality": lambda s, d: _round(prof.one_detector(events(s, d), det.Cardinality, GROUP, "trace_id"), "score", "expected", "confidence"),
    "burst": _detector(det.Burst),
    "spectral": _detector(det.Spectral),
    "change_point": _detector(det.ChangePoint),
    "rrcf": lambda s, d: _round(prof.forest_detector(events(s, d), GROUP), "score", "expected", "confidence"),
    "multi_scale": _detector(det.MultiScale),
    "behavioral": _detector(det.Behavioral),
    "drift": _detector(det.Drift),
}

_KEYED = recursion
_WINTERS = {"hn": "0", "level": "0e0", "trend": "0e0", "season": "list_transform(range(24), lambda i: 0e0)", "expected": "0e0", "off": "0e0"}
_HINKLEY = {"pm": "NULL::DOUBLE", "ps": "0e0", "pl": "0e0", "rise": "0e0", "alarm": "FALSE"}
_LIMIT = {"lm": "NULL::DOUBLE", "lv": "0e0", "lim": "0e0", "over": "0e0"}
_ONE = {"lm": "v", "lv": "0e0", "lim": "greatest(v + {k} * 0.001e0, 0.001e0)", "over": "greatest(0e0, least(v / greatest(v + {k} * 0.001e0, 0.001e0) - 1, 2e0)) / 2"}
_ADWIN = {"w": "[]::DOUBLE[]", "drift": "FALSE", "strength": "0e0"}
_MEDIAN = lambda w: f"(list_sort({w})[(len({w}) + 1) // 2] + list_sort({w})[len({w}) // 2 + 1]) / 2"
_RARE_BIN = "CASE WHEN {x} <= 0.1e0 THEN 0 WHEN {x} >= {high} THEN {last} ELSE least(CAST(floor(ln({x} / 0.1e0) / ln({high} / 0.1e0) * {bins}) AS INT), {last}) END"


_FIRST = "4096 * ln(4096e0 / 4095e0)"


def distinct_sql(rows: str, key: str, value: str, p: int) -> str:
    """h: the count of a sketch of 2^p registers after each of the numbered rows, and what each row adds to it."""
    m = 1 << p
    return f"""ha AS (SELECT event_id, {key}, rn, md5_number_upper(coalesce(CAST({value} AS VARCHAR), '')) AS hash FROM {rows}),
  hb AS (SELECT *, hash >> {64 - p} AS reg, hash & {(1 << 64 - p) - 1}::UBIGINT AS rest FROM ha),
  hc AS (SELECT *, {65 - p} - CASE WHEN rest = 0 THEN 0 ELSE length(bin(rest)) END AS rank FROM hb),
  hd AS (SELECT *, greatest(coalesce(max(rank) OVER (PARTITION BY {key}, reg ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS old FROM hc),
  he AS (SELECT *, {m} + sum(CASE WHEN rank > old THEN pow(2e0, -rank) - pow(2e0, -old) ELSE 0e0 END) OVER w AS s, {m} - sum((old = 0)::INT) OVER w AS z FROM hd WINDOW w AS (PARTITION BY {key} ORDER BY rn ROWS UNBOUNDED PRECEDING)),
  hf AS (SELECT *, {real(0.7213 / (1 + 1.079 / m))} * {m} * {m} / s AS raw FROM he),
  hg AS (SELECT *, CASE WHEN raw <= {2.5 * m} AND z > 0 THEN {m} * ln({m}::DOUBLE / z) ELSE raw END AS n FROM hf),
  h AS MATERIALIZED (SELECT *, greatest(n - coalesce(lag(n) OVER (PARTITION BY {key} ORDER BY rn), 0), 0) AS new FROM hg)"""


def _windows(size: int, kind: str) -> str:
    """SQL of a threshold over the last values, by the fold's rules; no recursion but the mean's."""
    old = f"list(value) OVER (PARTITION BY entity ORDER BY t, event_id ROWS {size - 1} PRECEDING)"
    mean = _KEYED("entity", {"m": "v", "q": "0e0"}, {"m_": "m + 0.1e0 * (v - m)", "q_": "0.9e0 * (q + 0.1e0 * (v - m) * (v - m))"})
    w = f"w AS (SELECT event_id, entity, t, value, {old} AS s FROM e), d AS (SELECT *, {_MEDIAN('s')} AS med FROM w)"
    d = f"f AS (SELECT *, list(abs(value - med)) OVER (PARTITION BY entity ORDER BY t, event_id ROWS {size - 1} PRECEDING) AS far FROM d)"
    p = "CASE WHEN len(s) >= 10 THEN list_sort(s)[1 + CAST(floor(0.95e0 * (len(s) - 1)) AS INT)] ELSE 2e0 * m END"
    mad = f"CASE WHEN len(s) >= 10 THEN med + 3e0 * 1.4826e0 * ({_MEDIAN('far')}) ELSE 2e0 * m END"
    value = {"percentile": p, "mad": mad, "median": f"list_sort([m + 3e0 * greatest(sqrt(q), 0.001e0), {p}, {mad}])[2]"}[kind]
    limits = f"l AS (SELECT event_id, value, greatest({value}, 0.001e0) AS lim FROM f JOIN r USING (event_id))"
    return f"{mean}, {w}, {d}, {limits} SELECT event_id, lim AS threshold, {_above('value', 'lim')} AS score FROM l"


def _markers(q: float) -> str:
    """SQL of a running quantile by five markers: heights h0 to h4 and places p0 to p4, the first five values in l."""
    state = {"n": "1", "l": "[v]"} | {f"h{i}": "0e0" for i in range(5)} | {f"p{i}": "0e0" for i in range(5)}
    layers = [
        {"n_": "n + 1", "l_": "CASE WHEN n < 5 THEN list_append(l, v) ELSE l END", "ready": "n >= 5", "init": "n = 4"},
        {"first": "CASE WHEN NOT ready OR v < h0 OR v >= h4 THEN 9 WHEN v < h1 THEN 1 WHEN v < h2 THEN 2 WHEN v < h3 THEN 3 ELSE 4 END", "s": "list_sort(l_)"},
        {f"a{i}": f"CASE WHEN init THEN s[{i + 1}] " + {0: "WHEN ready THEN least(h0, v) ", 4: "WHEN ready THEN greatest(h4, v) "}.get(i, "") + f"ELSE h{i} END" for i in range(5)}
        | {f"q{i}": f"CASE WHEN init THEN {i}e0 ELSE p{i} + (ready AND first <= {i})::INT END" for i in range(5)},
    ]
    want = {1: f"2 * n_ * {real(q)}", 2: f"n_ * {real(q)}", 3: f"n_ * {real(1 + q)}"}
    low, p = "a0", "q0"
    for i in (1, 2, 3):
        h, up, at, above = f"a{i}", f"a{i + 1}", f"q{i}", f"q{i + 1}"
        layers += [
            {f"d{i}": f"{want[i]} - {at}"},
            {f"s{i}": f"CASE WHEN NOT ready THEN 0e0 WHEN d{i} >= 1 AND {above} - {at} > 1 THEN 1e0 WHEN d{i} <= -1 AND {p} - {at} < -1 THEN -1e0 ELSE 0e0 END"},
            {f"u{i}": f"({at} - {p} + s{i}) * ({up} - {h}) / ({above} - {at}) + ({above} - {at} - s{i}) * ({h} - {low}) / ({at} - {p})"},
            {f"w{i}": f"CASE WHEN abs({above} - {p}) >= 1e-10 THEN {h} + s{i} / ({above} - {p}) * u{i} ELSE {h} END"},
            {
                f"b{i}": f"CASE WHEN s{i} = 0 THEN {h} WHEN {low} < w{i} AND w{i} < {up} THEN w{i} WHEN s{i} > 0 THEN {h} + ({up} - {h}) / ({above} - {at}) "
                f"ELSE {h} + ({low} - {h}) / ({p} - {at}) END",
                f"r{i}": f"{at} + s{i}",
            },
        ]
        low, p = f"b{i}", f"r{i}"
    layers.append({"h0_": "a0", "h4_": "a4", "p0_": "q0", "p4_": "q4"} | {f"h{i}_": f"b{i}" for i in (1, 2, 3)} | {f"p{i}_": f"r{i}" for i in (1, 2, 3)})
    return recursion(GROUP, state, *layers) + f" SELECT event_id, round(CASE WHEN n >= 5 THEN h2 ELSE list_sort(l)[1 + CAST(floor((len(l) - 1) * {real(q)}) AS INT)] END, 6) AS quantile FROM r"


def _scales() -> str:
    """SQL of the four scales, each a recursion of its own, and what they come to where a window ends."""
    parts, found = [], []
    for k, (seconds, half, tolerance, _kept, period, weight) in enumerate(det.MultiScale.SCALES, 1):
        ends = {
            "mean_": "CASE WHEN done THEN avg1 END", "begun_": "CASE WHEN done THEN t ELSE begun END", "total_": "CASE WHEN done THEN v ELSE total + v END",
            "c_": "CASE WHEN done THEN 1 ELSE c + 1 END",
        }
        state = {"begun": "t", "total": "v", "c": "1", "mean": "NULL::DOUBLE"}
        done = {"done": f"t - begun >= {seconds * 10**9}", "avg1": "total / c"}
        if period:
            one = _KEYED(GROUP, _WINTERS | {"season": f"list_transform(range({period}), lambda i: 0e0)"} | state, done, *_winters("avg1", period, "done"), ends)
        else:
            usual = f"CASE WHEN NOT done THEN expected WHEN expected IS NULL THEN avg1 ELSE expected + {_half_life(half)} * (avg1 - expected) END"
            one = _KEYED(GROUP, {"expected": "NULL::DOUBLE", "off": "0e0"} | state, done, {"expected_": usual}, {"off_": "abs(avg1 - expected_)"} | ends)
        begin = one.index(", r AS (") + 2
        parts.append(re.sub(r"\br\b", f"r{k}", one[begin:]))
        score = f"least(greatest(off - greatest({real(tolerance)} * expected, 1e0), 0e0) / greatest(expected, 1e0), 2e0) / 2"
        found.append(f"SELECT event_id, {score} AS s, {real(weight)} AS w FROM r{k} WHERE mean IS NOT NULL")
    head = one[: one.index(", r AS (") + 2]
    return f"""{head}{", ".join(parts)}, f AS ({" UNION ALL ".join(found)}),
  g AS (SELECT event_id, sum(s * w) / sum(w) AS score, count(*) FILTER (s > 0.5) AS high FROM f GROUP BY 1),
  o AS (SELECT event_id, CASE WHEN high >= 2 THEN least(1.2e0 * score, 1e0) ELSE score END AS score, 0e0 AS expected, 0.75e0 + least(0.05e0 * high, 0.2e0) AS confidence FROM g)
  SELECT event_id, round(score, 6) AS score, expected, round(confidence, 6) AS confidence FROM o WHERE score > 0.6"""


_FIRED = "SELECT event_id, round(score, 6) AS score, round(expected, 6) AS expected, round(confidence, 6) AS confidence FROM o WHERE score > 0"


def _spectral(key: str) -> str:
    """SQL of the spectral residual: raw values of the windows that are looked at, then the recurrence of their limit."""
    turn = "list_transform(range(24), lambda i: z[i + 1] * {f}(-2 * pi() * k * i / 24))"
    rest = "abs(lg[k + 1] - list_sum(lg[greatest(k, 1):least(k + 2, 13)]) / len(lg[greatest(k, 1):least(k + 2, 13)]))"
    return f"""WITH RECURSIVE {EVENTS}, {numbered(key)},
  w AS (SELECT event_id, g, rn, list(value) OVER (PARTITION BY g ORDER BY rn ROWS 23 PRECEDING) AS s FROM n),
  x AS (SELECT *, list_sum(s) / 24 AS m FROM w WHERE rn = 24 OR (rn > 24 AND rn % 5 = 0)),
  y AS (SELECT *, greatest(sqrt(list_sum(list_transform(s, lambda v: (v - m) * (v - m))) / 24), 1e-10) AS sd FROM x),
  z AS (SELECT *, list_transform(s, lambda v: (v - m) / sd) AS z FROM y),
  a AS (SELECT *, list_transform(range(13), lambda k: CASE WHEN k = 0 THEN ln(1e-10) ELSE ln(sqrt(pow(list_sum({turn.format(f='cos')}), 2) + pow(list_sum({turn.format(f='sin')}), 2)) / 24 + 1e-10) END) AS lg FROM z),
  b AS (SELECT *, list_transform(range(13), lambda k: {rest}) AS rest FROM a),
  raw AS (SELECT event_id, g, rn, (rest[13] + (rest[1] + rest[2] + rest[3]) / 3) / 2 * 1.6e0 AS raw, row_number() OVER (PARTITION BY g ORDER BY rn) AS k FROM b),
  r AS (SELECT event_id, g, k, raw, raw AS mean, raw * raw + 0.1e0 AS var FROM raw WHERE k = 1 UNION ALL
    SELECT raw.event_id, raw.g, raw.k, raw.raw, r.mean + 0.08e0 * (raw.raw - r.mean), greatest(0.92e0 * (r.var + 0.08e0 * (raw.raw - r.mean) * (raw.raw - r.mean)), 0.01e0)
    FROM r JOIN raw ON raw.g = r.g AND raw.k = r.k + 1),
  l AS (SELECT event_id, raw, mean + 2.8e0 * sqrt(var) AS lim FROM r),
  o AS (SELECT event_id, CASE WHEN lim > 0 AND raw > 0 THEN least(raw / greatest(lim, 0.01e0), 2e0) / 2 ELSE 0e0 END AS score, raw > lim AND raw > 0.1 AS anomaly FROM l)"""


SQL = {
    "spectral_residual": _spectral("entity") + " SELECT e.event_id, round(coalesce(score, 0e0), 6) AS score, coalesce(anomaly, FALSE) AS anomaly FROM e LEFT JOIN o USING (event_id)",
    "spectral": _spectral(GROUP) + " SELECT event_id, round(score, 6) AS score, 0e0 AS expected, 0.85e0 AS confidence FROM o WHERE anomaly AND score > 0.15",
    "ewma_threshold": _KEYED(
        "entity", {"mean": "v", "var": "0e0", "threshold": "NULL::DOUBLE"},
        {"threshold_": "greatest(mean + 3e0 * greatest(sqrt(var), 0.001e0), 0.001e0)"} | _ewma("v", "mean", "var", _half_life(50)),
    ) + " SELECT event_id, mean, sqrt(var) AS std, threshold FROM r",
    "ewma_blocks": _KEYED(
        "detector", {"mean": "v", "var": "0e0", "threshold": "NULL::DOUBLE"},
        {"threshold_": "greatest(mean + 3e0 * greatest(sqrt(var), 0.001e0), 0.001e0)"} | _ewma("v", "mean", "var", _half_life(50)),
    ) + " SELECT event_id, round(mean, 5) AS mean, round(sqrt(var), 5) AS std, round(threshold, 5) AS threshold FROM r",
    "page_hinkley": _KEYED("entity", _HINKLEY | {"pm": "v", "ps": "-0.5e0", "pl": "-0.5e0"}, *_hinkley("v", 500.0, 0.5))
    + " SELECT event_id, rise, rise / 500e0 AS strength, alarm FROM r",
    "holt_winters": _KEYED("entity", _WINTERS | {"hn": "1", "level": "v", "expected": "v"}, *_winters("v", 24)) + " SELECT event_id, expected, off AS deviation FROM r",
    "adwin": _KEYED("entity", _ADWIN | {"w": "[v]"}, *_adwin("v", 30, 15)) + " SELECT event_id, drift, round(strength, 6) AS strength FROM r",
    "cusum": _KEYED("entity", _cusum_first("v", 100.0, 5.0, 50.0), *_cusum("v", 100.0, 5.0, 10, 50.0)) + " SELECT event_id, side, round(severity, 6) AS severity FROM r",
    "cusum_default": _KEYED(GROUP, _cusum_first("v", 100.0, 5.0, 50.0), *_cusum("v", 100.0, 5.0, 10, 50.0)) + " SELECT event_id, side, round(severity, 6) AS severity FROM r",
    "level_and_drift": _KEYED(
        "entity", _WINTERS | _ADWIN | {"hn": "1", "level": "v", "expected": "v", "w": "[v]"}, *_winters("v", 24), *_adwin("v", 30, 15)
    ) + " SELECT event_id, expected, off AS deviation, drift, round(strength, 6) AS strength FROM r",
    "kl_drift": _KEYED(GROUP, _kl_start(20) | {"now": _put(20, 500.0), "kn": "1"}, *_kl("v", 20, 500.0, 0.05, 100))
    + " SELECT event_id, kdrift AS drift, round(kstrength, 6) AS strength FROM r",
    "drift_vote": _KEYED(
        GROUP, _ADWIN | {"w": "[v]"} | _HINKLEY | {"pm": "v", "ps": "-0.1e0", "pl": "-0.1e0"} | _kl_start(50) | {"now": _put(50, 1000.0), "kn": "1"},
        *_adwin("v", 500, 30), *_hinkley("v", 50.0, 0.1), *_kl("v", 50, 1000.0, 0.5, 1000),
    ) + """ SELECT event_id, CASE WHEN drift THEN 'sudden' WHEN alarm THEN 'gradual' WHEN kdrift THEN 'incremental' END AS kind,
  round((strength + rise / 50e0 + kstrength) / 3, 6) AS score FROM r""",
    "limit_volume": _KEYED("entity", {k: x.format(k="2e0") for k, x in _ONE.items()}, *_limit("v", 2 / 51, 2.0))
    + " SELECT event_id, round(lim, 6) AS threshold, round(over, 6) AS score FROM r",
    "limit_cardinality": _windows(100, "percentile"),
    "limit_burst": _windows(50, "mad"),
    "limit_conservative": _windows(100, "median"),
    "distinct_sketches": f"""WITH {EVENTS}, a AS (SELECT DISTINCT detector, md5_number_upper(coalesce(CAST(entity AS VARCHAR), '')) AS hash FROM e),
  b AS (SELECT detector, hash >> 54 AS reg, max(55 - CASE WHEN hash & {(1 << 54) - 1}::UBIGINT = 0 THEN 0 ELSE length(bin(hash & {(1 << 54) - 1}::UBIGINT)) END) AS rank FROM a GROUP BY 1, 2),
  c AS (SELECT detector, 1024 - count(*) AS z, {real(0.7213 / (1 + 1.079 / 1024))} * 1024 * 1024 / (sum(pow(2e0, -rank)) + 1024 - count(*)) AS raw FROM b GROUP BY 1)
  SELECT detector, round(CASE WHEN raw <= 2560 AND z > 0 THEN 1024 * ln(1024e0 / z) ELSE raw END, 6) AS distinct FROM c""",
    "quantile_markers": _markers(0.95),
    "multi_scale": _scales(),
    "scale_hours": _KEYED(
        GROUP, _WINTERS | {"begun": "t", "total": "v", "c": "1", "mean": "NULL::DOUBLE"},
        {"done": "t - begun >= 3600000000000", "avg1": "total / c"}, *_winters("avg1", 24, "done"),
        {
            "mean_": "CASE WHEN done THEN avg1 END", "begun_": "CASE WHEN done THEN t ELSE begun END", "total_": "CASE WHEN done THEN v ELSE total + v END",
            "c_": "CASE WHEN done THEN 1 ELSE c + 1 END",
        },
    ) + """ SELECT event_id, round(mean, 6) AS mean, round(least(greatest(off - greatest(0.15e0 * expected, 1e0), 0e0) / greatest(expected, 1e0), 2e0) / 2, 6) AS score,
  round(expected, 6) AS expected FROM r WHERE mean IS NOT NULL""",
    "faded_histogram": f"""WITH {EVENTS}, {numbered('entity')}, b AS (SELECT *, {_RARE_BIN.format(x='value', high='1000e0', last=19, bins=20)} AS bin, pow(0.999e0, -rn) AS w FROM n),
  c AS (SELECT *, coalesce(sum(w) OVER (PARTITION BY g, bin ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS own, sum(w) OVER p AS total,
    sum(w * 0.1e0 * pow(10000e0, (bin + 0.5e0) / 20)) OVER p AS weighed FROM b WINDOW p AS (PARTITION BY g ORDER BY rn ROWS UNBOUNDED PRECEDING)),
  q AS (SELECT *, CASE WHEN rn = 1 THEN 0.5e0 ELSE own / (total - w) END AS p FROM c)
  SELECT event_id, round(CASE WHEN p > 0.5 THEN 0e0 WHEN p < 0.001 THEN 1e0 ELSE 1 - 2 * p END, 6) AS rarity, round(weighed / total, 6) AS mean FROM q""",
    "distribution": f"""{_KEYED(GROUP, {"lm": "1e0", "lv": "0e0", "lim": "1.003e0", "over": "0e0", "rare": "1e0"}, {"rare_": "(SELECT rarity FROM h WHERE h.event_id = q.event_id)"}, *_limit("rare_", 2 / 101, 3.0))}""".replace(
        "), r AS (SELECT", f"""), b AS (SELECT *, {_RARE_BIN.format(x='value', high='10000e0', last=49, bins=50)} AS bin, pow(0.999e0, -rn) AS w FROM n),
  c AS (SELECT *, coalesce(sum(w) OVER (PARTITION BY g, bin ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS own,
    sum(w) OVER (PARTITION BY g ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS total FROM b),
  h AS (SELECT event_id, CASE WHEN total IS NULL THEN 1e0 WHEN own / total < 0.001 THEN 100e0 ELSE total / own END AS rarity FROM c), r AS (SELECT""", 1
    ) + ", o AS (SELECT event_id, over AS score, 0e0 AS expected, CASE WHEN rare > 50 THEN 0.95e0 WHEN rare > 20 THEN 0.8e0 WHEN rare > 10 THEN 0.6e0 ELSE 0.4e0 END AS confidence FROM r) " + _FIRED,
    "cardinality": _KEYED(
        GROUP, {"vel": _FIRST, "m": _FIRST, "s": f"[{_FIRST}]", "new": _FIRST, "lim": f"2e0 * ({_FIRST})"},
        {"new_": "(SELECT new FROM h WHERE h.event_id = q.event_id)"},
        {"s_": "list_append(s, new_)[-100:]", "m_": "m + 0.1e0 * (new_ - m)"} | _ewma("new_", "vel", None, _half_life(100)),
        {"lim_": "greatest(CASE WHEN len(s_) >= 10 THEN list_sort(s_)[1 + CAST(floor(0.95e0 * (len(s_) - 1)) AS INT)] ELSE 2e0 * m_ END, 0.001e0)"},
        uid="trace_id",
    ).replace("), r AS (SELECT", f"), {distinct_sql('n', 'g', 'trace_id', 12)}, r AS (SELECT", 1)
    + f", o AS (SELECT event_id, {_above('new', 'lim')} AS score, vel AS expected, CASE WHEN new > vel * 10 THEN 0.95e0 ELSE 0.85e0 END AS confidence FROM r) " + _FIRED,
    "volume": _KEYED(
        GROUP, _WINTERS | _LIMIT | {"last": "t", "rate": "NULL::DOUBLE", "vn": "0"},
        {"last_": "t", "gap": "greatest(t - last, 1)", "vn_": "vn + 1"}, {"rps": "1e9 / gap"}, _ewma("rps", "rate", None, _half_life(50)), *_winters("rate_", 24),
        {"ready": "rn >= 100 AND vn_ >= 100", "x": "abs(off_)"}, *_limit("x", 2 / 51, 2.0, live="ready"),
    ) + """, o AS (SELECT event_id, over AS score, expected, CASE WHEN abs(off) / greatest(expected, 1e0) < 0.1 THEN 0.9e0 WHEN abs(off) / greatest(expected, 1e0) < 0.3 THEN 0.7e0 ELSE 0.5e0 END AS confidence FROM r) """
    + _FIRED,
    "burst": _KEYED(
        GROUP, _cusum_start(4.0) | {"last": "t", "usual": "NULL::DOUBLE"},
        {"last_": "t", "gap": "greatest(t - last, 0) / 1e6", "ready": "rn > 51"}, _ewma("gap", "usual", None, _half_life(100)),
        {"shift": "greatest(usual_ - gap, 0e0)"}, *_cusum("shift", 4.0, 0.5, 5, live="ready"),
    ) + " SELECT event_id, round(severity, 6) AS score, round(usual, 6) AS expected, 0.75e0 AS confidence FROM r WHERE side != 0",
    "change_point": _KEYED(
        GROUP, _cusum_start(4.0) | {"last": "v", "trend": "NULL::DOUBLE"}, {"last_": "v", "step": "v - last"}, _ewma("step", "trend", None, _half_life(100)), *_cusum("trend_", 4.0, 0.5, 8),
    ) + " SELECT event_id, round(severity, 6) AS score, 0e0 AS expected, 0.8e0 AS confidence FROM r WHERE side != 0",
    "drift": _KEYED(
        GROUP, _ADWIN | _HINKLEY | _kl_start(50), {"ready": "rn >= 100"},
        *_adwin("v", 500, 30, "ready"), *_hinkley("v", 50.0, 0.1, "ready"), *_kl("v", 50, 1000.0, 0.5, 1000, "ready"),
    ) + """, s AS (SELECT *, (strength + rise / 50e0 + kstrength) / 3 AS score FROM r WHERE drift OR alarm OR kdrift)
  SELECT event_id, round(score, 6) AS score, 0e0 AS expected, round(0.7e0 + score * 0.25e0, 6) AS confidence FROM s""",
}
