"""Every query with SQL gives DuckDB's rows."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from pulsegrid.functions.scoring import severity_level
from pulsegrid.operators import canonical, evaluation, incidents, learning, policy, profile, windows
from pulsegrid.plans import detectors, fold, steps
from pulsegrid.queries import QUERIES, SQL, otel_batches
from pulsegrid.sources.events import events, flatten_otel

SF = "/root/testdata/sf0.001"


def rows(names, found):
    fix = lambda v: None if v is None or v != v else float(v) if isinstance(v, int | float) and not isinstance(v, bool) else v
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(([fix(r[i]) for i in order] for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    c = duckdb.connect()
    for table in ("events", "documents", "embeddings"):
        c.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = c.execute(SQL[name])
    names = [x[0] for x in want.description]
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    got, want = rows(df.columns, df.collect()), rows(names, want.fetchall())
    assert got == want


def test_severity(spark):
    scores = spark.createDataFrame([(0.95,), (0.8,), (0.65,), (0.45,), (0.2,)], "s double")
    assert [r[0] for r in scores.select(severity_level(scores.s)).collect()] == [4, 3, 2, 1, 0]


def test_ewma_follows_the_recurrence(spark):
    e = spark.createDataFrame([(i, 1, i, float(i % 7)) for i in range(50)], "event_id long, entity long, t long, value double")
    mean, alpha = None, 1 - 0.5 ** (1 / 50)
    got = {r.event_id: r.mean for r in fold.ewma(e).collect()}
    for i in range(50):
        mean = float(i % 7) if mean is None else mean + alpha * (i % 7 - mean)
        assert math.isclose(got[i], mean)


def test_otel_batches_stay_small_in_a_crowded_hour(spark):
    e = spark.range(5500).selectExpr("id AS event_id", "id % 7 AS entity", "id AS trace_id", "id / 2.0D AS value", "id % 3600 AS t")
    batches = otel_batches(e)
    sizes = [r.batch.count("timeUnixNano") for r in batches.collect()]
    assert max(sizes) <= 1000 and sum(sizes) == 5500
    got = {(r.entity, r.value, r.t_ns, r.trace_id) for r in flatten_otel(batches).collect()}
    assert got == {(str(i % 7), i / 2, i % 3600 * 10**9, str(i)) for i in range(5500)}


def test_profile_is_its_detectors_and_does_not_depend_on_partitions(spark):
    e = events(spark, SF)
    whole = profile.outputs(e, "entity % 2", "trace_id")
    got = {r.event_id: r for r in whole.collect()}
    made = (lambda: detectors.Distribution(detectors.Config()), detectors.Cardinality, detectors.Burst, detectors.ChangePoint, detectors.MultiScale, detectors.Drift)
    for i, make in zip((1, 2, 3, 5, 7, 9), made, strict=True):
        one = {r.event_id: r.score for r in profile.one_detector(e, make, "entity % 2", "trace_id").collect()}
        assert one == {k: r.scores[i] for k, r in got.items() if r.scores[i] is not None}
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert {r.event_id: r for r in whole.repartition(7).collect()} == got
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_profile_fires_on_a_spike_and_keeps_its_detectors_on_reset():
    p, r = detectors.Profile(), random.Random(3)
    for i in range(300):
        out = p.step(i * 10**9, 1, r.gauss(100, 5))
    assert out[0] == 300 and not out[4]
    spike = p.step(301 * 10**9, 1, 9000.0)
    assert spike[6][1] is not None and spike[6][6] is not None  # distribution and forest
    p.reset()
    assert p.step(302 * 10**9, 1, 100.0)[0] == 1 and p.detectors[6].n == 302


def test_forest_scores_what_lies_outside():
    f, r = detectors.Forest(), random.Random(4)
    for _ in range(300):
        f.update([r.gauss(0, 1) for _ in range(4)])
    assert f.update([25.0] * 4)[1] and not f.update([0.0] * 4)[1]


def test_quantile_markers_follow():
    q, r = detectors.Quantile(0.95, parity=False), random.Random(5)
    xs = [r.random() for _ in range(5000)]
    for x in xs:
        q.update(x)
    assert abs(q.value() - 0.95) < 0.02


def test_page_hinkley_starts_again_after_an_alarm(spark):
    e = spark.createDataFrame([(i, 1, i, 0.0 if i < 5 else 100.0) for i in range(12)], "event_id long, entity long, t long, value double")
    got = [r.alarm for r in fold.page_hinkley(e, 0.0, 150.0).orderBy("event_id").collect()]
    assert got == [False] * 6 + [True] + [False] * 5  # the mean is the value itself after it


def test_fold_keeps_null_keys_large_ids_and_null_values(spark):
    big = 2**53
    rows = [(1, None, 1, 1.0), (2, None, 2, 3.0), (3, big, 1, 5.0), (4, big + 1, 1, 7.0), (5, big + 1, 2, None), (6, big + 1, 3, 9.0)]
    e = spark.createDataFrame(rows, "event_id long, entity long, t long, value double")
    got = {r.event_id: r.mean for r in fold.ewma(e, 1.0).collect()}
    assert got == {1: 1.0, 2: 2.0, 3: 5.0, 4: 7.0, 5: None, 6: 8.0}


def test_duplicates_count_from_the_last_accepted(spark):
    e = spark.createDataFrame([(i, 1, "d", 1, 600 * i) for i in range(5)], "event_id long, entity long, detector string, trace_id long, t long")
    assert sorted(r.t for r in windows.duplicates_removed(e).collect()) == [0, 1200, 2400]


def test_decisions_and_rules(spark):
    cols = "reason string, key string, members int, confidence double, score_max double, severity_max double"
    c = spark.createDataFrame([("a", "k", 1, 0.4, 0.1, 0.5), ("b", "k", 2, 0.3, 0.1, 0.1), ("c", "k", 1, 0.9, 0.1, 0.1), ("d", "k", 1, 0.1, 0.6, 0.0)], cols)
    assert [r.status for r in incidents.with_status(c).orderBy("reason").collect()] == ["escalated", "merged", "new", "escalated"]
    rows = [("i1", "suppressed", "hash:7", 90, 5), ("i2", "merged", "hash:8", 80, 4), ("i3", "new", "hash:9", 90, 3), ("i4", "escalated", "hash:10", 50, 2), ("i5", "merged", "trace:1", 90, 1)]
    cases = spark.createDataFrame(rows, "incident_id string, status string, entity_key string, confidence_pct int, last_seen long")
    made = {r.pattern_id: r for r in policy.rules_of(cases, F.lit(1000)).collect()}
    assert set(made) == {"i1", "i2"} and made["i1"].action == "suppress" and made["i2"].score_scale == 1.1 and made["i2"].ttl == 1800
    assert policy.rules_of(cases, F.lit(1000), allow_wildcard=True).count() == 3
    s = spark.createDataFrame([("e", 7, 0, 0.95, 1500), ("f", 8, 0, 0.85, 1500), ("g", 8, 0, 0.5, 1500), ("h", 8, 0, 0.9, 9999)], "event_id string, entity long, detector int, confidence double, t long")
    got = {r.event_id: (r.score_scale, r.suppress) for r in policy.effects(s, policy.rules_of(cases, F.lit(1000))).collect()}
    assert got == {"e": (1.0, True), "f": (1.1, False)}
    with pytest.raises(ValueError):
        policy.published(policy.artifact(policy.rules_of(cases, F.lit(1)), "v1", 1), "v2")


def test_divisions_by_zero_have_results(spark):
    e = spark.createDataFrame([(1, "d", 5, 1.0)], "event_id long, detector string, t long, value double")
    assert evaluation.throughput(e).first().per_second is None
    assert evaluation.percentiles(e).first().p99 == 1.0
    from pulsegrid.functions.scoring import excess_score

    assert spark.range(1).select(excess_score(F.lit(1.0), F.lit(0.0))).first()[0] == 0.0


def test_snapshot_restores_what_its_checksum_covers(spark):
    states = spark.createDataFrame([(1, d, 5, 1.0 + d, 2.0) for d in range(3)], "entity long, detector int, n long, alpha double, beta double")
    weights = learning.expected_weights(states)
    snap = learning.snapshot(states, weights, "p")
    assert learning.restored(snap).count() == 3 and learning.restored(snap.withColumn("checksum", F.lit(0))).count() == 0 and learning.restored(snap, 2).count() == 0
    drawn = learning.sampled_weights(states).collect()
    assert abs(sum(r.weight for r in drawn) - 1) < 1e-9 and drawn == learning.sampled_weights(states).collect()


def test_times_tell_their_unit(spark):
    t = ["1704067200", "1704067200000", "1704067200000000000", "50000000000", "x", "-1", None]
    df = spark.createDataFrame([(x,) for x in t], "t string").select(canonical.seconds(F.col("t"), F.lit(9).cast("long")))
    assert [r[0] for r in df.collect()] == [1704067200, 1704067200, 1704067200, 50, 9, 9, 9]


def test_rules_of_one_time(spark):
    log = "rhythm string, kind string, change string, at long, seconds long"
    rows = [("a", "suppress", "set", 5, 10), ("a", "suppress", "set", 5, 99), ("b", "patch", "set", 5, None), ("b", "patch", "lift", 5, None), ("c", "suppress", "set", 5, None), ("c", "suppress", "set", 5, 7)]
    got = {r.rhythm: r.expires for r in policy.active_rules(spark.createDataFrame(rows, log), F.lit(0)).collect()}
    assert got == {"a": 104, "b": None, "c": None}
    rows = [(*r, i) for i, r in enumerate(rows[:4])] + [("a", "suppress", "set", 5, 10, 9)]
    got = {r.rhythm: r.expires for r in policy.active_rules(spark.createDataFrame(rows, log + ", seq int"), F.lit(0)).collect()}
    assert got == {"a": 15}  # the last of a holds, and b is lifted


def test_relative_times_of_runs(spark):
    a = F.create_map(F.lit("benchmark_run_id"), F.col("run"))
    rows = [("5000000000", "r1"), ("5000000000", None), ("1700000000000000000", "r1"), ("x", "r1"), ("-1", "r1")]
    signals = spark.createDataFrame(rows, "timestamp string, run string").withColumn("attributes", a).selectExpr(
        "*", "'1' AS entity_hash", "1 AS schema_version", "0.5D AS score", "2D AS severity", "1 AS primary_detector", "1 AS detectors_fired", "0.5D AS confidence",
        "array(0D) AS detector_scores", "timestamp AS event_id",
    )
    got = sorted((r.event_id, r.run_id or "", r.t) for r in canonical.canonical(signals, 1000).collect())
    assert got == [("-1", "r1", 1000), ("1700000000000000000", "r1", 1700000000), ("5000000000", "", 5000000000), ("5000000000", "r1", 1005), ("x", "r1", 1000)]
