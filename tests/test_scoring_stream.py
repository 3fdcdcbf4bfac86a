"""The scoring loop: stream against replay, feedback, restart from a table of states, and entities that are dropped."""

import math
import random

import pytest
from pyspark.sql import functions as F

from pulsegrid.plans.learner import Learner, Scoring
from pulsegrid.streaming import scoring

EVENTS = "entity long, t_ns long, event_id long, trace_id long, value double"
TOLD = "entity long, t_ns long, event_id long, scores array<double>, decision boolean, truth boolean"
SEC = 10**9


@pytest.fixture
def rocks(spark):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def some_events(rnd, first, n, begin=0, entities=(1, 2, 2**40)):
    out = []
    for i in range(n):
        e = rnd.choice(entities)
        out.append((e, (begin + i) * SEC, first + i, rnd.choice([None, 1, 2]), rnd.gauss(100, 5) if rnd.random() > 0.03 else 5000.0))
    return out


def some_feedback(rnd, first, n, at, entities=(1, 2)):
    return [(rnd.choice(entities), at * SEC, first + i, [rnd.random() for _ in range(10)], rnd.random() < 0.5, rnd.random() < 0.5) for i in range(n)]


def run(df, checkpoint, name):
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None
    return df.sparkSession.sql(f"SELECT * FROM {name}").collect()


def same(got, want):
    key = lambda r: r.event_id
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or (isinstance(x, float) and math.isclose(x, y, rel_tol=1e-12)), (a, b)


def rounds(spark, path, parts):
    """Each part's rows in a folder of files, one a round, and as a table with the round."""
    whole = None
    for i, (e, f) in enumerate(parts):
        rows = scoring.tagged(spark.createDataFrame(e, EVENTS), spark.createDataFrame(f, TOLD))
        rows.coalesce(1).write.mode("append").parquet(path)
        rows = rows.withColumn("round", F.lit(i))
        whole = rows if whole is None else whole.unionByName(rows)
    return whole


def stream(spark, path):
    return spark.readStream.schema(scoring.ROWS).option("maxFilesPerTrigger", 1).parquet(path)


def test_stream_with_feedback_equals_replay_and_survives_a_move(rocks, tmp_path):
    spark, rnd = rocks, random.Random(7)
    parts = [
        (some_events(rnd, 0, 120), []),
        (some_events(rnd, 1000, 60, 120), some_feedback(rnd, 5000, 25, 119)),
        (some_events(rnd, 2000, 60, 180), some_feedback(rnd, 6000, 15, 179, (1, 77))),  # nobody knows 77
    ]
    whole = rounds(spark, str(tmp_path / "a"), parts)
    want = scoring.replayed(whole, every=10).collect()
    assert {tuple(round(w, 9) for w in r.weights) for r in want if r.entity == 1} != {(0.1,) * 10}
    same(run(scoring.scored(stream(spark, str(tmp_path / "a")), every=10), str(tmp_path / "ca"), "whole_run"), want)
    # Stop after two rounds, take the states as a table, start elsewhere: the third round comes out alike.
    rounds(spark, str(tmp_path / "b"), parts[:2])
    first = run(scoring.scored(stream(spark, str(tmp_path / "b")), every=10), str(tmp_path / "cb"), "first_run")
    kept = scoring.snapshot(spark, str(tmp_path / "cb"))
    kept.write.parquet(str(tmp_path / "snap"))
    kept = spark.read.parquet(str(tmp_path / "snap"))
    assert {r.entity for r in kept.select("entity").collect()} == {1, 2, 2**40}
    rounds(spark, str(tmp_path / "c"), parts[2:])
    rest = run(scoring.scored(stream(spark, str(tmp_path / "c")), every=10, start=kept), str(tmp_path / "cc"), "second_run")
    same(first + rest, want)
    # A snapshot that does not hold is not used: its entities begin anew.
    bad = kept.withColumn("checksum", F.when(F.col("entity") == 1, F.lit(1)).otherwise(F.col("checksum")))
    rest = run(scoring.scored(stream(spark, str(tmp_path / "c")), every=10, start=bad), str(tmp_path / "cd"), "third_run")
    assert min(r.sequence for r in rest if r.entity == 1) == 1 and min(r.sequence for r in rest if r.entity == 2) > 1


def test_idle_entities_are_dropped_and_start_anew(rocks, tmp_path):
    spark, rnd = rocks, random.Random(8)
    parts = [
        (some_events(rnd, 0, 40, 100, (1, 2)), []),
        (some_events(rnd, 100, 40, 5000, (2,)), []),  # moves the watermark past entity 1
        (some_events(rnd, 200, 20, 6000, (2,)), []),
        (some_events(rnd, 300, 20, 6100, (1, 2)), []),
    ]
    rounds(spark, str(tmp_path / "a"), parts)
    df = scoring.scored(stream(spark, str(tmp_path / "a")), idle_seconds=600, late="10 seconds")
    got = run(df, str(tmp_path / "ca"), "idle_run")
    assert len(got) == 120
    assert min(r.sequence for r in got if r.entity == 1 and r.event_id >= 300) == 1
    assert {r.entity for r in scoring.snapshot(spark, str(tmp_path / "ca")).collect()} == {1, 2}


def test_feedback_moves_weights_to_detectors_that_are_right():
    learner = Learner(every=5)
    assert not learner.batch([([0.0] * 10, False, False)] * 50)  # true negatives alone say nothing
    assert learner.weights == [0.1] * 10
    for _ in range(20):
        learner.batch([([0.9] + [0.0] * 9, True, True), ([0.0] + [0.9] * 9, True, False)])
    assert learner.weights[0] > 0.2 and abs(sum(learner.weights) - 1) < 1e-12
    assert max(max(learner.alpha), max(learner.beta)) <= 1 / (1 - 0.98) + 1
    s = Scoring(every=1)
    s.feedback([([0.9] + [0.0] * 9, True, True)])
    assert s.profile.weights == tuple(s.learner.weights) != (0.1,) * 10


def test_rows_without_entity_time_or_value_are_left_out(spark):
    e = spark.createDataFrame([(None, 1, 1, None, 1.0), (1, None, 2, None, 1.0), (1, 1, 3, None, None), (1, 1, 4, None, 2.0)], EVENTS)
    f = spark.createDataFrame([(None, 1, 1, [0.1], True, True), (1, 1, 2, None, None, None), (1, 1, 5, None, None, True)], TOLD)
    rows = scoring.tagged(e, f).withColumn("round", F.lit(0))
    assert sorted(r.event_id for r in rows.collect()) == [4, 5]
    assert [r.event_id for r in scoring.replayed(rows).collect()] == [4]
