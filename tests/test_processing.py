"""Micro-batches: replays, crashes, duplicates, late rows, dead letters, and policies that change between batches."""

import json

import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import policy
from pulsegrid.streaming import processing as pro

T0 = 1_700_000_000


def signal(i, entity, t, score=0.9, **more):
    return {
        "event_id": f"e{i}", "schema_version": 1, "entity_hash": str(entity), "timestamp": str(t), "score": score, "severity": 3.0, "primary_detector": 2, "detectors_fired": 1,
        "confidence": 0.9, "detector_scores": [0.0, 0.0, 0.9], "attributes": {"trace_id": f"t{i // 4}"}, **more,
    }


def frame(spark, signals):
    schema = ", ".join(pro._columns()) + ", corrupt string"
    lines = spark.createDataFrame([(json.dumps(s) if isinstance(s, dict) else s,) for s in signals], "line string")
    return lines.select(F.from_json("line", schema, {"columnNameOfCorruptRecord": "corrupt"}).alias("s")).select("s.*")


def tables(spark, folder):
    out = {}
    for t in ("signals", "dead_letters", "late_events", "decisions", "incidents", "feedback"):
        out[t] = sorted((json.dumps(r.asDict(True), sort_keys=True, default=str) for r in pro.read(spark, folder, t).collect()))
    out["ledger"] = sorted(map(str, pro.ledger(spark, folder).collect()))
    return out


def batches():
    one = [signal(i, 1 + i % 2, T0 + i) for i in range(12)] + ["{broken", {k: v for k, v in signal(90, 1, T0).items() if k != "score"}]
    two = [signal(i, 1 + i % 3, T0 + 7200 + i) for i in range(8, 24)] + [signal(50, 1, T0 - 9000)]  # one is late
    return one, two


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    folder = str(tmp_path)
    run = pro.Batches(folder, clock=lambda: T0 + 8000)
    one, two = batches()
    run(frame(spark, one), 0)
    run(frame(spark, two), 1)
    before = tables(spark, folder)
    assert len(before["dead_letters"]) == 2 and len(before["late_events"]) == 1 and before["incidents"] and before["feedback"]
    run(frame(spark, two), 1)
    assert tables(spark, folder) == before
    rows = {r.batch: r for r in pro.ledger(spark, folder).collect()}
    assert (rows[0].signals, rows[0].late, rows[1].signals, rows[1].late) == (12, 0, 16, 1)
    assert rows[1].latest == T0 + 7200 + 23
    # An incident that both batches met is the second one's, whole.
    now = {r.incident_id: r for r in pro.incidents(spark, folder).collect()}
    assert len(now) < len(before["incidents"])
    assert all(r.members for r in now.values())


@pytest.mark.parametrize("at", ["incidents", "ledger"])
def test_a_crash_in_any_step_is_made_good(spark, tmp_path, monkeypatch, at):
    one, two = batches()
    clean = pro.Batches(str(tmp_path / "clean"), clock=lambda: T0 + 8000)
    for k, b in enumerate((one, two)):
        clean(frame(spark, b), k)
    folder = str(tmp_path / "crashed")
    run = pro.Batches(folder, clock=lambda: T0 + 8000)
    run(frame(spark, one), 0)
    put, finish = pro._put, pro.Batches._finish

    def broken(df, where, table, batch):
        if table == at:
            df.limit(1).write.mode("overwrite").parquet(f"{where}/{table}/batch={batch}")  # half a table
            raise OSError("lost")
        return put(df, where, table, batch)

    monkeypatch.setattr(pro, "_put", broken)
    if at == "ledger":
        monkeypatch.setattr(pro.Batches, "_finish", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        run(frame(spark, two), 1)
    assert all(r.event_id != "e20" for r in pro.read(spark, folder, "signals").collect())  # nothing of it is seen
    monkeypatch.setattr(pro, "_put", put)
    monkeypatch.setattr(pro.Batches, "_finish", finish)
    run.clock = lambda: T0 + 999_999  # a replay keeps the time of the first attempt
    run(frame(spark, two), 1)
    assert tables(spark, folder) == tables(spark, str(tmp_path / "clean"))


def test_duplicate_batches_are_rejected_for_a_while(spark, tmp_path):
    folder, at = str(tmp_path), [T0]
    run = pro.Batches(folder, clock=lambda: at[0])
    one, _ = batches()
    run(frame(spark, one), 0)
    run(frame(spark, one[::-1]), 1)
    at[0] += 901
    run(frame(spark, one), 2)
    assert [r.outcome for r in pro.ledger(spark, folder).orderBy("batch").collect()] == ["processed", "duplicate", "processed"]
    assert {r.event_id for r in pro.read(spark, folder, "signals").collect()} == {f"e{i}" for i in range(12)}


def registry(spark, version, entity, now):
    rules = spark.createDataFrame(
        [(1, "p", "suppress", [entity], 0.1, None, None, 0)],
        "rule int, pattern_id string, action string, entities array<bigint>, min_confidence double, score_scale double, confidence_scale double, ttl bigint",
    )
    return policy.artifact(rules, version, now)


def test_a_publish_changes_later_batches_only(spark, tmp_path):
    folder = str(tmp_path)
    run = pro.Batches(folder, clock=lambda: T0)
    one = [signal(i, 1, T0 + i) for i in range(6)]
    two = [signal(i, 1, T0 + i) for i in range(10, 16)]
    three = [signal(i, 1, T0 + i) for i in range(20, 26)]
    four = [signal(i, 1, T0 + i) for i in range(30, 36)]
    run(frame(spark, one), 0)
    first = policy.published(registry(spark, "v1", 1, 10), "v1")
    assert pro.publish(first, folder) == 1
    run(frame(spark, two), 1)
    second = policy.published(first.unionByName(registry(spark, "v2", 2, 20)), "v2")
    assert pro.publish(second, folder) == 2
    run(frame(spark, three), 2)
    pro.publish(policy.rolled_back(pro.registry_at(spark, folder, 2), "v1", 30), folder)
    run(frame(spark, four), 3)
    rows = {r.batch: (r.policy, r.suppressed) for r in pro.ledger(spark, folder).collect()}
    assert rows == {0: ("none", 0), 1: ("v1", 6), 2: ("v2", 0), 3: ("v1-rollback-30", 6)}
    assert not pro.of_batch(spark, folder, "incidents", 1).count() and pro.of_batch(spark, folder, "incidents", 2).count()


def test_a_stream_of_files_lands_in_the_tables(spark, tmp_path):
    one, two = batches()
    (tmp_path / "in").mkdir()
    for k, b in enumerate((one, two)):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in b))
    folder = str(tmp_path / "out")
    df = pro.signal_stream(spark, str(tmp_path / "in"))
    q = df.writeStream.foreachBatch(pro.Batches(folder, clock=lambda: T0)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    assert pro.read(spark, folder, "signals").count() == 29 and pro.read(spark, folder, "dead_letters").count() == 2
