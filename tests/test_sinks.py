"""Sinks, and truths and detections of two streams."""

import json
import os
import random

from pyspark.sql import functions as F

from pulsegrid.operators import evaluation
from pulsegrid.sources import sinks
from pulsegrid.streaming.matching import stream_matches


def test_a_stream_lands_in_hours(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [{"event_id": i, "t": 1_700_000_000 + i * 600, "score": i / 10} for i in range(20)]
    for k in range(2):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(json.dumps(r) for r in rows[k * 10 : k * 10 + 10]))
        q = sinks.stream_hourly(spark.readStream.schema("event_id long, t long, score double").json(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "c"), once=True)
        q.awaitTermination(60)
    got = spark.read.json(str(tmp_path / "out"))
    assert sorted((r.event_id, r.t, r.score) for r in got.collect()) == [(r["event_id"], r["t"], r["score"]) for r in rows]
    assert all(r.h == r.hour for r in got.select(F.date_format(F.timestamp_seconds("t"), "yyyy-MM-dd-HH").alias("h"), "hour").collect())


def test_letters_reports_and_history(spark, tmp_path):
    letters = spark.createDataFrame([("a", "missing:score", "{}"), (None, "no_signals", "x")], "event_id string, reason string, payload string")
    for now in (1_700_000_000, 1_700_100_000):
        sinks.append_letters(letters, str(tmp_path / "l"), now)
    got = sinks.latest_letters(spark, str(tmp_path / "l"), 3).collect()
    assert [(r.event_id, r.at) for r in got] == [(None, 1_700_100_000), ("a", 1_700_100_000), (None, 1_700_000_000)]
    sinks.write_report(spark.createDataFrame([("tp", 1.0)], "metric string, value double"), str(tmp_path / "r"))
    assert spark.read.option("header", True).csv(str(tmp_path / "r")).collect()[0].asDict() == {"metric": "tp", "value": "1.0"}
    truths = spark.createDataFrame([(100, True), (103, False)], "t long, anomaly boolean")
    for now in (104, 110):
        sinks.append_evaluation(evaluation.windowed(truths, truths, now, scenario=f"s{now}"), str(tmp_path / "h"))
    assert [r.at for r in sinks.evaluations(spark, str(tmp_path / "h")).collect()] == [110, 104]
    assert [r.recall for r in sinks.evaluations(spark, str(tmp_path / "h"), scenario="s104").collect()] == [100]


def test_two_streams_match_within_a_second(spark, tmp_path):
    r = random.Random(6)
    truths = [{"id": i, "t": 1000 + r.randrange(200), "anomaly": i % 2 == 0} for i in range(30)]
    found = [{"event_id": 100 + i, "t": 1000 + r.randrange(200)} for i in range(60)]
    end = [{"id": 99, "t": 9000, "anomaly": False}], [{"event_id": 999, "t": 9000}], [{"id": 98, "t": 9900, "anomaly": False}], [{"event_id": 998, "t": 9900}]
    for name, parts in (("a", (truths[:15], truths[15:], end[0], end[2])), ("b", (found[:30], found[30:], end[1], end[3]))):
        (tmp_path / name).mkdir()
        for k, p in enumerate(parts):
            (tmp_path / name / f"{k}.json").write_text("\n".join(map(json.dumps, p)))
            os.utime(tmp_path / name / f"{k}.json", (1_700_000_000 + k, 1_700_000_000 + k))  # files are read in this order
    read = lambda n, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / n))
    df = stream_matches(read("a", "id long, t long, anomaly boolean"), read("b", "event_id long, t long"), late="5 minutes")
    q = df.writeStream.format("memory").queryName("matches").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(x.id, x.detected) for x in spark.sql("SELECT * FROM matches").collect() if x.id < 90}
    want = {(a["id"], b["event_id"]) for a in truths for b in found if abs(a["t"] - b["t"]) <= 1}
    want |= {(a["id"], None) for a in truths if all(abs(a["t"] - b["t"]) > 1 for b in found)}
    assert got == want and any(d is None for _, d in got)
