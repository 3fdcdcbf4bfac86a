"""The endpoint sweep against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import evaluation as ev


@pytest.mark.parametrize("few", [1000, 0])
@pytest.mark.parametrize("parts", [1, 5])
def test_pairs_are_those_of_all_pairs(spark, few, parts):
    r = random.Random(3)
    points = [(i, r.choice([None, *range(100)]), "x") for i in range(300)]
    windows = [(k, s := r.choice([None, *range(100)]), None if s is None or k % 9 == 0 else s + r.choice([-3, 0, 0, 1, 5, 70]), [str(k)]) for k in range(80)]
    p, w = spark.createDataFrame(points, "id long, t long, name string"), spark.createDataFrame(windows, "seq long, start long, end long, tags array<string>")
    got = ev.within(p.repartition(3), w, few=few, parts=parts)
    assert got.columns == ["id", "t", "name", "seq", "start", "end", "tags"]
    want = sorted((i, t, n, k, s, e) for i, t, n in points for k, s, e, _ in windows if None not in (t, s, e) and s <= t <= e)
    assert sorted(tuple(x)[:6] for x in got.collect()) == want and all(x.tags == [str(x.seq)] for x in got.collect())
    assert ev.within(p.limit(0), w, few=few, parts=parts).count() == ev.within(p, w.limit(0), few=few, parts=parts).count() == 0


def test_many_windows_of_one_day(spark):
    n = 100_000
    w = spark.range(n).select(F.col("id").alias("seq"), (F.col("id") % 86400).alias("start"), (F.col("id") % 86400 + F.when(F.col("id") % 1000 == 0, 3600).otherwise(0)).alias("end"))
    p = spark.range(20_000).select(F.col("id").alias("event_id"), (F.col("id") * 4).alias("t"))
    got = ev.within(p, w, parts=8).groupBy("event_id").agg(F.count("*").alias("n"))
    total = got.agg(F.sum("n")).first()[0]
    starts = [(k % 86400, k % 86400 + (3600 if k % 1000 == 0 else 0)) for k in range(n)]
    edges = [0] * 90_001
    for s, e in starts:
        edges[s] += 1
        edges[min(e + 1, 90_000)] -= 1
    open_, want = 0, 0
    for t in range(90_000):
        open_ += edges[t]
        want += open_ if t % 4 == 0 and t < 80_000 else 0
    assert total == want
