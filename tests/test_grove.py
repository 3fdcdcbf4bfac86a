"""Trees of a key one by one against its forest, and the fold over them against the plain one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import profile as prof
from pulsegrid.plans import detectors, fold, grove, steps
from pulsegrid.plans.forest import CutForest


def _summed(points, size, pieces, seed=3):
    parts = np.zeros(len(points))
    for t in range(4):
        tree, cuts = grove.CutTree(t, size, seed), np.append(np.arange(0, len(points), pieces), len(points))
        parts += np.concatenate([tree.run(points[i:j]) for i, j in zip(cuts[:-1], cuts[1:])])
    return [0.0, *(parts / 4 + 1.0)[1:].tolist()]


def _whole(points, size, seed=3):
    f = CutForest(4, size, seed)
    return [f.add(p) for p in points.tolist()]


@pytest.mark.parametrize("width", [1, 3, 10])
@pytest.mark.parametrize("size", [1, 5, 128])
def test_trees_add_up_to_their_forest(width, size):
    rng = np.random.default_rng(width * size)
    few = rng.integers(0, 4, (350, width)).astype(float)  # many equal points and values
    many = np.round(rng.lognormal(3, 1, (350, width)), 2)
    many[::50] *= -1000
    runs = np.repeat(np.round(rng.normal(0, 1, (30, width)), 3), 12, axis=0)
    for points in (few, many, runs):
        for pieces in (1, 37, 1000):
            assert _summed(points, size, pieces) == _whole(points, size)


@pytest.mark.parametrize("odd", [np.nan, np.inf, -np.inf, 1e308, 1e17, 5e-324])
def test_trees_take_odd_numbers_as_their_forest_does(odd):
    points = np.round(np.random.default_rng(5).normal(0, 3, (300, 2)), 2)
    points[150, 1], points[170, 0] = odd, -odd
    with np.errstate(all="ignore"):
        assert _summed(points, 32, 40) == _whole(points, 32)


def test_few_long_keys_keep_a_task_for_each_tree(spark):
    rows = spark.range(3 * 10 * 5).select((F.col("id") % 3).alias("_key"), (F.floor(F.col("id") / 3) % 10).cast("int").alias("tree"))
    got = grove._dealt(rows, [0, 1, 2], 10).groupBy(F.spark_partition_id().alias("p")).agg(F.countDistinct("_key", "tree").alias("n")).collect()
    assert [r.n for r in got] == [1] * 30


def _events(spark, n=700):
    rng = np.random.default_rng(8)
    rows = [(i, [None, 5, -2, 7][k], int(t), None if i % 41 == 0 else float(x), int(u)) for i, (k, t, x, u) in enumerate(zip(rng.integers(0, 4, n), rng.integers(0, 300, n), np.round(rng.lognormal(3, 1, n), 2), rng.integers(0, 9, n)))]
    rows += [(n + i, 100 + i, 3, 1.0 * i, 1) for i in range(60)]  # more keys than have partitions of their own
    return spark.createDataFrame(rows, "event_id long, entity long, t long, value double, trace_id long").withColumn("t_ns", F.col("t") * 10**9)


def _rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("part, points", [(128, 2048), (3, 5)])
def test_fold_over_trees_is_the_plain_fold(spark, monkeypatch, part, points):
    monkeypatch.setattr(grove, "PART", part)
    monkeypatch.setattr(grove, "POINTS", points)
    e = _events(spark)
    want = fold.keyed_fold(e, dict, *steps.forest(10))
    assert _rows(grove.scores(e, "entity", shingle=10)) == _rows(want)
    found = _rows(prof.forest_detector(e))
    assert found == _rows(prof.one_detector(e, detectors.Rrcf)) and found
    whole = e.where("value IS NOT NULL").withColumn("point", F.array("value", F.col("trace_id").cast("double")))
    want = _rows(fold.keyed_fold(whole, dict, *steps.forest(), columns=("t", "point")))
    got = _rows(grove.scores(e, "entity", "array(value, CAST(trace_id AS double))", 2))
    assert [r for r in got if r[1] is not None] == want
    assert {r[0] for r in got if r[1] is None} == {r.event_id for r in e.where("value IS NULL").collect()}
