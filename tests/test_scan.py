"""Folds by blocks against the plain fold."""

import math
import random

import pytest

from pulsegrid.plans import fold, scan

E = "event_id long, entity long, t long, value double"


@pytest.mark.parametrize("hot", [10**9, 100, 0])
def test_blocks_give_the_folds_states(spark, hot):
    r = random.Random(2)
    rows = [(i, r.choice([1, 1, 1, 1, 2, None]), r.randrange(3000), r.choice([None, *[1e6 + r.gauss(0, 3)] * 9])) for i in range(4000)]
    rows += [(9000 + i, 7, 5, 1.0 * i) for i in range(300)]  # one time only: one block
    rows += [(9999, 8, 5, None)]
    e = spark.createDataFrame(rows, E).repartition(3)
    want = {x.event_id: x for x in fold.ewma(e).collect()}
    got = scan.ewma(e, hot=hot, blocks=9).collect()
    assert len(got) == len(want) == len(rows)
    for x in got:
        for a, b in zip(x, want[x.event_id], strict=True):
            assert a == b if a is None or b is None else math.isclose(a, b, rel_tol=1e-7, abs_tol=1e-5), (x, want[x.event_id])


@pytest.mark.parametrize("blocks", [3, 40])
def test_blocks_give_the_very_bits_of_the_fold(spark, blocks):
    r = random.Random(7)
    rows = [(i, i % 2, i // 3, None if i % 50 == 0 else round(r.lognormvariate(3, 1), 2)) for i in range(12_000)]
    e = spark.createDataFrame(rows, E).repartition(3)
    want = sorted(tuple(x) for x in fold.ewma(e).collect())
    assert sorted(tuple(x) for x in scan.ewma(e, hot=100, blocks=blocks).collect()) == want


def test_one_key_fills_many_tasks(spark):
    e = spark.range(20_000).selectExpr("id AS event_id", "1L AS entity", "id AS t", "sin(id) * 100 AS value")
    dealt = scan.ewma(e, hot=1000, blocks=16)
    assert dealt.count() == 20_000
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the rows are few
    try:
        assert dealt.selectExpr("spark_partition_id() AS p").distinct().count() == 4
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_products_are_in_order():
    x = [3.0, -1.0, 7.5, 2.0, 0.5]
    state, a = [1.0, 1.0, 0.0, 1.0], 0.2
    mean, var = 1.0, 0.0
    for v in x:
        d = v - mean
        mean, var = mean + a * d, (1 - a) * (var + a * d * d)
    got = scan.product(scan.ewma_maps(__import__("numpy").array(x), a)) @ state
    assert got[0] == pytest.approx(mean) and got[2] == pytest.approx(var) and got[1] == pytest.approx(mean * mean)
