"""Forests side by side against forests one by one, and folds whose keys start together against plain ones."""

import numpy as np
import pyarrow as pa
import pytest

from pulsegrid.operators import profile as prof
from pulsegrid.plans import bank, detectors, fold
from pulsegrid.plans.forest import CutForest


def _alone(points):
    f = CutForest()
    return [f.add(x) for x in points.tolist()]


@pytest.mark.parametrize("width", [1, 3, 10])
def test_side_by_side_is_one_by_one(width, monkeypatch):
    monkeypatch.setattr(bank, "GROUP", 9)
    rng = np.random.default_rng(width)
    sizes = [300, 290, 260, 200, 170, 160, 155, 150, 140, 20, 12, 3, 1, 0, 700]
    series = [rng.integers(0, 6, (n, width)).astype(float) if n % 20 else np.round(rng.lognormal(3, 1, (n, width)), 2) for n in sizes]
    assert [s.tolist() for s in bank.raws(series)] == [_alone(s) for s in series]


def test_points_that_are_no_numbers():
    series = [np.array([[1.0], [np.nan], [2.0], [np.inf], [3.0]])] + [np.arange(9.0)[:, None]] * 8
    got = bank.raws(series)
    assert np.array_equal(got[0], _alone(series[0]), equal_nan=True) and got[3].tolist() == _alone(series[3])


def test_few_registers_begin_empty():
    from pulsegrid.plans.sketches import Distinct

    a, b = Distinct(10), Distinct(10, bytes(1024))
    assert (a.sum, a.empty, a.count()) == (b.sum, b.empty, b.count())


@pytest.mark.parametrize("held", [3, 10, 1000])
def test_batches_are_cut_between_keys(held):
    keys = [1] * 4 + [None] * 2 + [2] + [3] * 25 + [4] * 5
    batches = [pa.RecordBatch.from_pydict({"k": keys[i : i + 4], "i": list(range(i, min(i + 4, len(keys))))}) for i in range(0, len(keys), 4)]
    got = list(fold.whole_keys(iter(batches), "k", held))
    assert [i for b, _ in got for i in b["i"].to_pylist()] == list(range(len(keys)))
    for (b, more), (c, _) in zip(got, got[1:]):
        same = b["k"][-1].as_py() == c["k"][0].as_py()
        assert more or not same
        assert not more or len(set(b["k"].to_pylist())) == 1
    assert not got[-1][1] or held < 25


@pytest.mark.parametrize("held", [40, 20_000])
def test_profiles_that_start_together(spark, held, monkeypatch):
    monkeypatch.setattr(fold, "HELD", held)
    rng = np.random.default_rng(5)
    rows = [(i, int(k) if k else None, i * 10**9, i, None if i % 31 == 0 else float(x), int(u)) for i, (k, x, u) in enumerate(zip(rng.integers(0, 12, 500), np.round(rng.lognormal(3, 1, 500), 2), rng.integers(0, 9, 500)))]
    e = spark.createDataFrame(rows, "event_id long, entity long, t_ns long, t long, value double, trace_id long")
    got = {r.event_id: r for r in prof.outputs(e, "entity", "trace_id").collect()}
    states = {}
    for i, k, t_ns, _, x, u in rows:
        want = (None,) * 9 if x is None else states.setdefault(k, detectors.Profile()).step(t_ns, u, x)
        assert tuple(got[i])[1:] == tuple(want)


def test_hash_vector_works_the_hash_out_once(spark):
    from pyspark.sql import functions as F

    from pulsegrid.operators.vectors import hash_vector

    df = spark.createDataFrame([("a",), ("",), (None,), ("some text",)], "x string")
    made = df.select(hash_vector(F.col("x")).alias("v"))
    inner = made._jdf.queryExecution().optimizedPlan().toString()
    assert inner.count("md5(") == 1 and "lambda" in inner[inner.index("md5(") :]  # an argument of the outer function, not in its body
    import hashlib

    bits = lambda x: [float(b >> (7 - i) & 1) for b in hashlib.md5(x.encode()).digest()[:8][::-1] for i in range(8)]
    for x, v in zip(["a", "", None, "some text"], made.collect()):
        assert v.v == ([None] * 64 if x is None else bits(x))


def test_terms_are_counted_where_their_texts_are(spark):
    from pulsegrid.operators.vectors import sparse_terms

    plan = sparse_terms(spark.createDataFrame([(1, "a b a")], "k long, text string"), "k")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_registry_is_made_of_one_pass(spark):
    from pulsegrid.catalog import stage2

    plan = stage2._registry(spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString()
    assert "parquet" not in plan.lower()
