"""Sketches in states and as tables."""

import pickle
import random

import pytest

from pulsegrid.operators import sketches as tables
from pulsegrid.plans import detectors
from pulsegrid.plans.sketches import CountMin, Distinct


def test_distinct_keeps_its_size_and_stays_near():
    s, sizes = Distinct(12), set()
    for i in range(1_000_000):
        s.add(i)
        if i in (0, 999, 99_999, 999_999):
            sizes.add(len(s.registers))
            assert abs(s.count() - (i + 1)) <= 3 * 1.04 / 64 * (i + 1) + 0.5
    assert sizes == {4096}
    assert s.sum == pytest.approx(sum(2.0**-r for r in s.registers)) and s.empty == s.registers.count(0)


@pytest.mark.parametrize("p", [4, 6, 10])
def test_merged_halves_are_the_whole(p):
    whole, one, other = Distinct(p), Distinct(p), Distinct(p)
    for i in range(3000):
        whole.add(f"v{i}")
        (one if i % 3 else other).add(f"v{i}")
    both = one.merged(other)
    assert both.registers == whole.registers and both.count() == pytest.approx(whole.count())
    assert pickle.loads(pickle.dumps(whole.registers)) == whole.registers
    with pytest.raises(ValueError):
        one.merged(Distinct(p + 1))


def test_counts_are_never_below_the_truth():
    r, s, truth = random.Random(1), CountMin(), {}
    half = CountMin(), CountMin()
    for i in range(20_000):
        v = int(r.paretovariate(1))
        s.add(v)
        half[i % 2].add(v)
        truth[v] = truth.get(v, 0) + 1
    both = half[0].merged(half[1])
    for v, n in truth.items():
        assert n <= s.estimate(v) and n <= both.estimate(v) and v in s
    assert len(s.cells) == 256 and s.estimate(1) < truth[1] * 1.1
    assert "never seen" not in CountMin()


def test_tables_are_the_states(spark):
    r = random.Random(4)
    rows = [(k, r.choice([None, r.randrange(40_000)])) for k in "ab" for _ in range(3000)]
    df = spark.createDataFrame(rows, "k string, v long").repartition(5)
    for p in (4, 10, 12):
        states = {}
        for k, v in rows:
            states.setdefault(k, Distinct(p)).add(v)
        got = tables.registers(df, "k", "v", p)
        for k, s in states.items():
            assert {x.register: x["rank"] for x in got.where(f"k = '{k}'").collect()} == {i: n for i, n in enumerate(s.registers) if n}
        for x in tables.estimates(got, "k", p).collect():
            assert x.distinct == pytest.approx(states[x.k].count())
        halves = tables.merged(tables.registers(df.where("v % 2 = 0"), "k", "v", p), tables.registers(df.where("v IS NULL OR v % 2 = 1"), "k", "v", p), "k")
        assert sorted(map(tuple, halves.collect())) == sorted(map(tuple, got.collect()))


def test_states_of_detectors_do_not_grow_with_ids():
    c = detectors.Cardinality()
    sizes = []
    for i in range(30_000):
        c.update(i, i, 1.0, False)
        if i in (1000, 29_999):
            sizes.append(len(pickle.dumps(c)))
    assert sizes[1] < sizes[0] * 1.1
    b = detectors.Behavioral(most=50)
    for i in range(5000):
        b.step(i * 10**9, i % 500, 1.0, f"s{i}", f"place{i}")
    assert len(b.store) == 50 and b.evicted == 4950
    score = [b.step(10**13 + i, 7777, 5.0, "s", None)[0] for i in range(60)]
    assert score[:50] == [0.0] * 50  # an id that was evicted, or is new, is not judged before it is known
    b.step(10**13, 0, 1.0, "s0")
    assert b.store[0].n == 1


def test_behaviour_tells_new_services():
    own = detectors.Behaviour()
    for i in range(60):
        own.add(i * 10**9, 1000.0, 50.0, "api", "x")
    assert own.deviation(61 * 10**9, 1000.0, 50.0, "api") < 0.3
    assert own.deviation(61 * 10**9, 1000.0, 50.0, "other") >= 0.3
    assert 0.9 < own.variety.count() < 1.1
