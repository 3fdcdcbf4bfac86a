"""Fold steps against known series, and the streaming forms against the batch ones."""

import pickle
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import adaptive
from pulsegrid.plans import fold, steps
from pulsegrid.sources.events import events, signals
from pulsegrid.sources.sinks import write_hourly
from pulsegrid.streaming.fold import stream_duplicates_removed, stream_fold, stream_rollup

SF = "/root/testdata/sf0.001"


def through(step, values):
    state, out = {}, []
    for i, v in enumerate(values):
        out.append(step[0](state, i, v))
        state = pickle.loads(pickle.dumps(state))  # as a state store keeps it
    return out


def test_holt_winters_learns_a_season():
    wave = [10 + 5 * math.sin(2 * math.pi * i / 12) for i in range(600)]
    got = through(steps.holt_winters(12), wave)
    assert all(d == 0 for _, d in got[:13])
    assert max(abs(d) for _, d in got[-50:]) < 0.5  # a tenth of the wave


def test_cusum_finds_the_side_of_a_shift():
    still = through(steps.cusum(10.0, 5.0, 30.0, 10), [10.0] * 60)
    shifted = through(steps.cusum(10.0, 5.0, 30.0, 10), [10.0] * 60 + [40.0] * 3)
    fallen = through(steps.cusum(10.0, 5.0, 30.0, 10), [10.0] * 60 + [-40.0] * 3)
    assert all(side == 0 for side, _ in still[20:])
    assert 1 in [s for s, _ in shifted[60:]] and -1 not in [s for s, _ in shifted[60:]]
    assert -1 in [s for s, _ in fallen[60:]] and 1 not in [s for s, _ in fallen[60:]]


def test_adwin_finds_a_jump_once_and_starts_again():
    r = random.Random(1)
    got = through(steps.adwin(100, 20), [r.gauss(0, 1) for _ in range(200)] + [r.gauss(20, 1) for _ in range(80)])
    drifts = [i for i, (d, _) in enumerate(got) if d]
    assert len(drifts) == 1 and 200 <= drifts[0] < 250  # the jump must outgrow the variance it brings
    assert got[drifts[0] + 1] == (False, 0.0)


def test_spectral_residual_is_evaluated_every_fifth_event():
    r = np.random.default_rng(1)
    got = through(steps.spectral_residual(24), r.normal(size=100).tolist())
    assert [i + 1 for i, (s, _) in enumerate(got) if s] == [24, *range(25, 101, 5)]


def test_rarity_over_blocks_is_the_decayed_loop(spark):
    r = random.Random(2)
    values = [r.lognormvariate(3, 2) for _ in range(400)]
    e = spark.createDataFrame([(i, 1, i, v) for i, v in enumerate(values)], "event_id long, entity long, t long, value double")
    got = {x.event_id: x.rarity for x in adaptive.fading_rarity(e, decay=0.7, block=110).collect()}
    bins: dict[int, float] = {}
    for i, v in enumerate(values):
        b = 0 if v <= 0.1 else 49 if v >= 1e4 else int(math.log(v / 0.1) / math.log(1e5) * 50)
        p = bins.get(b, 0.0) / sum(bins.values()) if bins else 1.0
        assert math.isclose(got[i], 100.0 if p < 0.001 else 1 / p, rel_tol=1e-3)
        bins = {k: w * 0.7 for k, w in bins.items()}
        bins[b] = bins.get(b, 0.0) + 1


@pytest.fixture(scope="module")
def two_batches(spark, tmp_path_factory):
    """The events as two files, the older first, and a function that opens them as a stream of a file a batch."""
    path = str(tmp_path_factory.mktemp("stream"))
    e = events(spark, SF)
    middle = e.agg(F.expr("percentile(t, 0.5)")).first()[0]
    e.where(F.col("t") <= middle).coalesce(1).write.mode("append").parquet(path)
    e.where(F.col("t") > middle).coalesce(1).write.mode("append").parquet(path)
    return lambda: spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(path)


def drained(spark, stream, name, tmp_path):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return spark.table(name)


def test_stream_fold_is_the_batch_fold(spark, two_batches, tmp_path):
    step = steps.holt_winters(4)
    got = drained(spark, stream_fold(two_batches(), step), "folded", tmp_path)
    want = fold.keyed_fold(events(spark, SF), dict, *step)
    as_dict = lambda df: {r.event_id: (round(r.expected, 6), round(r.deviation, 6)) for r in df.collect()}
    assert as_dict(got) == as_dict(want)


def test_stream_rollup_emits_what_the_watermark_has_passed(spark, two_batches, tmp_path):
    got = drained(spark, stream_rollup(two_batches()), "rolled", tmp_path)
    n = events(spark, SF).count()
    assert 0 < got.agg(F.sum("n")).first()[0] <= n


def test_stream_duplicates(spark, two_batches, tmp_path):
    got = drained(spark, stream_duplicates_removed(two_batches()), "single", tmp_path)
    assert 0 < got.count() <= events(spark, SF).count()
    assert got.groupBy("event_id").count().where("count > 1").isEmpty()


def test_hourly_json(spark, tmp_path):
    s = signals(spark, SF)
    write_hourly(s, str(tmp_path / "out"))
    back = spark.read.json(str(tmp_path / "out"))
    assert back.count() == s.count() and "hour" in back.columns
