"""Folds of a key with very many events, by blocks side by side: a prefix scan.

An exponentially weighted mean and variance move by an affine map of (mean, mean squared, variance) at each event. Maps
compose, so each block of a hot key's time gives one map, and the maps of a key's blocks are applied one after the other.
States found so are rounded otherwise than the fold's, but the fold forgets: blocks replayed from them mostly end with the
fold's very bits. Blocks whose predecessor ends otherwise than they begin are replayed from its end until there are none,
so what comes out is the fold's, bit for bit. No task holds more than a batch.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Events of a key beyond which it is cut into blocks, and the number of blocks.
HOT, BLOCKS = 1_000_000, 200


def product(maps: np.ndarray) -> np.ndarray:
    """The map that applies ``maps`` one after the other, the first one first; by halves."""
    while len(maps) > 1:
        if len(maps) % 2:
            maps = np.concatenate([maps, np.eye(maps.shape[1])[None]])
        maps = maps[1::2] @ maps[0::2]
    return maps[0]


def ewma_maps(x: np.ndarray, alpha: float) -> np.ndarray:
    """Each value's map of (mean, mean squared, variance, 1)."""
    a, out = alpha, np.zeros((len(x), 4, 4))
    out[:, 0, 0], out[:, 0, 3] = 1 - a, a * x
    out[:, 1, 0], out[:, 1, 1], out[:, 1, 3] = 2 * a * (1 - a) * x, (1 - a) ** 2, (a * x) ** 2
    out[:, 2, 0], out[:, 2, 1], out[:, 2, 2], out[:, 2, 3] = -2 * a * (1 - a) * x, a * (1 - a), 1 - a, a * (1 - a) * x * x
    out[:, 3, 3] = 1
    return out


def kept(df: DataFrame) -> DataFrame:
    """``df`` worked out once: in the session's checkpoint folder, or where there is none, with the executors."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.localCheckpoint()


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Parts of the batches with one (_key, _block) each, in order."""
    for b in batches:
        keys, blocks = b["_key"].to_pylist(), b["_block"].to_pylist()
        at = 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[at] or blocks[i] != blocks[at]:
                yield (keys[at], blocks[at]), b.slice(at, i - at)
                at = i


def ewma(
    events: DataFrame, half_life: float = 50.0, k: float = 3.0, low: float = 0.001, high: float = math.inf, key: str = "entity", hot: int = HOT, blocks: int = BLOCKS
) -> DataFrame:
    """``fold.ewma`` (event_id, mean, std, threshold) with hot keys spread over tasks.

    Keys of more than ``hot`` events are cut at quantiles of their times; events of one time stay together. States are the
    fold's, bit for bit. Events without a value get nulls and leave the state alone; events with a null key share one.
    What blocks begin with is found at once, not when the result is read.
    """
    alpha = 1 - math.exp(-math.log(2) / half_life)
    kind = dict(events.selectExpr(f"{key} AS k").dtypes)["k"]
    rows = events.selectExpr(f"{key} AS _key", "t", "event_id", "value")
    some = rows.where("value IS NOT NULL")
    counted = some.groupBy("_key").agg(F.count("*").alias("n"), F.avg("value").alias("_centre"), F.percentile_approx("t", [i / blocks for i in range(1, blocks)], 10_000).alias("_cuts"))
    crowded = counted.where(F.col("n") > hot).select(F.col("_key").alias("_hot"), "_centre", F.array_distinct("_cuts").alias("_cuts"))
    crowded = kept(crowded)  # quantiles of many rows differ from run to run, and all that follows must cut alike
    placed = rows.join(crowded, F.col("_key").eqNullSafe(F.col("_hot")), "left")
    placed = placed.withColumn("_block", F.when(F.col("_cuts").isNull(), 0).otherwise(F.size(F.filter("_cuts", lambda c: c <= F.col("t")))))
    placed = placed.select("_key", "_block", "t", "event_id", "value", "_centre")
    sort = ["_key", "_block", "t", "event_id"]

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each block its map, its end if the key begins with it, and the key's centre."""
        now, whole, begun, centre, out = None, None, None, 0.0, []
        for at, b in _runs(batches):
            x = b["value"].to_numpy() - b["_centre"][0].as_py()
            one = ewma_maps(x, alpha)
            if at != now:
                if now is not None:
                    out.append((*now, centre, whole.ravel().tolist(), begun.tolist()))
                now, whole, centre = at, np.eye(4), b["_centre"][0].as_py()
                begun = np.array([x[0], x[0] ** 2, 0.0, 1.0])
                begun = product(one[1:]) @ begun if len(one) > 1 else begun
            else:
                begun = product(one) @ begun
            whole = product(one) @ whole
        if now is not None:
            out.append((*now, centre, whole.ravel().tolist(), begun.tolist()))
        cols = list(zip(*out, strict=True)) if out else [[]] * 5
        types = (b["_key"].type if out else pa.null(), pa.int32(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=["_key", "_block", "centre", "map", "begun"])

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Mean and variance that each block begins with; nulls for a key's first."""
        key_, state = object(), None
        for b in batches:
            mean, var = [], []
            for k_, c, m, s in zip(*(b[n].to_pylist() for n in ("_key", "centre", "map", "begun")), strict=True):
                if k_ != key_:
                    key_, state = k_, None
                mean.append(None if state is None else float(state[0] + c))
                var.append(None if state is None else max(float(state[2]), 0.0))
                state = np.array(s) if state is None else np.array(m).reshape(4, 4) @ state
            yield pa.RecordBatch.from_arrays([b["_key"], b["_block"], pa.array(mean, pa.float64()), pa.array(var, pa.float64())], names=["_k", "_b", "_mean", "_var"])

    hot_rows = placed.where("_centre IS NOT NULL AND value IS NOT NULL")
    summary = hot_rows.repartition("_key", "_block").sortWithinPartitions(*sort).mapInArrow(maps, f"_key {kind}, _block int, centre double, map array<double>, begun array<double>")
    begin = summary.repartition("_key").sortWithinPartitions("_key", "_block").mapInArrow(states, f"_k {kind}, _b int, _mean double, _var double")

    def stepped(mean: float | None, var: float, x: float) -> tuple[float, float]:
        if mean is None:
            return x, 0.0
        d = x - mean
        return mean + alpha * d, (1 - alpha) * (var + alpha * d * d)

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Mean and variance that each block ends with, beside those that it begins with."""
        now, row, out = None, [], []
        for at, b in _runs(batches):
            if at != now:
                now, row = at, [*at, b["_mean"][0].as_py(), b["_var"][0].as_py(), b["_mean"][0].as_py(), b["_var"][0].as_py() or 0.0]
                out.append(row)
            mean, var = row[4:]
            for x in b["value"].to_pylist():
                mean, var = stepped(mean, var, x)
            row[4:], type_ = (mean, var), b["_key"].type
        if out:
            cols = zip(zip(*out, strict=True), (type_, pa.int32(), *[pa.float64()] * 4), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in cols], names=["_k", "_b", "_mean", "_var", "mean", "var"])

    def ended(begin: DataFrame) -> DataFrame:
        rows = hot_rows.join(begin, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_block") == F.col("_b"))).select(*sort, "value", "_mean", "_var")
        rows = rows.repartition("_key", "_block").sortWithinPartitions(*sort)
        return rows.mapInArrow(ends, f"_k {kind}, _b int, _mean double, _var double, mean double, var double")

    found = kept(ended(begin))
    while True:
        before = Window.partitionBy("_k").orderBy("_b")
        moved = found.withColumn("_m", F.lag("mean").over(before)).withColumn("_v", F.lag("var").over(before))
        moved = kept(moved.withColumn("_same", F.col("_mean").eqNullSafe(F.col("_m")) & F.col("_var").eqNullSafe(F.col("_v"))))
        again = moved.where("NOT _same").select("_k", "_b", F.col("_m").alias("_mean"), F.col("_v").alias("_var"))
        if again.isEmpty():
            break
        found = kept(moved.where("_same").select(*found.columns).unionByName(ended(again)))
    begin = found.where("_mean IS NOT NULL").select("_k", "_b", "_mean", "_var")
    joined = placed.join(begin, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_block") == F.col("_b")), "left").drop("_k", "_b", "_centre")

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, mean, var = None, None, 0.0
        for at, b in _runs(batches):
            if at != now:
                now, mean, var = at, b["_mean"][0].as_py(), b["_var"][0].as_py() or 0.0
            out: list[tuple] = []
            for x in b["value"].to_pylist():
                if x is None:
                    out.append((None, None, None))
                    continue
                limit = None if mean is None else min(max(mean + k * max(math.sqrt(var), 0.001), low), high)
                mean, var = stepped(mean, var, x)
                out.append((mean, math.sqrt(var), limit))
            cols = [pa.array(list(c), pa.float64()) for c in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays([b["event_id"], *cols], names=["event_id", "mean", "std", "threshold"])

    dealt = joined.repartition("_key", "_block").sortWithinPartitions(*sort)
    return dealt.mapInArrow(replay, "event_id long, mean double, std double, threshold double")
