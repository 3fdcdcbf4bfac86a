"""The streaming forms: the keyed fold with its state in Spark's state store, rollups and duplicate removal under a watermark."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.steps import Step


def stream_fold(events: DataFrame, step: Step) -> DataFrame:
    """entity, event_id and the step's fields for each event of a stream; an entity's events are ordered within a micro-batch."""
    apply, fields = step
    names = [f.split()[0] for f in fields.split(", ")]

    def run(key: tuple, batches: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        state = pickle.loads(kept.get[0]) if kept.exists else {}
        rows = pd.concat(batches).sort_values(["t", "event_id"])
        out = pd.DataFrame([apply(state, int(t), float(v)) for t, v in zip(rows["t"], rows["value"], strict=True)], columns=names)
        kept.update((pickle.dumps(state),))
        out.insert(0, "event_id", rows["event_id"].to_numpy())
        out.insert(0, "entity", key[0])
        yield out

    rows = events.where("value IS NOT NULL AND entity IS NOT NULL").select("entity", "t", "event_id", "value")
    return rows.groupBy("entity").applyInPandasWithState(run, f"entity long, event_id long, {fields}", "state binary", "append", GroupStateTimeout.NoTimeout)


def stream_rollup(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count and mean per entity and window; a window is emitted once the watermark has passed it."""
    timed = events.withColumn("ts", F.timestamp_seconds("t")).withWatermark("ts", late)
    means = timed.groupBy("entity", F.window("ts", window).alias("w")).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return means.select("entity", F.col("w.start").alias("start"), "n", "mean")


def stream_duplicates_removed(events: DataFrame, seconds: int = 900) -> DataFrame:
    """A stream without repeats of entity, detector and trace within a time."""
    timed = events.withColumn("ts", F.timestamp_seconds("t")).withWatermark("ts", f"{seconds} seconds")
    return timed.dropDuplicatesWithinWatermark(["entity", "detector", "trace_id"])
