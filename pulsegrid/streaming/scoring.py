"""The scoring loop as a stream: events and feedback in, profiles and what they learn as state, scored events out.

Events and feedback are one stream of tagged rows (``tagged``). In a micro-batch an entity's feedback is taken in first,
then its events in order. State is three named variables, the profile, what was learned, and the time last seen; an
entity that is not seen for a while is dropped by an event-time timer and starts anew. ``replayed`` is the same loop over
a table of rounds, ``snapshot`` turns a stream's state into a table, and ``scored`` can start from such a table.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import _parse_datatype_string

from ..plans.detectors import FIELDS, Config
from ..plans.bank import foretold
from ..plans.fold import dealt, runs, whole_keys
from ..plans.learner import Scoring

#: Rows of the loop: feedback (kind 0) has scores, decision and truth; events (kind 1) have uid and value.
ROWS = "entity long, kind int, t_ns long, event_id long, trace_id long, uid long, value double, scores array<double>, decision boolean, truth boolean"
OUT = f"entity long, event_id long, trace_id long, t_ns long, value double, {FIELDS}, weights array<double>"
#: Layout of what is kept; snapshots of other versions are not read.
VERSION = 1
_NAMES = [f.split()[0] for f in OUT.split(", ")]


def tagged(events: DataFrame | None, feedback: DataFrame | None, unique_id: str = "entity") -> DataFrame:
    """Events (entity, t_ns, event_id, trace_id, value) and feedback (entity, t_ns, event_id, scores, decision, truth) as rows of the loop.

    Rows without an entity, and events without a time or value, are no rows of the loop.
    """
    columns = [f.split()[0] for f in ROWS.split(", ")]
    kinds = dict(f.split() for f in ROWS.split(", "))
    parts = []
    if events is not None:
        e = events.where("entity IS NOT NULL AND t_ns IS NOT NULL AND value IS NOT NULL")
        parts.append(e.select("entity", F.lit(1).alias("kind"), "t_ns", "event_id", "trace_id", F.expr(unique_id).alias("uid"), "value"))
    if feedback is not None:
        parts.append(feedback.where("entity IS NOT NULL AND truth IS NOT NULL").select("entity", F.lit(0).alias("kind"), "t_ns", "event_id", "scores", "decision", "truth"))
    whole = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
    return whole.select(*[(F.col(c) if c in whole.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in columns])


def _feedback(scores, decision, truth) -> tuple[list[float], bool, bool]:
    return [0.0 if s is None else float(s) for s in (scores if scores is not None else [])], bool(decision), bool(truth)


def replayed(rows: DataFrame, config: Config | None = None, every: int = 100) -> DataFrame:
    """Scored events of a table of rows with a ``round`` each, as the stream would give them round by round."""
    arrow = to_arrow_schema(_parse_datatype_string(OUT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, held, at = object(), None, [], None
        for b, more in whole_keys(batches, "entity"):
            out: list[tuple] = []
            rows_ = b.to_pylist()
            new: list[Scoring] = []
            if not more:  # entities that begin and end here start together
                parts = [rows_[i:j] for i, j in runs([r["entity"] for r in rows_]) if rows_[i]["entity"] != key]
                new = [Scoring(config, every) for _ in parts]
                foretold([s.profile.rrcf for s in new], [[r["value"] for r in p if r["kind"]] for p in parts])
            begin = iter(new)
            for r in rows_:
                if r["entity"] != key:
                    key, state, held = r["entity"], next(begin, None) or Scoring(config, every), []
                if held and (r["kind"] or r["round"] != at):
                    state.feedback(held)
                    held = []
                at = r["round"]
                if r["kind"]:
                    out.append((key, r["event_id"], r["trace_id"], r["t_ns"], r["value"], *state.event(r["t_ns"], r["uid"], r["value"])))
                else:
                    held.append(_feedback(r["scores"], r["decision"], r["truth"]))
            cols = list(zip(*out, strict=True)) if out else [()] * len(arrow)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    ordered = dealt(rows, "entity").sortWithinPartitions("entity", "round", "kind", "t_ns", "event_id")
    return ordered.mapInArrow(run, OUT)


class _Loop(StatefulProcessor):
    """An entity's part of the loop; all its rows of a micro-batch are held to be put in order."""

    def __init__(self, idle_seconds: int, config: Config | None, every: int):
        self.idle, self.config, self.every = idle_seconds * 1000, config, every

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.profile = handle.getValueState("profile", "state binary")
        self.learned = handle.getValueState("learned", "state binary, weights array<double>")
        self.last = handle.getValueState("last", "t_ns long")

    def _state(self) -> Scoring:
        own = Scoring(self.config, self.every)
        if self.profile.exists():
            own.profile, own.learner = pickle.loads(self.profile.get()[0]), pickle.loads(self.learned.get()[0])
            own.last = self.last.get()[0]
        return own

    def _keep(self, own: Scoring) -> None:
        self.profile.update((pickle.dumps(own.profile),))
        self.learned.update((pickle.dumps(own.learner), own.learner.weights))
        self.last.update((own.last,))
        if self.idle:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(own.last // 1_000_000 + self.idle)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(rows)).sort_values(["kind", "t_ns", "event_id"], kind="stable")
        own = self._state()
        told = got[got["kind"] == 0]
        if len(told):
            own.feedback([_feedback(s, d, t) for s, d, t in zip(told["scores"], told["decision"], told["truth"], strict=True)])
        e = got[got["kind"] == 1]
        ids = [None if pd.isna(x) else int(x) for x in e["trace_id"]]
        uids = [None if pd.isna(x) else int(x) for x in e["uid"]]
        out = [
            (key[0], int(i), c, int(t), float(v), *own.event(int(t), u, float(v)))
            for i, c, t, u, v in zip(e["event_id"], ids, e["t_ns"], uids, e["value"], strict=True)
        ]
        if len(e) or self.profile.exists():  # feedback for an entity without a profile makes none
            self._keep(own)
        yield pd.DataFrame(out, columns=_NAMES).astype({"trace_id": "Int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in (self.profile, self.learned, self.last):
            state.clear()
        yield pd.DataFrame([], columns=_NAMES)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for r in initialState.itertuples():
            if r.version == VERSION and zlib.crc32(r.profile + r.learned) == r.checksum:
                own = Scoring(self.config, self.every)
                own.profile, own.learner, own.last = pickle.loads(r.profile), pickle.loads(r.learned), r.last
                self._keep(own)

    def close(self) -> None:
        pass


def scored(
    rows: DataFrame, config: Config | None = None, every: int = 100, idle_seconds: int = 0, late: str = "10 minutes", start: DataFrame | None = None
) -> DataFrame:
    """A stream of scored events of a stream of tagged rows; needs the RocksDB state store.

    An entity whose last event is ``idle_seconds`` before the watermark is dropped (0: never). ``start`` is a table of
    ``snapshot``; rows of another version or with a wrong checksum are left out, so their entities start anew.
    """
    loop = _Loop(idle_seconds, config, every)
    timed = rows.withColumn("ts", F.timestamp_micros(F.expr("t_ns DIV 1000"))).withWatermark("ts", late)
    initial = start.select("entity", "profile", "learned", "last", "version", "checksum").groupBy("entity") if start is not None else None
    mode = "EventTime" if idle_seconds else "None"
    return timed.groupBy("entity").transformWithStateInPandas(loop, OUT, "Append", mode, initialState=initial)


def snapshot(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The profiles that a stopped stream's checkpoint holds, a row an entity, with version and checksum, to start from."""

    def of(name: str) -> DataFrame:
        return spark.read.format("statestore").option("stateVarName", name).load(checkpoint).select(F.col("key.entity").alias("entity"), "value")

    profile, learned, last = of("profile"), of("learned"), of("last")
    whole = profile.select("entity", F.col("value.state").alias("profile")).join(
        learned.select("entity", F.col("value.state").alias("learned"), F.col("value.weights").alias("weights")), "entity"
    )
    whole = whole.join(last.select("entity", F.col("value.t_ns").alias("last")), "entity")
    return whole.withColumn("version", F.lit(VERSION)).withColumn("checksum", F.crc32(F.concat("profile", "learned")))
