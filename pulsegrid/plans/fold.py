"""The keyed fold: operators whose next state needs the last, once over each key's ordered events."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string


#: Rows that are held, so that the keys that begin and end in them can start together.
HELD = 20_000


def whole_keys(batches: Iterator[pa.RecordBatch], key: str, held: int = HELD) -> Iterator[tuple[pa.RecordBatch, bool]]:
    """Ordered batches cut between keys, and whether a batch's key goes on: one of more rows than are held has batches of its own."""
    kept, n = [], 0
    for b in batches:
        kept, n = [*kept, b], n + len(b)
        if n < held:
            continue
        b = pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
        keys = b[key].to_pylist()
        at = next((i for i in range(n - 1, 0, -1) if keys[i - 1] != keys[-1]), 0)
        if at:
            yield b.slice(0, at), False
            kept, n = [b.slice(at)], n - at
        else:
            yield b, True
            kept, n = [], 0
    if n:
        yield pa.Table.from_batches(kept).combine_chunks().to_batches()[0], False


def runs(keys: list) -> list[tuple[int, int]]:
    """Where each run of equal keys begins and ends."""
    at = [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1]]
    return list(zip(at, [*at[1:], len(keys)], strict=True))


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows by key in four partitions a core (no more than the session's): few bytes may be much work, so none are joined."""
    spark = rows.sparkSession
    n = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return rows.repartition(n, key)


def keyed_fold(
    events: DataFrame, start: Callable[[], object], step: Callable, fields: str, key: str = "entity", columns: tuple[str, ...] = ("t", "value"), carry: tuple[str, ...] = (),
    ahead: Callable[[list[list]], list] | None = None,
) -> DataFrame:
    """event_id, the columns to ``carry`` along and what ``step(state, *columns)`` returns for each event, in the order of t
    and event_id within a key.

    Partitions are sorted and streamed, so a task holds one state and one batch. An event with a null in the last of the
    columns gets nulls and leaves the state alone; events with a null key share one. ``ahead`` may make the states of many
    keys at once, from all values that the last column has for each; keys of more than ``HELD`` rows begin with ``start``.
    """
    kinds = dict(events.dtypes)
    schema = _parse_datatype_string(", ".join(["event_id long", *(f"{c} {kinds[c]}" for c in carry), fields]))
    arrow = to_arrow_schema(schema)
    own = list(arrow)[1 + len(carry) :]
    none, held = (None,) * len(own), HELD

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = object(), None
        for b, more in whole_keys(batches, "_key", held) if ahead else ((b, False) for b in batches):
            out, rest, keys = [], [b[c].to_pylist() for c in columns], b["_key"].to_pylist()
            new = iter(())
            if ahead and not more:
                new = iter(ahead([[x for x in rest[-1][i:j] if x is not None] for i, j in runs(keys) if keys[i] != last]))
            for k, *row in zip(keys, *rest, strict=True):
                if k != last:
                    last, state = k, next(new, None) or start()
                out.append(none if row[-1] is None else step(state, *row))
            cols = list(zip(*out, strict=True)) if out else [()] * len(none)
            arrays = [pa.array(list(c), f.type) for c, f in zip(cols, own, strict=True)]
            yield pa.RecordBatch.from_arrays([b["event_id"], *(b[c] for c in carry), *arrays], schema=arrow)

    others = [c for c in dict.fromkeys((*columns, *carry)) if c not in ("t", "event_id")]
    rows = events.selectExpr(f"{key} AS _key", "t", "event_id", *others)
    return dealt(rows, "_key").sortWithinPartitions("_key", "t", "event_id").mapInArrow(run, schema)


def ewma(events: DataFrame, half_life: float = 50.0, k: float = 3.0, low: float = 0.001, high: float = math.inf) -> DataFrame:
    """Exponentially weighted mean and deviation, and the threshold mean + k deviations before the event, in its bounds."""
    alpha = 1 - math.exp(-math.log(2) / half_life)

    def step(s: dict, _t: int, value: float) -> tuple:
        limit = min(max(s["mean"] + k * max(math.sqrt(s["var"]), 0.001), low), high) if s else None
        if not s:
            s |= {"mean": value, "var": 0.0}
        else:
            d = value - s["mean"]
            s["mean"] += alpha * d
            s["var"] = (1 - alpha) * (s["var"] + alpha * d * d)
        return s["mean"], math.sqrt(s["var"]), limit

    return keyed_fold(events, dict, step, "mean double, std double, threshold double")


def page_hinkley(events: DataFrame, slack: float = 0.5, limit: float = 500.0, alpha: float = 0.01) -> DataFrame:
    """Cumulative deviation above a slow mean, over its minimum; an alarm at the limit starts it again from the value."""

    def step(s: dict, _t: int, value: float) -> tuple:
        s["mean"] = alpha * value + (1 - alpha) * s["mean"] if "mean" in s else value
        s["sum"] = s.get("sum", 0.0) + (value - s["mean"] - slack)
        s["min"] = min(s.get("min", 0.0), s["sum"])
        rise = s["sum"] - s["min"]
        if alarm := rise > limit:
            s |= {"sum": 0.0, "min": 0.0, "mean": value}
        return rise, rise / limit, alarm

    return keyed_fold(events, dict, step, "rise double, strength double, alarm boolean")
