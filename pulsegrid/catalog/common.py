"""Pieces of SQL that the catalogues share."""

from __future__ import annotations

#: The events as ``sources.events.events`` has them.
EVENTS = """e AS (SELECT event_id, user_id AS entity, event_type AS detector, CAST(json_extract_string(props, '$.k') AS BIGINT) AS trace_id, value,
  CAST(floor(epoch(ts)) AS BIGINT) AS t, epoch_us(ts) * 1000 AS t_ns FROM events)"""


def real(x: float) -> str:
    """A double, exactly."""
    return f"{x!r}" if "e" in repr(x) else f"{x!r}e0"


def numbered(key: str) -> str:
    """n: the events with their key g and their number rn in it."""
    return f"n AS (SELECT *, {key} AS g, row_number() OVER (PARTITION BY {key} ORDER BY t, event_id) AS rn FROM e)"


def recursion(key: str, state: dict[str, str], *layers: dict[str, str], uid: str = "entity") -> str:
    """r: the state after each event, as SQL. ``state`` has each column's start (``v``, ``t`` and ``uid`` are the event's).

    Each layer adds columns from those before; a state column x takes what a layer calls x_, and is carried on without one.
    """
    named = {k for layer in layers for k in layer}
    inner = f"SELECT r.* EXCLUDE (rn, event_id), n.rn, n.event_id, n.value AS v, n.t_ns AS t, n.{uid} AS uid FROM r JOIN n ON n.g = r.g AND n.rn = r.rn + 1"
    for layer in layers:
        inner = f"SELECT *, {', '.join(f'{x} AS {k}' for k, x in layer.items())} FROM ({inner}) AS q"
    first = ", ".join(f"{x} AS {k}" for k, x in state.items())
    after = ", ".join(f"{k}_ AS {k}" if f"{k}_" in named else k for k in state)
    start = f"SELECT g, rn, event_id, {first} FROM (SELECT g, rn, event_id, value AS v, t_ns AS t, {uid} AS uid FROM n WHERE rn = 1) AS q"
    return f"WITH RECURSIVE {EVENTS}, {numbered(key)}, r AS ({start} UNION ALL SELECT g, rn, event_id, {after} FROM ({inner}) AS q)"
