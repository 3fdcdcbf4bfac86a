"""Evaluation against ground truth."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


#: Windows that are broadcast (some 100 bytes each); with more, points and windows are dealt into ranges of time.
FEW = 50_000


def within(points: DataFrame, windows: DataFrame, at: str = "t", few: int = FEW, parts: int | None = None) -> DataFrame:
    """Every pair of a point (all its columns) and a window (columns start, end and others, none of the points' names) that holds it.

    Up to ``few`` windows are broadcast, and points stay where they are: each batch is sorted and every window takes its run of
    it. Beyond that, an endpoint sweep: time is cut into ``parts`` ranges of about as many points and starts each, a window goes
    to the ranges that it touches, and there points and starts are swept in order, with the windows open at the time.
    Either way no pair is looked at but those that come out. Points without a time, and windows without an end or that end
    before they start, meet nothing.
    """
    p = points.where(F.col(at).isNotNull())
    w = windows.where("start IS NOT NULL AND end IS NOT NULL AND start <= end")
    schema = StructType([*p.schema.fields, *w.schema.fields])
    if w.limit(few + 1).count() <= few:
        held = points.sparkSession.sparkContext.broadcast(w.toArrow())

        def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = held.value.combine_chunks()
            start, end = (table[c].to_numpy() for c in ("start", "end"))
            for b in batches:
                t = b[at].to_numpy(zero_copy_only=False)
                order = np.argsort(t, kind="stable")
                first, last = np.searchsorted(t[order], start), np.searchsorted(t[order], end, "right")
                n = last - first
                if n.sum():
                    row = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)]
                    right = table.take(pa.array(np.repeat(np.arange(len(n)), n)))
                    yield pa.RecordBatch.from_arrays([*b.take(pa.array(row)).columns, *(c.combine_chunks() for c in right.columns)], names=schema.names)

        return p.mapInArrow(runs, schema)
    n = parts or int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    times = p.select(F.col(at).cast("double").alias("x")).unionByName(w.select(F.col("start").cast("double").alias("x")))
    cuts = sorted(set(times.agg(F.percentile_approx("x", [k / n for k in range(1, n)], 1000).alias("q")).first().q or [])) if n > 1 else []
    # How many cuts are at or below.
    part = lambda x: F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= x.cast("double"))) if cuts else F.lit(0)
    marked = p.select(part(F.col(at)).alias("_part"), F.col(at).cast("double").alias("_at"), F.lit(1).alias("_kind"), F.struct(*p.columns).alias("_p"))
    spread = w.withColumn("_part", F.explode(F.sequence(part(F.col("start")), part(F.col("end")))))
    opened = spread.select("_part", F.col("start").cast("double").alias("_at"), F.lit(0).alias("_kind"), F.struct(*w.columns).alias("_w"))

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, open_, number = None, [], count()
        for b in batches:
            row, met = [], []
            rows = zip(*(b[c].to_pylist() for c in ("_part", "_at", "_kind", "_w")), strict=True)
            for i, (k, x, kind, window) in enumerate(rows):
                if k != now:
                    now, open_ = k, []
                if not kind:
                    heapq.heappush(open_, (window["end"], next(number), window))
                    continue
                while open_ and open_[0][0] < x:
                    heapq.heappop(open_)
                row += [i] * len(open_)
                met += [o[2] for o in open_]
            if row:
                left, right = b["_p"].take(pa.array(row)), pa.array(met, b["_w"].type)
                yield pa.RecordBatch.from_arrays([*left.flatten(), *right.flatten()], names=schema.names)

    both = marked.unionByName(opened, allowMissingColumns=True)
    return both.repartition(n, "_part").sortWithinPartitions("_part", "_at", "_kind").mapInArrow(sweep, schema)


def truth_windows(e: DataFrame) -> DataFrame:
    """Per day the minutes around the day's largest value: anomaly_id, start and end in seconds."""
    top = e.groupBy(F.floor(F.col("t") / 86400).cast("long").alias("anomaly_id")).agg(F.max_by("t", F.struct("value", F.col("event_id"))).alias("at"))
    return top.select("anomaly_id", (F.col("at") - 3600).alias("start"), (F.col("at") + 3600).alias("end"))


def labelled(s: DataFrame, windows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Signals with whether a window holds their time."""
    hits = within(s.select("event_id", "t"), windows.select("anomaly_id", "start", "end")).groupBy("event_id").agg(F.min("anomaly_id").alias("anomaly_id"))
    return s.join(hits, "event_id", "left").select(
        "event_id", "entity", "detector", "score", "t", F.col("anomaly_id").isNotNull().alias("truth"), "anomaly_id", (F.col("score") >= threshold).alias("flagged")
    )


def confusion(rows: DataFrame, *by: str) -> DataFrame:
    """Counts with precision, recall and F1 (0 where undefined)."""
    c = rows.groupBy(*by).agg(
        F.count_if(F.col("truth") & F.col("flagged")).alias("tp"),
        F.count_if(~F.col("truth") & F.col("flagged")).alias("fp"),
        F.count_if(F.col("truth") & ~F.col("flagged")).alias("fn"),
        F.count_if(~F.col("truth") & ~F.col("flagged")).alias("tn"),
    )
    ratio = lambda a, b: F.when(b > 0, F.round(a / b, 6)).otherwise(0.0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select(*by, "tp", "fp", "fn", "tn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def recall_by_anomaly(rows: DataFrame) -> DataFrame:
    return rows.where("truth").groupBy("anomaly_id").agg(F.count("*").alias("events"), F.count_if("flagged").alias("found"))


def per_second(rows: DataFrame) -> DataFrame:
    """Seconds that are true, flagged, or both."""
    s = rows.groupBy("t").agg(F.bool_or("truth").alias("truth"), F.bool_or("flagged").alias("flagged"))
    return s.agg(F.count_if("truth").alias("truth_s"), F.count_if("flagged").alias("flagged_s"), F.count_if(F.col("truth") & F.col("flagged")).alias("both_s"))


def ranked_values(e: DataFrame, ranks: dict[str, Column], by: str = "detector", value: str = "value") -> DataFrame:
    """Per group the values at exact ranks of its sorted order (from 0; each rank is an expression of the group's size ``n``).

    Counts of equal values are kept instead of rows, cumulated over ranges of values: first whole ranges by their totals,
    then inside the few ranges that hold a rank. So a group is spread over tasks however large it is.
    """
    counts = e.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("c"))
    ranges = counts.withColumn("_range", F.floor(F.signum(value) * F.log2(F.abs(F.col(value)) + 1) * 32))  # some two thousand of them, in order
    totals = ranges.groupBy(by, "_range").agg(F.sum("c").alias("total"))
    before = F.sum("total").over(W.partitionBy(by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    totals = totals.select(by, "_range", "total", F.coalesce(before, F.lit(0)).alias("before"), F.sum("total").over(W.partitionBy(by)).alias("n"))
    wanted = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.least(F.floor(r), F.col("n") - 1).alias("rank")) for k, r in ranks.items()]))
    held = totals.select(by, "_range", "before", "total", wanted.alias("w")).where((F.col("w.rank") >= F.col("before")) & (F.col("w.rank") < F.col("before") + F.col("total")))
    inside = ranges.join(held, [by, "_range"]).withColumn("upto", F.col("before") + F.sum("c").over(W.partitionBy(by, "_range", "w.name").orderBy(value)))
    at = inside.where(F.col("upto") > F.col("w.rank")).groupBy(by, "w.name").agg(F.min(value).alias("v"))
    return at.groupBy(by).agg(*[F.max(F.when(F.col("name") == k, F.col("v"))).alias(k) for k in ranks])


def percentiles(e: DataFrame) -> DataFrame:
    """Per detector the values at the middle, 95 and 99 hundredths of the sorted order (rank from 0: n * p / 100)."""
    return ranked_values(e, {f"p{p}": F.col("n") * p / 100 for p in (50, 95, 99)})


def rounded_percentiles(e: DataFrame) -> DataFrame:
    """Per detector the values at ranks round((n - 1) * p), halves up."""
    return ranked_values(e, {f"p{p}": (F.col("n") - 1) * p / 100 + 0.5 for p in (50, 95, 99)})


def throughput(e: DataFrame, cost_per_second: float = 0.0) -> DataFrame:
    """Events a second of each detector (null for events of one second), and what ten thousand events cost."""
    span = F.max("t") - F.min("t")
    rate = F.try_divide(F.count("*"), span)
    return e.groupBy("detector").agg(
        F.count("*").alias("events"), span.alias("seconds"), F.round(rate, 8).alias("per_second"), F.round(F.try_divide(F.lit(10_000 * cost_per_second), rate), 6).alias("cost_10k")
    )


def with_truth(logs: DataFrame, windows: DataFrame) -> DataFrame:
    """Logs (event_id, t, service, own_id, flagged_truth) with their truth: their own id, else, if flagged, the first window that holds them.

    Windows (seq, anomaly_id, start, end, services) with services hold only theirs; without any they hold all.
    """
    asked = logs.where("flagged_truth AND own_id IS NULL").select("event_id", "t", "service")
    met = within(asked, windows.select("seq", "anomaly_id", "start", "end", "services"))
    met = met.where((F.size("services") == 0) | F.array_contains("services", F.col("service")))
    first = met.groupBy("event_id").agg(F.min_by("anomaly_id", "seq").alias("_window"))
    return logs.join(first, "event_id", "left").withColumn("truth_id", F.coalesce("own_id", "_window")).drop("_window")


def truth_diagnostics(logs: DataFrame, windows: DataFrame) -> DataFrame:
    """One row: flagged logs, those with an id, detected ones with an id, ids expected and ids seen."""
    seen = logs.agg(
        F.count_if("flagged_truth").alias("flagged"), F.count_if(F.col("truth_id").isNotNull()).alias("with_id"),
        F.count_if(F.col("truth_id").isNotNull() & F.col("detected")).alias("detected_with_id"), F.countDistinct("truth_id").alias("ids_seen"),
    )
    return seen.join(windows.agg(F.countDistinct("anomaly_id").alias("ids_expected")))


def breakdown(logs: DataFrame, windows: DataFrame) -> DataFrame:
    """Each anomaly with its events, those detected and missed, and the recall; anomalies without events have zeros."""
    c = logs.where("truth_id IS NOT NULL").groupBy(F.col("truth_id").alias("anomaly_id")).agg(F.count("*").alias("events"), F.count_if("detected").alias("found"))
    n = lambda x: F.coalesce(F.col(x), F.lit(0).cast("long"))
    j = windows.select("anomaly_id").distinct().join(c, "anomaly_id", "left").select("anomaly_id", n("events").alias("events"), n("found").alias("found"))
    return j.select("anomaly_id", "events", "found", (F.col("events") - F.col("found")).alias("missed"), F.coalesce(F.try_divide("found", "events"), F.lit(0.0)).alias("recall"))


def by_score(signals: DataFrame, truth: str = "truth") -> DataFrame:
    """Per detector of the detector_scores array: confusion of its firing with the truth, how often it fired, its mean score where it did."""
    each = signals.select(truth, F.posexplode("detector_scores").alias("detector", "d"))
    hit, t = F.col("d.fired"), F.col(truth)
    # Scores are whole hundredths here, so the mean comes from an exact sum.
    c = each.groupBy("detector").agg(
        F.count_if(t & hit).alias("tp"), F.count_if(~t & hit).alias("fp"), F.count_if(t & ~hit).alias("fn"), F.count_if(~t & ~hit).alias("tn"), F.count_if(hit).alias("triggers"),
        F.sum(F.when(hit, F.round(F.col("d.score") * 100).cast("long"))).alias("s"),
    )
    return c.select("detector", "tp", "fp", "fn", "tn", "triggers", F.coalesce(F.try_divide(F.col("s") / 100, F.col("triggers")), F.lit(0.0)).alias("mean_score"))


def windowed(truths: DataFrame, detections: DataFrame, now: int, seconds_: int = 60, scenario: str = "unknown") -> DataFrame:
    """Precision, recall and F1 as whole percents of the truths (t, anomaly) in the last seconds; a detection within 2 s meets one.

    No row where no truth lies in the window.
    """
    w = truths.where(F.col("t") >= now - seconds_)
    near = detections.where((F.col("t") >= now - seconds_) & F.col("anomaly")).select(F.explode(F.sequence(F.col("t") - 1, F.col("t") + 1)).alias("t")).distinct().withColumn("met", F.lit(True))
    j = w.join(near, "t", "left").withColumn("met", F.coalesce("met", F.lit(False)))
    a, m = F.col("anomaly"), F.col("met")
    c = j.agg(F.count("*").alias("n"), F.count_if(a & m).alias("tp"), F.count_if(~a & m).alias("fp"), F.count_if(a & ~m).alias("fn")).where("n > 0")
    ratio = lambda x, y: F.coalesce(F.try_divide(x, y), F.lit(0.0))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    pct = lambda x: F.floor(x * 100 + 0.5).cast("int")
    return c.select(F.lit(now).cast("long").alias("at"), pct(p).alias("precision"), pct(r).alias("recall"), pct(ratio(2 * p * r, p + r)).alias("f1"), F.lit(scenario).alias("scenario"))


def truth_seconds(windows: DataFrame, detections: DataFrame, start: int, duration: int) -> DataFrame:
    """Each second of a run: whether a window holds it and whether an incident was last seen in it."""
    s = windows.sparkSession.range(start, start + duration).withColumnRenamed("id", "t")
    true = windows.select(F.explode(F.sequence("start", "end")).alias("t")).distinct().withColumn("truth", F.lit(True))
    seen = detections.select("t").distinct().withColumn("detected", F.lit(True))
    out = s.join(true, "t", "left").join(seen, "t", "left")
    return out.select("t", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("truth", "detected")])


def run_summary(signals: DataFrame) -> DataFrame:
    """One row: events, seconds, events a second, anomalies, keys, and events of truth."""
    span = F.max("t") - F.min("t")
    return signals.agg(
        F.count("*").alias("events"), span.alias("seconds"), F.try_divide(F.count("*"), span).alias("per_second"), F.count_if("flagged").alias("anomalies"),
        F.countDistinct("entity").alias("profiles"), F.count_if("truth").alias("truth_events"),
    )


def counters(outcomes: DataFrame, name: str = "outcome") -> DataFrame:
    """How often each outcome (queued, processed, dropped, ...) occurred."""
    return outcomes.groupBy(name).agg(F.count("*").alias("n"))


def diversity(e: DataFrame, column: str = "detector") -> DataFrame:
    """Distinct values of a column per entity, exactly and by a sketch that merges."""
    return e.groupBy("entity").agg(F.countDistinct(column).alias("exact"), F.hll_sketch_estimate(F.hll_sketch_agg(column)).alias("sketched"))


def frequencies(e: DataFrame, column: str = "trace_id") -> DataFrame:
    """How often each entity has each value of a column."""
    return e.where(F.col(column).isNotNull()).groupBy("entity", column).agg(F.count("*").alias("n"))


def count_min(e: DataFrame, column: str = "trace_id", rows: int = 4, width: int = 2048) -> DataFrame:
    """A count-min table of (entity, column) pairs: row, cell and count. Tables of several inputs add up."""
    cells = F.array(*[F.struct(F.lit(i).alias("row"), F.pmod(F.xxhash64(F.lit(i), "entity", column), F.lit(width)).alias("cell")) for i in range(rows)])
    return e.where(F.col(column).isNotNull()).select(F.explode(cells).alias("c")).groupBy("c.row", "c.cell").agg(F.count("*").alias("n"))


def estimated(pairs: DataFrame, table: DataFrame, column: str = "trace_id", rows: int = 4, width: int = 2048) -> DataFrame:
    """The smallest count of each pair's cells: never below the true one, 0 for pairs that are surely absent."""
    cells = F.array(*[F.struct(F.lit(i).alias("row"), F.pmod(F.xxhash64(F.lit(i), "entity", column), F.lit(width)).alias("cell")) for i in range(rows)])
    each = pairs.select("entity", column, F.explode(cells).alias("c")).select("entity", column, "c.row", "c.cell")
    met = each.join(F.broadcast(table), ["row", "cell"], "left")  # rows x width cells
    return met.groupBy("entity", column).agg(F.min(F.coalesce("n", F.lit(0).cast("long"))).alias("estimate"))


def report(confusion_: DataFrame) -> DataFrame:
    """A confusion by detector as rows of metric and value, for a CSV file."""
    names = ("tp", "fp", "fn", "tn")
    return confusion_.select("detector", F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])))
