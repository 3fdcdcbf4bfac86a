"""Micro-batches of wire signals into cases, so that a batch that runs twice changes nothing.

A batch of a stream is worked on in this order: what it will use (policy version, time) is noted; signals are read once,
judged, and written; decisions, incidents and feedback are derived from what was written; at last the batch's ledger row is
written. Every table is a folder with a part for each batch, and a batch writes its own part anew, so a replay after a
crash ends in the same tables. Readers see the parts of ledgered batches only. An incident is what the last batch says.

Policies are a registry with versions (``operators.policy``); a publish adds a snapshot of it, and each batch reads the newest.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import canonical as can
from ..operators import casework as case
from ..operators import policy as pol
from ..sources.wire import REQUIRED, SIGNAL

#: Fixed value: seconds within which a batch of the same signals is a duplicate.
DUPLICATE = 900
_RULES = (
    "created long, rules array<struct<rule:int,pattern_id:string,action:string,entities:array<bigint>,min_confidence:double,"
    "score_scale:double,confidence_scale:double,ttl:bigint>>"
)


def signal_stream(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    """Wire signals of a folder of JSON lines as a stream; a line that is no signal comes with its text in ``corrupt``."""
    schema = f"{', '.join(_columns())}, corrupt string"
    read = spark.readStream.schema(schema).option("columnNameOfCorruptRecord", "corrupt").option("maxFilesPerTrigger", files)
    return read.json(path)


def _columns() -> list[str]:
    """The wire signal's fields as DDL; those in brackets hold commas of their own."""
    inner, out, depth = SIGNAL.removeprefix("struct<").removesuffix(">"), [""], 0
    for ch in inner:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append("")
        else:
            out[-1] += ch
    return [x.replace(":", " ", 1) for x in out]


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


# Policies


def publish(registry: DataFrame, folder: str) -> int:
    """Add a snapshot of the registry (version, status, document, ...); batches that begin from now on use it. Its number."""
    spark = registry.sparkSession
    number = latest_snapshot(spark, folder) + 1
    registry.write.mode("overwrite").parquet(f"{folder}/registry/{number:010d}")
    return number


def latest_snapshot(spark: SparkSession, folder: str) -> int:
    """Number of the newest complete snapshot, 0 without any."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(f"{folder}/registry")
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return 0
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    return max([int(n) for n in names if _exists(spark, f"{folder}/registry/{n}/_SUCCESS")], default=0)


def registry_at(spark: SparkSession, folder: str, number: int) -> DataFrame:
    return spark.read.parquet(f"{folder}/registry/{number:010d}")


def rules_at(spark: SparkSession, folder: str, number: int) -> tuple[str, DataFrame | None]:
    """Name and rules of the policy that a snapshot has active; none before the first publish."""
    if not number:
        return "none", None
    active = pol.current(registry_at(spark, folder, number))
    row = active.select("version").first()
    if row is None:
        return "none", None
    doc = active.select(F.from_json("document", _RULES).alias("d")).select("d.created", F.inline("d.rules"))
    return row.version, doc.withColumn("detector", F.lit(None).cast("int"))


# Batches


def of_batch(spark: SparkSession, folder: str, table: str, batch: int) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}/batch={batch}")


def _put(df: DataFrame, folder: str, table: str, batch: int) -> DataFrame:
    df.write.mode("overwrite").parquet(f"{folder}/{table}/batch={batch}")
    return of_batch(df.sparkSession, folder, table, batch)


def ledger(spark: SparkSession, folder: str) -> DataFrame | None:
    """A row a finished batch: what became of it, its policy, counts, and the latest time seen; None before the first."""
    return spark.read.parquet(f"{folder}/ledger") if _exists(spark, f"{folder}/ledger") else None


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A table's rows of finished batches."""
    done = ledger(spark, folder).where("outcome = 'processed'").select("batch")
    return spark.read.option("basePath", f"{folder}/{table}").parquet(f"{folder}/{table}").join(F.broadcast(done), "batch", "left_semi")


def incidents(spark: SparkSession, folder: str) -> DataFrame:
    """Each incident as the last batch that met it has it."""
    rows = read(spark, folder, "incidents")
    newest = W.partitionBy("incident_id").orderBy(F.desc("batch"))
    return rows.withColumn("_r", F.row_number().over(newest)).where("_r = 1").drop("_r")


class Batches:
    """For ``foreachBatch``: wire signals (see ``signal_stream``) of a stream into the tables of a folder.

    Tables: ``signals`` (canonical, with the policy's effect), ``dead_letters``, ``late_events`` (older than the latest time of
    earlier batches by more than ``late`` seconds), ``decisions``, ``incidents``, ``feedback``. A batch whose signals are those
    of a batch of the last 900 seconds is a duplicate and leaves a ledger row only.
    """

    def __init__(self, folder: str, late: int = 3600, clock: Callable[[], float] = time.time):
        self.folder, self.late, self.clock = folder, late, clock

    def _begun(self, spark: SparkSession, batch: int) -> tuple[int, int]:
        """Time and policy snapshot of a batch, noted when it first begins and kept for replays."""
        path = f"{self.folder}/begun/batch={batch}"
        if not _exists(spark, f"{path}/_SUCCESS"):
            row = [(int(self.clock()), latest_snapshot(spark, self.folder))]
            spark.createDataFrame(row, "now long, snapshot int").coalesce(1).write.mode("overwrite").parquet(path)
        row = spark.read.parquet(path).first()
        return row.now, row.snapshot

    def __call__(self, batch_df: DataFrame, batch: int) -> None:
        spark, folder = batch_df.sparkSession, self.folder
        done = ledger(spark, folder)
        if done is not None and not done.where(F.col("batch") == batch).isEmpty():
            return
        now, snapshot = self._begun(spark, batch)
        earlier = done.where(F.col("batch") < batch) if done is not None else None
        raw = batch_df if "corrupt" in batch_df.columns else batch_df.withColumn("corrupt", F.lit(None).cast("string"))
        lacks = F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in REQUIRED]), lambda c: c.isNotNull())
        reason = F.when(F.col("corrupt").isNotNull(), "no_signal").when(F.size(lacks) > 0, F.concat(F.lit("missing:"), F.array_join(lacks, ",")))
        raw = _put(raw.withColumn("reason", reason), folder, "raw", batch)
        good = can.canonical(raw.where("reason IS NULL"), now)
        # A batch is known by sums over its signals, in whatever order they come.
        ids = F.concat_ws(":", "event_id", F.col("t").cast("string"))
        sums = [F.sum(F.xxhash64(F.lit(i), ids).cast("decimal(38,0)")) for i in (0, 1)]
        key = good.agg(F.md5(F.concat_ws(":", F.count("*"), *sums).cast("binary")).alias("k")).first().k
        if earlier is not None and not earlier.where((F.col("key") == key) & (F.col("signals") > 0) & (F.col("now") > now - DUPLICATE)).isEmpty():
            self._finish(spark, batch, "duplicate", now, key, "none", {}, None)
            return
        letters = raw.where("reason IS NOT NULL").select("event_id", "reason", F.coalesce("corrupt", F.to_json(F.struct(*REQUIRED))).alias("payload"))
        _put(letters, folder, "dead_letters", batch)
        seen = earlier.agg(F.max("latest").alias("m")).first().m if earlier is not None else None
        is_late = F.lit(False) if seen is None else F.col("t") < seen - self.late
        name, rules = rules_at(spark, folder, snapshot)
        judged = self._with_policy(good.withColumn("late", is_late), rules)
        # The counters come with the write; no job of their own.
        counted = Observation(f"batch-{batch}")
        signals = judged.observe(
            counted, F.count_if(~F.col("late")).alias("signals"), F.count_if("late").alias("late"), F.count_if("suppressed").alias("suppressed"),
            F.count_if(F.col("score") >= case.HIGH).alias("high"), F.max("t").alias("latest"),
        )
        signals = _put(signals, folder, "signals", batch)
        _put(signals.where("late").drop("late", "suppressed"), folder, "late_events", batch)
        live = signals.where("NOT late AND NOT suppressed")
        decisions = _put(case.decided(case.derived(live, live), name), folder, "decisions", batch)
        _put(case.incidents(decisions), folder, "incidents", batch)
        _put(case.feedback(decisions, now), folder, "feedback", batch)
        found = counted.get
        latest = found["latest"] if seen is None else max(seen, found["latest"] or seen)
        self._finish(spark, batch, "processed", now, key, name, found, latest)

    def _with_policy(self, signals: DataFrame, rules: DataFrame | None) -> DataFrame:
        if rules is None:
            return signals.withColumn("suppressed", F.lit(False))
        known = signals.withColumn("entity", F.col("entity_hash").try_cast("bigint"))
        effect = pol.effects(known, rules)
        scaled = lambda x, by: F.least(F.greatest(F.col(x) * F.coalesce(F.col(by), F.lit(1.0)), F.lit(0.0)), F.lit(1.0))
        j = signals.join(effect, "event_id", "left")
        return j.select(
            *[scaled(c, f"{c}_scale").alias(c) if c in ("score", "confidence") else F.col(c) for c in signals.columns],
            F.coalesce("suppress", F.lit(False)).alias("suppressed"),
        )

    def _finish(self, spark: SparkSession, batch: int, outcome: str, now: int, key: str, policy: str, found: dict, latest: int | None) -> None:
        counts = [found.get(k) or 0 for k in ("signals", "late", "suppressed", "high")]
        row = spark.createDataFrame(
            [(outcome, now, key, policy, *counts, latest)], "outcome string, now long, key string, policy string, signals long, late long, suppressed long, high long, latest long"
        )
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/ledger/batch={batch}")
