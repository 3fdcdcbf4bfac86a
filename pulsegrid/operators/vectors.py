"""The vector side: hash and sparse vectors, the day-partitioned index, clusters, triage and re-ranking by exact cosine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scoring import plain_text

#: Width of dense vectors and buckets of sparse ones.
WIDTH, BUCKETS = 64, 16384


def hash_vector(text: Column) -> Column:
    """64 bits of a hash of the text as 0.0 and 1.0: bytes from low to high, bits of a byte from high to low."""
    h = F.conv(F.substring(F.md5(text.cast("binary")), 1, 16), 16, 2)
    bits = F.lpad(h, 64, "0")  # the highest bit first
    places = F.array(*[F.lit(57 - 8 * (i // 8) + i % 8) for i in range(WIDTH)])
    # As an array's only element the bits are a value in the inner function, which else works the text's hash out for each bit.
    return F.flatten(F.transform(F.array(bits), lambda b: F.transform(places, lambda i: F.substring(b, i, F.lit(1)).cast("float"))))


def resized(vector: Column, width: int = WIDTH) -> Column:
    """A vector cut or filled with zeros to a width."""
    return F.slice(F.concat(vector, F.array_repeat(F.lit(0.0).cast("float"), width)), 1, width)


def sparse_terms(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Key, bucket and weight of each text's words: 1 + share of the text's words, summed where words share a bucket."""
    # Whole texts travel once, by key; words are then counted where they are.
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words = texts.select(key, text).repartition(n, key).select(key, F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+").alias("w"))
    counts = words.select(key, F.size("w").alias("n"), F.explode("w").alias("word")).groupBy(key, "n", "word").agg(F.count("*").alias("c"))
    bucket = F.conv(F.substring(F.md5(F.col("word").cast("binary")), 1, 8), 16, 10).cast("long") % BUCKETS
    return counts.groupBy(key, bucket.alias("bucket")).agg(F.sum("c").alias("c"), F.count("*").alias("words"), F.max("n").alias("n")).select(
        key, "bucket", (F.col("words") + F.col("c") / F.col("n")).alias("weight")
    )


def embedded(texts: DataFrame, vectors: DataFrame, text: str = "text") -> DataFrame:
    """``texts`` with the vector of their normalised text (table: text, vector), or the hash vector where it has none."""
    known = vectors.select(plain_text(F.col("text")).alias("_plain"), resized(F.col("vector")).alias("_known")).dropDuplicates(["_plain"])
    plain = texts.withColumn("_plain", plain_text(F.col(text)))
    return plain.join(known, "_plain", "left").withColumn("dense", F.coalesce("_known", hash_vector(F.col("_plain")))).drop("_known", "_plain")


def indexed(rows: DataFrame, vectors: DataFrame) -> DataFrame:
    """Canonical rows as points of the index: a real vector only where it is worth one, else the context's hash vector."""
    sure = (F.col("confidence") >= 0.9) | (F.col("severity") >= 0.85)
    found = embedded(rows, vectors, "context")
    return found.withColumn("dense", F.when(sure, F.col("dense")).otherwise(hash_vector(plain_text(F.col("context")))))


def write_index(points: DataFrame, path: str) -> None:
    """Points by day, each file in the order of group and time, so that filters skip files and row groups."""
    points.repartitionByRange("day", "group_key").sortWithinPartitions("group_key", "t").write.mode("append").partitionBy("day").parquet(path)


def in_window(points: DataFrame, first: int, last: int, text: str | None = None) -> DataFrame:
    """Points of a time range whose context holds every word of a text; the days prune partitions."""
    day = lambda t: F.date_format(F.timestamp_seconds(F.lit(t)), "yyyy_MM_dd")
    out = points.where(F.col("day").between(day(first), day(last)) & F.col("t").between(first, last))
    words = F.split(F.lower("context"), r"\W+")
    for w in (text or "").lower().split():
        out = out.where(F.array_contains(words, w))
    return out


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, in doubles; 0 where one is nothing."""
    total = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(total(a, a)) * F.sqrt(total(b, b))
    return F.coalesce(F.try_divide(total(a, b), norm), F.lit(0.0))


def clusters(points: DataFrame, per_group: int = 3, per_day: int = 100, most: int = 200, score: str | None = None, least: float = 0.15) -> DataFrame:
    """One hit for each group key, of the earliest day that has it, with how many hits the group had there.

    Per day the groups that come first; by time and id, or by a score column of at least ``least`` (a text query).
    """
    first = [F.desc(score), "event_id"] if score else ["t", "event_id"]
    if score:
        points = points.where(F.col(score) >= least)
    hits = points.withColumn("_rank", F.row_number().over(W.partitionBy("day", "group_key").orderBy(*first))).where(F.col("_rank") <= per_group)
    many = hits.groupBy("day", "group_key").agg(F.count("*").alias("count"))
    top = hits.where("_rank = 1").join(many, ["day", "group_key"])
    top = top.withColumn("_place", F.row_number().over(W.partitionBy("day").orderBy(*first))).where(F.col("_place") <= per_day)
    top = top.withColumn("_day", F.row_number().over(W.partitionBy("group_key").orderBy("day"))).where("_day = 1")
    return top.orderBy("day", *first).limit(most).drop("_rank", "_place", "_day")


def firsts(points: DataFrame, most: int = 200) -> DataFrame:
    """Where grouping is unavailable: the first point of each key (group, else rhythm, entity, entity id, own id)."""
    key = F.coalesce("group_key", "rhythm", "entity_hash", "entity_id", "event_id")
    ranked = points.withColumn("key", key).withColumn("_r", F.row_number().over(W.partitionBy("key").orderBy("t", "event_id")))
    return ranked.where("_r = 1").drop("_r").orderBy("t", "event_id").limit(most)


def mean_vector(points: DataFrame, vector: str = "dense") -> DataFrame:
    """One row with the mean of vectors of one width (column m); empty vectors and an empty table give an empty one."""
    each = points.select(F.posexplode(vector).alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return each.agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("m")).select(F.col("m.x").alias("m"))


def triaged(points: DataFrame, positive: DataFrame, negative: DataFrame, least: float = 0.1, per_group: int = 3, most: int = 50) -> DataFrame:
    """The points most like the positive examples and unlike the negative ones: cosine with 2 avg(positive) - avg(negative).

    At most ``per_group`` of a group; examples take no part. The examples' means are one row each, so they are broadcast.
    """
    p, n = mean_vector(positive).withColumnRenamed("m", "p"), mean_vector(negative).withColumnRenamed("m", "n")
    target = p.join(n).select(F.when(F.size("n") > 0, F.zip_with("p", "n", lambda a, b: 2 * a - b)).otherwise(F.col("p")).alias("target"))
    ids = positive.select("event_id").unionByName(negative.select("event_id")).distinct()
    rest = points.join(ids, "event_id", "left_anti").withColumn("_one", F.lit(1)).join(F.broadcast(target.withColumn("_one", F.lit(1))), "_one")
    scored = rest.withColumn("score", cosine(F.col("dense"), F.col("target"))).where(F.col("score") >= least)
    ranked = scored.withColumn("_r", F.row_number().over(W.partitionBy("group_key").orderBy(F.desc("score"), "event_id"))).where(F.col("_r") <= per_group)
    return ranked.orderBy(F.desc("score"), "event_id").limit(most).drop("_r", "_one", "target")


def refined(hits: DataFrame, most: int = 100, pairs: int = 8) -> DataFrame:
    """Hits ranked again by pairs of sure and doubtful ones among them: sum of min(0, cosine with sure - cosine with doubtful).

    Only with four hits and two pairs at least; else the first hits stay as they are. Hits are a query's few hundred.
    """
    good = (F.col("confidence") >= 0.85) | (F.col("severity") >= 0.8) | (F.col("score") >= 0.9)
    bad = (F.col("confidence") <= 0.4) & (F.col("severity") <= 0.5) & (F.col("score") <= 0.7)
    first = lambda cond, name: hits.where(cond).orderBy("t", "event_id").limit(pairs).agg(F.array_sort(F.collect_list(F.struct("t", "event_id", "dense"))).alias(name))
    sides = first(good, "g").join(first(bad, "b"))
    n = F.least(F.size("g"), F.size("b"))
    all_ = hits.agg(F.count("*").alias("hits"))
    context = sides.join(all_).select(F.when((F.col("hits") >= 4) & (n >= 2), F.arrays_zip(F.slice("g", 1, n).alias("g"), F.slice("b", 1, n).alias("b"))).otherwise(F.array()).alias("context"))
    one = lambda df: df.withColumn("_one", F.lit(1))
    scored = one(hits).join(F.broadcast(one(context)), "_one").withColumn(
        "context_score", F.aggregate("context", F.lit(0.0), lambda s, p: s + F.least(F.lit(0.0), cosine(F.col("dense"), p["g"]["dense"]) - cosine(F.col("dense"), p["b"]["dense"])))
    )
    return scored.orderBy(F.desc("context_score"), "t", "event_id").limit(most).drop("_one", "context")
