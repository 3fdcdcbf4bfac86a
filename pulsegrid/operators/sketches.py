"""Distinct and count sketches as tables: partial sketches meet by maxima and sums, and equal those of ``plans.sketches``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _hash(value: Column) -> Column:
    """The 16 hexadecimal digits of a value's 64-bit hash, the highest first (``plans.sketches.hashed``)."""
    digest = F.md5(F.coalesce(value.cast("string"), F.lit("")).cast("binary"))
    return F.concat(*[F.substring(digest, i, 2) for i in range(15, 0, -2)])


def _number(digits: Column) -> Column:
    return F.conv(digits, 16, 10).cast("decimal(20,0)")


def registers(rows: DataFrame, key: str, value: str, p: int = 12) -> DataFrame:
    """key, register and its largest rank: a sketch of a key has 2^p rows at most, however many values there are."""
    if not 4 <= p <= 16:
        raise ValueError("p must be from 4 to 16")
    bits = F.lpad(F.conv(F.substring(_hash(F.col(value)), 1, 4), 16, 2), 16, "0")
    bits = F.concat(bits, *[F.lpad(F.conv(F.substring(_hash(F.col(value)), i, 4), 16, 2), 16, "0") for i in (5, 9, 13)])
    first = F.locate("1", F.substring(bits, p + 1, 64 - p))
    rank = F.when(first > 0, first).otherwise(65 - p)
    found = rows.select(F.col(key), F.conv(F.substring(bits, 1, p), 2, 10).cast("int").alias("register"), rank.alias("rank"))
    return found.groupBy(key, "register").agg(F.max("rank").alias("rank"))


def merged(one: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """The sketches of both inputs together."""
    return one.unionByName(other).groupBy(key, "register").agg(F.max("rank").alias("rank"))


def estimates(sketches: DataFrame, key: str, p: int = 12) -> DataFrame:
    """key and the estimated number of its distinct values; few of them are counted by the registers left empty."""
    m = 1 << p
    bias = {16: 0.673, 32: 0.697, 64: 0.709}.get(m, 0.7213 / (1 + 1.079 / m))
    n = sketches.groupBy(key).agg(F.count("*").alias("used"), F.sum(F.pow(F.lit(2.0), -F.col("rank"))).alias("s"))
    empty = F.lit(m) - F.col("used")
    raw = bias * m * m / (F.col("s") + empty)
    return n.select(key, F.when((raw <= 2.5 * m) & (empty > 0), m * F.log(m / empty)).otherwise(raw).alias("distinct"))
