"""Scalar functions on scores, times and keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Least score of each severity level, highest first.
SEVERITY_CUTS = ((0.9, 4), (0.75, 3), (0.6, 2), (0.4, 1))


def severity_level(score: Column) -> Column:
    """Severity 0 to 4 of a score."""
    return reduce(lambda rest, cut: F.when(score >= cut[0], cut[1]).otherwise(rest), reversed(SEVERITY_CUTS), F.lit(0))


def excess_score(value: Column, threshold: Column) -> Column:
    """0 up to the threshold (or where it is not above 0), then half the relative excess, 1 at most."""
    return F.when((value <= threshold) | (threshold <= 0), 0.0).otherwise(F.least(F.try_divide(value, threshold) - 1, F.lit(2.0)) / 2)


def unix_seconds(t: Column, now: Column) -> Column:
    """Seconds of a time in ns, ms or s, told apart by size; null and non-positive times are ``now``."""
    return (
        F.when(t.isNull() | (t <= 0), now)
        .when((t > F.lit(10**15)) | ((t > F.lit(10**10)) & (t <= F.lit(10**12))), F.floor(t / 1e9))
        .when(t > F.lit(10**12), F.floor(t / 1000))
        .otherwise(t)
        .cast("long")
    )


def severity_share(severity: Column) -> Column:
    """Severity in [0, 1]: levels above 1 are quarters; null, NaN and non-positive ones are 0."""
    return F.when(severity.isNull() | F.isnan(severity) | (severity <= 0), 0.0).when(severity <= 1, severity).otherwise(F.least(severity / 4, F.lit(1.0)))


def log_bin(value: Column, bins: int, low: float, high: float) -> Column:
    """Bin of a value on a logarithmic scale from low to high, clamped."""
    place = F.floor(F.log(value / low) / F.log(F.lit(high) / low) * bins)
    return F.when(value <= low, 0).when(value >= high, bins - 1).otherwise(F.least(place, F.lit(bins - 1))).cast("long")


def uncertainty(value: Column, mean: Column, std: Column, share: Column) -> Column:
    """Mean of a step of the distance in deviations (1, 2 and 3 of them) and of share / (share + 1); 0 without spread."""
    z = F.abs(value - mean) / std
    step = F.when(z > 3, 0.8).when(z > 2, 0.5).when(z > 1, 0.2).otherwise(0.0)
    return F.when(std < 1e-9, 0.0).otherwise((step + share / (share + 1)) / 2)


def keep_score(events: Column, priority: Column, age: Column) -> Column:
    """How much a profile is worth keeping: many events, high priority, seen lately."""
    return F.log(events) * (1 + 0.5 * priority) / (age + 1)


def plain_text(text: Column) -> Column:
    """Lower case, blanks collapsed and trimmed."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def incident_id(reason: Column, key: Column, bucket: Column) -> Column:
    return F.concat(F.lit("inc_"), F.substring(F.sha2(F.concat_ws(":", reason, key, bucket.cast("string")), 256), 1, 16))


def scaled(value: Column, scale: int = 100) -> Column:
    """A value as a whole number of 1 / scale, so that sums are exact and do not depend on the order of rows."""
    return F.round(value * scale).cast("decimal(38,0)")
