"""Lookups in one domain: points, batches, ordinals, ranges and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def get(domain: DataFrame, key: bytes) -> bytes | None:
    """The value of ``key``: none if absent, ``b''`` if empty.  The predicate reaches the Parquet scan."""
    row = domain.where(F.col("key") == F.lit(key)).select("value").first()
    return None if row is None else bytes(row.value)


def get_many(probes: DataFrame, domain: DataFrame) -> DataFrame:
    """The probes with ``value``: null where absent, empty where empty; null keys find nothing."""
    return probes.join(domain.select("key", "value"), "key", "left")


def nth_key(ordered: DataFrame, i: int) -> DataFrame:
    """The row with ordinal ``i``; none beyond the end."""
    return ordered.where(F.col("ordinal") == i)


def key_range(domain: DataFrame, low: bytes | None = None, high: bytes | None = None) -> DataFrame:
    """Keys from ``low`` up to but not including ``high``, in unsigned byte order."""
    out = domain
    if low is not None:
        out = out.where(F.col("key") >= F.lit(low))
    if high is not None:
        out = out.where(F.col("key") < F.lit(high))
    return out


def prefix_scan(domain: DataFrame, prefix: bytes) -> DataFrame:
    """Keys that begin with ``prefix``, as a range, so that row groups are pruned."""
    trimmed = prefix.rstrip(b"\xff")
    high = trimmed[:-1] + bytes([trimmed[-1] + 1]) if trimmed else None
    return key_range(domain, prefix, high)


def first_rows(domain: DataFrame, n: int) -> DataFrame:
    """The first ``n`` pairs in key order: a top-n, not a sort of everything."""
    return domain.orderBy("key").limit(n)


def stride_sample(ordered: DataFrame, step: int, most: int) -> DataFrame:
    """Every ``step``-th pair, ``most`` of them."""
    return ordered.where((F.col("ordinal") % step == 0) & (F.col("ordinal") < step * most))


def existing(probes: DataFrame, domain: DataFrame) -> DataFrame:
    return probes.join(domain.select("key"), "key", "left_semi")


def missing(probes: DataFrame, domain: DataFrame) -> DataFrame:
    """Probes without an entry; null keys are among them."""
    return probes.join(domain.select("key"), "key", "left_anti")


def override(older: DataFrame, newer: DataFrame) -> DataFrame:
    """The newer pair of each key, else the older.  An empty newer value overrides."""
    return older.join(newer.select("key"), "key", "left_anti").unionByName(newer)


def shared_keys(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("key").intersect(b.select("key"))


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either that the other lacks, repeats counted, with ``side``; empty when both are equal."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def lockstep_difference(a: DataFrame, b: DataFrame, pos: str = "pos", word: str = "word") -> DataFrame:
    """Positions at which two streams differ, one of them ending among them."""
    there = lambda df, name: df.select(pos, F.col(word).alias(name))
    return there(a, "left_word").join(there(b, "right_word"), pos, "full").where(~F.col("left_word").eqNullSafe(F.col("right_word")))
