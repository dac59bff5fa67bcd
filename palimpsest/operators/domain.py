"""Domains: validated, key-sorted writes, ordinals and offsets, and reports about them.

A domain on disk is a folder ``<base>.kv`` of Parquet files, each sorted and disjoint from
the others in keys; ``<base>.bt``, with what is in each file (``files``) and every M-th
key (``nodes``); and, with a salt, ``<base>.kvei`` (the words of an existence filter).
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions.steps import step_range
from palimpsest.operators import existence
from palimpsest.session import materialize, remove

DEFAULT_FANOUT = 256

#: Columns of a written domain's files: number of the file, place in it, bytes before it in it, whether its key rises.
NO, AT, UPTO, RISES = "__no", "__at", "__upto", "__rises"
#: Schemas of what a domain has on disk, so that reading one need not look into its files first.
_KV = f"key binary, value binary, {NO} int, {AT} long, {UPTO} long, {RISES} boolean"
_FILES = f"{NO} int, keys long, bytes long, empty_words long, first_key binary, last_key binary, fanout long, falls long, first_ordinal long, first_offset long"


class DomainError(ValueError):
    """Rows that are no domain: repeated, falling or null keys."""


@dataclass
class DomainPaths:
    kv: str
    bt: str
    kvei: str | None


def pairs(df: DataFrame) -> DataFrame:
    """``key, value`` as a domain has them: a null value in a written pair is the empty one."""
    return df.select(F.col("key").cast("binary").alias("key"), F.coalesce(F.col("value").cast("binary"), F.lit(b"")).alias("value"))


def _measured(key: str, value: str | None) -> Column:
    """at, upto, previous, rises: place in the partition, bytes before, the key before, and whether the key rises over it.

    Runs through the partition in its order; only keys and sizes leave the JVM.
    """
    size = F.coalesce(F.octet_length(key), F.lit(0)) + (F.coalesce(F.octet_length(value), F.lit(0)) if value else F.lit(0))

    @F.arrow_udf("struct<at:long,upto:long,previous:binary,rises:boolean>")
    def measure(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        rows = held = 0
        last: pa.Array = pa.nulls(1, pa.binary())
        for keys, sizes in batches:
            keys = keys.cast(pa.binary())
            upto = held + np.cumsum(sizes.to_numpy())
            before = pa.concat_arrays([last, keys[:-1]]) if len(keys) else keys
            rises = np.array(pc.fill_null(pc.greater(keys, before), False), bool)
            if len(keys) and not rows:
                rises[0] = keys[0].is_valid
            at = pa.array(np.arange(rows, rows + len(keys)))
            yield pa.StructArray.from_arrays([at, pa.array(upto - sizes.to_numpy()), before, pa.array(rises)], names=["at", "upto", "previous", "rises"])
            if len(keys):
                rows, held, last = rows + len(keys), int(upto[-1]), keys[-1:]

    return measure.asNondeterministic()(F.col(key), size.cast("long"))


def order_violations(df: DataFrame, pos: str = "pos", group: Sequence[str] = ()) -> DataFrame:
    """Rows whose key does not rise over the key before them, by ``pos``; within ``group`` where given.

    Without a group the input is one stream; it is compared partition by partition
    after one range exchange by position, and the seams between partitions separately.
    """
    if group:
        before = F.lag("key").over(Window.partitionBy(*group).orderBy(pos))
        return df.withColumn("previous", before).where("previous is not null and key <= previous")
    rows = df.repartitionByRange(pos).sortWithinPartitions(pos).withColumn("__m", _measured("key", None))
    rows = rows.select(*df.columns, F.col("__m.previous").alias("__previous"), F.col("__m.at").alias(AT), F.spark_partition_id().alias(NO))
    rows = materialize(rows, "ordered")
    # One row a partition.
    ends = rows.groupBy(NO).agg(F.max_by("key", AT).alias("last"))
    seams = ends.select(NO, F.lag("last").over(Window.orderBy(NO)).alias("before"))
    joined = rows.join(F.broadcast(seams), NO)
    previous = F.when(F.col(AT) == 0, F.col("before")).otherwise(F.col("__previous"))
    return joined.withColumn("previous", previous).where("previous is not null and key <= previous").select(*df.columns, "previous")


def repeated_keys(df: DataFrame) -> DataFrame:
    """``key, copies``: keys that occur more than once."""
    return df.groupBy("key").agg(F.count("*").alias("copies")).where("copies > 1")


def with_ordinals(df: DataFrame, with_offsets: bool = False) -> DataFrame:
    """Adds ``ordinal``, the place of each key in key order from 0, and with ``with_offsets`` ``logical_offset``.

    The logical offset is the bytes of all keys and values before the key.  Rows are
    range-partitioned and numbered within partitions; only the sums of partitions, a row
    each, are put in order.  Equal keys are numbered in an order of their
    own; a null key is the first and, like a null value, has no bytes.
    """
    value = "value" if "value" in df.columns else None
    rows = df.repartitionByRange("key").sortWithinPartitions("key", *([value] if value else [])).withColumn("__m", _measured("key", value))
    size = F.coalesce(F.octet_length("key"), F.lit(0)) + (F.coalesce(F.octet_length(value), F.lit(0)) if value else F.lit(0))
    rows = rows.select(*df.columns, F.spark_partition_id().alias(NO), F.col("__m.at").alias(AT), F.col("__m.upto").alias(UPTO), size.cast("long").alias("__size"))
    rows = materialize(rows, "ordinals")
    parts = _first_of(rows.groupBy(NO).agg(F.count("*").alias("keys"), F.sum("__size").alias("bytes")))
    # A row a partition of the range exchange.
    out = rows.join(F.broadcast(parts.select(NO, "first_ordinal", "first_offset")), NO).withColumn("ordinal", F.col("first_ordinal") + F.col(AT))
    if with_offsets:
        out = out.withColumn("logical_offset", F.col("first_offset") + F.col(UPTO))
    return out.drop(NO, AT, UPTO, "__size", "first_ordinal", "first_offset")


def _first_of(parts: DataFrame) -> DataFrame:
    """Adds what comes before each part: ``first_ordinal`` and ``first_offset``.  A row a file or partition, in one window."""
    before = Window.orderBy(NO).rowsBetween(Window.unboundedPreceding, -1)
    upto = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    return parts.select("*", upto("keys").alias("first_ordinal"), upto("bytes").alias("first_offset"))


def key_nodes(ordered: DataFrame, fanout: int = DEFAULT_FANOUT) -> DataFrame:
    """Every ``fanout``-th key of a table with ordinals."""
    return ordered.where(F.col("ordinal") % max(1, fanout) == 0)


def write_domain(df: DataFrame, base: str, salt: int | None = None, fanout: int = DEFAULT_FANOUT, compress: bool = False) -> DomainPaths:
    """Writes ``df`` (key, value in any order) as a domain; repeated or null keys raise DomainError.

    The data is written once, from the range exchange, so each file has a key range of
    its own with min/max statistics and a Parquet Bloom filter of its keys, and a point
    lookup opens one file.  The check compares neighbours on the way; a domain that
    fails it is removed.  ``compress``: by zstd instead of the session's codec.
    """
    spark = df.sparkSession
    out = DomainPaths(f"{base}.kv", f"{base}.bt", f"{base}.kvei" if salt is not None else None)
    rows = pairs(df).repartitionByRange("key").sortWithinPartitions("key").withColumn("__m", _measured("key", "value"))
    rows = rows.select("key", "value", F.spark_partition_id().alias(NO), F.col("__m.at").alias(AT), F.col("__m.upto").alias(UPTO), F.col("__m.rises").alias(RISES))
    writer = rows.write.option("parquet.bloom.filter.enabled#key", "true")
    (writer.option("compression", "zstd") if compress else writer).parquet(out.kv)
    stored = spark.read.schema(_KV).parquet(out.kv)
    empty = lambda c: F.count_if(F.octet_length(c) == 0)
    parts = stored.groupBy(NO).agg(
        F.count("*").alias("keys"), F.max(F.col(UPTO) + F.octet_length("key") + F.octet_length("value")).alias("bytes"), (empty("key") + empty("value")).alias("empty_words"),
        F.min("key").alias("first_key"), F.max("key").alias("last_key"), F.lit(max(1, fanout)).cast("long").alias("fanout"), F.count_if(~F.col(RISES)).alias("falls"),
    )
    _first_of(parts).coalesce(1).write.parquet(f"{out.bt}/files")
    told = file_parts(spark, base).agg(F.coalesce(F.sum("keys"), F.lit(0)).alias("keys"), F.coalesce(F.sum("falls"), F.lit(0)).alias("falls")).first()
    if told.falls:
        bad = stored.where(f"not {RISES}").select("key").first()
        for path in (out.kv, out.bt):
            remove(spark, path)
        raise DomainError(f"keys must be strictly increasing: {bad.key!r} is null or occurs again")
    key_nodes(read_domain(spark, base).select("ordinal", "logical_offset", "key"), fanout).write.parquet(f"{out.bt}/nodes")
    if salt is not None:
        existence.write_filter(stored.select("key"), salt, out.kvei, count=told.keys)
    return out


def file_parts(spark: SparkSession, base: str) -> DataFrame:
    """A row a file of a written domain: keys, bytes, empty words, key range, and what comes before it."""
    return spark.read.schema(_FILES).parquet(f"{base}.bt/files")


def read_pairs(spark: SparkSession, base: str) -> DataFrame:
    """``key, value`` alone: a predicate on key reaches the scan, and files of other key ranges are left out by their statistics."""
    return spark.read.schema(_KV).parquet(f"{base}.kv").select("key", "value")


def read_domain(spark: SparkSession, base: str) -> DataFrame:
    """``key, value, ordinal, logical_offset``; order by key where order matters."""
    kv = spark.read.schema(_KV).parquet(f"{base}.kv")
    # A row a file.
    first = F.broadcast(file_parts(spark, base).select(NO, "first_ordinal", "first_offset"))
    return kv.join(first, NO).select("key", "value", (F.col("first_ordinal") + F.col(AT)).alias("ordinal"), (F.col("first_offset") + F.col(UPTO)).alias("logical_offset"))


def pairs_at(spark: SparkSession, base: str, ordinals: Sequence[int]) -> DataFrame:
    """``key, value, ordinal`` at a few ordinals; only the row groups that hold them are read.  None beyond the end."""
    parts = file_parts(spark, base).select(NO, "keys", "first_ordinal").orderBy(NO).toArrow()
    first = parts.column("first_ordinal").to_numpy()
    upto = first + parts.column("keys").to_numpy()
    kv = spark.read.schema(_KV).parquet(f"{base}.kv")
    where, number = F.lit(False), F.lit(None).cast("long")
    for i in sorted({int(o) for o in ordinals}):
        part = int(np.searchsorted(upto, i, "right"))
        if 0 <= i and part < len(first):
            here = (F.col(NO) == parts.column(NO)[part].as_py()) & (F.col(AT) == int(i - first[part]))
            where, number = where | here, F.when(here, F.lit(i)).otherwise(number)
    return kv.where(where).select("key", "value", number.cast("long").alias("ordinal"))


def sampled_keys(spark: SparkSession, base: str, n: int) -> DataFrame:
    """``key`` of ``n`` evenly spaced ordinals, floor(i * count / n), of a written domain."""
    count = file_parts(spark, base).agg(F.coalesce(F.sum("keys"), F.lit(0))).first()[0]
    return pairs_at(spark, base, [i * count // min(n, count) for i in range(min(n, count))]).select("key")


def counts(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Words, empty words and keys, in all or for each of ``by``."""
    empty = lambda c: F.count_if(F.coalesce(F.octet_length(c), F.lit(0)) == 0)
    return df.groupBy(*by).agg((F.count("*") * 2).alias("words_count"), (empty("key") + empty("value")).alias("empty_words_count"), F.count("*").alias("key_count"))


def inspect(spark: SparkSession, base: str) -> DataFrame:
    """One row about a domain: name, step range, counts, bytes, fanout, filter.  Data files are not opened but for their sizes."""
    held = spark.read.schema(_KV).parquet(f"{base}.kv").select(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_size").alias("s")).distinct()
    size = held.agg(F.count("*").alias("files"), F.coalesce(F.sum("s"), F.lit(0)).alias("file_bytes")).first()
    parts = file_parts(spark, base)
    sums = parts.agg(F.coalesce(F.sum("keys"), F.lit(0)), F.coalesce(F.sum("empty_words"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0)), F.max("fanout")).first()
    name = base.rstrip("/").rpartition("/")[2] + ".kv"
    steps = step_range(name) or (None, None)
    meta = existence.filter_meta(spark, f"{base}.kvei") or {}
    row = (name, *steps, 2 * sums[0], sums[1], sums[0], sums[2], sums[3], meta.get("kind"), meta.get("kind") == "bloom", meta.get("salt"), size.files, size.file_bytes)
    schema = (
        "name string, step_from long, step_to long, words_count long, empty_words_count long, key_count long, logical_bytes long, fanout long, "
        "filter_kind string, filter_accelerates boolean, salt long, files long, file_bytes long"
    )
    return spark.createDataFrame([row], schema)


def manifest_json(paths: DomainPaths) -> str:
    return json.dumps(paths.__dict__)
