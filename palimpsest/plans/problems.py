"""The queries of the general data problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.steps import resolved_path, step_columns
from palimpsest.operators.changes import apply_change_feed
from palimpsest.operators.differences import field_differences, header_differences
from palimpsest.operators.intervals import periods_and_gaps
from palimpsest.operators import existence
from palimpsest.operators.small_files import SMALL_BYTES, consolidated_records, write_siblings
from palimpsest.session import new_path, table


def key_hex(name: str = "key"):
    return F.lower(F.hex(name)).alias("key_hex")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    lo, hi = step_columns(F.col("name"))
    files = table(spark, sf_dir, "step_files").select("domain_name", F.when(hi.isNotNull(), F.coalesce("range_from", lo)).alias("lo"), hi.alias("hi"))
    found = periods_and_gaps(files, "domain_name", "lo", "hi")
    return found.select("kind", F.col("entity").alias("domain_name"), F.col("lo").alias("step_from"), F.col("hi").alias("step_to"))


def _p2_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_change_feed(table(spark, sf_dir, "kv_changes"), table(spark, sf_dir, "merge_jobs"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p2_state(spark, sf_dir).select("domain_name", key_hex(), "change_id")


def p2_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rebuilt table itself: a kept deletion has the empty value."""
    value = F.when(F.col("deleted"), F.lit("")).otherwise(F.lower(F.hex("value"))).alias("value_hex")
    return _p2_state(spark, sf_dir).select("domain_name", key_hex(), value, "deleted")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, _ = consolidated_records(table(spark, sf_dir, "flush_files"), table(spark, sf_dir, "flush_records"))
    return records.select("row_id").distinct()


def p3_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the large files by their footers, and whether each has all blocks and rows of its sources."""
    _, manifest = consolidated_records(table(spark, sf_dir, "flush_files"), table(spark, sf_dir, "flush_records"))
    whole = F.bool_and(F.expr("blocks = want_blocks and rows = want_rows")).alias("whole")
    return manifest.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), whole)


def p3_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the filter written beside the large files says of their keys: all may be there."""
    records, _ = consolidated_records(table(spark, sf_dir, "flush_files"), table(spark, sf_dir, "flush_records"))
    paths = write_siblings(records, new_path(spark, "siblings") + "/all.0-1", 9)
    probes = records.select("key").distinct().select(F.lit("held").alias("kind"), "key")
    held = existence.read_filter(spark, paths.kvei)
    return existence.contains(probes, held, 9).groupBy("kind", "maybe").agg(F.count("*").alias("keys"))


def p3_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is listed of each domain: small files, how many lack an index or filter, their records, and what the listing says of keys."""
    path = resolved_path(F.col("kv")).alias("path")
    files = table(spark, sf_dir, "flush_files").where(F.col("kv_bytes") < SMALL_BYTES).select(path, "domain_name", "bt", "kvei", "key_count").where(F.col("path").endswith(".kv"))
    files = files.groupBy("domain_name", "path").agg(F.count("bt").alias("bt"), F.count("kvei").alias("kvei"), F.max("key_count").alias("key_count"))
    held = table(spark, sf_dir, "flush_records").select(path).groupBy("path").agg(F.count("*").alias("records"))
    return files.join(held, "path", "left").groupBy("domain_name").agg(
        F.count("*").alias("small_files"), F.count_if(F.col("bt") == 0).alias("without_bt"), F.count_if(F.col("kvei") == 0).alias("without_kvei"),
        F.coalesce(F.sum("records"), F.lit(0)).alias("records"), F.coalesce(F.sum("key_count"), F.lit(0)).alias("listed_keys"),
    )


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = (table(spark, sf_dir, f"pairs_{s}") for s in ("left", "right"))
    rows = field_differences(left, right, ["name", "key"], ["value"]).select("name", key_hex(), "field_name", "diff_kind")
    headers = header_differences(table(spark, sf_dir, "seg_counts"), "side", "name", ["words_count", "empty_words_count"])
    return rows.unionByName(headers.select("name", F.lit("").alias("key_hex"), "field_name", "diff_kind"))


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p2_state, p3_found, p3_files, p3_index, p3_listing, p5_found)}
