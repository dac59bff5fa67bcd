"""A third of all rows under one key, file or entity, against counts that need no brute force."""

from pyspark.sql import functions as F

from palimpsest.operators import changes, differences, small_files
from palimpsest.operators.intervals import periods_and_gaps
from palimpsest.operators.stack import Run, Stack


def hot(n, spark):
    return spark.range(n).withColumn("name", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("f"), (F.col("id") % 997).cast("string"))))


def test_intervals_of_a_hot_entity(spark):
    n = 60_000
    df = hot(n, spark).select("name", (F.col("id") * 10).alias("a"), (F.col("id") * 10 + 4).alias("b"))
    got = {r.kind: r.n for r in periods_and_gaps(df, "name", "a", "b").groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert got == {"period": n, "gap": n - df.select("name").distinct().count()}
    # One interval under all others of the hot entity makes them one period.
    over = df.unionByName(spark.createDataFrame([("hot", 0, n * 10)], df.schema))
    found = periods_and_gaps(over, "name", "a", "b").where("entity = 'hot'").collect()
    assert [(r.kind, r.lo, r.hi) for r in found] == [("period", 0, n * 10)]


def test_changes_of_a_hot_key(spark, tmp_path):
    n = 60_000
    df = hot(n, spark).select(F.col("name").cast("binary").alias("key"), F.lit("d").alias("domain_name"), F.col("id").alias("change_id"), (F.col("id") % 50).alias("step"), F.lit(1).alias("txn"), F.lit(b"v").alias("value"))
    df.repartition(7).write.parquet(str(tmp_path / "f"))
    state = changes.current_state(spark.read.parquet(str(tmp_path / "f")), ["domain_name", "key"], ["step", "txn", "change_id"])
    rows = {bytes(r.key).decode(): r.change_id for r in state.select("key", "change_id").collect()}
    assert len(rows) == 998 and rows["hot"] == max(i for i in range(0, n, 3) if i % 50 == 49)


def test_differences_in_a_hot_file(spark):
    n = 60_000
    left = hot(n, spark).select("name", F.col("id").cast("string").cast("binary").alias("key"), F.lit(b"v").alias("value"))
    right = left.where("cast(cast(key as string) as long) % 1000 <> 0").withColumn("value", F.when(F.col("key") == F.lit(b"7"), F.lit(b"w")).otherwise(F.col("value")))
    got = differences.field_differences(left, right, ["name", "key"], ["value"]).groupBy("diff_kind").count().collect()
    assert {r.diff_kind: r["count"] for r in got} == {"only_left": 60, "differs": 1}


def test_records_of_a_hot_file(spark):
    n = 30_000
    files = hot(n, spark).select(F.lit("d").alias("domain_name"), F.concat(F.lit("/s/"), "name", F.lit(".0-1.kv")).alias("kv"), F.lit(5).cast("long").alias("kv_bytes")).distinct()
    rows = hot(n, spark).select(F.col("id").alias("row_id"), F.concat(F.lit("/s/"), "name", F.lit(".0-1.kv")).alias("kv"), (F.col("id") % 1500).cast("string").cast("binary").alias("key"), F.lit(b"v").alias("value"))
    found, _ = small_files.consolidated_records(files, rows)
    assert sorted(r.row_id for r in found.collect()) == list(range(1500))


def test_stack_of_a_hot_run(spark):
    base = spark.range(40_000).select(F.col("id").cast("string").cast("binary").alias("key"))
    runs = [Run(f"d.{i}-{i + 1}.kv", base.where(F.col("key") > F.lit(b"3") if i else F.lit(True)).withColumn("value", F.lit(bytes([65 + i])))) for i in range(3)]
    got = Stack(runs).resolve().groupBy(F.col("value").cast("string").alias("v")).count().collect()
    assert sum(r["count"] for r in got) == 40_000 and {r.v for r in got} == {"A", "C"}
