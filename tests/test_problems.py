"""Intervals, change feeds, small files and differences, against brute force and at their edges."""

import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from palimpsest.operators import changes, differences, small_files
from palimpsest.operators.intervals import IntervalMap, periods_and_gaps
from palimpsest.sources.parquet_blocks import BlockError, join_files
from palimpsest.streaming.upserts import stream_into, stream_periods

from .conftest import rows


def brute_periods(data):
    by = {}
    for e, a, b in data:
        if a is not None and b is not None and a < b:
            by.setdefault(e, []).append((a, b))
    out = set()
    for e, v in by.items():
        cur = None
        for a, b in sorted(v):
            if cur and a <= cur[1]:
                cur[1] = max(cur[1], b)
            else:
                if cur:
                    out |= {("period", e, *cur), ("gap", e, cur[1], a)}
                cur = [a, b]
        out.add(("period", e, *cur))
    return out


def test_interval_map():
    rng = random.Random(3)
    for _ in range(200):
        data = [(0, a := rng.randrange(60), a + rng.randrange(-2, 9)) for _ in range(rng.randrange(1, 25))]
        m = IntervalMap()
        for _, a, b in data:
            m.insert(a, b)
        assert {("period", 0, *p) for p in m.periods()} | {("gap", 0, *g) for g in m.gaps()} == brute_periods(data)


@pytest.mark.parametrize("spread", [40, 3000])
def test_periods_with_a_hot_entity(spark, spread):
    rng = random.Random(spread)
    data = [(rng.choice(["hot", "hot", "hot", "cold", None, ""]), a := rng.randrange(spread), a + rng.choice([-1, 0, 1, 2, 5, 40])) for _ in range(3000)]
    data += [("hot", None, 5), ("hot", 5, None), ("hot", 10, spread // 2), ("only", 1, 2)] * 2
    df = spark.createDataFrame(data, "entity string, lo long, hi long").selectExpr("entity as name", "lo as pid", "hi as last", "1 as kind", "2 as lo")
    found = periods_and_gaps(df, "name", "pid", "last")
    assert found.columns == ["kind", "entity", "lo", "hi"]
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == brute_periods(data)


def test_periods_of_nothing(spark):
    assert periods_and_gaps(spark.createDataFrame([], "e string, a long, b long"), "e", "a", "b").count() == 0


def test_stream_of_intervals(spark, tmp_path):
    schema = "e string, a long, b long"
    for part in ([("x", 0, 5), ("y", 1, 2)], [("x", 8, 9)], [("x", 5, 6), ("x", None, 3)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream_periods(stream, "e", "a", "b").writeStream.outputMode("update").format("memory").queryName("periods").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("periods").where("e = 'x'").orderBy(__import__("pyspark").sql.functions.desc("period_to")).collect()
    assert any((r.period_from, r.period_to, r.gap_from, r.gap_to) == ([0, 8], [6, 9], [6], [8]) for r in got)


FEED = "change_id long, domain_name string, op string, key binary, value binary, step long, txn long, arrived_at string, deleted boolean"


def feed_rows(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        key = rng.choice([b"hot", b"hot", b"", None, b"k%d" % rng.randrange(20)])
        row = [i, rng.choice(["d", "e", None]), rng.choice(["set", " Delete ", "D", None, "Update"]), key, rng.choice([b"", None, b"v%d" % i]), rng.choice([None, 1, 2, 3]), rng.randrange(3), str(rng.random()), None]
        out.append(tuple(row))
        if rng.random() < 0.2:
            out.append((*row[:7], "later", None))
    rng.shuffle(out)
    return out


def brute_state(data, drops):
    low = lambda x: (x is not None, x)
    best = {}
    for r in data:
        rank = (low(r[5]), low(r[6]), low(r[0]))
        if (r[1], r[3]) not in best or rank > best[r[1], r[3]][0]:
            best[r[1], r[3]] = (rank, r)
    gone = lambda r: (r[2] or "").strip().lower() in changes.DELETE_OPS or not r[4]
    return {(d, k, r[0]) for (d, k), (_, r) in best.items() if not (gone(r) and drops.get(d))}


def state_of(df):
    got = [(r.domain_name, None if r.key is None else bytes(r.key), r.change_id) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


JOBS = "domain_name string, out_name string, range_from long, drop_deleted boolean"


def test_change_feed(spark, tmp_path):
    data = feed_rows(2000, 1)
    spark.createDataFrame(data, FEED).repartition(5).write.parquet(str(tmp_path / "f"))
    feed = spark.read.parquet(str(tmp_path / "f"))
    jobs = spark.createDataFrame([("d", "v1.0-4.kv", None, None), ("e", "v1.0-4.kv", 3, True), (None, "x.0-1.kv", 0, True)], JOBS)
    found = changes.apply_change_feed(feed.drop("deleted"), jobs)
    assert state_of(found) == brute_state(data, {"d": True})


def test_values_are_not_shuffled(spark, tmp_path):
    spark.createDataFrame(feed_rows(300, 4), FEED).repartition(3).write.parquet(str(tmp_path / "f"))
    state = changes.current_state(spark.read.parquet(str(tmp_path / "f")), ["domain_name", "key"], ["step", "txn", "change_id"])
    plan = state._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Broadcast" not in plan and "ArrowEvalPython" in plan


def test_bitmaps_of_many_segments(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(changes, "SEGMENT", 128)
    data = [(i, "d", "set", b"k%d" % (i % 700), b"v", i % 5, 0, "", None) for i in range(3000)]
    spark.createDataFrame(data, FEED).coalesce(2).write.parquet(str(tmp_path / "f"))
    found = changes.current_state(spark.read.parquet(str(tmp_path / "f")), ["domain_name", "key"], ["step", "txn", "change_id"])
    assert state_of(found) == brute_state(data, {})


def test_change_feed_of_nothing(spark, tmp_path):
    spark.createDataFrame([], FEED).drop("deleted").write.parquet(str(tmp_path / "f"))
    assert changes.apply_change_feed(spark.read.parquet(str(tmp_path / "f")), spark.createDataFrame([], JOBS)).count() == 0


def test_versioned_table_takes_batches_in_any_order(spark, tmp_path):
    data = feed_rows(600, 2)
    held = changes.VersionedTable(spark, f"file://{tmp_path}/t", ["domain_name", "key"], ["step", "txn", "change_id"])
    held.INDEX_RUNS = 2
    seen = []
    for i in range(0, len(data), 250):
        part = data[i : i + 250]
        seen += part
        held.apply(spark.createDataFrame(part, FEED).repartition(2))
        assert state_of(held.read()) == brute_state(seen, {})
    held.apply(spark.createDataFrame(data[:250], FEED))
    assert state_of(held.read()) == brute_state(seen, {}) and held.version == 4 and '"version": 4' in held.manifest()


def test_versioned_table_outlives_its_writer(spark, tmp_path, monkeypatch):
    """Killed between its files and its commit, opened again by another, and gone on with."""
    data, path = feed_rows(400, 5), f"file://{tmp_path}/t"
    keys, rank = ["domain_name", "key"], ["step", "txn", "change_id"]
    with pytest.raises(changes.VersionError):
        changes.VersionedTable.open(spark, path)
    first = changes.VersionedTable(spark, path, keys, rank)
    first.apply(spark.createDataFrame(data[:200], FEED), "s", 0)
    killed = changes.VersionedTable.open(spark, path)
    monkeypatch.setattr(changes, "commit_file", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        killed.apply(spark.createDataFrame(data[200:], FEED), "s", 1)
    monkeypatch.undo()
    assert state_of(changes.VersionedTable.open(spark, path).read()) == brute_state(data[:200], {})
    again = changes.VersionedTable.open(spark, path)
    assert (again.version, again.keys, again.rank) == (1, keys, rank)
    assert not again.apply(spark.createDataFrame(data[:200], FEED), "s", 0) and again.version == 1
    assert again.apply(spark.createDataFrame(data[200:], FEED), "s", 1)
    assert state_of(changes.VersionedTable.open(spark, path).read()) == brute_state(data, {})
    # The first object does not know of the second version: it loses, and nothing is overwritten.
    with pytest.raises(changes.VersionError):
        first.apply(spark.createDataFrame(data[:10], FEED))
    assert state_of(changes.VersionedTable.open(spark, path).read()) == brute_state(data, {})
    with pytest.raises(changes.VersionError):
        changes.VersionedTable(spark, path, ["key"], rank)


def test_versioned_table_is_moved(spark, tmp_path):
    data = feed_rows(200, 8)
    held = changes.VersionedTable(spark, f"file://{tmp_path}/t", ["domain_name", "key"], ["step", "txn", "change_id"])
    for part in (data[:120], data[120:]):
        held.apply(spark.createDataFrame(part, FEED).repartition(2))
    (tmp_path / "t").rename(tmp_path / "moved")
    assert state_of(changes.VersionedTable.open(spark, f"file://{tmp_path}/moved").read()) == brute_state(data, {})


def test_feed_that_is_no_scan(spark):
    data = feed_rows(200, 9)
    feed = spark.createDataFrame(data, FEED).withColumn("step", __import__("pyspark").sql.functions.col("step") + 0)
    assert state_of(changes.current_state(feed, ["domain_name", "key"], ["step", "txn", "change_id"])) == brute_state(data, {})


def test_stream_into_versioned_table(spark, tmp_path):
    data = feed_rows(300, 3)
    spark.createDataFrame(data, FEED).repartition(3).write.parquet(str(tmp_path / "in"))
    held = changes.VersionedTable(spark, f"file://{tmp_path}/t", ["domain_name", "key"], ["step", "txn", "change_id"])
    stream = spark.readStream.schema(FEED).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream_into(stream, held, str(tmp_path / "c")).awaitTermination()
    assert state_of(held.read()) == brute_state(data, {})


def test_blocks_are_joined_undecoded(tmp_path):
    tables, paths = [], []
    for i, compression in enumerate(["snappy", "zstd", "none"]):
        t = pa.table({"a": pa.array([None, *range(i * 100, i * 100 + 99)], pa.int64()), "b": pa.array([b"x%d" % (j % 3) for j in range(100)], pa.binary()), "c": pa.array([[j] * (j % 3) for j in range(100)], pa.list_(pa.int32()))})
        paths.append(str(tmp_path / f"{i}.parquet"))
        pq.write_table(t, paths[-1], compression=compression, row_group_size=30, use_dictionary=i != 1, write_page_index=i == 0)
        tables.append(t)
    done = join_files(paths, str(tmp_path / "out.parquet"))
    assert (done.files, done.blocks, done.rows) == (3, 12, 300)
    assert done.size == (tmp_path / "out.parquet").stat().st_size
    assert pq.read_table(tmp_path / "out.parquet").equals(pa.concat_tables(tables))
    assert pq.read_table(tmp_path / "out.parquet", filters=[("a", ">", 250)]).num_rows == 48
    pq.write_table(pa.table({"a": [1]}), tmp_path / "other.parquet")
    with pytest.raises(BlockError):
        join_files([paths[0], str(tmp_path / "other.parquet")], str(tmp_path / "bad.parquet"))
    (tmp_path / "junk").write_bytes(b"PAR1" * 5)
    with pytest.raises(BlockError):
        join_files([str(tmp_path / "junk")], str(tmp_path / "bad.parquet"))
    with pytest.raises(BlockError):
        join_files([], str(tmp_path / "bad.parquet"))


def test_consolidate_folder(spark, tmp_path):
    df = spark.range(10_000).selectExpr("id", "cast(id as string) as s")
    df.repartition(40).write.parquet(f"file://{tmp_path}/many")
    sizes = [r.bytes for r in small_files.list_files(spark, f"file://{tmp_path}/many").collect()]
    manifest = small_files.consolidate(spark, f"file://{tmp_path}/many", f"file://{tmp_path}/few", target=sum(sizes) // 3)
    assert manifest.count() in (3, 4)
    again = small_files.read_consolidated(spark, manifest, df.schema)
    assert again.exceptAll(df).count() == 0 and again.count() == 10_000
    spark.createDataFrame([], "a long").repartition(1).write.parquet(f"file://{tmp_path}/none")
    assert small_files.read_consolidated(spark, small_files.consolidate(spark, f"file://{tmp_path}/none", f"file://{tmp_path}/n2"), spark.createDataFrame([], "a long").schema).count() == 0


def test_consolidate_what_differs(spark, tmp_path):
    """Files of two schemas, in folders of folders, by two spellings of one file system; an empty file; one that is none."""
    a = spark.range(1000).selectExpr("id", "cast(id as string) as s")
    b = spark.range(500).selectExpr("cast(id as int) as other")
    a.repartition(10).write.parquet(f"file://{tmp_path}/in/x/y")
    a.repartition(5).write.parquet(f"file://{tmp_path}/in/x/z")
    b.repartition(7).write.parquet(f"file://{tmp_path}/in/w")
    (tmp_path / "in" / "x" / "nothing.parquet").write_bytes(b"")
    (tmp_path / "in" / ".hidden").write_bytes(b"x")
    manifest = small_files.consolidate(spark, f"{tmp_path}/in", f"file://{tmp_path}/out")
    assert manifest.agg({"files": "sum"}).first()[0] == 22
    kinds = {}
    for r in manifest.collect():
        schema = tuple(pq.read_schema(r.path.removeprefix("file://")).names)
        kinds[schema] = kinds.get(schema, 0) + r.rows
    assert kinds == {("id", "s"): 2000, ("other",): 500}
    (tmp_path / "in" / "bad.parquet").write_bytes(b"no parquet at all")
    with pytest.raises(BlockError):
        small_files.consolidate(spark, f"{tmp_path}/in", f"file://{tmp_path}/out2")


def test_index_and_filter_of_consolidated_records(spark, tmp_path):
    from palimpsest.operators import existence

    rows = [("d", 0, 1, b"k%05d" % i, b"v", i) for i in range(1000)]
    spark.createDataFrame(rows, "domain_name string, step_from long, step_to long, key binary, value binary, row_id long").coalesce(1).sortWithinPartitions("key").write.parquet(f"file://{tmp_path}/kv")
    records = spark.read.parquet(f"file://{tmp_path}/kv")
    paths = small_files.write_siblings(records, f"file://{tmp_path}/all", 7)
    assert sorted(bytes(r.key) for r in spark.read.parquet(paths.bt).collect()) == [b"k%05d" % i for i in range(0, 1000, 256)]
    f = existence.read_filter(spark, paths.kvei)
    assert existence.contains(records, f, 7).where("not maybe").count() == 0


def test_small_file_records(spark):
    files = spark.createDataFrame(
        [
            ("d", "/s/a.0-1.kv", 10), ("d", " /s/./a.0-1.kv", 10), ("d", "/s/big.0-1.kv", 16384), ("d", "/s/a.0-1.kv.tmp", 1), ("e", "/s/c.kv", 1),
            (None, None, 5), ("d", "/s/null.0-1.kv", None), ("d", "/s/retry.0-1.kv", 3),
        ],
        "domain_name string, kv string, kv_bytes long",
    )
    records = spark.createDataFrame(
        [
            (1, "/s/a.0-1.kv", b"k", b"v"), (2, "/s//a.0-1.kv ", b"k", b"v"), (3, "/s/big.0-1.kv", b"k", b"v"), (4, "/s/c.kv", b"k", None), (5, "/s/c.kv", b"k", b""),
            (6, "/s/x/../retry.0-1.kv", b"k", b"v"), (7, "/s/retry.0-1.kv", None, b"v"), (8, None, b"k", b"v"), (9, "/s/c.kv", b"k", None), (10, "/s/null.0-1.kv", b"k", b"v"),
        ],
        "row_id long, kv string, key binary, value binary",
    )
    found, manifest = small_files.consolidated_records(files, records)
    assert sorted(r.row_id for r in found.collect()) == [1, 4, 5, 7]
    assert manifest.count() == 1
    empty, _ = small_files.consolidated_records(files.limit(0), records)
    assert empty.count() == 0


def brute_differences(left, right):
    l, r = ({x[:2]: x[2] for x in t} for t in (left, right))
    out = set()
    for k in l.keys() | r.keys():
        if k not in r:
            out.add((*k, "key", "only_left"))
        elif k not in l:
            out.add((*k, "key", "only_right"))
        elif l[k] != r[k]:
            out.add((*k, "value", "differs"))
    return out


@pytest.mark.parametrize("loss", [0.0, 0.02, 0.9])
def test_differences(spark, loss):
    rng = random.Random(int(loss * 100))
    left = [(rng.choice(["hot", "hot", "f", None]), b"%d" % i if i else None, rng.choice([None, b"", b"v"])) for i in range(4000)]
    right = [(*x[:2], b"other" if rng.random() < loss / 2 else x[2]) for x in left if rng.random() >= loss / 2]
    left, right = [x for x in left if rng.random() >= loss / 3], right
    schema = "name string, key binary, value binary"
    dfs = [spark.createDataFrame(t + t[:100], schema) for t in (left, right)]
    found = differences.field_differences(*[d.selectExpr("*", "1 as kh", "2 as bucket") for d in dfs], ["name", "key"], ["value"])
    got = [(r.name, None if r.key is None else bytes(r.key), r.field_name, r.diff_kind) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == brute_differences(left, right)


def test_differences_with_an_empty_copy_and_header_lists(spark):
    schema = "name string, key binary, value binary"
    some, none = spark.createDataFrame([("f", b"", None)], schema), spark.createDataFrame([], schema)
    assert rows(differences.field_differences(some, none, ["name", "key"], ["value"]).select("field_name", "diff_kind")) == [("key", "only_left")]
    assert differences.field_differences(none, none, ["name", "key"], ["value"]).count() == 0
    heads = spark.createDataFrame([("left", "a", 1, None), ("left", "a", 1, None), ("right", "a", 2, None), ("left", "b", 1, 1), ("right", "c", None, 1), (None, "d", 1, 1), ("left", None, 1, 1), ("left", "e", None, 0), ("right", "e", 0, 0)], "side string, name string, w long, e long")
    assert rows(differences.header_differences(heads, "side", "name", ["w", "e"])) == [("a", "w", "differs"), ("b", "name", "only_left"), ("c", "name", "only_right"), ("e", "w", "differs")]


def test_peel_reports_what_it_cannot_tell():
    cells = {i: [2, 5, 6, 7, 8, 9] for i in range(4)}
    assert differences.peel(cells) == ([], False)


@pytest.mark.parametrize("task_rows", [64, 1 << 20])
def test_repeats_and_finer_buckets(spark, monkeypatch, task_rows):
    """Rows repeated unequally are no differences; the first table tells all, or nothing."""
    monkeypatch.setattr(differences, "TASK_ROWS_A_BUCKET", task_rows)
    rng = random.Random(task_rows)
    left = [("f", b"%d" % i, b"v") for i in range(6000)]
    right = [(n, k, b"w" if rng.random() < 0.2 else v) for n, k, v in left]
    schema = "name string, key binary, value binary"
    dfs = [spark.createDataFrame(t, schema).repartition(3) for t in (left + left[:500] * 3 + [("hot", b"h", b"h")] * 3000, [*right, ("hot", b"h", b"h")])]
    got = [(r.name, bytes(r.key), r.field_name, r.diff_kind) for r in differences.field_differences(*dfs, ["name", "key"], ["value"]).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_differences(left, right)
