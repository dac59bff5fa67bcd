"""Stacks, merges, domains, filters and lookups."""

import pytest
from pyspark.sql import functions as F

from palimpsest.functions.steps import resolved_path, step_columns, step_range
from palimpsest.operators import domain, existence, lookup, ngrams
from palimpsest.operators.merge import MergeOptions, drops_deleted, merge, merge_runs
from palimpsest.operators.stack import Run, Stack, StackError, as_of

from .conftest import rows


def pairs(spark, **kv):
    return spark.createDataFrame([(k.encode(), v.encode()) for k, v in kv.items()], "key binary, value binary")


def as_dict(df):
    return {bytes(r.key).decode(): None if r.value is None else bytes(r.value).decode() for r in df.collect()}


@pytest.fixture
def two_runs(spark):
    return [Run("d.0-1.kv", pairs(spark, a="a0", b="b0", c="c0", e="e0")), Run("d.1-2.kv", pairs(spark, b="b1", c="", d="d1"))]


def test_merge_keeps_and_drops(two_runs):
    assert as_dict(merge_runs(two_runs, "d.1-2.kv")) == {"a": "a0", "b": "b1", "c": "", "d": "d1", "e": "e0"}
    assert as_dict(merge_runs(two_runs, "d.0-2.kv")) == {"a": "a0", "b": "b1", "d": "d1", "e": "e0"}
    assert as_dict(merge_runs(two_runs, "d.0-2.kv", MergeOptions(drop_deleted=False)))["c"] == ""
    assert "c" not in as_dict(merge_runs(two_runs, "d.kv", MergeOptions(range_from=0)))
    assert drops_deleted("d.kv", MergeOptions()) is False


def test_stack_returns_deletions_as_hits(two_runs):
    stack = Stack(two_runs)
    assert stack.get(b"c") == b"" and stack.get(b"b") == b"b1" and stack.get(b"zz") is None
    assert as_dict(stack.resolve())["c"] == ""
    assert len(stack) == 2 and stack.bloom_count() == 0
    assert [(r.name, r.key_count) for r in stack.files().collect()] == [("d.0-1.kv", 4), ("d.1-2.kv", 3)]


def test_stack_and_merge_order_runs_differently(spark):
    runs = [Run("x.0-2.kv", pairs(spark, a="two")), Run("x.0-1.kv", pairs(spark, a="one"))]
    assert as_dict(Stack(runs).resolve()) == {"a": "two"}
    assert as_dict(merge_runs(runs, "x.1-2.kv")) == {"a": "one"}


def test_errors(spark, two_runs):
    with pytest.raises(StackError):
        Stack([])
    with pytest.raises(StackError):
        merge_runs([], "d.kv")
    twice = Run("d.2-3.kv", spark.createDataFrame([(b"a", b"1"), (b"a", b"2")], "key binary, value binary"))
    with pytest.raises(domain.DomainError):
        merge_runs([*two_runs, twice], "d.0-3.kv", checked=True)
    with pytest.raises(domain.DomainError):
        domain.write_domain(twice.pairs, "/tmp/never")
    with pytest.raises(domain.DomainError):
        domain.write_domain(spark.createDataFrame([(None, b"1")], "key binary, value binary"), "/tmp/never")


def test_written_stack(spark, two_runs, tmp_path):
    for r in two_runs:
        domain.write_domain(r.pairs, f"file://{tmp_path}/{r.name[:-3]}", salt=3)
    stack = Stack.open_dir(spark, f"file://{tmp_path}", "d.", salt=3)
    assert stack.bloom_count() == 2 and stack.get(b"d") == b"d1"
    found = Stack.open_dir(spark, f"file://{tmp_path}", salt="find", search_limit=64)
    assert found.salt is not None and found.salt <= 3
    probes = spark.createDataFrame([(b"a",), (b"c",), (b"q",), (None,)], "key binary")
    got = {r.key and bytes(r.key): r.value and bytes(r.value) for r in stack.get_many(probes).collect()}
    assert got == {b"a": b"a0", b"c": b"", b"q": None, None: None}
    with pytest.raises(StackError):
        Stack.open_dir(spark, f"file://{tmp_path}", "nothing")
    out = merge(stack.runs, f"file://{tmp_path}/m.0-2", MergeOptions(salt=5))
    about = domain.inspect(spark, out.kv[:-3]).first()
    assert (about.key_count, about.words_count, about.step_to, about.filter_kind, about.salt) == (4, 8, 2, "bloom", 5)


def test_as_of(two_runs):
    assert as_dict(Stack(as_of(two_runs, 0)).resolve()) == {"a": "a0", "b": "b0", "c": "c0", "e": "e0"}


def test_unsigned_order_and_empty_key(spark):
    keys = [b"", b"\x7f", b"\x7f\x00", b"\x80", b"\xff"]
    df = domain.with_ordinals(spark.createDataFrame([(k, b"1") for k in reversed(keys)], "key binary, value binary"), True)
    assert [bytes(r.key) for r in df.orderBy("ordinal").collect()] == keys
    assert [r.logical_offset for r in df.orderBy("ordinal").collect()] == [0, 1, 3, 6, 8]
    assert lookup.get(df, b"") == b"1" and lookup.nth_key(df, 9).count() == 0
    assert [bytes(r.key) for r in lookup.prefix_scan(df, b"\x7f").orderBy("key").collect()] == keys[1:3]
    assert lookup.prefix_scan(df, b"\xff").count() == 1


def test_order_violations_across_partitions(spark):
    df = spark.createDataFrame([(i, b"%05d" % (i if i != 500 else 1)) for i in range(1000)], "pos long, key binary")
    assert [r.pos for r in domain.order_violations(df).collect()] == [500]
    assert domain.order_violations(spark.createDataFrame([(1, b"b"), (2, b"a"), (3, b"a")], "pos long, key binary")).count() == 2
    assert domain.repeated_keys(spark.createDataFrame([(1, b"b"), (2, b"b")], "pos long, key binary")).count() == 1


def test_filter_never_misses(spark):
    keys = spark.createDataFrame([(b"addr%010d" % i,) for i in range(3000)], "key binary")
    f = existence.build_filter(keys, 12345)
    f.words = f.words.persist()
    assert existence.validate_salt(keys, f, 12345)
    sample = [bytes(r.key) for r in keys.limit(16).collect()]
    assert existence.find_salt(spark, sample, f, chunk=64, limit=512) is None
    assert existence.contains(spark.createDataFrame([(None,)], "key binary"), f, 12345).first().maybe is False
    tiny = existence.build_filter(keys.limit(1), 1)
    assert tiny.kind == "empty" and existence.contains(keys, tiny, 1).where("not maybe").count() == 0
    # The way for filters too large to broadcast gives the same.
    probes = keys.limit(50).unionByName(spark.createDataFrame([(b"no%d" % i,) for i in range(50)], "key binary"))
    small = {bytes(r.key): r.maybe for r in existence.contains(probes, f, 12345).collect()}
    limit, existence.BROADCAST_WORDS = existence.BROADCAST_WORDS, 0
    try:
        assert {bytes(r.key): r.maybe for r in existence.contains(probes, f, 12345).collect()} == small
    finally:
        existence.BROADCAST_WORDS = limit


def test_salt_file(spark, tmp_path):
    (tmp_path / "salt").write_bytes(bytes.fromhex("34e93639ffff"))
    (tmp_path / "short").write_bytes(b"ab")
    assert existence.salt_from_file(spark, f"file://{tmp_path}/salt") == 887699001
    assert existence.salt_from_file(spark, f"file://{tmp_path}/short") is None
    assert existence.salt_from_file(spark, f"file://{tmp_path}/none") is None


def test_step_names(spark):
    names = {
        "v1.1-accounts.0-1024.kv": (0, 1024), "v1.1-accounts.1024-2048.kv": (1024, 2048), "accounts.kv": None, "v1.1-2.0-1024.kv": (1, 2), "x.0-10-20.kv": None,
        "x.1-18446744073709551616.3-4.kv": (3, 4), "x.+1-2.kv": None, "x.-1.kv": None, "": None, "007-9": (7, 9),
    }
    assert {n: step_range(n) for n in names} == names
    lo, hi = (c.alias(n) for c, n in zip(step_columns(spark_col("name")), ("lo", "hi")))
    got = {r.name: None if r.lo is None else (r.lo, r.hi) for r in spark.createDataFrame([(n,) for n in names], "name string").select("name", lo, hi).collect()}
    assert got == names


def spark_col(name):
    from pyspark.sql import functions as F

    return F.col(name)


def test_resolved_paths(spark):
    cases = {" /a/b.kv\n": "/a/b.kv", "\u00a0\x1f/a b\u2003": "/a b", "//a//b": "/a/b", "/a/./b": "/a/b", "/a/x/../b": "/a/b", "/../a": "/a", "a/b": "/a/b", "/": "/", "": "/", "/a/..b": "/a/..b", "/a/b/": "/a/b", "/a/b/..": "/a"}
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "p string").select("p", resolved_path(spark_col("p")).alias("r"))
    assert {r.p: r.r for r in df.collect()} == cases | {None: None}


def test_ngrams(spark):
    words = spark.createDataFrame([(i, w) for i, w in enumerate([b"abcdefgh" * 3, b"abcdefgh", b"", None, b"xyz"])], "pos long, word binary")
    best = ngrams.mine(words, lengths=(16, 8))
    assert [(bytes(r.ngram), r.uses) for r in best.collect()] == [(b"abcdefgh", 4), (b"abcdefghabcdefgh", 2), *[(bytes((b"abcdefgh" * 2)[i : i + 8]), 2) for i in range(1, 8)]]
    assert dict(rows(ngrams.length_histogram(words))) == {0: 4, 1: 1, 4: 1, 9: 1, 25: 1}
    cover = ngrams.cover_words(words, [b"abcdefghabcdefgh", b"abcdefgh"])
    assert rows(cover) == [(0, 0, 0), (0, 16, 1), (1, 0, 1)]
    assert dict(rows(ngrams.distance_histogram(words, cover))) == {0: 4, 1: 3, 4: 1, 9: 1, 17: 1, 25: 1}


def test_differences_of_streams(spark):
    a = spark.createDataFrame([(0, b"a"), (1, b"b")], "pos long, word binary")
    b = spark.createDataFrame([(0, b"a"), (1, b"c"), (2, b"d")], "pos long, word binary")
    assert sorted(r.pos for r in lookup.lockstep_difference(a, b).collect()) == [1, 2]
    assert lookup.multiset_difference(a, b).count() == 3 and lookup.multiset_difference(a, a).count() == 0


def test_salts_are_searched_in_slices(spark, monkeypatch):
    keys = spark.createDataFrame([(b"addr%010d" % i,) for i in range(3000)], "key binary")
    f = existence.build_filter(keys, 700)
    sample = [bytes(r.key) for r in keys.limit(16).collect()]
    for words in (existence.SLICE_WORDS, 7):
        monkeypatch.setattr(existence, "SLICE_WORDS", words)
        assert existence.find_salt(spark, sample, f, chunk=50, limit=2000, first_chunks=2) == 700
    assert existence.find_salt(spark, [], f) is None
    assert existence.find_salt(spark, sample, existence.Filter(None, 0, (0, 0, 0), "empty")) is None
    assert not existence.validate_salt(keys.limit(0), f, 700) and not existence.validate_salt(keys, existence.Filter(None, 0, (0, 0, 0), "empty"), 1)


def test_files_of_a_domain_are_disjoint(spark, tmp_path):
    """Many ranges, none packed with another; a lookup opens one of them."""
    n = 20_000
    df = spark.range(n).select(F.xxhash64("id").cast("string").cast("binary").alias("key"), F.col("id").cast("string").cast("binary").alias("value"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        domain.write_domain(df, f"file://{tmp_path}/d.0-1", salt=7)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    parts = domain.file_parts(spark, f"file://{tmp_path}/d.0-1").orderBy("first_key").collect()
    assert len(parts) == 16 and all(bytes(a.last_key) < bytes(b.first_key) for a, b in zip(parts, parts[1:]))
    assert [p.first_ordinal for p in parts] == [sum(q.keys for q in parts[:i]) for i in range(16)]
    ordered = domain.read_domain(spark, f"file://{tmp_path}/d.0-1").orderBy("key").collect()
    assert [r.ordinal for r in ordered] == list(range(n))
    assert [r.logical_offset for r in ordered[:3]] == [0, len(ordered[0].key) + len(ordered[0].value), sum(len(r.key) + len(r.value) for r in ordered[:2])]
    at = domain.pairs_at(spark, f"file://{tmp_path}/d.0-1", [0, 777, n - 1, n, -1]).orderBy("ordinal").collect()
    assert [(r.ordinal, r.key) for r in at] == [(i, ordered[i].key) for i in (0, 777, n - 1)]
    found = domain.read_pairs(spark, f"file://{tmp_path}/d.0-1").where(F.col("key") == F.lit(bytes(ordered[777].key)))
    assert "PushedFilters: [IsNotNull(key), EqualTo(key," in found._jdf.queryExecution().executedPlan().toString()
    # Of the files, only the one that has the key gives rows to the scan.
    scanned = [p for p in parts if bytes(p.first_key) <= bytes(ordered[777].key) <= bytes(p.last_key)]
    assert found.count() == 1 and len(scanned) == 1
    assert domain.sampled_keys(spark, f"file://{tmp_path}/d.0-1", 64).count() == 64
    nodes = spark.read.parquet(f"file://{tmp_path}/d.0-1.bt/nodes").orderBy("ordinal").collect()
    assert [(r.ordinal, r.key) for r in nodes] == [(i, ordered[i].key) for i in range(0, n, 256)]


def test_rejected_domains_leave_nothing(spark, tmp_path):
    for bad in ([(b"a", b"1"), (b"b", b"1"), (b"b", b"2")], [(b"a", b"1"), (None, b"2")]):
        with pytest.raises(domain.DomainError):
            domain.write_domain(spark.createDataFrame(bad, "key binary, value binary"), f"file://{tmp_path}/d.0-1")
        assert not (tmp_path / "d.0-1.kv").exists()
    domain.write_domain(spark.createDataFrame([], "key binary, value binary"), f"file://{tmp_path}/none", salt=1)
    about = domain.inspect(spark, f"file://{tmp_path}/none").first()
    assert (about.key_count, about.words_count, about.filter_kind) == (0, 0, "empty") and domain.read_domain(spark, f"file://{tmp_path}/none").count() == 0
    domain.write_domain(spark.createDataFrame([(b"", b"1"), (b"a", b"")], "key binary, value binary"), f"file://{tmp_path}/e", fanout=1, compress=True)
    about = domain.inspect(spark, f"file://{tmp_path}/e").first()
    assert (about.key_count, about.empty_words_count, about.logical_bytes, about.fanout, about.filter_kind) == (2, 2, 2, 1, None) and about.file_bytes > 0


def test_stack_lookups_ask_the_filters(spark, tmp_path):
    for i in range(4):
        df = spark.range(500).select(F.format_string(f"{'abcd'[i]}%05d", "id").cast("binary").alias("key"), F.lit(b"v%d" % i).alias("value"))
        domain.write_domain(df.unionByName(spark.createDataFrame([(b"all", b"%d" % i)], df.schema)), f"file://{tmp_path}/d.{i}-{i + 1}", salt=7)
    stack = Stack.open_dir(spark, f"file://{tmp_path}", "d.", salt=7)
    assert stack.bloom_count() == 4 and not stack.is_empty() and [r.name for r in stack.runs] == [f"d.{i}-{i + 1}.kv" for i in range(4)]
    assert stack.get(b"all") == b"3" and stack.get(b"a00007") == b"v0" and len(stack.candidates(b"all")) == 4
    assert sum(len(stack.candidates(b"c%05d" % i)) for i in range(10)) < 14
    assert stack.get(b"nowhere") is None
    assert all(r.file_bytes > 0 for r in stack.sizes().collect()) and stack.sizes().count() == 4
    resolved = stack.resolve()
    plan = resolved._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    assert resolved.count() == 2001 and resolved.where("key = cast('all' as binary)").first().value == b"3"


def test_left_folders_are_swept(spark, tmp_path, monkeypatch):
    from palimpsest import session

    monkeypatch.setattr(session, "shared_dir", lambda _: f"file://{tmp_path}")
    own = f"palimpsest-{spark.sparkContext.applicationId}"
    for name in (own, "palimpsest-killed", "other"):
        spark.range(3).write.parquet(f"file://{tmp_path}/{name}/x")
    assert session.sweep(spark, 1) == []
    assert session.sweep(spark, -1) == ["palimpsest-killed"]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["other", own]
