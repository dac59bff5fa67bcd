"""Queries over the engine's operators, each on a domain derived from the star schema or the event table.

users   events by user: key u + 8 digits, step = days since 2024-01-01, a run for ten
        days, deleted by an ``error`` event.
buyers  orders by customer: key c + 8 digits, step = year, a run a year, deleted by status F.
orders  one run of unique keys o + 10 digits.
Every query reads its whole table.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.columns import encode_monotone, get_monotone, monotone_round_trip, read_uvarint_column, select64_column, uvarint_column
from palimpsest.functions.hashing import filter_keys, murmur3, optimal_bits
from palimpsest.functions.steps import step_columns
from palimpsest.operators import domain, existence, lookup, ngrams
from palimpsest.operators.merge import MergeOptions, merge_runs
from palimpsest.operators.stack import Run, Stack, as_of
from palimpsest.session import materialize, new_path, table

SALT = 9
RUN_STEPS = 10
#: A salt to be found, beyond the first eight chunks of salts tried, and one to be read from a file.
FOUND_SALT, FOUND_CHUNK, FILE_SALT = 5003, 256, 887699001


def _hex(c: str) -> Column:
    return F.lower(F.hex(c)).alias(f"{c}_hex")


def _shown(df: DataFrame, *more: str) -> DataFrame:
    return df.select(_hex("key"), _hex("value"), *more)


def _key(letter: str, number: Column, width: int) -> Column:
    return F.concat(F.lit(letter), F.lpad(number.cast("string"), width, "0")).cast("binary")


def _users(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("user_id is not null")
    value = F.when(F.col("event_type") == "error", F.lit("")).otherwise(F.coalesce("props", F.lit("")))
    step = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    return e.select(_key("u", F.col("user_id"), 8).alias("key"), value.cast("binary").alias("value"), step.alias("step"), "event_id")


def _buyers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    value = F.when(F.col("o_orderstatus") == "F", F.lit("")).otherwise(F.col("o_orderpriority"))
    return o.select(_key("c", F.col("o_custkey"), 8).alias("key"), value.cast("binary").alias("value"), F.year("o_orderdate").alias("step"), F.col("o_orderkey").alias("event_id"))


def orders_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(_key("o", F.col("o_orderkey"), 10).alias("key"), F.concat_ws("|", "o_orderstatus", "o_orderpriority").cast("binary").alias("value"))


def _runs(rows: DataFrame, width: int, name: str) -> list[Run]:
    """A run for each ``width`` steps, written once, a folder a run, as published files would lie.

    The runs are few, as files are; their numbers are read on the driver.
    """
    spark = rows.sparkSession
    best = F.max(F.struct("step", "event_id", "value")).alias("best")
    won = rows.groupBy(F.floor(F.col("step") / width).cast("long").alias("run"), "key").agg(best)
    path = new_path(spark, name)
    won.select("run", "key", F.col("best.value").alias("value")).write.partitionBy("run").parquet(path)
    written = spark.read.parquet(path)
    numbers = sorted(r.run for r in written.select("run").distinct().collect())
    pairs = lambda i: spark.read.schema("key binary, value binary").parquet(f"{path}/run={i}")
    return [Run(f"v1.1-{name}.{i * width}-{(i + 1) * width}.kv", pairs(i), path=f"{path}/run={i}") for i in numbers]


def user_runs(spark: SparkSession, sf_dir: str) -> list[Run]:
    return _runs(_users(spark, sf_dir), RUN_STEPS, "users")


def buyer_runs(spark: SparkSession, sf_dir: str) -> list[Run]:
    return _runs(_buyers(spark, sf_dir), 1, "buyers")


def _short_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of exactly eight bytes."""
    return table(spark, sf_dir, "events").where("user_id is not null").select(_key("u", F.col("user_id"), 7).alias("key")).distinct()


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pos"), F.concat_ws("|", F.lpad("o_custkey", 8, "0"), "o_orderstatus", "o_orderpriority", F.lit("0x0000000000000000")).cast("binary").alias("word"))


# Scans and lookups


def scan_pairs(spark, d):
    return _shown(orders_domain(spark, d))


def point_get(spark, d):
    return _shown(orders_domain(spark, d).where(F.col("key") == F.lit(b"o0000000042")))


def get_absent(spark, d):
    return _shown(orders_domain(spark, d).where(F.col("key") == F.lit(b"nothing")))


def batch_get(spark, d):
    probes = table(spark, d, "lineitem").select(_key("o", F.col("l_orderkey") * 3, 10).alias("key")).distinct()
    return _shown(lookup.get_many(probes, orders_domain(spark, d)))


def key_range(spark, d):
    return _shown(lookup.key_range(orders_domain(spark, d), b"o0000000100", b"o0000000200"))


def prefix_scan(spark, d):
    return _shown(lookup.prefix_scan(orders_domain(spark, d), b"o00000001"))


def first_rows(spark, d):
    return _shown(lookup.first_rows(orders_domain(spark, d), 5))


# Stacks and merges


def stack_newest_wins(spark, d):
    return _shown(Stack(user_runs(spark, d)).resolve())


def stack_buyers(spark, d):
    return _shown(Stack(buyer_runs(spark, d)).resolve())


def stack_get_many(spark, d):
    probes = table(spark, d, "customer").select(_key("c", F.col("c_custkey") * 2, 8).alias("key")).distinct()
    return _shown(Stack(buyer_runs(spark, d)).get_many(probes))


def merge_keep(spark, d):
    return _shown(merge_runs(user_runs(spark, d), "v1.1-users.1-1000.kv"))


def merge_drop_from_zero(spark, d):
    return _shown(merge_runs(user_runs(spark, d), "v1.1-users.0-1000.kv"))


def merge_buyers_range_from(spark, d):
    return _shown(merge_runs(buyer_runs(spark, d), "v1.1-buyers.kv", MergeOptions(range_from=0)))


def as_of_step(spark, d):
    return _shown(Stack(as_of(buyer_runs(spark, d), 1997)).resolve())


def _before_and_last(spark, d) -> tuple[DataFrame, DataFrame]:
    """What the stack of all runs but the last says, and the last run."""
    runs = buyer_runs(spark, d)
    return materialize(Stack(runs[:-1]).resolve(), "before"), runs[-1].pairs


def override_antijoin(spark, d):
    return _shown(lookup.override(*_before_and_last(spark, d)))


def shared_keys(spark, d):
    return lookup.shared_keys(*_before_and_last(spark, d)).select(_hex("key"))


def semi_exists(spark, d):
    return lookup.existing(*_before_and_last(spark, d)).select(_hex("key"))


def anti_missing(spark, d):
    return lookup.missing(*_before_and_last(spark, d)).select(_hex("key"))


def files_key_counts(spark, d):
    return Stack(buyer_runs(spark, d)).files()


def union_key_count(spark, d):
    return Stack(buyer_runs(spark, d)).rows().agg(F.count_distinct("key").alias("keys"))


def smallest_run(spark, d):
    return Stack(buyer_runs(spark, d)).files().orderBy("key_count", "name").limit(1).select("name", "key_count")


def smallest_by_bytes(spark, d):
    """The run of fewest bytes of keys and values."""
    size = F.sum(F.octet_length("key") + F.octet_length("value")).alias("bytes")
    return Stack(buyer_runs(spark, d)).rows().groupBy("name").agg(size).orderBy("bytes", "name").limit(1)


# Order, ordinals, counts


def ordinals(spark, d):
    return _shown(domain.with_ordinals(orders_domain(spark, d)), "ordinal")


def nth_key(spark, d):
    return _shown(lookup.nth_key(domain.with_ordinals(orders_domain(spark, d)), 777), "ordinal")


def every_mth_key(spark, d):
    return domain.key_nodes(domain.with_ordinals(orders_domain(spark, d))).select(_hex("key"), "ordinal")


def offsets_prefix_sum(spark, d):
    return domain.with_ordinals(orders_domain(spark, d), with_offsets=True).select(_hex("key"), "ordinal", "logical_offset")


def evenly_spaced_sample(spark, d):
    return existence.sample_keys(domain.with_ordinals(orders_domain(spark, d)), 64).select(_hex("key"), "ordinal")


def stride_sample(spark, d):
    return lookup.stride_sample(domain.with_ordinals(orders_domain(spark, d)), 100, 50).select(_hex("key"), "ordinal")


def order_violations(spark, d):
    rows = table(spark, d, "events").where("user_id is not null").select(F.col("event_id").alias("pos"), _key("u", F.col("user_id"), 8).alias("key"))
    return domain.order_violations(rows).select("pos", _hex("key"))


def repeated_keys(spark, d):
    rows = table(spark, d, "lineitem").select(F.concat(_key("l", F.col("l_orderkey"), 10), _key("n", F.col("l_linenumber"), 3)).alias("key"))
    return domain.repeated_keys(rows).select(_hex("key"), "copies")


def inspect_counts(spark, d):
    return domain.counts(Stack(buyer_runs(spark, d)).rows(), ["name"])


def length_histogram(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderpriority").cast("binary").alias("word"))
    return ngrams.length_histogram(o)


def step_names(spark, d):
    lo, hi = step_columns(F.col("name"))
    return table(spark, d, "step_files").select("file_id", lo.alias("step_from"), hi.alias("step_to"))


# Hashes and filters


def murmur3_h1(spark, d):
    return _short_keys(spark, d).select(_hex("key"), murmur3(F.col("key"), SALT).alias("h1"))


def _short_filter(spark, d) -> tuple[DataFrame, existence.Filter]:
    keys = _short_keys(spark, d)
    return keys, existence.build_filter(keys, SALT)


def bloom_bits(spark, d):
    keys = _short_keys(spark, d)
    n = keys.count()
    return existence.bit_rows(keys, SALT, filter_keys(n), optimal_bits(n)).select(_hex("key"), "bit")


def bloom_word_or(spark, d):
    return _short_filter(spark, d)[1].words


def bloom_contains(spark, d):
    """All keys of the filter and as many that are not in it: which may be there."""
    keys, f = _short_filter(spark, d)
    others = table(spark, d, "events").where("user_id is not null").select(_key("x", F.col("user_id"), 7).alias("key")).distinct()
    return existence.contains(keys.unionByName(others), f, SALT).select(_hex("key"), "maybe")


def salt_validate(spark, d):
    """Whether the filter holds 64 evenly spaced keys: under its salt and under another."""
    keys, f = _short_filter(spark, d)
    samples = existence.sample_keys(domain.with_ordinals(keys), existence.VALIDATE_KEYS)
    return spark.createDataFrame([(s, existence.validate_salt(samples, f, s)) for s in (SALT, SALT + 1)], "salt long, valid boolean")


def find_salt(spark, d):
    """The least salt under which the filter holds sixteen of its keys; it lies beyond the first batch of salts tried."""
    keys = _short_keys(spark, d)
    f = existence.build_filter(keys, FOUND_SALT)
    sample = [bytes(r.key) for r in existence.sample_keys(domain.with_ordinals(keys), existence.SEARCH_KEYS).collect()]
    return spark.createDataFrame([(existence.find_salt(spark, sample, f, chunk=FOUND_CHUNK),)], "salt long")


def salt_file(spark, d):
    """A salt read back from a file of it."""
    from palimpsest.sources import files

    path = new_path(spark, "salt") + "/salt-state.txt"
    files.publish(path, FILE_SALT.to_bytes(4, "big") + b"more")
    found = [("whole", existence.salt_from_file(spark, path)), ("missing", existence.salt_from_file(spark, path + ".none"))]
    return spark.createDataFrame(found, "file string, salt long")


def murmur3_long_keys(spark, d):
    """Keys of 22 bytes: a block and a rest."""
    keys = table(spark, d, "events").where("user_id is not null").select(F.concat(_key("u", F.col("user_id"), 10), _key("v", F.col("user_id"), 10)).alias("key")).distinct()
    return keys.select(_hex("key"), murmur3(F.col("key"), SALT).alias("h1"))


# Patterns


def ngram_top_patterns(spark, d):
    """The dictionary: every length, as many patterns as it takes at most."""
    return ngrams.mine(_words(spark, d)).select(_hex("ngram"), "uses", "score")


def ngram_top_all_lengths(spark, d):
    """The best patterns of all lengths of the dictionary."""
    return ngrams.mine(_words(spark, d), most=100).select(_hex("ngram"), "uses", "score")


def _cover(spark, d) -> tuple[DataFrame, DataFrame]:
    """All words, and where the patterns mined from the sampled words cover them."""
    words = _words(spark, d)
    patterns = [bytes(r.ngram) for r in ngrams.mine(ngrams.sample_words(words)).orderBy(F.desc("score"), "ngram").collect()]
    return words, materialize(ngrams.cover_words(words, patterns), "cover")


def greedy_cover(spark, d):
    return _cover(spark, d)[1]


def pattern_usage(spark, d):
    return ngrams.pattern_usage(_cover(spark, d)[1])


def distance_histogram(spark, d):
    return ngrams.distance_histogram(*_cover(spark, d))


def huffman_depths(spark, d):
    return ngrams.code_depths(length_histogram(spark, d))


# Writing and reading again


def write_and_inspect(spark, d):
    base = new_path(spark, "domain") + "/v1.1-orders.0-16"
    domain.write_domain(orders_domain(spark, d), base, salt=SALT)
    about = domain.inspect(spark, base).withColumn("has_bytes", F.col("file_bytes") > F.col("logical_bytes") / 100)
    return about.select("name", "step_from", "step_to", "words_count", "empty_words_count", "key_count", "logical_bytes", "fanout", "filter_kind", "filter_accelerates", "salt", "has_bytes")


def _compared(source: DataFrame, again: DataFrame) -> DataFrame:
    """Rows of both, and rows of either that the other lacks."""
    parts = [source.select(F.lit(1).alias("s"), F.lit(0).alias("a"), F.lit(0).alias("x")), again.select(F.lit(0), F.lit(1), F.lit(0)), lookup.multiset_difference(source, again).select(F.lit(0), F.lit(0), F.lit(1))]
    rows = parts[0].union(parts[1]).union(parts[2])
    return rows.agg(F.sum("s").alias("source_rows"), F.sum("a").alias("read_rows"), F.sum("x").alias("differing"))


def recode_identity(spark, d):
    """A written and re-read domain against its source: as many rows, and none differs."""
    base = new_path(spark, "domain") + "/v1.1-orders.0-16"
    source = orders_domain(spark, d)
    domain.write_domain(source, base)
    return _compared(source, domain.read_domain(spark, base).select("key", "value"))


def codec_round_trip(spark, d):
    """The same through the foreign file format, all its files compressed."""
    source = orders_domain(spark, d)
    return _compared(source, _foreign(spark, source, compress="true", salt=str(SALT)).select("key", "value"))


# Lookups in written domains


def _written_orders(spark, d, salt: int | None = None) -> str:
    base = new_path(spark, "domain") + "/v1.1-orders.0-16"
    domain.write_domain(orders_domain(spark, d), base, salt=salt)
    return base


def domain_get(spark, d):
    """A present and an absent key by point lookups that reach the scan."""
    kv = domain.read_pairs(spark, _written_orders(spark, d))
    return _shown(kv.where(F.col("key").isin(b"o0000000042", b"nothing")))


def domain_range(spark, d):
    return _shown(lookup.key_range(domain.read_pairs(spark, _written_orders(spark, d)), b"o0000000100", b"o0000000200"))


def domain_prefix(spark, d):
    return _shown(lookup.prefix_scan(domain.read_pairs(spark, _written_orders(spark, d)), b"o00000001"))


def domain_nth(spark, d):
    """Keys by ordinal: only their row groups are read."""
    return domain.pairs_at(spark, _written_orders(spark, d), [0, 5, 777]).select(_hex("key"), _hex("value"), "ordinal")


def domain_ordinals(spark, d):
    """Ordinals and logical offsets as a written domain has them."""
    return domain.read_domain(spark, _written_orders(spark, d)).select(_hex("key"), "ordinal", "logical_offset")


def domain_batch_get(spark, d):
    probes = table(spark, d, "lineitem").select(_key("o", F.col("l_orderkey") * 3, 10).alias("key")).distinct()
    return _shown(lookup.get_many(probes, domain.read_pairs(spark, _written_orders(spark, d))))


def domain_nodes(spark, d):
    """The written index of every 256th key."""
    return spark.read.parquet(_written_orders(spark, d) + ".bt/nodes").select(_hex("key"), "ordinal", "logical_offset")


def _write_runs(spark, runs: list[Run], salt: int | None = None) -> str:
    """Each run as a domain in one folder; a few are written at once."""
    base = new_path(spark, "runs")
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda r: domain.write_domain(r.pairs, f"{base}/{r.name[:-3]}", salt=salt), runs))
    return base


def _written_buyers(spark, d) -> Stack:
    return Stack.open_dir(spark, _write_runs(spark, buyer_runs(spark, d), SALT), "buyers", salt=SALT)


def stack_get(spark, d):
    """Single keys, newest run first, filters asked: a few present ones, a deleted or an absent one."""
    stack = _written_buyers(spark, d)
    keys = [b"c%08d" % i for i in (0, 1, 2, 42, 77)] + [b"nothing"]
    found = [(k.hex(), v.hex()) for k in keys if (v := stack.get(k)) is not None]
    return spark.createDataFrame(found, "key_hex string, value_hex string")


def stack_written(spark, d):
    """The stack of written runs resolved by delete vectors."""
    return _shown(_written_buyers(spark, d).resolve())


def stack_shape(spark, d):
    stack = _written_buyers(spark, d)
    return spark.createDataFrame([(len(stack), stack.is_empty(), stack.bloom_count(), stack.salt)], "runs long, empty boolean, filters_in_use long, salt long")


def stack_find(spark, d):
    """A stack whose salt is not known: found in its oldest run, checked against each, and used."""
    base = _write_runs(spark, buyer_runs(spark, d), SALT)
    stack = Stack.open_dir(spark, base, "buyers", salt="find", search_limit=1 << 12)
    unknown = Stack.open_dir(spark, base, "buyers")
    return spark.createDataFrame([("find", stack.salt, stack.bloom_count()), ("none", unknown.salt, unknown.bloom_count())], "policy string, salt long, filters_in_use long")


def stack_readers(spark, d):
    """The readers of a written stack, oldest first, with what each is made of."""
    stack = _written_buyers(spark, d)
    found = [(r.name, i, *r.steps, r.filters, r.salt) for i, r in enumerate(stack.runs)]
    return spark.createDataFrame(found, "name string, rank long, step_from long, step_to long, filter_in_use boolean, salt long")


def rejected_writes(spark, d):
    """What a write does with rows that are no domain: a repeated key, a null key, and no runs to merge."""
    from palimpsest.operators.merge import merge
    from palimpsest.operators.stack import StackError

    items = table(spark, d, "lineitem").select(_key("l", F.col("l_orderkey"), 10).alias("key"), F.lit(b"v").alias("value"))
    nulls = orders_domain(spark, d).select(F.when(F.col("key") != F.lit(b"o0000000000"), F.col("key")).alias("key"), "value")
    found = []
    for case, work in (("repeated", lambda p: domain.write_domain(items, p)), ("null", lambda p: domain.write_domain(nulls, p)), ("no runs", lambda p: merge([], p))):
        path = new_path(spark, "rejected") + "/v1.1-x.0-1"
        try:
            work(path)
            found.append((case, "written"))
        except (domain.DomainError, StackError) as e:
            found.append((case, type(e).__name__))
    return spark.createDataFrame(found, "case string, result string")


# Foreign files


def _foreign(spark, source: DataFrame, path: str | None = None, parts: int = 8, **options: str) -> DataFrame:
    from palimpsest.sources import kvseg

    kvseg.register(spark)
    path = path or new_path(spark, "kvseg")
    source.repartitionByRange(parts, "key").sortWithinPartitions("key").write.format("kvseg").options(**options).mode("append").save(path)
    return spark.read.format("kvseg").load(path)


def _foreign_orders(spark, d, **options: str) -> str:
    """All orders as one triple; its path."""
    path = new_path(spark, "kvseg")
    _foreign(spark, orders_domain(spark, d), path, 1, name="v1.1-orders.0-16", salt=str(SALT), **options)
    return f"{path}/v1.1-orders.0-16.kv"


def foreign_scan(spark, d):
    """Pairs of a compressed file, read in parts split at keys by its index."""
    path = _foreign_orders(spark, d, compress="true")
    return _shown(spark.read.format("kvseg").option("splitBytes", str(1 << 16)).load(path))


def foreign_words(spark, d):
    """The word stream of a file: keys and values in turn by their place."""
    return spark.read.format("kvseg").option("words", "true").load(_foreign_orders(spark, d)).select("pos", _hex("word"))


def foreign_cursor(spark, d):
    """A walk by cursor: each word's place and length, the bytes of every other word only passed over."""
    import pyarrow as pa

    from palimpsest.sources import triples

    def walk(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                c, rows = triples.TripleReader(path).cursor(), []
                while c.has_next():
                    at = c.offset
                    n = len(c.next()) if len(rows) % 2 == 0 else c.skip()
                    after = c.offset
                    c.reset(at)
                    same = c.skip() == n and c.offset == after
                    rows.append((len(rows), n, same))
                yield pa.record_batch([pa.array(list(x)) for x in zip(*rows)], names=["pos", "length", "same"])

    return spark.createDataFrame([(_foreign_orders(spark, d, compress="true"),)], "path string").mapInArrow(walk, "pos long, length long, same boolean")


def _foreign_get(spark, d, with_index: bool) -> DataFrame:
    import pyarrow as pa

    from palimpsest.sources import files, triples

    path = _foreign_orders(spark, d)
    if not with_index:
        files.remove(path.removesuffix(".kv") + ".bt")

    def find(batches):
        reader = triples.TripleReader(path)
        reader.enable_bloom(SALT)
        for batch in batches:
            yield pa.record_batch([batch.column(0), reader.get_many(batch.column(0)), pa.array([reader.bloom_active] * len(batch))], names=["key", "value", "filtered"])

    # A lookup without an index is a scan up to the key, so of those there are fewer, and in order they share one.
    every = 1 if with_index else 500
    keys = table(spark, d, "orders").where(F.col("o_orderkey") % every == 0).select(_key("o", F.col("o_orderkey") * 2, 10).alias("key"))
    ordered = (keys.repartitionByRange("key") if with_index else keys.repartition(1)).sortWithinPartitions("key")
    return _shown(ordered.mapInArrow(find, "key binary, value binary, filtered boolean"), "filtered")


def foreign_get_indexed(spark, d):
    """Each probe by filter and binary search of the index."""
    return _foreign_get(spark, d, True)


def foreign_get_scanned(spark, d):
    """Probes by filter and ordered scan with an early end, as in a file without an index."""
    return _foreign_get(spark, d, False)


def foreign_headers(spark, d):
    """Headers of the same words under each version of the header and each index layout."""
    from palimpsest.sources import files, triples

    path = _foreign_orders(spark, d)
    folder, body = path.rpartition("/")[0], files.read(path)
    for name, lead in (("paged.0-1.kv", b"\x01\x01\x10"), ("plain.0-1.kv", b"\x01\x00")):
        files.publish(f"{folder}/{name}", lead + body)
    triples.build_index(f"{folder}/paged.0-1.kv", f"{folder}/paged.0-1.bt", layout="legacy")
    triples.build_index(f"{folder}/plain.0-1.kv", f"{folder}/plain.0-1.bt", fanout=64)
    about = triples.inspect_files(spark, folder)
    return about.select("name", "step_from", "step_to", "version", "page_values_count", "words_count", "empty_words_count", "key_count", "fanout", "filter_kind", "sorted")


def foreign_metadata(spark, d):
    """A file with metadata before its header, read with the option that says so."""
    from palimpsest.sources import files

    path = _foreign_orders(spark, d)
    out = path.rpartition("/")[0] + "/with/v1.1-meta.0-1.kv"
    files.publish(out, b"\x01\x00" + (5).to_bytes(4, "big") + b"about" + files.read(path))
    return _shown(spark.read.format("kvseg").option("hasMetadata", "true").load(out))


def foreign_filter(spark, d):
    """The foreign existence filter: which of as many present and absent keys may be there."""
    from palimpsest.sources import triples

    keys = _short_keys(spark, d)
    path = new_path(spark, "kvseg")
    _foreign(spark, keys.withColumn("value", F.lit(b"v")), path, 1, name="v1.1-short.0-1", salt=str(SALT))
    run = triples.foreign_run(spark, f"{path}/v1.1-short.0-1.kv")
    others = table(spark, d, "events").where("user_id is not null").select(_key("x", F.col("user_id"), 7).alias("key")).distinct()
    return existence.contains(keys.unionByName(others), run.filter, SALT).select(_hex("key"), "maybe")


def foreign_stack(spark, d):
    """Runs as foreign triples, opened as a stack from their folder, their batch lookup."""
    from palimpsest.sources import triples

    folder = new_path(spark, "kvseg")
    for r in buyer_runs(spark, d):
        triples.write_named(r.pairs, folder, r.name[:-3], MergeOptions(salt=SALT))
    probes = table(spark, d, "customer").select(_key("c", F.col("c_custkey") * 2, 8).alias("key")).distinct()
    return _shown(triples.foreign_stack(spark, folder, "buyers", salt=SALT).get_many(probes))


def foreign_merge(spark, d):
    """Foreign runs merged into a triple of its own name, whose range starts at 0, and that read."""
    from palimpsest.sources import triples

    folder = new_path(spark, "kvseg")
    for r in user_runs(spark, d):
        triples.write_named(r.pairs, folder, r.name[:-3])
    triples.merge_triples(triples.foreign_stack(spark, folder, "users").runs, f"{folder}/merged", "v1.1-users.0-1000", MergeOptions(compress=True, salt=SALT))
    return _shown(spark.read.format("kvseg").load(f"{folder}/merged/v1.1-users.0-1000.kv"))


def word_files(spark, d):
    """Words written one by one, a file a task, under a name only once they are whole, and read again."""
    import pyarrow as pa

    from palimpsest.sources import files, kvseg, triples

    kvseg.register(spark)
    folder = new_path(spark, "words")

    def write(batches):
        from pyspark import TaskContext

        files.make_folder(folder)
        writer = triples.WordWriter(f"{folder}/{TaskContext.get().partitionId():05d}.kv")
        for batch in batches:
            for word in batch.column(0).to_pylist():
                writer.add(word)
        writer.finish()
        yield pa.record_batch([pa.array([writer.words_count])], names=["n"])

    told = _words(spark, d).repartition(4).select("word").mapInArrow(write, "n long").agg(F.sum("n")).first()[0]
    read = spark.read.format("kvseg").option("words", "true").load(folder)
    left = sum(not n.endswith(".kv") for n in files.names(folder))
    return read.groupBy(_hex("word")).agg(F.count("*").alias("copies")).select("word_hex", "copies", F.lit(told).cast("long").alias("written"), F.lit(left).cast("long").alias("left_over"))


def stream_upserts(spark, d):
    """The change feed as a stream of micro-batches into a table with delete vectors: its final state."""
    from palimpsest.operators.changes import VersionedTable
    from palimpsest.streaming.upserts import stream_into

    feed = table(spark, d, "kv_changes")
    source = new_path(spark, "stream-source")
    feed.repartition(3).write.parquet(source)
    held = VersionedTable(spark, None, ["domain_name", "key"], ["step", "txn", "change_id"])
    stream = spark.readStream.schema(feed.schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = stream_into(stream, held, new_path(spark, "stream-checkpoint"))
    query.awaitTermination()
    return held.read().select("domain_name", _hex("key"), "change_id")


def merge_written(spark, d):
    """Runs written as domains, opened as a stack from their folder, merged into a new domain, and that read."""
    from palimpsest.operators.merge import merge

    base = _write_runs(spark, user_runs(spark, d))
    out = merge(Stack.open_dir(spark, base, "users").runs, new_path(spark, "merged") + "/v1.1-users.0-1000")
    return _shown(spark.read.parquet(out.kv))


def stack_filtered_get_many(spark, d):
    """The lookups of stack_get_many on written runs, whose filters leave out what a run cannot have."""
    base = _write_runs(spark, buyer_runs(spark, d), SALT)
    probes = table(spark, d, "customer").select(_key("c", F.col("c_custkey") * 2, 8).alias("key")).distinct()
    return _shown(Stack.open_dir(spark, base, salt=SALT).get_many(probes))


def uvarints(spark, d):
    """Each order's key as a variable-length integer."""
    return table(spark, d, "orders").select("o_orderkey", F.lower(F.hex(uvarint_column(F.col("o_orderkey")))).alias("code"))


def uvarints_read(spark, d):
    """Codes of large numbers read again, each cut short by a byte as well."""
    number = F.col("o_orderkey") * 1_000_003
    code = table(spark, d, "orders").select("o_orderkey", number.alias("number"), uvarint_column(number).alias("code"))
    cut = F.expr("substring(code, 1, octet_length(code) - 1)")
    return code.select("o_orderkey", "number", read_uvarint_column(F.col("code")).alias("again"), read_uvarint_column(cut).alias("cut"))


def elias_fano_offsets(spark, d):
    """The logical offsets, a monotone sequence for every 4096 keys, encoded and read again."""
    offsets = domain.with_ordinals(orders_domain(spark, d), with_offsets=True).select("ordinal", "logical_offset")
    return monotone_round_trip(offsets, "ordinal", "logical_offset", 4096)


def elias_fano_get(spark, d):
    """Single offsets of the encoded sequences, each found by its jump entry."""
    offsets = domain.with_ordinals(orders_domain(spark, d), with_offsets=True).select("ordinal", "logical_offset")
    wanted = offsets.where("ordinal % 7 = 3").select("ordinal")
    return get_monotone(encode_monotone(offsets, "ordinal", "logical_offset", 4096), wanted, "ordinal", "logical_offset", 4096)


def select_bits(spark, d):
    """The place of the third set bit of each order's key; 64 where it has fewer."""
    return table(spark, d, "orders").select("o_orderkey", select64_column(F.col("o_orderkey"), 2).alias("place"))


def lockstep_positions(spark, d):
    """Positions at which the words and a copy of them differ: changed ones, and those where the copy has ended."""
    words = _words(spark, d)
    last = words.agg(F.max("pos")).first()[0]
    copy = words.where(F.col("pos") <= last - 3).withColumn("word", F.when(F.col("pos") % 1000 == 7, F.lit(b"other")).otherwise(F.col("word")))
    return lookup.lockstep_difference(words, copy).select("pos", _hex("left_word"), _hex("right_word"))


def foreign_inspect(spark, d):
    """What the headers of written foreign files add up to."""
    from palimpsest.sources import triples

    path = new_path(spark, "kvseg")
    _foreign(spark, orders_domain(spark, d), path)
    about = triples.inspect_files(spark, path)
    return about.agg(
        F.sum("words_count").alias("words_count"), F.sum("empty_words_count").alias("empty_words_count"), F.sum("key_count").alias("key_count"), F.bool_and("sorted").alias("sorted"), F.count("error").alias("errors")
    )


def stream_intervals(spark, d):
    """Periods and gaps of step_files as a stream of micro-batches: each entity's last state."""
    from palimpsest.streaming.upserts import stream_periods

    lo, hi = step_columns(F.col("name"))
    files = table(spark, d, "step_files").select("domain_name", F.when(hi.isNotNull(), F.coalesce("range_from", lo)).alias("lo"), hi.alias("hi")).where("lo < hi")
    source, out = new_path(spark, "stream-source"), new_path(spark, "stream-periods")
    files.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(files.schema).option("maxFilesPerTrigger", 1).parquet(source)
    append = lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("append").parquet(out)
    query = stream_periods(stream, "domain_name", "lo", "hi").writeStream.outputMode("update").foreachBatch(append)
    query.option("checkpointLocation", new_path(spark, "stream-checkpoint")).trigger(availableNow=True).start().awaitTermination()
    last = spark.read.parquet(out).groupBy("domain_name").agg(F.max_by(F.struct("period_from", "period_to", "gap_from", "gap_to"), "batch").alias("s"))
    parts = [last.select(F.lit(k).alias("kind"), "domain_name", F.explode(F.arrays_zip(f"s.{k}_from", f"s.{k}_to")).alias("x")).select("kind", "domain_name", F.col(f"x.{k}_from").alias("step_from"), F.col(f"x.{k}_to").alias("step_to")) for k in ("period", "gap")]
    return parts[0].unionByName(parts[1])


QUERIES = {
    f.__name__: f
    for f in (
        scan_pairs, point_get, get_absent, batch_get, key_range, prefix_scan, first_rows, stack_newest_wins, stack_buyers, stack_get_many, merge_keep,
        merge_drop_from_zero, merge_buyers_range_from, as_of_step, override_antijoin, shared_keys, semi_exists, anti_missing, files_key_counts, union_key_count,
        smallest_run, smallest_by_bytes, ordinals, nth_key, every_mth_key, offsets_prefix_sum, evenly_spaced_sample, stride_sample, order_violations, repeated_keys,
        inspect_counts, length_histogram, step_names, murmur3_h1, murmur3_long_keys, bloom_bits, bloom_word_or, bloom_contains, salt_validate, find_salt, salt_file,
        ngram_top_patterns, ngram_top_all_lengths, greedy_cover, pattern_usage, distance_histogram, huffman_depths, write_and_inspect, recode_identity,
        codec_round_trip, domain_get, domain_range, domain_prefix, domain_nth, domain_ordinals, domain_batch_get, domain_nodes, stack_get, stack_written, stack_shape, stack_find, stack_readers,
        rejected_writes, foreign_scan, foreign_words, foreign_cursor, foreign_get_indexed, foreign_get_scanned, foreign_headers, foreign_metadata, foreign_filter,
        foreign_stack, foreign_merge, word_files, stream_upserts, merge_written, stack_filtered_get_many, uvarints, uvarints_read, elias_fano_offsets, elias_fano_get,
        select_bits, lockstep_positions, foreign_inspect, stream_intervals,
    )
}
