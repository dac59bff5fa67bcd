"""Existence filters: built, probed and saved as tables of 64-bit words; salts checked and found.

A filter answers "certainly absent" or "perhaps there".  It never misses a key.
"""

from __future__ import annotations

import json
from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.hashing import bit_positions, bits_of, filter_keys, murmur3_array, murmur3_h1, murmur3_rows, optimal_bits
from palimpsest.session import exists, materialize, new_path
from palimpsest.sources import files

#: Filters up to this many words (32 MB, some 28 million keys) are broadcast to probe; of larger ones every
#: probe meets its three words by a join, which shuffles 3 rows of 24 bytes a probe and the filter once.
BROADCAST_WORDS = 4 << 20
#: 64-bit words of a slice of a shared filter (4 MB), slices a worker keeps, and salts it tries at once.
SLICE_WORDS, HELD_SLICES, CHUNK = 1 << 19, 16, 1 << 20
#: Sampled keys a salt must all find to be believed, and those the search tries.
VALIDATE_KEYS, SEARCH_KEYS = 64, 16
SALTS = 1 << 32
_META, _WORD_ROWS = "kind string, m long, keys string, salt long", "word long, bits long"


@dataclass
class Filter:
    """Words of a filter and what is needed to probe it.  kind: bloom, or empty (matches all)."""

    words: DataFrame | None
    m: int
    keys: tuple[int, ...]
    kind: str = "bloom"
    salt: int | None = None


def bit_rows(keys: DataFrame, salt: int, mixed: tuple[int, ...], m: int, key: str = "key") -> DataFrame:
    return keys.select(key, F.explode(bits_of(F.col(key), salt, mixed, m)).alias("bit"))


def word_rows(bits: DataFrame) -> DataFrame:
    """``word, bits``: the words that have a bit set, by map-side OR."""
    one = F.expr("shiftleft(1L, cast(bit % 64 as int))")
    return bits.groupBy(F.expr("bit div 64").alias("word")).agg(F.bit_or(one).alias("bits"))


def build_filter(keys: DataFrame, salt: int, key: str = "key", count: int | None = None) -> Filter:
    """A filter for the keys of a table; below two keys it is empty and matches all."""
    n = keys.count() if count is None else count
    if n < 2:
        return Filter(None, 0, (0, 0, 0), "empty", salt)
    m, mixed = max(2, optimal_bits(n)), filter_keys(n)
    return Filter(word_rows(bit_rows(keys, salt, mixed, m, key)), m, mixed, "bloom", salt)


def contains(probes: DataFrame, f: Filter, salt: int, key: str = "key", out: str = "maybe") -> DataFrame:
    """Adds ``out``: false where the key is certainly absent.  Null keys are absent."""
    if f.kind != "bloom":
        return probes.withColumn(out, F.lit(True))
    n_words = -(-f.m // 64)
    if n_words <= BROADCAST_WORDS:
        table = np.zeros(n_words, np.uint64)
        for batch in f.words.toArrow().to_batches(1 << 16):
            table[batch.column(0).to_numpy()] = batch.column(1).to_numpy().view(np.uint64)
        shared = probes.sparkSession.sparkContext.broadcast(table)
        mixed, m = f.keys, f.m

        @F.arrow_udf("boolean")
        def probe(values: pa.Array) -> pa.Array:
            bits = bit_positions(murmur3_array(values, salt), mixed, m)
            hit = ((shared.value[bits >> 6] >> (bits & 63).astype(np.uint64)) & np.uint64(1)).all(1)
            return pa.array(hit & ~np.asarray(values.is_null()))

        return probes.withColumn(out, probe(F.col(key)))
    # Too large to send around: every probe meets its three words by a join.
    ids = materialize(probes.withColumn("__id", F.monotonically_increasing_id()), "probes")
    bits = ids.select("__id", F.explode(bits_of(F.col(key), salt, f.keys, f.m)).alias("bit")).withColumn("word", F.expr("bit div 64"))
    seen = bits.join(f.words, "word", "left").groupBy("__id").agg(F.bool_and(F.coalesce(F.expr("getbit(bits, cast(bit % 64 as int))") == 1, F.lit(False))).alias(out))
    return ids.join(seen, "__id", "left").drop("__id").withColumn(out, F.coalesce(F.col(out), F.lit(False)) & F.col(key).isNotNull())


def sample_keys(ordered: DataFrame, n: int) -> DataFrame:
    """``n`` evenly spaced keys of a table with ordinals: the ordinals floor(i * count / n)."""
    count = ordered.count()
    wanted = sorted({i * count // n for i in range(min(n, count))}) if count > n else list(range(count))
    return ordered.where(F.col("ordinal").isin(wanted)) if wanted else ordered.limit(0)


def validate_salt(samples: DataFrame, f: Filter, salt: int, key: str = "key") -> bool:
    """Whether the filter can leave keys out and holds every sampled key under ``salt``; no samples prove nothing."""
    if f.kind != "bloom":
        return False
    told = contains(samples, f, salt, key).agg(F.count("*").alias("n"), F.bool_and("maybe").alias("all")).first()
    return bool(told.n and told.all)


def share_words(f: Filter) -> str:
    """The filter's words as raw slices in the shared folder, each written by a task; a slice of no bits is missing."""
    path = new_path(f.words.sparkSession, "filter-slices")
    size = SLICE_WORDS

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = -1, np.zeros(0, np.uint64)
        for batch in batches:
            number, word, bits = (c.to_numpy() for c in batch.columns)
            for n in np.unique(number).tolist():
                if n != current:
                    if current >= 0:
                        files.publish(f"{path}/{current:08d}", held.tobytes())
                    current, held = n, np.zeros(size, np.uint64)
                at = number == n
                held[word[at] - n * size] = bits[at].view(np.uint64)
        if current >= 0:
            files.publish(f"{path}/{current:08d}", held.tobytes())
        yield pa.record_batch([pa.array([current])], names=["slice"])

    rows = f.words.select(F.expr(f"word div {size}").alias("slice"), "word", "bits").repartition("slice").sortWithinPartitions("slice")
    rows.mapInArrow(work, "slice long").write.format("noop").mode("overwrite").save()
    return path


def shared_bits(path: str, size: int) -> Callable[[np.ndarray], np.ndarray]:
    """For a task: whether each bit of an array is set; the slices, of ``size`` words, are read as they are met, in order."""
    held: OrderedDict[int, np.ndarray | None] = OrderedDict()
    have: set[str] = set()

    def is_set(bits: np.ndarray) -> np.ndarray:
        if not have:
            have.update(files.names(path))
        number = bits // (64 * size)
        out = np.zeros(bits.shape, bool)
        for n in np.unique(number).tolist():
            if n not in held:
                name = f"{n:08d}"
                held[n] = np.frombuffer(files.read(f"{path}/{name}"), np.uint64) if name in have else None
                if len(held) > HELD_SLICES:
                    held.popitem(last=False)
            if held[n] is not None:
                at = number == n
                inside = bits[at] - n * 64 * size
                out[at] = (held[n][inside >> 6] >> (inside & 63).astype(np.uint64)) & np.uint64(1) != 0
        return out

    return is_set


def find_salt(spark: SparkSession, keys: list[bytes], f: Filter, chunk: int = CHUNK, limit: int = SALTS, first_chunks: int = 8) -> int | None:
    """The least salt under which the filter holds all of ``keys`` (a few samples); none without keys or a usable filter.

    A filter of any size is searched alike: tasks read it slice by slice from the shared
    folder.  A task tries a chunk of salts at once, the first key's bits first, which
    one salt in fifty survives.  Salts are tried in batches of chunks, each twice the
    one before; the search stops after the first batch with a hit.
    """
    if f.kind != "bloom" or not keys:
        return None
    path, size, mixed, m = share_words(f), SLICE_WORDS, f.keys, f.m
    sample = [bytes(k) for k in keys[:SEARCH_KEYS]]

    def tried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_set = shared_bits(path, size)
        rows = [np.frombuffer(k, np.uint8)[None, :] for k in sample]
        for batch in batches:
            for number in batch.column(0).to_pylist():
                good = np.arange(number * chunk, min(limit, (number + 1) * chunk), dtype=np.int64)
                # The first key leaves few salts, so all bits of the others are asked for at once.
                for group in (rows[:1], rows[1:]):
                    if len(good) and group:
                        hashes = [murmur3_rows(np.broadcast_to(r, (len(good), r.shape[1])), good.astype(np.uint64)) for r in group]
                        bits = np.concatenate([bit_positions(h, mixed, m) for h in hashes], 1)
                        good = good[is_set(bits).all(1)]
                yield pa.record_batch([pa.array(good[:1], pa.int64())], names=["salt"])

    chunks, lo, step = -(-limit // chunk), 0, first_chunks
    while lo < chunks:
        hi = min(chunks, lo + step)
        tasks = min(hi - lo, 2 * spark.sparkContext.defaultParallelism)
        hit = spark.range(lo, hi, 1, tasks).mapInArrow(tried, "salt long").agg(F.min("salt")).first()[0]
        if hit is not None:
            return hit
        lo, step = hi, 2 * step
    return None


def may_have(f: Filter, salt: int, key: bytes) -> DataFrame | None:
    """The filter's words that one key needs, with the bits it needs of them; none for a filter that matches all."""
    if f.kind != "bloom":
        return None
    need: dict[int, int] = {}
    for bit in bit_positions(np.array([murmur3_h1(key, salt)], np.uint64), f.keys, f.m)[0].tolist():
        need[bit >> 6] = need.get(bit >> 6, 0) | 1 << (bit & 63)
    held = F.lit(False)
    for word, bits in need.items():
        signed = bits - 2**64 if bits >= 2**63 else bits
        held = held | ((F.col("word") == word) & (F.col("bits").bitwiseAND(F.lit(signed)) == F.lit(signed)))
    return f.words.where(F.col("word").isin(*need)).where(held).select(F.lit(len(need)).alias("need"))


def write_filter(keys: DataFrame, salt: int, path: str, count: int | None = None) -> Filter:
    """Saves a filter for ``keys``: its words in order, so that statistics find them, and one row of what is needed to probe it."""
    f = build_filter(keys, salt, count=count)
    spark = keys.sparkSession
    spark.createDataFrame([(f.kind, f.m, json.dumps(f.keys), salt)], _META).coalesce(1).write.parquet(f"{path}/meta")
    if f.words is not None:
        # A small filter is one file; a larger one is cut into ranges of words.
        ranges = f.words.coalesce(1) if -(-f.m // 64) <= SLICE_WORDS else f.words.repartitionByRange("word")
        ranges.sortWithinPartitions("word").write.parquet(f"{path}/words")
    return f


def filter_meta(spark: SparkSession, path: str) -> dict | None:
    return spark.read.schema(_META).parquet(f"{path}/meta").first().asDict() if exists(spark, f"{path}/meta") else None


def read_filter(spark: SparkSession, path: str) -> Filter | None:
    meta = filter_meta(spark, path)
    if meta is None:
        return None
    words = spark.read.schema(_WORD_ROWS).parquet(f"{path}/words") if meta["kind"] == "bloom" else None
    return Filter(words, meta["m"], tuple(json.loads(meta["keys"])), meta["kind"], meta["salt"])


def salt_from_file(spark: SparkSession, path: str) -> int | None:
    """A salt file's first four bytes, big-endian; none where it is missing or shorter."""
    if not exists(spark, path):
        return None
    content = spark.read.format("binaryFile").load(path).first().content
    return int.from_bytes(content[:4], "big") if len(content) >= 4 else None
