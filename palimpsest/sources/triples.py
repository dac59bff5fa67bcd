"""Reading and writing single files of the foreign triple, and Spark tables over many of them."""

from __future__ import annotations

from array import array
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from palimpsest.functions.steps import step_range
from palimpsest.operators.existence import SALTS, SEARCH_KEYS, SLICE_WORDS, VALIDATE_KEYS, Filter, find_salt
from palimpsest.operators.merge import MergeOptions, merge_runs
from palimpsest.operators.stack import Run, Stack
from palimpsest.sources import files, kvseg


class Cursor:
    """A place among the words of a file."""

    def __init__(self, file: kvseg.WordFile):
        self.file, self.offset = file, 0

    def reset(self, offset: int = 0) -> None:
        self.offset = offset

    def has_next(self) -> bool:
        return self.offset < len(self.file.data)

    def next(self) -> bytes:
        word, self.offset = self.file.word(self.offset)
        return word

    def skip(self) -> int:
        """Moves past a word without putting it together; its length."""
        n, self.offset = self.file.skip(self.offset)
        return n


class TripleReader:
    """A .kv with the .bt and .kvei beside it, where they are there; all are read a block at a time, as asked for."""

    def __init__(self, path: str, has_metadata: bool = False):
        self.path, self.name = path, files.name(path)
        self.words = kvseg.WordFile.open(path, has_metadata)
        base = path.removesuffix(".kv")
        self.index = kvseg.IndexFile.parse(files.Blocks(f"{base}.bt")) if files.exists(f"{base}.bt") else None
        self.filter = kvseg.FilterFile.parse(files.Blocks(f"{base}.kvei")) if files.exists(f"{base}.kvei") else None
        self.salt: int | None = None
        self.scan: kvseg.OrderedScan | None = None

    @property
    def bloom_active(self) -> bool:
        return self.salt is not None

    @property
    def key_count(self) -> int:
        return self.index.key_count if self.index is not None else self.words.words_count // 2

    def pairs(self) -> Iterator[tuple[bytes, bytes]]:
        return self.words.pairs()

    def cursor(self) -> Cursor:
        return Cursor(self.words)

    def sample_keys(self, n: int) -> list[bytes]:
        """Evenly spaced keys by the index, else the first ones."""
        if self.index is None:
            return [k for (_, k), _ in zip(self.words.keys(), range(n))]
        count = self.index.key_count
        n = min(n, count)
        return [self.words.word(self.index.key_offset(i * count // n))[0] for i in range(n)]

    def enable_bloom(self, salt: int) -> bool:
        """Uses the filter with ``salt`` if it holds every sampled key; else, or without a key, things stay as they were."""
        if self.filter is None or not self.filter.accelerates:
            return False
        keys = self.sample_keys(VALIDATE_KEYS)
        if not keys or not self.filter.contains(keys, salt).all():
            return False
        self.salt = salt
        return True

    def get(self, key: bytes) -> bytes | None:
        """Filter, then binary search by the index, or a scan up to the key's place."""
        if self.salt is not None and not self.filter.contains([key], self.salt)[0]:
            return None
        if self.index is not None:
            return kvseg.search(self.words, self.index, key)
        for k, v in self.pairs():
            if k >= key:
                return v if k == key else None
        return None

    def get_many(self, keys: pa.Array) -> pa.Array:
        """What ``get`` has of each key, null where it has none.  Keys in order, in one call after another, share their scan."""
        keys = keys.cast(pa.large_binary())
        asked = keys.drop_null()
        if self.salt is not None:
            asked = asked.filter(pa.array(self.filter.contains(asked, self.salt)))
        asked = asked.unique()
        asked = asked.take(pc.sort_indices(asked))
        if self.index is not None:
            asked, found = kvseg.search_many(self.words, self.index, asked)
        else:
            self.scan = self.scan or kvseg.OrderedScan(self.words)
            asked, found = self.scan.find(asked)
        return found.take(pc.index_in(keys, value_set=asked)).cast(pa.binary())


class WordWriter:
    """Words one by one into a .kv file; nothing is under its name before ``finish``, and nothing left when given up.

    Words wait in a spool beside the target, so memory does not grow with them.
    """

    def __init__(self, path: str, compress: bool = False):
        self.path, self.compress = path, compress
        self.spool = kvseg.Spool(path)

    @property
    def words_count(self) -> int:
        return self.spool.count

    def add(self, word: bytes) -> None:
        self.spool.add(bytes(word))

    def finish(self) -> None:
        try:
            self.spool.write_to(self.path, self.compress)
        finally:
            self.abandon()

    def abandon(self) -> None:
        self.spool.remove()

    def __enter__(self) -> WordWriter:
        return self

    def __exit__(self, *_) -> None:
        self.abandon()


def build_index(kv: str, out: str, layout: str = "footer", fanout: int = kvseg.DEFAULT_FANOUT, magic: bytes = bytes(8)) -> int:
    """Writes the index of a .kv file; its number of keys."""
    file, notes, offsets = kvseg.WordFile.open(kv, block=1 << 22), kvseg.KeyNotes(fanout), array("q")
    for offset, key in file.keys():
        notes.add(key)
        offsets.append(offset)
    files.write(out, kvseg.index_of(offsets, notes.nodes, file.size, layout, notes.fanout, magic))
    return notes.count


def build_filter(kv: str, salt: int, out: str) -> None:
    """Writes the existence filter of a .kv file."""
    notes = kvseg.KeyNotes(salt=salt)
    for _, key in kvseg.WordFile.open(kv, block=1 << 22).keys():
        notes.add(key)
    files.write(out, notes.filter_file())


_ABOUT = (
    "name string, step_from long, step_to long, version int, page_values_count int, words_count long, empty_words_count long, file_bytes long, "
    "key_count long, fanout long, filter_kind string, sorted boolean, error string"
)


@dataclass
class _Report:
    has_metadata: bool

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split(" ")[0] for c in _ABOUT.split(", ")]
        for batch in batches:
            rows = [dict(zip(names, self.about(p))) for p in batch.column(0).to_pylist()]
            if rows:
                types = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
                schema = pa.schema([(c.split(" ")[0], types[c.split(" ")[1]]) for c in _ABOUT.split(", ")])
                yield pa.RecordBatch.from_pylist(rows, schema)

    def about(self, path: str) -> tuple:
        steps = step_range(files.name(path)) or (None, None)
        try:
            r = TripleReader(path, self.has_metadata)
            last, rising = None, True
            for _, k in r.words.keys():
                rising, last = rising and (last is None or last < k), k
        except (kvseg.FormatError, OSError) as e:
            return (files.name(path), *steps, *[None] * 9, str(e))
        w = r.words
        kind = r.filter.kind if r.filter else None
        return (r.name, *steps, w.version, w.page_values_count, w.words_count, w.empty_words_count, w.size, r.key_count, r.index and r.index.fanout, kind, rising, None)


def inspect_files(spark: SparkSession, path: str, has_metadata: bool = False) -> DataFrame:
    """A row for each .kv of a file or folder; a file that cannot be read has only its name and ``error``."""
    found = files.with_ending(path, ".kv")
    return spark.createDataFrame([(f,) for f in found], "path string").repartition(max(1, len(found))).mapInArrow(_Report(has_metadata), _ABOUT)


def _filter(spark: SparkSession, path: str) -> Filter | None:
    """A .kvei file as a table of words, which tasks read, a slice each."""
    if not files.exists(path):
        return None
    f = kvseg.FilterFile.parse(files.Blocks(path))
    if not f.accelerates:
        return Filter(None, 0, (0, 0, 0), f.kind)
    step, n = SLICE_WORDS, -(-f.m // 64)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = kvseg.FilterFile.parse(files.Blocks(path, block=8 * step, keep=2))
        for batch in batches:
            for number in batch.column(0).to_pylist():
                at, bits = own.word_rows(number * step, min(n, (number + 1) * step))
                yield pa.record_batch([pa.array(at), pa.array(bits)], names=["word", "bits"])

    slices = -(-n // step)
    return Filter(spark.range(0, slices, 1, min(slices, 4 * spark.sparkContext.defaultParallelism)).mapInArrow(work, "word long, bits long"), f.m, f.keys)


def foreign_run(spark: SparkSession, path: str, has_metadata: bool = False) -> Run:
    """A .kv file as a run of a stack, with its filter.  That its keys are unique is not known."""
    kvseg.register(spark)
    pairs = spark.read.format("kvseg").option("hasMetadata", str(has_metadata).lower()).load(path).select("key", "value")
    samples = lambda n: spark.createDataFrame([(k,) for k in TripleReader(path, has_metadata).sample_keys(n)], "key binary")
    return Run(files.name(path), pairs, _filter(spark, path.removesuffix(".kv") + ".kvei"), unique=False, samples=samples)


def foreign_stack(spark: SparkSession, folder: str, name_filter: str = "", salt: int | str | None = None, **limits: int) -> Stack:
    """The .kv files of a folder whose names contain ``name_filter`` as a stack."""
    return Stack([foreign_run(spark, p) for p in files.with_ending(folder, ".kv") if name_filter in files.name(p)], salt, **limits)


def write_named(df: DataFrame, folder: str, name: str, options: MergeOptions | None = None, layout: str = "footer", parts: int = 1) -> None:
    """Writes ``df`` (key, value in any order) as ``<name>.kv``, ``.bt`` and, with a salt, ``.kvei``.

    One file is one task's work.  With ``parts``, key ranges are written as
    ``<name>.p<number>.kv``, whose names have the same step range.
    """
    options = options or MergeOptions()
    kvseg.register(df.sparkSession)
    rows = df.select("key", "value").repartitionByRange(parts, "key").sortWithinPartitions("key")
    writer = rows.write.format("kvseg").option("name", name).option("compress", str(options.compress).lower()).option("layout", layout).option("fanout", str(options.fanout))
    (writer if options.salt is None else writer.option("salt", str(options.salt))).mode("append").save(folder)


def merge_triples(runs: Sequence[Run], folder: str, name: str, options: MergeOptions | None = None, layout: str = "footer", parts: int = 1) -> None:
    """Runs merged, newest wins, into a triple of the given name, whose step range says whether deletions are dropped."""
    write_named(merge_runs(runs, f"{name}.kv", options), folder, name, options, layout, parts)


def search_salt(spark: SparkSession, reader: TripleReader, limit: int = SALTS) -> int | None:
    """The least salt that holds for a triple's sampled keys; none without a usable filter."""
    held = _filter(spark, reader.path.removesuffix(".kv") + ".kvei")
    return None if held is None else find_salt(spark, reader.sample_keys(SEARCH_KEYS), held, limit=limit)
