"""Many small files into fewer well-sized ones."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.steps import last_component, resolved_path, step_columns
from palimpsest.operators import existence
from palimpsest.operators.domain import DEFAULT_FANOUT, DomainPaths
from palimpsest.session import materialize, new_path
from palimpsest.sources import files
from palimpsest.sources.parquet_blocks import BlockError, describe, join_files

#: Bytes of a file to aim at; files below half of it are worth joining.
TARGET_BYTES = 128 << 20
#: Files that a task joins into one at most, whatever their size.
MOST_FILES = 20_000

_MANIFEST = "path string, files long, blocks long, rows long, bytes long, want_blocks long, want_rows long"
_LISTED = "path string, bytes long, is_folder boolean"
_DESCRIBED = "path string, bytes long, shape string, blocks long, rows long, error string"


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """``path, bytes`` of the data files below a folder, hidden ones left out; listed by tasks, a level of folders at a time.

    The driver sees how many folders there are, never their files.
    """

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where in batch.column(0).to_pylist():
                found = files.children(where)
                yield pa.record_batch([pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.int64(), pa.bool_()))], names=["path", "bytes", "is_folder"])

    level = spark.createDataFrame([(folder.rstrip("/"),)], "path string")
    levels: list[DataFrame] = []
    while True:
        seen = materialize(level.repartition("path").mapInArrow(look, _LISTED), "listing")
        levels.append(seen.where("not is_folder").select("path", "bytes"))
        level = seen.where("is_folder").select("path")
        if level.isEmpty():
            break
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return out


def described(listed: DataFrame) -> DataFrame:
    """Adds what the footer of each file says: its schema (a digest), blocks and rows; or why it cannot be read."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for path, size in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    rows.append((path, size, *describe(path), None))
                except (BlockError, OSError) as e:
                    rows.append((path, size, None, 0, 0, str(e)))
            types = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["path", "bytes", "shape", "blocks", "rows", "error"])

    return listed.select("path", "bytes").mapInArrow(look, _DESCRIBED)


def consolidate(spark: SparkSession, folder: str, out: str, target: int = TARGET_BYTES) -> DataFrame:
    """Joins the Parquet files below ``folder`` by copying their encoded blocks; the manifest.

    Files are listed and described by tasks and put in order of schema and path by a
    range exchange; each task joins its neighbours of one schema into files of about
    ``target`` bytes, so files of several schemas end in files of each.  Sources and
    ``out`` may lie on several file systems.  Each attempt has names of its own, and only
    files in the manifest count, so a task that is lost and run again leaves no record
    twice.  Block counts and row totals of all are held against the footers read at
    first; a difference, or a file that cannot be read, raises BlockError.  An empty
    folder gives an empty manifest.
    """
    known = materialize(described(list_files(spark, folder).where("bytes > 0").repartition(4 * spark.sparkContext.defaultParallelism)), "described")
    about = known.agg(F.count("error").alias("bad"), F.first("error", ignorenulls=True).alias("why"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.count("*").alias("n"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("blocks", "rows")]).first()
    if about.bad:
        raise BlockError(f"{about.bad} files cannot be joined: {about.why}")
    parts = max(1, -(-about.bytes // target), -(-about.n // MOST_FILES))
    ordered = known.repartitionByRange(parts, "shape", "path").sortWithinPartitions("shape", "path").select("shape", "path", "bytes", "blocks", "rows")

    def join(paths: list[str], blocks: int, rows: int) -> pa.RecordBatch:
        name = f"{out}/part-{uuid.uuid4().hex}.parquet"
        done = join_files(paths, name)
        numbers = (done.files, done.blocks, done.rows, done.size, blocks, rows)
        return pa.record_batch([pa.array([name]), *(pa.array([x], pa.int64()) for x in numbers)], names=["path", "files", "blocks", "rows", "bytes", "want_blocks", "want_rows"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files.make_folder(out)
        held: list[str] = []
        shape, size, blocks, rows = None, 0, 0, 0
        for batch in batches:
            for s, path, n, b, r in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (s != shape or size >= target or len(held) >= MOST_FILES):
                    yield join(held, blocks, rows)
                    held, size, blocks, rows = [], 0, 0, 0
                shape = s
                held.append(path)
                size, blocks, rows = size + n, blocks + b, rows + r
        if held:
            yield join(held, blocks, rows)

    path = new_path(spark, "manifest")
    ordered.mapInArrow(work, _MANIFEST).write.parquet(path)
    manifest = spark.read.schema(_MANIFEST).parquet(path)
    have = manifest.agg(F.count_if(F.expr("blocks <> want_blocks or rows <> want_rows")).alias("wrong"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("files", "blocks", "rows")]).first()
    if have.wrong or (have.files, have.blocks, have.rows) != (about.n, about.blocks, about.rows):
        raise BlockError(f"{have.files} files, {have.blocks} blocks, {have.rows} rows were joined; the sources have {about.n}, {about.blocks}, {about.rows}")
    return manifest


def read_consolidated(spark: SparkSession, manifest: DataFrame, schema) -> DataFrame:
    """The rows of the files a manifest names; their number is that of well-sized files."""
    paths = [r.path for r in manifest.select("path").toLocalIterator()]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def write_siblings(records: DataFrame, base: str, salt: int, fanout: int = DEFAULT_FANOUT) -> DomainPaths:
    """The index and filter of consolidated records beside their files: every ``fanout``-th record of each file, and an existence filter of the keys."""
    paths = DomainPaths(f"{base}.kv", f"{base}.bt", f"{base}.kvei")
    placed = records.select(F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.row_index").alias("at"), "domain_name", "step_from", "key")
    placed.where(F.col("at") % max(1, fanout) == 0).write.parquet(paths.bt)
    existence.write_filter(records.select("key").where("key is not null").distinct(), salt, paths.kvei)
    return paths


#: A listed file below this many bytes is small.
SMALL_BYTES = 16384


def small_file_records(listing: DataFrame, records: DataFrame, limit: int = SMALL_BYTES) -> DataFrame:
    """``domain_name, step_from, step_to, key, value, row_id``: each record of the small files once.

    A listed file is small when its resolved kv path ends in ``.kv`` and kv_bytes is
    below ``limit``; null paths and sizes are not.  Records are equal when domain, step
    range, key and value are, nulls among them; the smallest row_id stands for them.
    Aggregated before the shuffle; a path listed under two domains is in both.
    """
    path = resolved_path(F.col("kv"))
    lo, hi = step_columns(last_component(F.col("path")))
    listed = (
        listing.where(F.col("kv_bytes") < limit)
        .select(path.alias("path"), "domain_name")
        .where(F.col("path").endswith(".kv"))
        .distinct()
        .select("path", "domain_name", lo.alias("step_from"), hi.alias("step_to"))
    )
    rows = records.select(path.alias("path"), "key", "value", "row_id").join(listed, "path")
    return rows.groupBy("domain_name", "step_from", "step_to", "key", "value").agg(F.min("row_id").alias("row_id"))


def consolidated_records(listing: DataFrame, records: DataFrame, target: int = TARGET_BYTES) -> tuple[DataFrame, DataFrame]:
    """The small files' records, read from the well-sized files they were packed into; and the manifest.

    Each task encodes its share of the records once, as one block; the blocks are then
    copied into the large files as they are.
    """
    spark = listing.sparkSession
    once = small_file_records(listing, records)
    blocks = new_path(spark, "blocks")
    once.sortWithinPartitions("domain_name", "step_from", "key").write.parquet(blocks)
    want = spark.read.schema(once.schema).parquet(blocks).count()
    manifest = consolidate(spark, blocks, new_path(spark, "consolidated"), target)
    have = manifest.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    if have != want:
        raise BlockError(f"{have} records in the large files, {want} in the blocks")
    return read_consolidated(spark, manifest, once.schema), manifest
