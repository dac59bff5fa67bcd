"""A change feed applied with delete vectors.

Every change is an image at a position of a file.  An index takes each key to the
position of the image that decides it; all other positions are superseded and their
bits are set in their file's bitmap.  Reading is a scan in which each task loads the
bitmap of the file it reads and leaves out the positions whose bit is set.  Values are
never shuffled and bitmaps never broadcast, whatever their size.
"""

from __future__ import annotations

import json
import uuid
from collections import OrderedDict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.steps import step_columns, strip_space
from palimpsest.session import commit_file, file_names, materialize, new_path, read_file
from palimpsest.sources import files

#: Spellings that mean a deletion, after trimming and lower-casing.
DELETE_OPS = ("d", "del", "delete", "deleted", "remove", "removed", "rm", "erase", "drop", "tombstone")

#: Domains up to which the merge jobs are broadcast.
BROADCAST_JOBS = 100_000
#: Positions a bitmap file covers (a bit each, so 1 MB); a data file has as many as its rows need.
SEGMENT = 1 << 23
#: Bitmap files a worker keeps at hand.
HELD_SEGMENTS = 16

FILE, POS = "__file", "__pos"
_SIZE, _WON, _LOST = 0, 1, 2


class VersionError(RuntimeError):
    """A version that another writer has committed already, or a folder that holds no table."""


def is_deletion(op: Column, value: Column) -> Column:
    """True where ``op`` means delete, or the value is null or empty; a null op alone does not delete."""
    spelled = F.lower(strip_space(op)).isin(*DELETE_OPS)
    return F.coalesce(spelled, F.lit(False)) | value.isNull() | (F.octet_length(value) == 0)


def with_positions(feed: DataFrame, by: str = "file_path") -> DataFrame:
    """Adds the file (a 64-bit hash of its path, or name) and the position in it to a scan of Parquet files."""
    return feed.select("*", F.xxhash64(F.col(f"_metadata.{by}")).alias(FILE), F.col("_metadata.row_index").alias(POS))


def key_index(images: DataFrame, keys: Sequence[str], rank: Sequence[str]) -> DataFrame:
    """One row a key: the largest rank, and the file and position of an image that has it.

    Repeated images tie in rank; the one with the largest (file, position) is kept.
    Aggregated before the shuffle, so a key with a third of the rows costs a row a task.
    """
    best = F.max(F.struct(*[F.col(c) for c in (*rank, FILE, POS)])).alias("best")
    return images.groupBy(*keys).agg(best).select(*keys, *[F.col(f"best.{c}").alias(c) for c in (*rank, FILE, POS)])


def file_lengths(images: DataFrame) -> DataFrame:
    return images.groupBy(FILE).agg((F.max(POS) + 1).alias("rows"))


def _latest(names: list[str], segment: int, commits: dict[int, str]) -> str | None:
    """Of a data file's bitmap files the newest of a segment that a committed version wrote."""
    best: tuple[int, str] | None = None
    for name in names:
        part, _, rest = name.partition("-")
        number, _, attempt = rest.partition("-")
        if part.isdigit() and number.isdigit() and int(part) == segment and commits.get(int(number)) == attempt:
            best = max(best or (-1, ""), (int(number), name))
    return best and best[1]


def _folder(root: str, file: int) -> str:
    return f"{root}/{file & (2**64 - 1):016x}"


def _load(root: str, file: int, segment: int, commits: dict[int, str]) -> np.ndarray | None:
    folder = _folder(root, file)
    name = _latest(files.names(folder), segment, commits)
    return None if name is None else np.frombuffer(files.read(f"{folder}/{name}"), np.uint8)


def _parts(df: DataFrame, kind: int) -> DataFrame:
    return df.select(FILE, F.expr(f"{POS} div {SEGMENT}").alias("segment"), F.lit(kind).alias("kind"), F.expr(f"cast({POS} % {SEGMENT} as int)").alias("at"))


def write_vectors(root: str, commits: dict[int, str], version: int, attempt: str, lengths: DataFrame, won: DataFrame, lost: DataFrame | None = None) -> DataFrame:
    """Writes the bitmaps of the files of ``lengths``, all superseded but for the positions ``won``; and sets
    the bits of ``lost`` in the held bitmaps of other files.  ``file, segment, superseded`` of each written.

    One exchange of positions; a task writes a segment at a time.  Only segments with a
    change are written, under names of this version and attempt.
    """
    size = SEGMENT
    whole = lengths.select(FILE, F.col("rows"), F.explode(F.expr(f"sequence(0L, (rows - 1) div {size})")).alias("segment"))
    whole = whole.select(FILE, "segment", F.lit(_SIZE).alias("kind"), F.expr(f"cast(least(rows - segment * {size}, {size}) as int)").alias("at"))
    rows = whole.unionByName(_parts(won, _WON))
    if lost is not None:
        rows = rows.unionByName(_parts(lost, _LOST))
    rows = rows.repartition(FILE, "segment").sortWithinPartitions(FILE, "segment", "kind")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: tuple[int, int] | None = None
        bits = np.zeros(0, np.uint8)
        done: list[tuple[int, int, int]] = []

        def close() -> None:
            if current is not None:
                files.publish(f"{_folder(root, current[0])}/{current[1]:06d}-{version:08d}-{attempt}", np.packbits(bits, bitorder="little").tobytes())
                done.append((*current, int(bits.sum())))

        for batch in batches:
            if not batch.num_rows:
                continue
            file, segment, kind, at = (c.to_numpy() for c in batch.columns)
            change = np.flatnonzero((file[1:] != file[:-1]) | (segment[1:] != segment[:-1]) | (kind[1:] != kind[:-1])) + 1
            for lo, hi in zip([0, *change], [*change, len(file)]):
                here = (int(file[lo]), int(segment[lo]))
                if here != current:
                    close()
                    current = here
                    if kind[lo] == _SIZE:
                        bits = np.ones(at[lo], np.uint8)
                    else:
                        held = _load(root, *here, commits)
                        if held is None:
                            raise VersionError(f"no bitmap of file {here[0]}, segment {here[1]}")
                        bits = np.unpackbits(held, bitorder="little")
                if kind[lo] != _SIZE:
                    bits[at[lo:hi]] = 0 if kind[lo] == _WON else 1
        close()
        columns = [pa.array([d[i] for d in done], pa.int64()) for i in range(3)]
        yield pa.record_batch(columns, names=["file", "segment", "superseded"])

    # Written down, so that the work is done here and once.
    return materialize(rows.mapInArrow(work, "file long, segment long, superseded long"), "vectors")


def read_live(images: DataFrame, root: str, commits: dict[int, str]) -> DataFrame:
    """The images whose bit is not set.  Each scan task loads its own file's bitmap: no shuffle, no broadcast.

    A file without a bitmap raises VersionError, so none is ever read as if nothing were superseded.
    """
    held: OrderedDict[tuple[int, int], np.ndarray] = OrderedDict()
    size, most = SEGMENT, HELD_SEGMENTS

    def bitmap(file: int, segment: int) -> np.ndarray:
        if (file, segment) not in held:
            found = _load(root, file, segment, commits)
            if found is None:
                raise VersionError(f"no bitmap of file {file}, segment {segment}")
            held[file, segment] = found
            if len(held) > most:
                held.popitem(last=False)
        return held[file, segment]

    @F.arrow_udf("boolean")
    def live(file: pa.Array, pos: pa.Array) -> pa.Array:
        f, p = file.to_numpy(), pos.to_numpy()
        segment, at = p // size, p % size
        out = np.zeros(len(p), bool)
        change = np.flatnonzero((f[1:] != f[:-1]) | (segment[1:] != segment[:-1])) + 1
        for lo, hi in zip([0, *change], [*change, len(p)]):
            if hi > lo:
                bits, x = bitmap(int(f[lo]), int(segment[lo])), at[lo:hi]
                out[lo:hi] = (bits[x >> 3] >> (x & 7).astype(np.uint8)) & 1 == 0
        return pa.array(out)

    return images.where(live(F.col(FILE), F.col(POS))).drop(FILE, POS)


def current_state(feed: DataFrame, keys: Sequence[str], rank: Sequence[str]) -> DataFrame:
    """The deciding image of each key, all columns, of a feed.

    Order of arrival, repeats and ties do not matter.  Null keys are keys of their
    own; a null rank is the lowest; an empty feed gives no rows.  A feed that is no scan
    of Parquet files is written down as such first.
    """
    try:
        images = with_positions(feed)
    except AnalysisException:
        images = with_positions(materialize(feed, "feed"))
    index = key_index(images.select(*keys, *rank, FILE, POS), keys, rank)
    root, commits = new_path(feed.sparkSession, "delete-vectors"), {0: "once"}
    write_vectors(root, commits, 0, commits[0], file_lengths(images), index)
    return read_live(images, root, commits)


def keeps_tombstones(jobs: DataFrame) -> DataFrame:
    """``domain_name, drops``: whether deleted keys are left out of a domain's result.

    They are if drop_deleted is true (null: true) and the start is 0, where the start
    is range_from, else that of the step range in out_name, else unknown.
    """
    start = F.coalesce("range_from", step_columns(F.col("out_name"))[0])
    drops = F.coalesce("drop_deleted", F.lit(True)) & F.coalesce(start == 0, F.lit(False))
    return jobs.select("domain_name", drops.alias("drops"))


def apply_change_feed(feed: DataFrame, jobs: DataFrame) -> DataFrame:
    """The rows of ``feed`` that decide their (domain_name, key), deletions as ``jobs`` asks.

    Adds ``deleted``.  A domain without a job keeps its deleted keys.  Jobs with the
    same domain drop if any of them does.
    """
    state = current_state(feed, ["domain_name", "key"], ["step", "txn", "change_id"])
    state = state.withColumn("deleted", is_deletion(F.col("op"), F.col("value")))
    asked = materialize(keeps_tombstones(jobs).groupBy("domain_name").agg(F.bool_or("drops").alias("drops")), "jobs")
    if asked.count() <= BROADCAST_JOBS:
        asked = F.broadcast(asked)
    return state.join(asked, "domain_name", "left").where("not deleted or not coalesce(drops, false)").drop("drops")


class VersionedTable:
    """A table of image files with delete vectors, changed batch by batch, each a version.

    A version is a manifest file that names all data files, index runs and bitmaps; it
    is put under its number by a rename that fails where the number is taken, so of two
    writers one wins and the other raises VersionError.  What a batch writes has names of
    its own attempt and counts only through a manifest: a driver killed halfway leaves
    unnamed files, and the batch is applied again.  An object on the path of a table
    opens its newest version.

    The index is a list of runs; a batch adds a run with the keys it has, and of the
    held runs only those keys' rows are taken.  Every INDEX_RUNS runs they are made one.
    Bitmaps are written anew only of files in which a bit changes, and go by the names of
    files, which Spark makes unique, so a table may be moved.  A batch older than what
    the table holds is appended with its bits set; null keys are keys of their own.
    """

    INDEX_RUNS = 16

    def __init__(self, spark: SparkSession, path: str | None, keys: Sequence[str] | None = None, rank: Sequence[str] | None = None):
        self.spark = spark
        self.path = path or new_path(spark, "versioned")
        self.keys, self.rank = list(keys or ()), list(rank or ())
        self.data: list[str] = []
        self.index: list[str] = []
        self.commits: dict[int, str] = {}
        self.batches: dict[str, int] = {}
        self.version = 0
        numbers = sorted(int(n[:-5]) for n in file_names(spark, f"{self.path}/versions") if n.endswith(".json") and n[:-5].isdigit())
        if numbers:
            held = json.loads(read_file(spark, f"{self.path}/versions/{numbers[-1]:08d}.json"))
            if (keys and list(keys) != held["keys"]) or (rank and list(rank) != held["rank"]):
                raise VersionError(f"the table at {self.path} has keys {held['keys']} and rank {held['rank']}")
            self.version, self.keys, self.rank, self.batches = held["version"], held["keys"], held["rank"], held["batches"]
            self.data, self.index = ([f"{self.path}/{x}" for x in held[k]] for k in ("data", "index"))
            self.commits = {int(k): v for k, v in held["commits"].items()}
        elif not keys or not rank:
            raise VersionError(f"no table at {self.path}")

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> VersionedTable:
        """The newest version of the table at ``path``; none there raises VersionError."""
        return cls(spark, path)

    @property
    def _vectors(self) -> str:
        return f"{self.path}/vectors"

    def apply(self, batch: DataFrame, source: str | None = None, number_in_source: int | None = None) -> bool:
        """Adds a version; False where ``source`` had this batch, or a later one, applied before."""
        if source is not None and self.batches.get(source, -1) >= number_in_source:
            return False
        number, attempt = self.version + 1, uuid.uuid4().hex[:12]
        data = f"{self.path}/data/{number:08d}-{attempt}"
        batch.write.parquet(data)
        images = with_positions(self.spark.read.schema(batch.schema).parquet(data), "file_name")
        both = fresh = key_index(images.select(*self.keys, *self.rank, FILE, POS), self.keys, self.rank)
        old = lost = None
        if self.index:
            asked = fresh.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(self.keys)])
            same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(self.keys)]
            old = self.spark.read.parquet(*self.index).join(asked, same, "left_semi")
            both = old.unionByName(fresh)
        run = f"{self.path}/index/{number:08d}-{attempt}"
        key_index(both, self.keys, self.rank).write.parquet(run)
        won = self.spark.read.parquet(run)
        lengths = file_lengths(images)
        own = won.join(lengths.select(FILE), FILE, "left_semi")
        if old is not None:
            # Held images of the batch's keys that no longer win: their bits are set in their own files' bitmaps.
            lost = old.join(won.select(FILE, POS), [FILE, POS], "left_anti").select(FILE, POS).distinct()
        write_vectors(self._vectors, self.commits, number, attempt, lengths, own, lost)
        index = [*self.index, run]
        if len(index) >= self.INDEX_RUNS:
            whole = f"{self.path}/index/{number:08d}-{attempt}-whole"
            key_index(self.spark.read.parquet(*index), self.keys, self.rank).write.parquet(whole)
            index = [whole]
        self._commit(number, [*self.data, data], index, {**self.commits, number: attempt}, self.batches if source is None else {**self.batches, source: number_in_source})
        return True

    def _commit(self, number: int, data: list[str], index: list[str], commits: dict[int, str], batches: dict[str, int]) -> None:
        held = self._manifest(number, data, index, commits, batches)
        if not commit_file(self.spark, f"{self.path}/versions/{number:08d}.json", held):
            raise VersionError(f"version {number} of {self.path} has been committed by another writer")
        self.version, self.data, self.index, self.commits, self.batches = number, data, index, commits, batches

    def _manifest(self, number: int, data: list[str], index: list[str], commits: dict[int, str], batches: dict[str, int]) -> str:
        inside = lambda paths: [p.removeprefix(self.path + "/") for p in paths]
        return json.dumps({"version": number, "keys": self.keys, "rank": self.rank, "data": inside(data), "index": inside(index), "commits": commits, "batches": batches})

    def manifest(self) -> str:
        return self._manifest(self.version, self.data, self.index, self.commits, self.batches)

    def read(self) -> DataFrame:
        if not self.data:
            raise VersionError(f"the table at {self.path} has no version yet")
        return read_live(with_positions(self.spark.read.parquet(*self.data), "file_name"), self._vectors, self.commits)
