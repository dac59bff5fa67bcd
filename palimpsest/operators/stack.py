"""Stacks of runs: successive step ranges of a domain, of which the newest that has a key decides.

Runs are ordered in two ways.  A stack sorts by (from, to), names without a range
first as (0, 0); a merge sorts by from alone and leaves equal ones as they were given.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.steps import step_range
from palimpsest.operators import existence
from palimpsest.operators.changes import FILE, POS, file_lengths, key_index, read_live, with_positions, write_vectors
from palimpsest.operators.domain import sampled_keys
from palimpsest.session import file_names, new_path, qualified

#: Runs up to which a batch lookup asks each run's filter; with more it meets one scan of all runs.
FILTERED_RUNS = 64


class StackError(ValueError):
    """No runs, or none that match."""


@dataclass
class Run:
    """A domain and its file name, which has the step range.

    ``path``: the folder of Parquet files that ``pairs`` reads, where it is one; runs
    with paths are read in one scan.  ``base``: of a domain written as one.
    ``unique``: that no key occurs twice is known.  ``samples``: how keys are sampled, where a run has a way of its own.
    """

    name: str
    pairs: DataFrame
    filter: existence.Filter | None = None
    salt: int | None = None
    path: str | None = None
    base: str | None = None
    unique: bool = True
    samples: Callable[[int], DataFrame] | None = None
    steps: tuple[int, int] | None = field(init=False)

    def __post_init__(self) -> None:
        self.steps = step_range(self.name)

    def sample_keys(self, n: int) -> DataFrame:
        """``n`` keys: evenly spaced ones of a written domain, else the first."""
        if self.samples:
            return self.samples(n)
        return sampled_keys(self.pairs.sparkSession, self.base, n) if self.base else self.pairs.select("key").orderBy("key").limit(n)

    @property
    def filters(self) -> bool:
        return self.salt is not None and self.filter is not None and self.filter.kind == "bloom"


def ranked(runs: Sequence[Run], mode: str = "stack") -> list[Run]:
    """Oldest first."""
    if not runs:
        raise StackError("no runs given")
    if mode == "stack":
        return sorted(runs, key=lambda r: r.steps or (0, 0))
    return sorted(runs, key=lambda r: (r.steps or (0, 0))[0])


def _one_scan(runs: Sequence[Run]) -> DataFrame:
    """``key, value, rank, name`` and the position of each row: all runs in one scan, their rank by their folder."""
    spark = runs[0].pairs.sparkSession
    folders = [qualified(spark, r.path) for r in runs]
    # A row a run, as many as there are paths to scan.
    ranks = F.broadcast(spark.createDataFrame([(f, i, r.name) for i, (f, r) in enumerate(zip(folders, runs))], "__folder string, rank long, name string"))
    scan = with_positions(spark.read.schema("key binary, value binary").parquet(*folders).select("key", "value", F.regexp_replace("_metadata.file_path", "/[^/]*$", "").alias("__folder"), "_metadata"))
    return scan.drop("_metadata").join(ranks, "__folder").drop("__folder")


def with_rank(runs: Sequence[Run], mode: str = "stack") -> DataFrame:
    """``key, value, rank, name``: all runs, rank 0 the oldest."""
    runs = ranked(runs, mode)
    if all(r.path for r in runs) and len({r.path for r in runs}) == len(runs):
        return _one_scan(runs).drop(FILE, POS)
    parts = [r.pairs.select("key", "value", F.lit(i).cast("long").alias("rank"), F.lit(r.name).alias("name")) for i, r in enumerate(runs)]
    return reduce(DataFrame.unionByName, parts)


def newest_of(runs: Sequence[Run], mode: str = "stack") -> DataFrame:
    """``key, value``: of each key the newest run's value, deletions (empty values) too.

    Runs with paths are read as one scan, of which delete vectors leave out what a newer
    run has: the index of keys is shuffled, values are not.  Other runs are grouped by key.
    """
    runs = ranked(runs, mode)
    if not all(r.path for r in runs) or len({r.path for r in runs}) < len(runs):
        return newest(with_rank(runs, mode), unique=all(r.unique for r in runs))
    images = _one_scan(runs)
    root, commits = new_path(runs[0].pairs.sparkSession, "delete-vectors"), {0: "once"}
    write_vectors(root, commits, 0, commits[0], file_lengths(images), key_index(images, ["key"], ["rank"]))
    return read_live(images, root, commits).select("key", "value")


def newest(rows: DataFrame, rank: str = "rank", unique: bool = False, extra: Sequence[str] = ()) -> DataFrame:
    """``key, value``: of each key the value with the largest rank, deletions (empty values) too.

    Ties in rank are broken by the larger value.  With ``unique`` - no key twice at a
    rank, as in a stack of checked runs - the largest rank is found by a hash
    aggregation of fixed-width rows and joined back, which moves no values to compare them.
    """
    if unique:
        best = rows.groupBy("key").agg(F.max(rank).alias(rank))
        return rows.join(best, ["key", rank]).select("key", "value", *extra)
    best = F.max(F.struct(F.col(rank).alias("r"), F.col("value").alias("v"), *[F.col(c) for c in extra])).alias("best")
    return rows.groupBy("key").agg(best).select("key", F.col("best.v").alias("value"), *[F.col(f"best.{c}") for c in extra])


def as_of(runs: Sequence[Run], step: int) -> list[Run]:
    """The runs that began at ``step`` or before."""
    return [r for r in runs if (r.steps or (0, 0))[0] <= step]


class Stack:
    """Runs, oldest first, with one salt policy: ``None``, a known salt, or ``"find"``."""

    def __init__(self, runs: Sequence[Run], salt: int | str | None = None, search_limit: int = existence.SALTS):
        self.runs = ranked(runs)
        self.salt: int | None = None
        if salt == "find":
            oldest = self.runs[0]
            if oldest.filter is not None and oldest.filter.kind == "bloom":
                keys = [bytes(r.key) for r in oldest.sample_keys(existence.SEARCH_KEYS).collect()]
                self.salt = existence.find_salt(oldest.pairs.sparkSession, keys, oldest.filter, limit=search_limit)
        elif salt is not None:
            self.salt = int(salt)
        if self.salt is not None:
            # Small jobs, a few for each run: side by side.
            with ThreadPoolExecutor(8) as pool:
                for r, valid in zip(self.runs, pool.map(self._valid, self.runs)):
                    r.salt = self.salt if valid else None

    def _valid(self, r: Run) -> bool:
        return r.filter is not None and r.filter.kind == "bloom" and existence.validate_salt(r.sample_keys(existence.VALIDATE_KEYS), r.filter, self.salt)

    @classmethod
    def open(cls, spark: SparkSession, bases: Sequence[str], salt: int | str | None = None, **limits: int) -> Stack:
        """From domains written by ``write_domain``, by their base paths."""
        runs = []
        for b in bases:
            base = b[:-3] if b.endswith(".kv") else b
            pairs = spark.read.schema("key binary, value binary").parquet(f"{base}.kv")
            runs.append(Run(base.rpartition("/")[2] + ".kv", pairs, existence.read_filter(spark, f"{base}.kvei"), path=f"{base}.kv", base=base))
        return cls(runs, salt, **limits)

    @classmethod
    def open_dir(cls, spark: SparkSession, folder: str, name_filter: str = "", salt: int | str | None = None, **limits: int) -> Stack:
        """All ``.kv`` of a folder whose names contain ``name_filter``; none is an error."""
        names = [n for n in file_names(spark, folder) if n.endswith(".kv") and name_filter in n]
        if not names:
            raise StackError(f"no .kv in {folder} has {name_filter!r} in its name")
        return cls.open(spark, [f"{folder}/{n}" for n in names], salt, **limits)

    def candidates(self, key: bytes) -> list[Run]:
        """Runs that may have ``key``: those without a filter in use, and those whose filter does not leave it out.

        All filters are asked in one job, of which statistics read the row groups with the key's words.
        """
        asked = {i: existence.may_have(r.filter, self.salt, key) for i, r in enumerate(self.runs) if r.filters}
        asked = {i: words.select(F.lit(i).alias("run"), "need") for i, words in asked.items() if words is not None}
        if not asked:
            return self.runs
        found = reduce(DataFrame.unionByName, asked.values()).groupBy("run", "need").count().where("count = need").collect()
        there = {r.run for r in found}
        return [r for i, r in enumerate(self.runs) if i not in asked or i in there]

    def get(self, key: bytes) -> bytes | None:
        """The newest run's value, empty ones too.  Runs whose filter leaves the key out are not read; of the others the predicate reaches the scan."""
        runs = self.candidates(key)
        if not runs:
            return None
        row = with_rank(runs).where(F.col("key") == F.lit(key)).orderBy(F.desc("rank")).first()
        return None if row is None else bytes(row.value)

    def rows(self) -> DataFrame:
        return with_rank(self.runs)

    def resolve(self) -> DataFrame:
        """``key, value``: newest wins.  A key twice in a run, where that was not checked, comes out once."""
        return newest_of(self.runs)

    def get_many(self, probes: DataFrame) -> DataFrame:
        """Each probe's key with its value; runs are first cut to the probed keys, by their filters where they are few and in use."""
        wanted = probes.select("key").distinct()
        unique = all(r.unique for r in self.runs)
        if any(r.filters for r in self.runs) and len(self.runs) <= FILTERED_RUNS:
            parts = []
            for i, r in enumerate(self.runs):
                asked = existence.contains(wanted, r.filter, r.salt).where("maybe").select("key") if r.filters else wanted
                parts.append(r.pairs.join(asked, "key", "left_semi").select("key", "value", F.lit(i).cast("long").alias("rank")))
            rows = reduce(DataFrame.unionByName, parts)
        else:
            rows = self.rows().join(wanted, "key", "left_semi")
        return probes.join(newest(rows, unique=unique), "key", "left")

    def files(self) -> DataFrame:
        """``name, rank, key_count`` of each run."""
        counted = self.rows().groupBy("name", "rank").agg(F.count("*").alias("key_count"))
        return counted.orderBy("rank")

    def sizes(self) -> DataFrame:
        """``name, rank, file_bytes`` of each run of Parquet files, for picking the smallest."""
        spark = self.runs[0].pairs.sparkSession
        held = []
        for i, r in enumerate(self.runs):
            if r.path:
                one = r.pairs.select(F.lit(i).cast("long").alias("rank"), F.lit(r.name).alias("name"), F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_size").alias("s"))
                held.append(one.distinct())
        if not held:
            return spark.createDataFrame([], "name string, rank long, file_bytes long")
        return reduce(DataFrame.unionByName, held).groupBy("name", "rank").agg(F.sum("s").alias("file_bytes"))

    def __len__(self) -> int:
        return len(self.runs)

    def is_empty(self) -> bool:
        """Never true of a stack that was opened, since no runs are an error."""
        return not self.runs

    def bloom_count(self) -> int:
        """Runs whose filter is in use."""
        return sum(r.filters for r in self.runs)
