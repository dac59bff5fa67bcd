"""Overlapping, nested and gapped intervals: continuous periods and the gaps between them."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.session import materialize


class IntervalMap:
    """Disjoint half-open intervals in order; touching ones are one.

    ``starts`` and ``ends`` are parallel sorted lists.  An insertion finds the
    intervals it meets by binary search and puts one in their place; the gaps are
    what lies between neighbours, so they follow each insertion by themselves.
    """

    __slots__ = ("starts", "ends")

    def __init__(self, starts: list[int] | None = None, ends: list[int] | None = None):
        self.starts, self.ends = starts or [], ends or []

    def insert(self, lo: int, hi: int) -> None:
        if lo >= hi:
            return
        first = bisect_left(self.ends, lo)  # the first that ends at lo or later: touching counts
        after = bisect_right(self.starts, hi)  # the first that starts beyond hi
        if first < after:
            lo, hi = min(lo, self.starts[first]), max(hi, self.ends[after - 1])
        self.starts[first:after] = [lo]
        self.ends[first:after] = [hi]

    def periods(self) -> list[tuple[int, int]]:
        return list(zip(self.starts, self.ends))

    def gaps(self) -> list[tuple[int, int]]:
        return list(zip(self.ends, self.starts[1:]))


_PIECES = T.StructType(
    [
        T.StructField("entity", T.StringType()),
        T.StructField("lo", T.LongType()),
        T.StructField("hi", T.LongType()),
        T.StructField("prev_hi", T.LongType()),
        T.StructField("pid", T.IntegerType()),
    ]
)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The disjoint intervals of each entity of a partition, which comes sorted by entity and start.

    So sorted, an insertion is at the end of the map, and a map is let go with its entity.
    """
    from pyspark import TaskContext

    pid = TaskContext.get().partitionId()
    held, current = IntervalMap(), object()
    out: list[list] = [[], [], [], []]

    def close() -> None:
        if held.starts:
            out[0] += [current] * len(held.starts)
            out[1] += held.starts
            out[2] += held.ends
            out[3] += [None, *held.ends[:-1]]

    def full(least: int) -> Iterator[pa.RecordBatch]:
        while len(out[0]) > least:
            part = [column[:50_000] for column in out]
            for column in out:
                del column[:50_000]
            types = (pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch([*map(pa.array, part, types), pa.array([pid] * len(part[0]), pa.int32())], names=_PIECES.names)

    for batch in batches:
        for entity, lo, hi in zip(*(c.to_pylist() for c in batch.columns)):
            if entity != current:
                close()
                held, current = IntervalMap(), entity
            held.insert(lo, hi)
        yield from full(200_000)
    close()
    yield from full(0)


def periods_and_gaps(df: DataFrame, entity: str, lo: str, hi: str) -> DataFrame:
    """``kind, entity, lo, hi``: the maximal covered stretches and the uncovered ones between them.

    Rows with a null bound or ``lo >= hi`` cover nothing; a null entity is an
    entity of its own; an empty table gives no rows; other columns are ignored.

    Equal starts are first reduced to the farthest end, map-side.  The rows are then
    range-partitioned by (entity, start), so an entity with a third of all rows is
    spread over as many partitions as its share; each keeps its entities' interval
    maps, one at a time.  Only what joins across partitions, at most two pieces an entity and
    partition, is stitched afterwards.
    """
    spark = df.sparkSession
    rows = (
        df.select(F.col(entity).cast("string").alias("entity"), F.col(lo).cast("long").alias("lo"), F.col(hi).cast("long").alias("hi"))
        .where("lo < hi")
        .groupBy("entity", "lo")
        .agg(F.max("hi").alias("hi"))
        .repartitionByRange("entity", "lo")
        .sortWithinPartitions("entity", "lo")
    )
    pieces = materialize(rows.mapInArrow(_pieces, _PIECES), "pieces")

    # What an entity's earlier partitions reach: one row for each (entity, partition) after its first.
    # That is fewer than the partitions of the range exchange, so it is safe to broadcast.
    spans = pieces.groupBy("entity", "pid").agg(F.min("lo").alias("first_lo"), F.max("hi").alias("last_hi"))
    order = Window.partitionBy("entity").orderBy("first_lo")
    spans = spans.select(
        F.col("entity").alias("e"),
        F.col("pid").alias("p"),
        "last_hi",
        F.max("last_hi").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("reached"),
        F.count("*").over(Window.partitionBy("entity")).alias("parts"),
    ).where("parts > 1")
    joined = pieces.join(F.broadcast(spans), F.col("entity").eqNullSafe(F.col("e")) & (F.col("pid") == F.col("p")), "left")

    gaps = joined.select(
        F.lit("gap").alias("kind"), "entity", F.greatest("prev_hi", "reached").alias("lo"), F.col("lo").alias("hi")
    ).where("lo < hi")

    left = joined.where("reached is null or hi > reached").select(
        "entity",
        F.greatest("lo", F.when(F.col("lo") <= F.col("reached"), F.col("reached"))).alias("lo"),
        "hi",
        F.coalesce(F.col("lo") <= F.col("reached"), F.lit(False)).alias("continues"),
        F.coalesce(F.col("hi") == F.col("last_hi"), F.lit(False)).alias("last"),
    )
    whole = left.where("not continues and not last").select(F.lit("period").alias("kind"), "entity", "lo", "hi")
    edges = left.where("continues or last")
    chained = edges.withColumn("chain", F.sum(F.when(F.col("continues"), 0).otherwise(1)).over(Window.partitionBy("entity").orderBy("lo")))
    stitched = chained.groupBy("entity", "chain").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).select(F.lit("period").alias("kind"), "entity", "lo", "hi")
    return whole.unionByName(stitched).unionByName(gaps)
