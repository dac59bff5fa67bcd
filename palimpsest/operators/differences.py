"""Differences between two copies of a keyed table by invertible Bloom lookup tables.

Each copy's rows go, by a hash of their key, into buckets; a bucket has a small table
of cells, each with a count and sums of the key hashes and row hashes put there.  The
two copies' tables are subtracted and peeled: what is left are the key hashes of rows
that differ.  Only the rows of those keys are then fetched and compared.

A first table is small enough that every task sends a fraction of its rows, whatever the
size of the copies.  Only of buckets that it cannot tell, the hashes are exchanged, into
finer buckets with a table each; what those cannot tell either is compared whole.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from palimpsest.session import materialize

#: Cells of a bucket: three sub-tables of a third each.  A bucket peels while its differing
#: rows are below about 0.8 of its cells.
CELLS = 768
#: Of the first table, rows of a task for each bucket: a task sends at most a tenth as many cells as it has rows.
TASK_ROWS_A_BUCKET = 8192
#: Rows of a finer bucket to aim at.
ROWS_A_BUCKET = 2048
#: Numbers of buckets up to which they are broadcast.
BROADCAST_BUCKETS = 1_000_000

_KEY_SEED, _ROW_SEED = 0x51ED, 0x7A3C
_SUMS = ("n", "k1", "k0", "r1", "r0", "chk")


def _hashes(df: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """kh: of the key; rh: of key and fields.  A null is hashed apart from an empty value."""
    marked = lambda cols: [x for c in cols for x in (F.col(c), F.col(c).isNull())]
    return df.select(
        *keys,
        *fields,
        F.xxhash64(F.lit(_KEY_SEED), *marked(keys)).alias("__kh"),
        F.xxhash64(F.lit(_ROW_SEED), *marked(keys), *marked(fields)).alias("__rh"),
    )


def _place(i: int, rh: Column) -> Column:
    field = F.shiftrightunsigned(rh, 21 * i).bitwiseAND(F.lit(0x1FFFFF))
    return (field % (CELLS // 3) + i * (CELLS // 3)).cast("int")


def _places(rh: int) -> tuple[int, ...]:
    return tuple((((rh & (2**64 - 1)) >> 21 * i) & 0x1FFFFF) % (CELLS // 3) + i * (CELLS // 3) for i in range(3))


def _check(kh: int, rh: int) -> int:
    """The low half of what ``xxhash64(kh, rh)`` of the SQL functions gives."""
    seed = xxh64_intdigest(struct.pack("<q", kh), 42)
    return xxh64_intdigest(struct.pack("<q", rh), seed) & 0xFFFFFFFF


def _signed(high: int, low: int) -> int:
    x = high << 32 | low
    return x - 2**64 if x >= 2**63 else x


def sketch(rows: DataFrame) -> DataFrame:
    """The cells of (bucket, kh, rh, n) rows, n the copies of a row, negative on the right.

    Sums, not exclusive ors: a row put in n times comes out with its n, so repeated rows
    need not be found before; one repeated otherwise on the other side comes out too, as
    a key to look at.
    """
    low, high = (lambda c: F.col(c).bitwiseAND(F.lit(0xFFFFFFFF))), (lambda c: F.shiftrightunsigned(F.col(c), 32))
    parts = {"k1": high("kh"), "k0": low("kh"), "r1": high("rh"), "r0": low("rh"), "chk": F.xxhash64("kh", "rh").bitwiseAND(F.lit(0xFFFFFFFF))}
    placed = rows.select("bucket", "n", *[(x * F.col("n")).alias(c) for c, x in parts.items()], F.explode(F.array(*[_place(i, F.col("rh")) for i in range(3)])).alias("cell"))
    return placed.groupBy("bucket", "cell").agg(*[F.sum(c).alias(c) for c in _SUMS])


def peel(cells: dict[int, list[int]]) -> tuple[list[int], bool]:
    """Key hashes of the rows left in a bucket's subtracted cells; whether all came out."""
    found: list[int] = []
    ready = list(cells)
    while ready:
        at = ready.pop()
        n, *sums = cells.get(at, (0,) * 6)
        if not n or any(x % n for x in sums):
            continue
        one = [x // n for x in sums]
        if not all(0 <= x < 2**32 for x in one):
            continue
        kh, rh = _signed(*one[:2]), _signed(*one[2:4])
        if at not in (places := _places(rh)) or one[4] != _check(kh, rh):
            continue
        found.append(kh)
        for c in places:
            cell = cells.setdefault(c, [0] * 6)
            for i, x in enumerate((n, *sums)):
                cell[i] -= x
            ready.append(c)
    return found, not any(any(c) for c in cells.values())


def _peel_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole buckets in; a row a differing key hash out, with a null one for a bucket that does not peel."""
    held: dict[int, dict[int, list[int]]] = {}
    for batch in batches:
        for bucket, cell, *rest in zip(*(c.to_pylist() for c in batch.columns)):
            held.setdefault(bucket, {})[cell] = rest
    out: list[tuple[int, int | None]] = []
    for bucket, cells in held.items():
        found, whole = peel(cells)
        out += [(bucket, kh) for kh in found] if whole else [(bucket, None)]
    if out:
        yield pa.record_batch([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["bucket", "kh"])


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal rows of a batch as one with their number, so that a row with a third of all copies is spread no further."""
    for batch in batches:
        bucket, kh, rh, n = (c.to_numpy() for c in batch.columns)
        order = np.lexsort((kh, rh))
        bucket, kh, rh, n = bucket[order], kh[order], rh[order], n[order]
        new = np.ones(len(kh), bool)
        new[1:] = (kh[1:] != kh[:-1]) | (rh[1:] != rh[:-1])
        first = np.flatnonzero(new)
        if len(first):
            sums = np.add.reduceat(n, first)
            keep = sums != 0
            yield pa.record_batch([pa.array(x[first][keep]) for x in (bucket, kh, rh)] + [pa.array(sums[keep])], names=["bucket", "kh", "rh", "n"])


def _rows(left: DataFrame, right: DataFrame, buckets: int) -> DataFrame:
    side = lambda df, n: df.select(F.pmod("__kh", F.lit(buckets)).alias("bucket"), F.col("__kh").alias("kh"), F.col("__rh").alias("rh"), F.lit(n).cast("long").alias("n"))
    return side(left, 1).unionByName(side(right, -1))


def _peeled(cells: DataFrame, tag: str) -> DataFrame:
    cells = cells.where(" or ".join(f"{c} <> 0" for c in _SUMS))
    return materialize(cells.mapInArrow(_peel_partition, "bucket long, kh long").distinct(), tag)


def _sent(numbers: DataFrame) -> DataFrame:
    return F.broadcast(numbers) if numbers.count() <= BROADCAST_BUCKETS else numbers


def suspect_keys(left: DataFrame, right: DataFrame, rows: int, tasks: int) -> tuple[DataFrame, DataFrame, int]:
    """``kh``: hashes of the keys with a differing row; and ``b``: finer buckets, of so many, to be compared whole."""
    coarse = max(1, rows // tasks // TASK_ROWS_A_BUCKET)
    first = _peeled(sketch(_rows(left, right, coarse)).repartition("bucket"), "suspects")
    told = first.where("kh is not null").select("kh")
    unclear = first.where("kh is null").select(F.col("bucket").alias("b"))
    # Finer buckets lie within coarse ones.
    fine = coarse * max(1, -(-rows // (coarse * ROWS_A_BUCKET)))
    if unclear.isEmpty():
        return told, unclear, fine
    again = _rows(left, right, fine).join(_sent(unclear), F.pmod("bucket", F.lit(coarse)) == F.col("b"), "left_semi")
    again = again.mapInArrow(_together, "bucket long, kh long, rh long, n long").repartition("bucket")
    second = _peeled(sketch(again), "suspects")
    whole = second.where("kh is null").select(F.col("bucket").alias("b"))
    return told.unionByName(second.where("kh is not null").select("kh")), whole, fine


def field_differences(left: DataFrame, right: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """``*keys, field_name, diff_kind``: keys in one copy only, and fields that differ in both.

    A null equals only a null.  Number and order of repeated rows do not matter; a key
    with several values in a copy differs in a field where the two sets of values do.
    Null keys are keys; an empty copy makes every key of the other one-sided; columns
    beside keys and fields are ignored.

    Buckets hold keys by hash, so a file with a third of the rows is spread over all.
    """
    copies = [_hashes(df, keys, fields) for df in (left, right)]
    rows = max(df.count() for df in (left, right))
    tasks = max(1, max(df.rdd.getNumPartitions() for df in (left, right)))
    suspects, overfull, buckets = suspect_keys(*copies, rows, tasks)
    suspects = suspects.distinct().select(F.col("kh").alias("__kh"))
    whole = not overfull.isEmpty()
    sides = []
    for copy, mark in zip(copies, (True, False)):
        rows = copy.join(suspects, "__kh", "left_semi")
        if whole:
            rows = rows.unionByName(copy.join(_sent(overfull), F.pmod("__kh", F.lit(buckets)) == F.col("b"), "left_semi"))
        sides.append(rows.select(*keys, *fields).distinct().withColumn("__left", F.lit(mark)))
    rows = sides[0].unionByName(sides[1])
    values = lambda c, mark: F.array_sort(F.collect_set(F.when(F.col("__left") == mark, F.struct(F.col(c).isNull().alias("z"), F.col(c).alias("v")))))
    told = rows.groupBy(*keys).agg(
        F.bool_or("__left").alias("__in_left"),
        F.bool_or(~F.col("__left")).alias("__in_right"),
        *[(values(c, True) != values(c, False)).alias(f"__{i}") for i, c in enumerate(fields)],
    )
    one_sided = F.when(~F.col("__in_right"), F.lit("only_left")).when(~F.col("__in_left"), F.lit("only_right"))
    pair = lambda name, kind: F.struct(F.lit(name).alias("field_name"), kind.alias("diff_kind"))
    kinds = [F.when(one_sided.isNotNull(), pair("key", one_sided))]
    kinds += [F.when(one_sided.isNull() & F.col(f"__{i}"), pair(c, F.lit("differs"))) for i, c in enumerate(fields)]
    return told.select(*keys, F.explode(F.array_compact(F.array(*kinds))).alias("d")).select(*keys, "d.field_name", "d.diff_kind")


def header_differences(headers: DataFrame, side: str, name: str, fields: Sequence[str]) -> DataFrame:
    """The same comparison for a list of headers that has both copies, told apart by ``side``.

    Rows with a null name or another side than ``left`` and ``right`` name nothing.
    The list has a row or so a file, so it is grouped by name without a sketch.
    """
    told = headers.where(F.col(name).isNotNull() & F.col(side).isin("left", "right"))
    values = lambda c, mark: F.array_sort(F.collect_set(F.when(F.col(side) == mark, F.struct(F.col(c).isNull().alias("z"), F.col(c).alias("v")))))
    told = told.groupBy(F.col(name).alias("__name")).agg(
        F.bool_or(F.col(side) == "left").alias("l"), F.bool_or(F.col(side) == "right").alias("r"), *[(values(c, "left") != values(c, "right")).alias(f"__{i}") for i, c in enumerate(fields)]
    )
    pair = lambda field, kind: F.struct(F.lit(field).alias("field_name"), F.lit(kind).alias("diff_kind"))
    kinds = [F.when(~F.col("r"), pair("name", "only_left")), F.when(~F.col("l"), pair("name", "only_right"))]
    kinds += [F.when(F.expr("l and r") & F.col(f"__{i}"), pair(c, "differs")) for i, c in enumerate(fields)]
    return told.select(F.col("__name").alias(name), F.explode(F.array_compact(F.array(*kinds))).alias("d")).select(name, "d.field_name", "d.diff_kind")
