"""The integer codes as column functions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.coding import EliasFano, ef_encode, read_uvarint, select64, uvarint


def uvarint_column(number: Column) -> Column:
    """A non-negative BIGINT as a variable-length integer; null for null."""

    @F.arrow_udf("binary")
    def encode(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else uvarint(v) for v in values.to_pylist()], pa.binary())

    return encode(number)


def read_uvarint_column(data: Column) -> Column:
    """The BIGINT at the start of a binary; 0 where it is cut short or too long, null for null."""

    @F.arrow_udf("long")
    def decode(values: pa.Array) -> pa.Array:
        found = (None if v is None else read_uvarint(v)[0] for v in values.to_pylist())
        return pa.array([None if v is None else v - 2**64 if v >= 2**63 else v for v in found], pa.int64())

    return decode(data)


def select64_column(bits: Column, k: int) -> Column:
    """The place of the ``k``-th (from 0) set bit of a BIGINT's 64; 64 where there is none, null for null."""

    @F.arrow_udf("int")
    def place(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else select64(v & (2**64 - 1), k) for v in values.to_pylist()], pa.int32())

    return place(bits)


def encode_monotone(rows: DataFrame, ordinal: str, value: str, block: int) -> DataFrame:
    """``block_no, first_value, code``: the values of every ``block`` ordinals as one sequence, from its first value on.

    A block is a bounded group, so it is encoded whole in one call.
    """

    def encode(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        values = t.column(value).to_numpy()[np.argsort(t.column(ordinal).to_numpy())]
        code = ef_encode((values - values[0]).tolist())
        return pa.table({"block_no": [key[0].as_py()], "first_value": [int(values[0])], "code": pa.array([code], pa.binary())})

    numbered = rows.select(F.expr(f"{ordinal} div {block}").alias("block_no"), ordinal, value)
    return numbered.groupBy("block_no").applyInArrow(encode, "block_no long, first_value long, code binary")


def decode_monotone(codes: DataFrame, ordinal: str, value: str, block: int) -> DataFrame:
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, first, code in zip(*(c.to_pylist() for c in batch.columns)):
                values = EliasFano(code).values().astype(np.int64) + first
                yield pa.record_batch([pa.array(number * block + np.arange(len(values))), pa.array(values)], names=[ordinal, value])

    return codes.select("block_no", "first_value", "code").mapInArrow(decode, f"{ordinal} long, {value} long")


def get_monotone(codes: DataFrame, wanted: DataFrame, ordinal: str, value: str, block: int) -> DataFrame:
    """``ordinal, value`` of the ordinals of ``wanted`` alone: each is found in its block's code, which is not decoded."""

    def find(key: tuple[pa.Scalar, ...], asked: pa.Table, held: pa.Table) -> pa.Table:
        numbers = asked.column(ordinal).to_numpy() if held.num_rows else np.zeros(0, np.int64)
        if held.num_rows:
            sequence, first = EliasFano(held.column("code")[0].as_py()), held.column("first_value")[0].as_py()
            numbers = numbers[numbers % block < len(sequence)]
        values = [first + sequence.get(int(i)) for i in numbers % block] if len(numbers) else []
        return pa.table({ordinal: pa.array(numbers, pa.int64()), value: pa.array(values, pa.int64())})

    numbered = wanted.select(F.expr(f"{ordinal} div {block}").alias("block_no"), ordinal)
    return numbered.groupBy("block_no").cogroup(codes.groupBy("block_no")).applyInArrow(find, f"{ordinal} long, {value} long")


def monotone_round_trip(rows: DataFrame, ordinal: str, value: str, block: int) -> DataFrame:
    return decode_monotone(encode_monotone(rows, ordinal, value, block), ordinal, value, block)
