"""Parquet files joined block by block: encoded column chunks are copied, footers rewritten.

The footer is read and written as generic Thrift compact-protocol structures, so
fields this module does not know are kept.
"""

from __future__ import annotations

import hashlib
import struct
from dataclasses import dataclass
from typing import Any, BinaryIO

from palimpsest.sources import files

# Fixed values of the Thrift compact protocol and the Parquet format.
_BOOL_TRUE, _BOOL_FALSE, _BYTE, _I16, _I32, _I64, _DOUBLE, _BINARY, _LIST, _SET, _MAP, _STRUCT = range(1, 13)
_MAGIC = b"PAR1"
_SCHEMA, _NUM_ROWS, _ROW_GROUPS, _PAIRS = 2, 3, 4, 5
_RG_COLUMNS, _RG_ROWS, _RG_FILE_OFFSET, _RG_ORDINAL = 1, 3, 5, 7
_CC_PATH, _CC_FILE_OFFSET, _CC_META, _CC_INDEXES = 1, 2, 3, (4, 5, 6, 7)
_CM_SIZE, _CM_DATA, _CM_INDEX, _CM_DICTIONARY, _CM_BLOOM = 7, 9, 10, 11, (14, 15)


class BlockError(ValueError):
    """Files that cannot be joined block by block, or whose totals do not agree."""


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def varint(self) -> int:
        shift = value = 0
        while True:
            b = self.data[self.at]
            self.at += 1
            value |= (b & 0x7F) << shift
            if b < 0x80:
                return value
            shift += 7

    def zigzag(self) -> int:
        n = self.varint()
        return (n >> 1) ^ -(n & 1)

    def take(self, n: int) -> bytes:
        self.at += n
        return self.data[self.at - n : self.at]

    def value(self, kind: int, in_list: bool = False) -> Any:
        if kind in (_BOOL_TRUE, _BOOL_FALSE):
            return self.take(1)[0] if in_list else kind
        if kind == _BYTE:
            return self.take(1)[0]
        if kind in (_I16, _I32, _I64):
            return self.zigzag()
        if kind == _DOUBLE:
            return self.take(8)
        if kind == _BINARY:
            return self.take(self.varint())
        if kind in (_LIST, _SET):
            head = self.take(1)[0]
            n = head >> 4 if head >> 4 < 15 else self.varint()
            return (head & 15, [self.value(head & 15, True) for _ in range(n)])
        if kind == _MAP:
            n = self.varint()
            kinds = self.take(1)[0] if n else 0
            return (kinds, [(self.value(kinds >> 4, True), self.value(kinds & 15, True)) for _ in range(n)])
        if kind == _STRUCT:
            return self.struct()
        raise BlockError(f"unknown field type {kind} in a footer")

    def struct(self) -> dict[int, tuple[int, Any]]:
        fields: dict[int, tuple[int, Any]] = {}
        last = 0
        while head := self.take(1)[0]:
            last = last + (head >> 4) if head >> 4 else self.zigzag()
            fields[last] = (head & 15, self.value(head & 15))
        return fields


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _zigzag(n: int) -> bytes:
    return _varint((n << 1) ^ (n >> 63))


def _write(kind: int, value: Any, in_list: bool = False) -> bytes:
    if kind in (_BOOL_TRUE, _BOOL_FALSE):
        return bytes([value]) if in_list else b""
    if kind == _BYTE:
        return bytes([value])
    if kind in (_I16, _I32, _I64):
        return _zigzag(value)
    if kind == _DOUBLE:
        return value
    if kind == _BINARY:
        return _varint(len(value)) + value
    if kind in (_LIST, _SET):
        of, items = value
        head = bytes([len(items) << 4 | of]) if len(items) < 15 else bytes([0xF0 | of]) + _varint(len(items))
        return head + b"".join(_write(of, x, True) for x in items)
    if kind == _MAP:
        kinds, items = value
        return _varint(len(items)) + (bytes([kinds]) if items else b"") + b"".join(_write(kinds >> 4, k, True) + _write(kinds & 15, v, True) for k, v in items)
    return _write_struct(value)


def _write_struct(fields: dict[int, tuple[int, Any]]) -> bytes:
    out, last = bytearray(), 0
    for number in sorted(fields):
        kind, value = fields[number]
        step = number - last
        out += bytes([step << 4 | kind]) if 0 < step < 16 else bytes([kind]) + _zigzag(number)
        out += _write(kind, value)
        last = number
    return bytes(out + b"\0")


def read_footer(file: BinaryIO, size: int) -> dict[int, tuple[int, Any]]:
    if size < 12:
        raise BlockError("too short for a Parquet file")
    file.seek(size - 8)
    tail = file.read(8)
    if tail[4:] != _MAGIC:
        raise BlockError("no Parquet footer")
    (length,) = struct.unpack("<I", tail[:4])
    if length + 12 > size:
        raise BlockError("footer longer than its file")
    file.seek(size - 8 - length)
    return _Reader(file.read(length)).struct()


def describe(path: str) -> tuple[str, int, int]:
    """A digest of a file's schema, and its blocks and rows, by its footer."""
    fs, inner = files.of(path)
    with fs.open_input_file(inner) as f:
        try:
            footer = read_footer(f, f.size())
            shape = hashlib.sha256(_write(*footer[_SCHEMA])).hexdigest()
            return shape, len(footer.get(_ROW_GROUPS, (_LIST, (_STRUCT, [])))[1][1]), footer[_NUM_ROWS][1]
        except (IndexError, KeyError, struct.error) as e:
            raise BlockError(f"a footer that cannot be read: {path}") from e


@dataclass
class Joined:
    files: int
    blocks: int
    rows: int
    size: int


def join_files(paths: list[str], out: str) -> Joined:
    """Writes the column chunks of ``paths``, in order, to ``out``, undecoded; each on its own file system.

    The files must have equal schemas; their row groups become row groups of the new
    file.  Page and Bloom indexes are left out, as their offsets are optional.  Raises
    BlockError for another schema, a chunk in another file, or totals that disagree.
    """
    groups: list[dict] = []
    first: dict[int, tuple[int, Any]] | None = None
    want_rows = want_blocks = at = 0
    to, inner_out = files.of(out)
    with to.open_output_stream(inner_out) as target:
        at += target.write(_MAGIC)
        for path in paths:
            fs, inner = files.of(path)
            with fs.open_input_file(inner) as source:
                footer = read_footer(source, source.size())
                first = first or footer
                if footer[_SCHEMA] != first[_SCHEMA]:
                    raise BlockError(f"another schema: {path}")
                blocks = footer.get(_ROW_GROUPS, (_LIST, (_STRUCT, [])))[1][1]
                want_rows += footer[_NUM_ROWS][1]
                want_blocks += len(blocks)
                for block in blocks:
                    begun = at
                    for chunk in block[_RG_COLUMNS][1][1]:
                        if _CC_PATH in chunk or _CC_META not in chunk:
                            raise BlockError(f"a column chunk lies elsewhere: {path}")
                        meta = chunk[_CC_META][1]
                        starts = [meta[f][1] for f in (_CM_DATA, _CM_DICTIONARY, _CM_INDEX) if f in meta and meta[f][1] > 0]
                        start, size = min(starts), meta[_CM_SIZE][1]
                        source.seek(start)
                        data = source.read(size)
                        if len(data) != size:
                            raise BlockError(f"a column chunk is cut short: {path}")
                        target.write(data)
                        for f in (_CM_DATA, _CM_DICTIONARY, _CM_INDEX):
                            if f in meta and meta[f][1] > 0:
                                meta[f] = (meta[f][0], meta[f][1] + at - start)
                        for f in _CM_BLOOM:
                            meta.pop(f, None)
                        for f in _CC_INDEXES:
                            chunk.pop(f, None)
                        chunk[_CC_FILE_OFFSET] = (_I64, at)
                        at += size
                    if _RG_FILE_OFFSET in block:
                        block[_RG_FILE_OFFSET] = (_I64, begun)
                    if _RG_ORDINAL in block:
                        block[_RG_ORDINAL] = (_I16, len(groups))
                    groups.append(block)
        if first is None:
            raise BlockError("no files to join")
        rows = sum(b[_RG_ROWS][1] for b in groups)
        if rows != want_rows or len(groups) != want_blocks:
            raise BlockError(f"{len(groups)} blocks of {rows} rows; the footers say {want_blocks} of {want_rows}")
        if len(groups) > 0x7FFF:
            for b in groups:
                b.pop(_RG_ORDINAL, None)
        footer = dict(first)
        footer[_NUM_ROWS] = (_I64, rows)
        footer[_ROW_GROUPS] = (_LIST, (_STRUCT, groups))
        data = _write_struct(footer)
        target.write(data + struct.pack("<I", len(data)) + _MAGIC)
    return Joined(len(paths), len(groups), rows, at + len(data) + 8)
