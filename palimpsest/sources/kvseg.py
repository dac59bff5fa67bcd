"""The foreign file triple: word streams (.kv), key-offset indexes (.bt) and existence filters (.kvei).

``spark.read.format("kvseg")`` reads key/value pairs of files or folders, and
``df.write.format("kvseg")`` writes a triple for each partition.  These bytes exist for
exchange; the engine's own storage is key-sorted Parquet.
"""

from __future__ import annotations

import struct
import uuid
from array import array
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceWriter, EqualTo, InputPartition, WriterCommitMessage

from palimpsest.functions.coding import BitWriter, EliasFano, FormatError, codes_from_depths, ef_encode, huffman, read_uvarint, uvarint
from palimpsest.functions.hashing import HASHES, bit_positions, filter_keys, murmur3_array, optimal_bits
from palimpsest.operators.ngrams import Cover, mine_words
from palimpsest.sources import files

# Fixed values of the formats.
_V1, _PAGED, _BODY_MIN, _MAX_DEPTH = 1, 1, 32, 50
_BLOOM_MAGIC = bytes(8) + b"v02\n"
_BLOOM_HEAD, _BLOOM_TAIL = 60, 48
_FOOTER_FIRST, _PAGE, _META, _ANCHOR, _BT_VERSION = 1, 4096, 24, 16, 1
DEFAULT_FANOUT = 256
#: Blocks kept of a filter: 32 MB, some 28 million keys.
_FILTER_BLOCKS = 512
#: Pairs and bytes for each key wanted up to which a stretch of a file is read whole.
_NEAR_PAIRS, _NEAR_BYTES = 16, 1 << 18
#: Bytes of a file that a task reads, where an index says at which keys to split it.
SPLIT_BYTES = 64 << 20


_ENDINGS = ("kv", "bt", "kvei")


def _fail(what: str) -> FormatError:
    return FormatError(f"invalid .kv file: {what}")


class _Codes:
    """A dictionary's codes, looked up in tables of up to TABLE_BITS at a time.

    An entry is a value with its depth, or the table for what follows those bits.
    """

    TABLE_BITS = 10

    def __init__(self, depths: list[int], values: list):
        self.only = values[0] if len(values) == 1 and depths[0] == 0 else None
        self.empty = not values
        self.root = self._table(list(zip(depths, codes_from_depths(depths), values))) if self.only is None else (0, [])

    @classmethod
    def _table(cls, codes: list[tuple[int, int, object]]) -> tuple[int, list]:
        bits = min(cls.TABLE_BITS, max((d for d, _, _ in codes), default=0))
        table: list = [None] * (1 << bits)
        longer: dict[int, list] = {}
        for depth, code, value in codes:
            if depth > bits:
                longer.setdefault(code & ((1 << bits) - 1), []).append((depth - bits, code >> bits, value))
            else:
                for i in range(code, 1 << bits, 1 << depth):
                    table[i] = (value, depth)
        for code, rest in longer.items():
            table[code] = cls._table(rest)
        return bits, table

    def read(self, data, bit: int) -> tuple[object, int]:
        if self.only is not None:
            return self.only, bit
        at = bit >> 3
        # The longest code spans at most eight bytes.
        window = int.from_bytes(data[at : at + 8], "little") >> (bit & 7)
        bits, table = self.root
        while True:
            found = table[window & ((1 << bits) - 1)]
            if found is None:
                raise _fail("unknown code")
            if type(found[1]) is int:
                bit += found[1]
                if bit > 8 * len(data):
                    raise _fail("a code runs past the end")
                return found[0], bit
            window >>= bits
            bit += bits
            bits, table = found


class _Begins:
    """How words without a pattern begin, in tables by the bits of two codes: bytes before the word's own, and with them; 0 for all other words."""

    def __init__(self, codes: _Codes):
        bits, table = (0, [(codes.only, 0)]) if codes.only is not None else codes.root
        known = [e if e is not None and type(e[1]) is int else (-1, 0) for e in table]
        # A value that no word in memory can have is left to be read one by one.
        value = np.array([min(v, 1 << 62) for v, _ in known], np.int64)
        depth = np.array([d for _, d in known], np.int64)
        self.mask = (1 << 2 * bits) - 1
        window = np.arange(self.mask + 1)
        one = window & ((1 << bits) - 1)
        two = window >> depth[one] & ((1 << bits) - 1)
        empty = (value[one] >= 0) & (value[one] <= 1)
        plain = empty | (value[one] > 1) & (value[one] < 1 << 62) & (value[two] == 0)
        self.head = np.where(plain, (depth[one] + np.where(empty, 0, depth[two]) + 7) // 8, 0)
        self.whole = np.where(plain, self.head + np.maximum(value[one] - 1, 0), 0)

    def windows(self, data: np.ndarray) -> np.ndarray:
        """What stands at each byte; the last two of ``data`` only follow others."""
        out = data[:-2].astype(np.uint32)
        for i in range(1, (self.mask.bit_length() + 7) // 8):
            out |= data[i : len(data) - 2 + i].astype(np.uint32) << np.uint32(8 * i)
        return out & np.uint32(self.mask)


class WordFile:
    """A .kv file: header, dictionaries, and the words behind them.

    ``data`` is the whole file as bytes, or anything with its length and slices.
    """

    def __init__(self, data, has_metadata: bool = False):
        at = 0
        lead = bytes(data[:3])
        self.version = lead[0] if lead[:1] == bytes([_V1]) else 0
        self.page_values_count = 0
        if self.version == _V1:
            at = 2
            if len(lead) > 1 and lead[1] & _PAGED:
                self.page_values_count = lead[2] if len(lead) > 2 else 0
                at = 3
        self.metadata = b""
        if has_metadata:
            if at + 4 > len(data):
                raise _fail("metadata length")
            (n,) = struct.unpack(">I", data[at : at + 4])
            self.metadata = bytes(data[at + 4 : at + 4 + n])
            at += 4 + n
        if len(data) - at < _BODY_MIN:
            raise _fail("too short")
        self.words_count, self.empty_words_count, n = struct.unpack(">QQQ", data[at : at + 24])
        at += 24
        self.patterns, at = self._dictionary(data, at, n, True)
        if at + 8 > len(data):
            raise _fail("no position dictionary")
        (n,) = struct.unpack(">Q", data[at : at + 8])
        self.positions, at = self._dictionary(data, at + 8, n, False)
        self.size = len(data)
        self.words_start = at
        #: The words; of a part of them (``only``), their offsets begin at ``origin``.
        self.data = data[at:] if isinstance(data, bytes) else files.Blocks(data.path, data.begin + at, data.end, data.block, data.keep)
        self.origin = 0
        self._begins: _Begins | None = None

    @classmethod
    def open(cls, path: str, has_metadata: bool = False, block: int = 1 << 16) -> WordFile:
        """A file whose words are read as they are asked for."""
        return cls(files.Blocks(path, block=block), has_metadata)

    def only(self, path: str, begin: int, end: int) -> None:
        """Keeps the words of [begin, end) alone, in memory."""
        self.data, self.origin = files.read_range(path, self.words_start + begin, end - begin), begin

    @staticmethod
    def _dictionary(data, at: int, n: int, with_bytes: bool) -> tuple[_Codes, int]:
        if at + n > len(data):
            raise _fail("dictionary past the end")
        own, end = bytes(data[at : at + n]), at + n
        depths: list[int] = []
        values: list = []
        at = 0
        while at < n:
            depth, k = read_uvarint(own, at)
            value, j = read_uvarint(own, at + k)
            if not k or not j or depth > _MAX_DEPTH:
                raise _fail("dictionary record")
            at += k + j
            depths.append(depth)
            if with_bytes:
                if at + value > n:
                    raise _fail("pattern past its dictionary")
                values.append(own[at : at + value])
                at += value
            else:
                values.append(value)
        return _Codes(depths, values), end

    def word(self, offset: int) -> tuple[bytes, int]:
        """The word that begins at a byte offset among the words, and where the next one does."""
        n, bit = self.positions.read(self.data, (offset - self.origin) * 8)
        n -= 1
        if n <= 0:
            return b"", self.origin + (bit + 7) // 8
        step, bit = self.positions.read(self.data, bit)
        if not step:
            # No pattern: the bytes lie as they are.
            byte = (bit + 7) // 8
            out = bytes(self.data[byte : byte + n])
            if len(out) != n:
                raise _fail("word past the end")
            return out, self.origin + byte + n
        out, covered, at = bytearray(n), bytearray(n), 0
        while step:
            at += step - 1
            pattern, bit = self.patterns.read(self.data, bit)
            upto = min(n, at + len(pattern))
            out[at:upto] = pattern[: upto - at]
            covered[at:upto] = b"\1" * (upto - at)
            step, bit = self.positions.read(self.data, bit)
        byte = (bit + 7) // 8
        loose = np.flatnonzero(np.frombuffer(covered, np.uint8) == 0)
        literal = self.data[byte : byte + len(loose)]
        if len(literal) != len(loose):
            raise _fail("word past the end")
        np.frombuffer(out, np.uint8)[loose] = np.frombuffer(literal, np.uint8)
        return bytes(out), self.origin + byte + len(loose)

    def skip(self, offset: int) -> tuple[int, int]:
        """The length of the word at ``offset``, and where the next one begins: codes are read, no bytes put together."""
        n, bit = self.positions.read(self.data, (offset - self.origin) * 8)
        n -= 1
        if n <= 0:
            return 0, self.origin + (bit + 7) // 8
        loose, at, upto = n, 0, 0
        while True:
            step, bit = self.positions.read(self.data, bit)
            if not step:
                break
            at += step - 1
            pattern, bit = self.patterns.read(self.data, bit)
            end = min(n, at + len(pattern))
            # Places rise, so what is covered before lies below ``upto``.
            loose -= max(0, end - max(at, upto))
            upto = max(upto, end)
        after = (bit + 7) // 8 + loose
        if after > len(self.data):
            raise _fail("word past the end")
        return n, self.origin + after

    def words(self, offset: int | None = None) -> Iterator[tuple[int, bytes]]:
        """(offset, word) until the bytes run out, whatever the header counts."""
        offset = self.origin if offset is None else offset
        end = self.origin + len(self.data)
        while offset < end:
            word, after = self.word(offset)
            yield offset, word
            offset = after

    def pairs(self) -> Iterator[tuple[bytes, bytes]]:
        """Keys and values in turn; a last key without one has the empty value."""
        words = (w for _, w in self.words())
        for key in words:
            yield key, next(words, b"")

    def pair_blocks(self, begin: int | None = None, end: int | None = None, size: int = 1 << 20) -> Iterator[tuple[pa.Array, pa.Array]]:
        """The keys and values between two offsets at which a key begins, those of ``size`` bytes at once.

        What would follow if a word began at a byte is looked up for all bytes together, so from
        word to word it takes a step; words with patterns or long codes are read one by one.
        """
        begins = self._begins = self._begins or _Begins(self.positions)
        at = 0 if begin is None else begin - self.origin
        end = len(self.data) if end is None else end - self.origin
        most = size
        while at < end:
            n = min(most, end - at)
            raw = bytes(self.data[at : at + n + 2])
            data = np.frombuffer(raw + bytes(n + 2 - len(raw)), np.uint8)
            windows = begins.windows(data)
            steps, last = memoryview(begins.whole[windows]), at + n == end
            starts, odd, here = [], {}, 0
            while here < n:
                after = here + steps[here]
                if after == here or last and after > n:
                    odd[len(starts)], after = self.word(self.origin + at + here)
                    after -= self.origin + at
                elif after > n:
                    break
                starts.append(here)
                here = after
            if len(starts) % 2 and not (last and here >= n):
                here = starts.pop()
                odd.pop(len(starts), None)
            if not starts:
                most *= 2
                continue
            most = size
            where = np.array(starts, np.int64)
            edges = np.empty(2 * len(where), np.int64)
            edges[::2] = where + begins.head[windows[where]]
            edges[1::2] = where + begins.whole[windows[where]]
            if odd:
                # They have no length here, at a place that keeps the edges in order.
                i = np.fromiter(odd, np.int64)
                edges[2 * i] = edges[2 * i + 1] = where[i]
            # Every other element is what lies between two words.
            words = pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(data)]).take(pa.array(np.arange(0, len(edges) - 1, 2)))
            if odd:
                words = pa.array([odd.get(i, w) for i, w in enumerate(words.to_pylist())], pa.large_binary())
            if len(words) % 2:
                words = pa.concat_arrays([words, pa.array([b""], pa.large_binary())])
            turns = np.arange(0, len(words), 2)
            yield words.take(pa.array(turns)), words.take(pa.array(turns + 1))
            at += here

    def keys(self) -> Iterator[tuple[int, bytes]]:
        """(offset, key): values are passed over without being put together."""
        offset, end = self.origin, self.origin + len(self.data)
        while offset < end:
            key, after = self.word(offset)
            yield offset, key
            offset = self.skip(after)[1] if after < end else after


def encode_words(words: Iterable[bytes], compress: bool = False) -> bytes:
    """A .kv file of ``words``; ``compress`` mines a pattern dictionary from them first."""
    words, out = list(words), []
    write_words(lambda: words, out.append, compress)
    return b"".join(out)


def write_words(words: Callable[[], Iterable[bytes]], write: Callable[[bytes], object], compress: bool = False, lengths: Counter[int] | None = None, blocks: Callable[[], Iterable[tuple[np.ndarray, bytes]]] | None = None) -> tuple[array, int]:
    """Writes a .kv file of words that can be gone through more than once: where each begins among the words, and the file's size.

    Once to mine patterns (the first ones only) and once to count codes, if not told
    the ``lengths``, then once to write: of the words themselves none is kept.
    Told ``blocks`` as well, lengths and bytes of many words, it writes those at once
    where no word has a pattern.
    """
    cover = Cover(mine_words(words()) if compress else [])
    uses: Counter[int] = Counter()
    pattern_uses: Counter[int] = Counter()
    if lengths is None or cover.patterns:
        lengths = Counter()
        for w in words():
            lengths[len(w)] += 1
            last = 0
            for start, pattern in cover.of(w) if cover.patterns else ():
                uses[start - last + 1] += 1
                pattern_uses[pattern] += 1
                last = start
    count = sum(lengths.values())
    for n, c in lengths.items():
        uses[n + 1] += c
    if count:
        # An uncompressed file counts the terminator for the empty word as well; either way the reader's codes agree.
        uses[0] += count
    kept = sorted(pattern_uses)
    pattern_code, pattern_dict = {}, b""
    for i, depth, code in huffman([(pattern_uses[p], i) for i, p in enumerate(kept)]):
        pattern = cover.patterns[kept[i]]
        pattern_code[kept[i]] = (code, depth)
        pattern_dict += uvarint(depth) + uvarint(len(pattern)) + pattern
    places = sorted(uses)
    place_code, place_dict = {}, b""
    for i, depth, code in huffman([(uses[p], p) for p in places]):
        place_code[places[i]] = (code, depth)
        place_dict += uvarint(depth) + uvarint(places[i])
    head = struct.pack(">QQQ", count, lengths[0], len(pattern_dict)) + pattern_dict + struct.pack(">Q", len(place_dict)) + place_dict
    write(head)
    bits = BitWriter()
    offsets, at = array("q"), 0
    if blocks is not None and not cover.patterns:
        begun = []
        for n in (known := sorted(lengths)):
            bits.put(*place_code[n + 1])
            if n:
                bits.put(*place_code[0])
            begun.append(bits.flush())
        for sizes, data in blocks():
            out, begins = _with_begins(np.array(known), begun, sizes, data)
            offsets.frombytes((begins + at).tobytes())
            at += len(out)
            write(out.tobytes())
        return offsets, len(head) + at
    held: list[bytes] = []
    size = 0
    # Words without a pattern begin alike where they are of a length.
    plain: dict[int, bytes] = {}
    for w in words():
        offsets.append(at)
        c = cover.of(w) if cover.patterns else ()
        if not c and (begun := plain.get(len(w))) is not None:
            parts = [begun, w]
        else:
            bits.put(*place_code[len(w) + 1])
            loose, last, upto = [], 0, 0
            if w:
                for start, pattern in c:
                    bits.put(*place_code[start - last + 1])
                    bits.put(*pattern_code[pattern])
                    loose.append(w[upto:start])
                    last, upto = start, start + len(cover.patterns[pattern])
                bits.put(*place_code[0])
            parts = [bits.flush(), *loose, w[upto:]]
            if not c:
                plain[len(w)] = parts[0]
        n = sum(map(len, parts))
        at, size = at + n, size + n
        held += parts
        if size >= _FLUSH:
            write(b"".join(held))
            held, size = [], 0
    write(b"".join(held))
    return offsets, len(head) + at


def _with_begins(known: np.ndarray, begun: list[bytes], sizes: np.ndarray, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Words each behind what begins those of its length, and their places."""
    which = np.searchsorted(known, sizes)
    more = np.array([len(b) for b in begun])[which]
    whole = more + sizes
    begins = np.cumsum(whole) - whole
    out, own = np.empty(int(whole.sum()), np.uint8), np.ones(int(whole.sum()), bool)
    table = np.array([list(b.ljust(max(map(len, begun)), b"\0")) for b in begun], np.uint8)
    for i in range(table.shape[1]):
        has = np.flatnonzero(more > i)
        out[begins[has] + i] = table[which[has], i]
        own[begins[has] + i] = False
    out[own] = np.frombuffer(data, np.uint8)
    return out, begins


#: Bytes put together before they are written, what a word takes in memory beside its own, and bytes of pairs taken at once.
_FLUSH, _PER_WORD, _AT_ONCE = 1 << 20, 50, 8 << 20


class Spool:
    """Words in a hidden file beside their target until their codes are known; memory holds how many there are of each length."""

    def __init__(self, target: str):
        folder, mark, name = target.rpartition("/")
        self.path = f"{folder}{mark}{name if name.startswith('.') else '.' + name}.{uuid.uuid4().hex}.words"
        self.count, self.lengths = 0, Counter()
        fs, inner = files.of(self.path)
        self.out = fs.open_output_stream(inner)
        self.held: list[bytes] = []
        self.size = 0

    def add(self, word: bytes) -> None:
        self.count += 1
        self.lengths[len(word)] += 1
        self.held.append(word)
        self.size += len(word) + _PER_WORD
        if self.size >= _FLUSH:
            self._flush()

    def add_all(self, words: pa.Array) -> None:
        """The words of a large binary array without nulls."""
        self._flush()
        edges = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
        sizes = np.diff(edges)
        for n, c in zip(*(x.tolist() for x in np.unique(sizes, return_counts=True))):
            self.lengths[n] += c
        self.count += len(words)
        data = words.buffers()[2]
        self._put(sizes, data.slice(edges[0], edges[-1] - edges[0]) if data is not None else b"")

    def _flush(self) -> None:
        if self.held:
            self._put(np.fromiter(map(len, self.held), np.int64), b"".join(self.held))
            self.held, self.size = [], 0

    def _put(self, sizes: np.ndarray, data) -> None:
        self.out.write(struct.pack("<QQ", len(sizes), len(data)) + sizes.astype("<u4").tobytes())
        self.out.write(data)

    def blocks(self) -> Iterator[tuple[np.ndarray, bytes]]:
        """Some words' lengths, and their bytes one behind the other."""
        if not self.out.closed:
            self._flush()
            self.out.close()
        fs, inner = files.of(self.path)
        with fs.open_input_stream(inner, buffer_size=_FLUSH) as f:
            while head := f.read(16):
                count, size = struct.unpack("<QQ", head)
                yield np.frombuffer(f.read(4 * count), "<u4").astype(np.int64), f.read(size) if size else b""

    def words(self) -> Iterator[bytes]:
        for sizes, data in self.blocks():
            at = 0
            for n in sizes.tolist():
                yield data[at : at + n]
                at += n

    def write_to(self, path: str, compress: bool) -> tuple[array, int]:
        """The .kv file of the words, under its name only once it is whole."""
        fs, inner = files.of(path)
        temporary = f"{self.path}.kv"
        try:
            with fs.open_output_stream(files.of(temporary)[1]) as f:
                told = write_words(self.words, f.write, compress, self.lengths, self.blocks)
            files.move(temporary, path)
            return told
        finally:
            if files.exists(temporary):
                files.remove(temporary)

    def remove(self) -> None:
        if not self.out.closed:
            self.out.close()
        if files.exists(self.path):
            files.remove(self.path)


class KeyNotes:
    """What an index and a filter need of the keys: each M-th one, and a hash of each."""

    def __init__(self, fanout: int = 256, salt: int | None = None):
        self.fanout, self.salt, self.count = max(1, fanout), salt, 0
        self.nodes: list[bytes] = []
        self.hashes: list[np.ndarray] = []
        self.held: list[bytes] = []

    def add(self, key: bytes) -> None:
        if self.count % self.fanout == 0:
            self.nodes.append(key)
        self.count += 1
        if self.salt is not None:
            self.held.append(key)
            if len(self.held) >= 1 << 16:
                self._hash()

    def add_all(self, keys: pa.Array) -> None:
        self.nodes += keys.take(pa.array(np.arange(-self.count % self.fanout, len(keys), self.fanout))).to_pylist()
        self.count += len(keys)
        if self.salt is not None:
            self.hashes.append(murmur3_array(keys, self.salt))

    def _hash(self) -> None:
        self.hashes.append(murmur3_array(pa.array(self.held, pa.binary()), self.salt))
        self.held = []

    def filter_file(self) -> bytes:
        self._hash()
        return _filter_of(np.concatenate(self.hashes))


def encode_filter(keys: Sequence[bytes], salt: int) -> bytes:
    """A .kvei file; below two keys it is empty and matches everything."""
    return _filter_of(murmur3_array(pa.array(keys, pa.binary()), salt))


def _filter_of(hashes: np.ndarray) -> bytes:
    n = len(hashes)
    if n < 2:
        return b""
    m, mixed = max(2, optimal_bits(n)), filter_keys(n)
    bits = np.zeros(-(-m // 64) * 8, np.uint8)
    for begin in range(0, n, 1 << 20):
        at = bit_positions(hashes[begin : begin + (1 << 20)], mixed, m).ravel()
        np.bitwise_or.at(bits, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
    return _BLOOM_MAGIC + struct.pack("<6Q", HASHES, n, m, *mixed) + bits.tobytes() + bytes(_BLOOM_TAIL)


@dataclass
class FilterFile:
    """A .kvei file.  kind ``empty`` and ``unsupported`` match every key.  ``bits``: bytes, or slices of a file."""

    kind: str
    keys: tuple[int, ...] = ()
    m: int = 0
    bits: object = b""

    @classmethod
    def parse(cls, data) -> FilterFile:
        if not len(data):
            return cls("empty")
        head = bytes(data[:_BLOOM_HEAD])
        if len(head) == _BLOOM_HEAD and head[:12] == _BLOOM_MAGIC:
            k, _n, m, *keys = struct.unpack_from("<6Q", head, 12)
            end = _BLOOM_HEAD + 8 * -(-m // 64)
            if k == HASHES and m >= 2 and end <= len(data):
                return cls("bloom", tuple(keys), m, data[_BLOOM_HEAD:end] if isinstance(data, bytes) else files.Blocks(data.path, _BLOOM_HEAD, end, keep=_FILTER_BLOCKS))
        return cls("unsupported")

    @property
    def accelerates(self) -> bool:
        return self.kind == "bloom"

    def contains(self, keys: Sequence[bytes] | pa.Array, salt: int) -> np.ndarray:
        """False: certainly absent."""
        if not self.accelerates:
            return np.ones(len(keys), bool)
        at = bit_positions(murmur3_array(keys if isinstance(keys, pa.Array) else pa.array(keys, pa.binary()), salt), self.keys, self.m)
        places = (at >> 3).ravel()
        held = (self.bits.at(places) if isinstance(self.bits, files.Blocks) else np.frombuffer(self.bits, np.uint8)[places]).reshape(at.shape)
        return ((held >> (at & 7).astype(np.uint8)) & 1).all(1)

    def word_rows(self, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and bits of the words of [begin, end) that have a bit set."""
        words = np.frombuffer(bytes(self.bits[8 * begin : 8 * end]), "<i8")
        at = np.flatnonzero(words)
        return at + begin, words[at]


def encode_index(offsets: Sequence[int], keys: Sequence[bytes], most: int, layout: str = "legacy", fanout: int = DEFAULT_FANOUT, magic: bytes = bytes(8)) -> bytes:
    """A .bt file.  The footer layout ends in eight bytes of ``magic``, which the reader of the file sets."""
    return index_of(offsets, keys[:: max(1, fanout)], most, layout, fanout, magic)


def index_of(offsets: Sequence[int], nodes: Sequence[bytes], most: int, layout: str = "legacy", fanout: int = DEFAULT_FANOUT, magic: bytes = bytes(8)) -> bytes:
    """The same from every ``fanout``-th key."""
    if not len(offsets):
        return b""
    sequence = ef_encode(offsets, most)
    if layout == "legacy":
        return sequence
    if layout != "footer" or len(magic) != 8:
        raise ValueError("layout is legacy or footer, magic eight bytes")
    fanout = max(1, fanout)
    out = bytearray([_FOOTER_FIRST])
    for key in nodes:
        if len(key) > 0xFFFF:
            raise FormatError("an indexed key is longer than 65535 bytes")
        out += struct.pack(">H", len(key)) + key
    out += bytes(-len(out) % _PAGE)
    at = len(out)
    out += sequence
    out += bytes(-len(out) % 8)
    return bytes(out) + struct.pack(">QQQ", len(offsets), fanout, at) + struct.pack(">IHH", _META, 0, _BT_VERSION) + magic


@dataclass
class IndexFile:
    """A .bt file: the offset of each key, and the fanout where the layout has it."""

    offsets: EliasFano | None
    fanout: int | None = None

    @classmethod
    def parse(cls, data) -> IndexFile:
        """From bytes, or from slices of a file, of which only what is asked for is read."""
        size = len(data)
        if not size:
            return cls(None)
        if bytes(data[:1]) == b"\0":
            return cls(EliasFano(data))
        if size < _ANCHOR + _META:
            raise FormatError("index footer cut short")
        (length,) = struct.unpack(">I", data[size - _ANCHOR : size - _ANCHOR + 4])
        begin = size - _ANCHOR - length
        if length < _META or begin < 0:
            raise FormatError("corrupt index footer")
        count, fanout, at = struct.unpack(">QQQ", data[begin : begin + 24])
        if at >= begin:
            raise FormatError("index offsets lie beyond the body")
        offsets = EliasFano(data, at)
        if len(offsets) != count:
            raise FormatError(f"index has {len(offsets)} keys, its footer says {count}")
        return cls(offsets, fanout)

    @property
    def key_count(self) -> int:
        return len(self.offsets) if self.offsets is not None else 0

    def key_offset(self, i: int) -> int | None:
        return self.offsets.get(i) if self.offsets is not None and 0 <= i < len(self.offsets) else None


class TripleWriter:
    """Pairs one by one into ``base``.kv, .bt and, with a salt, .kvei; keys must strictly rise.

    Words wait in a spool beside the target; of each key memory holds its offset and hash.
    """

    def __init__(self, base: str, compress: bool = False, salt: int | None = None, layout: str = "footer", fanout: int = DEFAULT_FANOUT, magic: bytes = bytes(8)):
        self.base, self.compress, self.layout, self.magic = base, compress, layout, magic
        self.notes, self.spool, self.last = KeyNotes(fanout, salt), Spool(base), None

    @property
    def key_count(self) -> int:
        return self.notes.count

    def add(self, key: bytes, value: bytes | None) -> None:
        key = bytes(key)
        if self.last is not None and key <= self.last:
            raise FormatError(f"keys must be strictly increasing: {key!r} after {self.last!r}")
        self.last = key
        self.notes.add(key)
        self.spool.add(key)
        self.spool.add(bytes(value or b""))

    def add_all(self, keys: pa.Array, values: pa.Array) -> None:
        """The same of two arrays of as many."""
        keys, values = keys.cast(pa.large_binary()), values.cast(pa.large_binary()).fill_null(b"")
        if keys.null_count:
            raise FormatError("a key is null")
        step = max(1, len(keys) * _AT_ONCE // max(1, keys.nbytes + values.nbytes))
        for begin in range(0, len(keys), step):
            k, v = keys[begin : begin + step], values[begin : begin + step]
            falls = pc.index(pc.less(k[:-1], k[1:]), False).as_py() + 1
            if self.last is not None and k[0].as_py() <= self.last or falls:
                before, key = (k[falls - 1].as_py(), k[falls].as_py()) if falls else (self.last, k[0].as_py())
                raise FormatError(f"keys must be strictly increasing: {key!r} after {before!r}")
            self.last = k[-1].as_py()
            self.notes.add_all(k)
            turns = np.arange(2 * len(k)).reshape(2, -1).T.ravel()
            self.spool.add_all(pa.concat_arrays([k, v]).take(pa.array(turns)))

    def finish(self) -> dict[str, str | None]:
        """The paths of the triple's files."""
        try:
            offsets, size = self.spool.write_to(f"{self.base}.kv", self.compress)
            offsets = offsets[::2]
            files.write(f"{self.base}.bt", index_of(offsets, self.notes.nodes, size, self.layout, self.notes.fanout, self.magic))
            if self.notes.salt is not None:
                files.write(f"{self.base}.kvei", self.notes.filter_file())
        finally:
            self.abandon()
        return {e: f"{self.base}.{e}" if e != "kvei" or self.notes.salt is not None else None for e in _ENDINGS}

    def abandon(self) -> None:
        self.spool.remove()


def write_triple(base: str, pairs: Iterable[tuple[bytes, bytes]], compress: bool = False, salt: int | None = None, layout: str = "footer", fanout: int = DEFAULT_FANOUT, magic: bytes = bytes(8)) -> dict[str, str | None]:
    """Writes a triple of ``pairs``, which are gone through once; their paths."""
    writer = TripleWriter(base, compress, salt, layout, fanout, magic)
    try:
        for key, value in pairs:
            writer.add(key, value)
        return writer.finish()
    finally:
        writer.abandon()


@dataclass
class _File(InputPartition):
    """A file, or its pairs of a range of ordinals, which lie between two offsets among the words."""

    path: str
    first: int = 0
    begin: int | None = None
    end: int | None = None


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.metadata = options.get("hasmetadata", "false").lower() == "true"
        self.words = options.get("words", "false").lower() == "true"
        self.split_bytes = int(options.get("splitbytes", SPLIT_BYTES))
        self.key: bytes | None = None

    def partitions(self) -> list[InputPartition]:
        return [part for p in files.with_ending(self.path, ".kv") for part in self._parts(p)]

    def _parts(self, path: str) -> list[_File]:
        """A file is split at keys whose offsets its index has, a few of which are read; a file without an index is one part."""
        index = path.removesuffix(".kv") + ".bt"
        size = files.size(path)
        if size <= self.split_bytes or not files.exists(index) or self.key is not None:
            return [_File(path)]
        held = IndexFile.parse(files.Blocks(index))
        n = min(held.key_count, -(-size // self.split_bytes))
        firsts = [i * held.key_count // n for i in range(n)]
        begins = [0, *(held.key_offset(i) for i in firsts[1:])] if n else []
        ends: list[int | None] = [*begins[1:], None]
        return [_File(path, f, b, e) for f, b, e in zip(firsts, begins, ends)] or [_File(path)]

    def read(self, partition: _File) -> Iterator[tuple]:
        path, name = partition.path, files.name(partition.path)
        file = WordFile.open(path, self.metadata, 1 << 22)
        if partition.begin is not None:
            file.only(path, partition.begin, file.size - file.words_start if partition.end is None else partition.end)
        if self.words:
            for pos, (_, word) in enumerate(file.words(), 2 * partition.first):
                yield pos, word, name
            return
        if self.key is not None:
            value = lookup(path, self.key, self.metadata)
            if value is not None:
                yield self.key, value, name
            return
        for key, value in file.pairs():
            yield key, value, name


def lookup(path: str, key: bytes, has_metadata: bool = False) -> bytes | None:
    """The value of ``key`` in a file: by binary search where it has an index, else by a scan up to the key's place."""
    file = WordFile.open(path, has_metadata)
    base = path.removesuffix(".kv")
    if not files.exists(f"{base}.bt"):
        for k, v in file.pairs():
            if k >= key:
                return v if k == key else None
        return None
    return search(file, IndexFile.parse(files.Blocks(f"{base}.bt")), key)


def search(file: WordFile, index: IndexFile, key: bytes) -> bytes | None:
    lo, hi = 0, index.key_count
    while lo < hi:
        mid = (lo + hi) // 2
        found, after = file.word(index.key_offset(mid))
        if found == key:
            return file.word(after)[0] if after < len(file.data) else b""
        lo, hi = (mid + 1, hi) if found < key else (lo, mid)
    return None


def search_many(file: WordFile, index: IndexFile, wanted: pa.Array) -> tuple[pa.Array, pa.Array]:
    """What ``search`` finds of some rising keys, and its values: a key's place halves the others', and where many lie close all pairs there are read at once."""
    keys, found = wanted.to_pylist(), []

    def place(key: bytes, lo: int, hi: int) -> int:
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if file.word(index.key_offset(mid))[0] < key else (lo, mid)
        return lo

    def offset(i: int) -> int:
        return index.key_offset(i) if i < index.key_count else len(file.data)

    def look(first: int, last: int, lo: int, hi: int) -> None:
        n = last - first
        if not n or lo >= hi:
            return
        if n == 1:
            at = place(keys[first], lo, hi)
            word, after = file.word(offset(at)) if at < hi else (None, 0)
            if word == keys[first]:
                value = file.word(after)[0] if after < len(file.data) else b""
                found.append((wanted[first:last], pa.array([value], pa.large_binary())))
        elif hi - lo <= _NEAR_PAIRS * n and offset(hi) - offset(lo) <= _NEAR_BYTES * n:
            found.extend(matches(wanted[first:last], *block) for block in file.pair_blocks(offset(lo), offset(hi)))
        else:
            middle = (first + last) // 2
            at = place(keys[middle], lo, hi)
            look(first, middle, lo, at)
            look(middle, last, at, hi)

    if keys:
        lo = place(keys[0], 0, index.key_count)
        hi = place(keys[-1], lo, index.key_count)
        look(0, len(keys), lo, min(hi + 1, index.key_count))
    return joined(found)


class OrderedScan:
    """Lookups in a file without an index, each by a scan up to the key's place; keys asked for in order share one."""

    def __init__(self, file: WordFile):
        self.file = file
        self._restart()

    def _restart(self) -> None:
        self.blocks = self.file.pair_blocks()
        self.below: bytes | None = None
        self.top: bytes | None = None
        self.keys = self.values = pa.array([], pa.large_binary())

    def _next(self) -> bool:
        """Goes to the next block; of its keys those are seen that are larger than all before, as when a scan ends at the first that is not smaller."""
        block = next(self.blocks, None)
        if block is None:
            return False
        self.below = self.top
        keys, values = block
        if not (self.top is None or keys[0].as_py() > self.top) or not pc.all(pc.less(keys[:-1], keys[1:])).as_py():
            top, seen = self.top, []
            for i, key in enumerate(keys.to_pylist()):
                if top is None or key > top:
                    top = key
                    seen.append(i)
            keys, values = keys.take(pa.array(seen, pa.int64())), values.take(pa.array(seen, pa.int64()))
        self.keys, self.values = keys, values
        self.top = keys[-1].as_py() if len(keys) else self.top
        return True

    def find(self, wanted: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Those of some rising keys that are there, and their values."""
        keys = wanted.to_pylist()
        if keys and self.below is not None and keys[0] <= self.below:
            self._restart()
        found, at = [], 0
        while at < len(keys):
            # What is not above the largest key so far can stand in no later block.
            upto = bisect_right(keys, self.top, at) if self.top is not None else at
            if upto > at:
                found.append(matches(wanted[at:upto], self.keys, self.values))
                at = upto
            elif not self._next():
                break
        return joined(found)


def matches(wanted: pa.Array, keys: pa.Array, values: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Those of ``wanted`` that are among ``keys``, and their values."""
    at = pc.index_in(wanted, value_set=keys)
    return wanted.filter(at.is_valid()), values.take(at.drop_null())


def joined(found: list[tuple[pa.Array, pa.Array]]) -> tuple[pa.Array, pa.Array]:
    none = pa.array([], pa.large_binary())
    return pa.concat_arrays([none, *(k for k, _ in found)]), pa.concat_arrays([none, *(v for _, v in found)])


class _PushingReader(_Reader):
    """A reader that takes a key equality upon itself; Spark does not apply it again."""

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            if not self.words and isinstance(f, EqualTo) and f.attribute == ("key",) and self.key is None:
                self.key = bytes(f.value)
            else:
                yield f


@dataclass
class _Written(WriterCommitMessage):
    base: str | None
    part: int = 0


class _Writer(DataSourceArrowWriter):
    """Tasks write hidden files with names of their own; ``commit`` gives them final names none else has.

    Without ``name`` those are ``part-<number>-<job>``.  With it, ``<name>`` where one
    partition has rows, else ``<name>.p<number>``, all of that name's step range.
    Appending onto an existing name fails before anything is moved.  Overwriting removes,
    after the new files are there, every other triple of the folder, or, with ``name``,
    that name's.
    """

    def __init__(self, options: dict[str, str], overwrite: bool = False):
        self.folder = options["path"].rstrip("/")
        self.overwrite = overwrite
        self.name = options.get("name", "").removesuffix(".kv")
        self.job = uuid.uuid4().hex
        self.compress = options.get("compress", "false").lower() == "true"
        self.salt = int(options["salt"]) if "salt" in options else None
        self.layout = options.get("layout", "footer")
        self.fanout = int(options.get("fanout", DEFAULT_FANOUT))

    def write(self, iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        batches = (b for b in iterator if b.num_rows)
        first = next(batches, None)
        if first is None:
            return _Written(None)
        files.make_folder(self.folder)
        base = f"{self.folder}/.{self.job}-{uuid.uuid4().hex}"
        writer = TripleWriter(base, self.compress, self.salt, self.layout, self.fanout)
        try:
            for batch in chain([first], batches):
                writer.add_all(batch.column("key"), batch.column("value"))
            writer.finish()
        finally:
            writer.abandon()
        return _Written(base, TaskContext.get().partitionId())

    def _mine(self, file: str) -> bool:
        """Whether an old file is to go: with a name, only that name's."""
        base = file.rpartition(".")[0]
        return not self.name or base == self.name or (base.startswith(f"{self.name}.p") and base[len(self.name) + 2 :].isdigit())

    def commit(self, messages) -> None:
        done = [m for m in messages if m and m.base]
        final = lambda m: f"part-{m.part:05d}-{self.job}" if not self.name else self.name if len(done) == 1 else f"{self.name}.p{m.part:05d}"
        held = [n for n in files.names(self.folder) if n.endswith(tuple(f".{e}" for e in _ENDINGS)) and not n.startswith(".")] if done or self.overwrite else []
        old = [n for n in held if self._mine(n)]
        if self.name and old and not self.overwrite:
            self.abort(messages)
            raise FileExistsError(f"{self.folder}/{old[0]} is there already")
        new = set()
        for m in done:
            for ending in _ENDINGS:
                if files.exists(f"{m.base}.{ending}"):
                    name = f"{final(m)}.{ending}"
                    if name in old:
                        files.remove(f"{self.folder}/{name}")
                    files.move(f"{m.base}.{ending}", f"{self.folder}/{name}")
                    new.add(name)
        if self.overwrite:
            for n in old:
                if n not in new:
                    files.remove(f"{self.folder}/{n}")
        self.abort([])

    def abort(self, messages) -> None:
        """Removes what the job's tasks left, those of lost attempts too."""
        for n in files.names(self.folder):
            if n.startswith(f".{self.job}-"):
                files.remove(f"{self.folder}/{n}")


class KvSegSource(DataSource):
    """Options: path (a file or folder), hasMetadata, words (a row a word instead of a pair), splitBytes, pushdown
    (with ``spark.sql.python.filterPushdown.enabled``); writing: name, compress, salt, layout, fanout."""

    @classmethod
    def name(cls) -> str:
        return "kvseg"

    def schema(self) -> str:
        return "pos long, word binary, file_name string" if self.options.get("words", "false").lower() == "true" else "key binary, value binary, file_name string"

    def reader(self, schema) -> DataSourceReader:
        return (_PushingReader if self.options.get("pushdown", "false").lower() == "true" else _Reader)(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options, overwrite)


def register(spark) -> None:
    spark.dataSource.register(KvSegSource)
