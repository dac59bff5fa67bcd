"""Integer and entropy codes of the file formats: varints, monotone sequences, Huffman codes, bit streams."""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

import numpy as np

# Fixed values of the monotone-sequence layout: values a jump entry and a super-block cover.
_Q, _SUPER = 256, 16384
_SUPER_WORDS = 1 + _SUPER // _Q // 2
#: Values whose bits are put in place at once.
_AT_ONCE = 1 << 20


def uvarint(n: int) -> bytes:
    """Little-endian base 128."""
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def read_uvarint(data: bytes, at: int = 0) -> tuple[int, int]:
    """(value, bytes read) of the varint at ``at``; (0, 0) where it is cut short or over 64 bits."""
    value = 0
    for i, b in enumerate(data[at : at + 10]):
        value |= (b & 0x7F) << 7 * i
        if b < 0x80:
            return (value, i + 1) if value < 2**64 else (0, 0)
    return 0, 0


def select64(x: int, k: int) -> int:
    """Place of the ``k``-th (from 0) set bit; 64 where there is none."""
    if k >= x.bit_count():
        return 64
    for _ in range(k):
        x &= x - 1
    return (x & -x).bit_length() - 1


class FormatError(ValueError):
    """Bytes that are not what their format says."""


def _shape(count: int, universe: int) -> tuple[int, int, int, int]:
    """Low bits a value, and words of the lower, upper and jump parts."""
    low = max(0, (universe // count).bit_length() - 1)
    lower = -(-count * low // 64) + 1
    upper = -(-(count + (universe >> low)) // 64)
    jump = count // _SUPER * _SUPER_WORDS
    if rest := count % _SUPER:
        jump += 1 + (-(-rest // _Q) + 3) // 2
    return low, lower, upper, jump


def ef_encode(values: Sequence[int], most: int | None = None) -> bytes:
    """A rising sequence (repeats allowed) as low bits, unary high parts and a jump table."""
    v = np.asarray(values, np.uint64)
    if not len(v) or (v[1:] < v[:-1]).any():
        raise FormatError("a monotone sequence must have values and not fall")
    most = int(v[-1]) if most is None else most
    if int(v[-1]) > most:
        raise FormatError("a value is over the largest allowed")
    low, n_lower, n_upper, n_jump = _shape(len(v), most + 1)
    lower = np.zeros(n_lower * 64, np.uint8)
    upper = np.zeros(n_upper * 64, np.uint8)
    for begin in range(0, len(v), _AT_ONCE):
        part = v[begin : begin + _AT_ONCE]
        order = np.arange(begin, begin + len(part))
        for b in range(low):
            lower[order * low + b] = part >> np.uint64(b) & np.uint64(1)
        upper[(part >> np.uint64(low)).astype(np.int64) + order] = 1
    jump = np.zeros(n_jump * 2, np.uint32)
    for begin in range(0, len(v), _SUPER):
        word = begin // _SUPER * _SUPER_WORDS
        order = np.arange(begin, min(begin + _SUPER, len(v)), _Q)
        ones = (v[order] >> np.uint64(low)).astype(np.int64) + order
        base = int(ones[0])
        jump[2 * word : 2 * word + 2] = base & 0xFFFFFFFF, base >> 32
        inside = ones - base
        jump[2 * word + 2 : 2 * word + 2 + len(inside)] = inside
    pack = lambda bits: np.packbits(bits, bitorder="little").tobytes()
    return (len(v) - 1).to_bytes(8, "big") + (most + 1).to_bytes(8, "big") + pack(lower) + pack(upper) + jump.astype("<u4").tobytes()


class EliasFano:
    """A monotone sequence read from ``ef_encode``'s bytes, or from any object with their length and slices.

    ``get`` reads a jump entry, the few words behind it and one value's low bits;
    ``values`` decodes all at once.
    """

    def __init__(self, data: bytes, base: int = 0):
        head = bytes(data[base : base + 16])
        if len(head) < 16:
            raise FormatError("monotone sequence: header cut short")
        self.count = int.from_bytes(head[:8], "big") + 1
        universe = int.from_bytes(head[8:], "big")
        self.low, self.n_lower, self.n_upper, self.n_jump = _shape(self.count, universe)
        self.data, self.lower_at = data, base + 16
        self.upper_at = self.lower_at + 8 * self.n_lower
        self.jump_at = self.upper_at + 8 * self.n_upper
        if self.jump_at > len(data):
            raise FormatError("monotone sequence: shorter than its header says")
        self._has_jump = self.jump_at + 8 * self.n_jump <= len(data)
        self._all: np.ndarray | None = None

    def __len__(self) -> int:
        return self.count

    def values(self) -> np.ndarray:
        if self._all is None:
            bits = lambda lo, hi: np.unpackbits(np.frombuffer(bytes(self.data[lo:hi]), np.uint8), bitorder="little")
            ones = np.flatnonzero(bits(self.upper_at, self.jump_at))[: self.count]
            v = (ones - np.arange(self.count)).astype(np.uint64) << np.uint64(self.low)
            low = bits(self.lower_at, self.upper_at)[: self.count * self.low].reshape(self.count, self.low)
            for b in range(self.low):
                v |= low[:, b].astype(np.uint64) << np.uint64(b)
            self._all = v
        return self._all

    def get(self, i: int) -> int:
        if not 0 <= i < self.count:
            raise IndexError(i)
        if self._all is not None or not self._has_jump:
            return int(self.values()[i])
        at = self.jump_at + 8 * (i // _SUPER * _SUPER_WORDS)
        entry = at + 8 + 4 * (i % _SUPER // _Q)
        one = int.from_bytes(self.data[at : at + 8], "little") + int.from_bytes(self.data[entry : entry + 4], "little")
        # From the one of the jump entry to the i-th: over whole words, then into one.
        left, word = i % _Q, one >> 6
        held = self._word(word) >> (one & 63) << (one & 63)
        while (n := held.bit_count()) <= left:
            left -= n
            word += 1
            held = self._word(word)
        high = (word << 6) + select64(held, left) - i
        bit = i * self.low
        begin = self.lower_at + (bit >> 3)
        low = int.from_bytes(self.data[begin : begin + 9], "little") >> (bit & 7) & ((1 << self.low) - 1)
        return high << self.low | low

    def _word(self, word: int) -> int:
        at = self.upper_at + 8 * word
        if at >= self.jump_at:
            raise FormatError("monotone sequence: fewer values than its header says")
        return int.from_bytes(self.data[at : at + 8], "little")


def huffman(symbols: Sequence[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(symbol index, depth, code) in the order of the codes' paths.

    ``symbols``: (uses, seed).  Leaves wait in order of uses, then of the seed's bits
    reversed; joined nodes wait in order of creation, and go first only if strictly
    rarer.  The first taken is branch 0.  A code's lowest bit is the root's branch.  A
    single symbol has depth 0.
    """
    back = lambda x: int(f"{x:064b}"[::-1], 2)
    leaves = deque(sorted(range(len(symbols)), key=lambda i: (symbols[i][0], back(symbols[i][1]))))
    joined: deque[tuple[int, tuple]] = deque()

    def take() -> tuple[int, object]:
        if joined and (not leaves or joined[0][0] < symbols[leaves[0]][0]):
            return joined.popleft()
        i = leaves.popleft()
        return symbols[i][0], i

    while len(leaves) + len(joined) > 1:
        (a, left), (b, right) = take(), take()
        joined.append((a + b, (left, right)))
    if not joined:
        return [(i, 0, 0) for i in leaves]
    out, stack = [], [(joined[0][1], 0, 0)]
    while stack:
        node, depth, code = stack.pop()
        if isinstance(node, tuple):
            stack += [(node[1], depth + 1, code | 1 << depth), (node[0], depth + 1, code)]
        else:
            out.append((node, depth, code))
    return out


def codes_from_depths(depths: Sequence[int]) -> list[int]:
    """The codes (lowest bit first) of leaves listed in path order, from their depths alone."""
    codes, path, last = [], 0, None
    for depth in depths:
        if last is not None:
            path += 1
            path = path << depth - last if depth >= last else path >> last - depth
        codes.append(int(f"{path:0{depth}b}"[::-1], 2) if depth else 0)
        last = depth
    return codes


class BitWriter:
    """Codes into bytes, lowest bit first."""

    def __init__(self) -> None:
        self.held = self.bits = 0

    def put(self, code: int, bits: int) -> None:
        self.held |= code << self.bits
        self.bits += bits

    def flush(self) -> bytes:
        """All so far, padded to a byte."""
        data = self.held.to_bytes((self.bits + 7) // 8, "little")
        self.held = self.bits = 0
        return data
