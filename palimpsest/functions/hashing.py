"""The 64-bit key hash (first half of MurmurHash3 x64 128) and the three-bit schedule of existence filters."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of MurmurHash3 x64 128 and of splitmix64.
_C1, _C2 = np.uint64(0x87C37B91114253D5), np.uint64(0x4CF5AD432745937F)
_N1, _N2 = np.uint64(0x52DCE729), np.uint64(0x38495AB5)
_F1, _F2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_GOLDEN, _S1, _S2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
_SEED = 0x123456789ABCDEF0
_M64 = 2**64 - 1

#: Bits an existence filter sets for a key, and the false-positive rate its size is taken for.
#: With three bits the rate is really about 1.94 %.
HASHES, RATE = 3, 0.01


def _rotl(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def _final(x: np.ndarray) -> np.ndarray:
    for c in (_F1, _F2):
        x = (x ^ (x >> np.uint64(33))) * c
    return x ^ (x >> np.uint64(33))


def murmur3_rows(rows: np.ndarray, seed: int | np.ndarray) -> np.ndarray:
    """h1 of each row of a byte matrix, all columns at once; one seed, or one for each row."""
    n, length = rows.shape
    whole = length // 16
    padded = np.zeros((n, (whole + 1) * 16), np.uint8)
    padded[:, :length] = rows
    words = padded.view("<u8")
    h1 = np.broadcast_to(np.asarray(seed, np.uint64), n).copy()
    h2 = h1.copy()
    for i in range(whole):
        h1 = (_rotl(h1 ^ _rotl(words[:, 2 * i] * _C1, 31) * _C2, 27) + h2) * np.uint64(5) + _N1
        h2 = (_rotl(h2 ^ _rotl(words[:, 2 * i + 1] * _C2, 33) * _C1, 31) + h1) * np.uint64(5) + _N2
    # The rest is padded with zeros, and a zero word leaves its half as it is.
    h2 ^= _rotl(words[:, 2 * whole + 1] * _C2, 33) * _C1
    h1 ^= _rotl(words[:, 2 * whole] * _C1, 31) * _C2
    h1 ^= np.uint64(length)
    h2 ^= np.uint64(length)
    h1 = h1 + h2
    h2 = h2 + h1
    return _final(h1) + _final(h2)


def murmur3_array(keys: pa.Array, seed: int) -> np.ndarray:
    """h1 of each key of a binary array; nulls hash as the empty key.  Keys of a length go together."""
    keys = keys.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(keys.buffers()[1], np.int64)[keys.offset : keys.offset + len(keys) + 1]
    data = np.frombuffer(keys.buffers()[2] or b"", np.uint8)
    sizes = np.diff(offsets)
    out = np.zeros(len(keys), np.uint64)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        rows = data[offsets[at][:, None] + np.arange(size)] if size else np.zeros((len(at), 0), np.uint8)
        out[at] = murmur3_rows(rows, seed)
    return out


def murmur3_h1(key: bytes, seed: int = 0) -> int:
    return int(murmur3_rows(np.frombuffer(key, np.uint8)[None, :], seed)[0])


def murmur3(key: Column, salt: int) -> Column:
    """The hash as a signed BIGINT with the same bits; null for a null key."""

    @F.arrow_udf("long")
    def h1(keys: pa.Array) -> pa.Array:
        return pa.array(murmur3_array(keys, salt).view(np.int64), mask=np.asarray(keys.is_null()))

    return h1(key)


def splitmix64(state: int) -> tuple[int, int]:
    """The next state and value."""
    state = (state + _GOLDEN) & _M64
    z = ((state ^ (state >> 30)) * _S1) & _M64
    z = ((z ^ (z >> 27)) * _S2) & _M64
    return state, z ^ (z >> 31)


def optimal_bits(n: int) -> int:
    """Bits of a filter for ``n`` keys."""
    return math.ceil(-n * math.log(RATE) / math.log(2) ** 2)


def filter_keys(n: int) -> tuple[int, int, int]:
    """What a filter for ``n`` keys mixes into the hash before each bit."""
    state, keys = _SEED ^ n, []
    for _ in range(HASHES):
        state, key = splitmix64(state)
        keys.append(key)
    return tuple(keys)


def bit_positions(hashes: np.ndarray, keys: tuple[int, ...], m: int) -> np.ndarray:
    """The bit of each hash (rows) at each step (columns)."""
    h, out = hashes, []
    for key in keys:
        h = _rotl(h, 17) ^ np.uint64(key)
        out.append(h % np.uint64(m))
    return np.stack(out, 1).astype(np.int64)


def bits_of(key: Column, salt: int, keys: tuple[int, ...], m: int) -> Column:
    """The three bit positions of a key as an array of BIGINT."""

    @F.arrow_udf("array<long>")
    def bits(values: pa.Array) -> pa.Array:
        at = bit_positions(murmur3_array(values, salt), keys, m)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * HASHES), pa.array(at.ravel()))

    return bits(key)
