"""Long spans that values of different keys share byte for byte.

Units are stretches of ``length`` bytes at every offset; their digests are grouped
globally, and the offsets kept.  Lines or paragraphs as units would miss spans that
begin inside one, and binary values have none, so the units are windows.  Few of them
are ever digested one by one:

1. Neighbouring windows with the same least fingerprint (of half a window) form a run.
   A window that occurs twice has that fingerprint in both places, so only runs whose
   fingerprint another key has as well go on.
2. Runs are grouped by a digest of all their bytes.  Where a fingerprint has one such
   digest, its windows are shared as a whole or not at all.
3. Only of fingerprints with several digests - at the ends of shared spans and around
   changes - are the windows digested, once a kind of run, and grouped.

No pair of values is ever formed, and no list of a stretch's holders.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.domain import with_ordinals
from palimpsest.session import materialize

LENGTH = 64
#: Bytes of values that one column-wise pass handles; a longer value is handled in pieces.
PASS_BYTES = 1 << 20
#: Windows of a run at most, so that those shared fit the bits of a number; a fingerprint that occurs once leads half a window and one.
RUN_WINDOWS = 60

#: Fingerprints (8 bytes each) up to which those that two keys have are broadcast; more are met by a shuffle of the runs.
BROADCAST_PRINTS = 1_000_000

_SEEDS = (0x9E37, 0x79B9)
_KEYS = ("kid", "vh")


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


@lru_cache(4)
def _powers(seed: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number for each byte, the powers of a random odd base, and those of its inverse, modulo 2^64."""
    rng = np.random.default_rng(seed)
    table = rng.integers(0, 2**64, 256, np.uint64, endpoint=False)
    base = int(rng.integers(0, 2**61)) * 8 + 5
    up, down = (np.full(n, b, np.uint64) for b in (base, pow(base, -1, 2**64)))
    up[0] = down[0] = 1
    return table, np.multiply.accumulate(up), np.multiply.accumulate(down)


def _slide_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = np.minimum(x[: len(x) - step], x[step:])
        done += step
    return x


class _Block:
    """Values laid end to end, with sums that give a hash of any stretch at once."""

    def __init__(self, values: Sequence[bytes], length: int):
        self.sizes = np.fromiter(map(len, values), np.int64, len(values))
        self.ends = np.cumsum(self.sizes)
        self.begins = self.ends - self.sizes
        self.data = np.frombuffer(b"".join(values), np.uint8)
        self.length = length
        # Powers are made once for all usual sizes.
        self.room = max(PASS_BYTES + 2 * length, len(self.data) + 1)
        self._sums: dict[int, np.ndarray] = {}

    def hashes(self, seed: int, at: np.ndarray | slice, n: int | np.ndarray) -> np.ndarray:
        table, up, down = _powers(seed, self.room)
        if seed not in self._sums:
            sums = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum(table[self.data] * up[: len(self.data)], out=sums[1:])
            self._sums[seed] = sums
        sums = self._sums[seed]
        if isinstance(at, slice):
            return _mix((sums[n:] - sums[: len(sums) - n]) * down[: len(sums) - n])
        return _mix((sums[at + n] - sums[at]) * down[at])

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """owner, offset in its value, windows and least fingerprint of each run of windows."""
        half = self.length // 2
        if len(self.data) < self.length:
            return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
        least = _slide_min(self.hashes(_SEEDS[0], slice(None), half), self.length - half + 1)
        inside = np.ones(len(least), bool)
        for b in self.ends[:-1]:
            inside[max(0, b - self.length + 1) : b] = False
        at = np.flatnonzero(inside)
        if not len(at):
            return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (least[at[1:]] != least[at[:-1]])
        first = np.flatnonzero(new)
        long = np.diff(np.append(first, len(at)))
        # A longer run, of bytes that repeat themselves, is cut.
        parts = -(-long // RUN_WINDOWS)
        which = np.repeat(np.arange(len(first)), parts)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
        begin = at[first[which]] + nth * RUN_WINDOWS
        windows = np.minimum(RUN_WINDOWS, long[which] - nth * RUN_WINDOWS)
        owner = np.searchsorted(self.ends, begin, "right")
        return owner, begin, windows, least[begin]


def _segments(batches: Iterator[pa.RecordBatch], length: int, pass_bytes: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, list[bytes]]]:
    """(batch, rows, offsets, pieces): the values of the last column, some ``pass_bytes`` at a time.

    A longer value comes in pieces that overlap by less than ``length``, so that every
    stretch of ``length`` bytes lies in exactly one of them; its row is named by each.
    """
    for batch in batches:
        rows: list[int] = []
        offsets: list[int] = []
        pieces: list[bytes] = []
        held = 0
        for row, value in enumerate(batch.column(batch.num_columns - 1)):
            data = value.as_buffer()
            for at in range(0, max(1, len(data) - length + 1), pass_bytes):
                piece = data[at : at + pass_bytes + length - 1].to_pybytes()
                if held and held + len(piece) > pass_bytes:
                    yield batch, np.array(rows), np.array(offsets), pieces
                    rows, offsets, pieces, held = [], [], [], 0
                rows.append(row)
                offsets.append(at)
                pieces.append(piece)
                held += len(piece)
        if pieces:
            yield batch, np.array(rows), np.array(offsets), pieces


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


_PRINTS = "kid long, fp long"
_RUNS = "kid long, vh long, fp long, ca long, cb long, place long, windows int"
_WINDOWS = "da long, db long, ca long, cb long, nth int, kmin long, kmax long"


def _emit_prints(length: int, pass_bytes: int):
    """(kid, value) in; each fingerprint that is the least of a window out, once a key and pass."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows, _, pieces in _segments(batches, length, pass_bytes):
            owner, _, _, fp = _Block(pieces, length).runs()
            kid = batch.column(0).to_numpy()[rows[owner]]
            order = np.lexsort((kid, fp))
            kid, fp = kid[order], fp[order]
            new = np.ones(len(fp), bool)
            new[1:] = (fp[1:] != fp[:-1]) | (kid[1:] != kid[:-1])
            yield pa.record_batch([pa.array(kid[new]), _signed(fp[new])], names=["kid", "fp"])

    return work


def _emit_runs(length: int, pass_bytes: int):
    """(kid, vh, value) in; its runs with their digests out."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows, offsets, pieces in _segments(batches, length, pass_bytes):
            block = _Block(pieces, length)
            owner, begin, windows, fp = block.runs()
            a, b = (block.hashes(s, begin, windows + length - 1) for s in _SEEDS)
            which = rows[owner]
            place = begin - block.begins[owner] + offsets[owner]
            ids = [pa.array(batch.column(i).to_numpy()[which]) for i in (0, 1)]
            # Runs of one length only are alike.
            a = _mix(a + windows.astype(np.uint64))
            yield pa.record_batch([*ids, _signed(fp), _signed(a), _signed(b), pa.array(place), pa.array(windows.astype(np.int32))], names=["kid", "vh", "fp", "ca", "cb", "place", "windows"])

    return work


def _emit_windows(length: int, pass_bytes: int):
    """(runs, value) in, runs a list of (place, windows, ca, cb, kmin, kmax); a digest of each of their windows out."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: pa.RecordBatch | None = None
        for batch, rows, offsets, pieces in _segments(batches, length, pass_bytes):
            if batch is not last:
                last = batch
                lists = batch.column(0)
                flat = lists.flatten()
                place, windows, ca, cb, kmin, kmax = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(6))
                row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
                run = np.repeat(np.arange(len(place)), windows)
                nth = np.arange(len(run)) - np.repeat(np.cumsum(windows) - windows, windows)
                where, of = place[run] + nth, row[run]
                order = np.lexsort((where, of))
                run, nth, where, of = run[order], nth[order], where[order], of[order]
            block = _Block(pieces, length)
            # The windows of each piece: of its row, from its offset on.
            for i, (r, o) in enumerate(zip(rows, offsets)):
                lo, hi = np.searchsorted(of, r), np.searchsorted(of, r, "right")
                lo, hi = lo + np.searchsorted(where[lo:hi], o), lo + np.searchsorted(where[lo:hi], o + pass_bytes)
                if lo == hi:
                    continue
                at = where[lo:hi] - o + block.begins[i]
                a, b = (block.hashes(s, at, length) for s in _SEEDS)
                k = run[lo:hi]
                columns = [_signed(a), _signed(b), *(pa.array(x[k]) for x in (ca, cb)), pa.array(nth[lo:hi].astype(np.int32)), *(pa.array(x[k]) for x in (kmin, kmax))]
                yield pa.record_batch(columns, names=["da", "db", "ca", "cb", "nth", "kmin", "kmax"])

    return work


def _covers(owner: np.ndarray, place: np.ndarray, mask: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """owner, begin, end of the maximal stretches that the windows of the masks cover; rows come by owner and place."""
    bits = np.unpackbits(mask.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    row, nth = np.nonzero(bits)
    owner, at = owner[row], place[row] + nth
    if not len(at):
        return owner, at, at
    cut = np.flatnonzero((owner[1:] != owner[:-1]) | (at[1:] - at[:-1] > length)) + 1
    first, end = np.append(0, cut), np.append(cut, len(at)) - 1
    return owner[first], at[first], at[end] + length


def _minus(shared: tuple[np.ndarray, ...], kept: tuple[np.ndarray, ...]) -> tuple[list[int], list[int], list[int]]:
    """What of the first stretches the second ones, which lie in them, leave."""
    out: tuple[list[int], list[int], list[int]] = ([], [], [])
    k = list(zip(*(x.tolist() for x in kept)))
    i = 0
    for o, lo, hi in zip(*(x.tolist() for x in shared)):
        while i < len(k) and k[i][0] == o and k[i][1] < hi:
            if k[i][1] > lo:
                for column, x in zip(out, (o, lo, k[i][1])):
                    column.append(x)
            lo = k[i][2]
            i += 1
        if lo < hi:
            for column, x in zip(out, (o, lo, hi)):
                column.append(x)
    return out


def _emit_spans(length: int, removable: bool):
    """(kid, vh, place, shared, kept) in, by value and place; spans out.  A value is handled when its last row is there."""

    def spans(kid, vh, place, shared, kept) -> pa.RecordBatch:
        new = np.ones(len(kid), bool)
        new[1:] = (kid[1:] != kid[:-1]) | (vh[1:] != vh[:-1])
        owner, first = np.cumsum(new) - 1, np.flatnonzero(new)
        found = _covers(owner, place, shared, length)
        if removable:
            found = tuple(np.array(x, np.int64) for x in _minus(found, _covers(owner, place, kept, length)))
        o, lo, hi = found
        return pa.record_batch([pa.array(kid[first][o]), pa.array(vh[first][o]), pa.array(lo), pa.array(hi)], names=["kid", "vh", "span_from", "span_to"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            rows = [c.to_numpy() for c in batch.columns]
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows)]
            if not len(rows[0]):
                continue
            ended = np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]))
            cut = int(ended[-1]) + 1 if len(ended) else 0
            if cut:
                yield spans(*(x[:cut] for x in rows))
            held = [x[cut:] for x in rows]
        if held is not None and len(held[0]):
            yield spans(*held)

    return work


def ranked_keys(df: DataFrame, rank: str | None) -> DataFrame:
    """``key, kid``: keys numbered by their earliest ``rank`` (a timestamp, null last), then by their bytes, null first.

    A sort of the keys alone.
    """
    when = F.min(F.unix_micros(F.col(rank).cast("timestamp"))) if rank else F.lit(0)
    keys = df.groupBy("key").agg(F.coalesce(when.cast("long"), F.lit(2**61)).alias("when"))
    # Eight bytes of time that sort as it does, then the key.
    order = F.concat(F.unhex(F.lpad(F.hex(F.col("when") + F.lit(2**60)), 16, "0")), F.when(F.col("key").isNull(), F.lit(b"\0")).otherwise(F.concat(F.lit(b"\1"), F.col("key"))))
    numbered = with_ordinals(keys.select(order.alias("key"), F.col("key").alias("own")))
    return numbered.select(F.col("own").alias("key"), F.col("ordinal").alias("kid"))


def shared_spans(df: DataFrame, key: str, value: str, length: int = LENGTH, removable: bool = False, rank: str | None = None) -> DataFrame:
    """``key, value_hash, n_bytes, span_from, span_to``: maximal runs of bytes shared with another key's value.

    A byte is shared when a stretch of ``length`` bytes or more around it occurs in a
    row of another key; repeats within a value or among a key's own rows do not count.
    Null, empty and shorter values share nothing; a null key is a key of its own;
    repeated rows count once; an empty table gives no rows; columns beside key, value
    and rank are ignored.

    ``removable``: only what may be cut.  Of the keys that hold a stretch the first by
    ``rank`` (a timestamp; null last, ties by key) keeps it, and cut are the shared bytes
    of no stretch that their own value keeps: every shared stretch is left whole where
    it is kept, and the offsets are those in the original values.

    Equal runs meet by their digest, aggregated before each shuffle; a value is shuffled
    at most once, and only where its runs differ from others of the same fingerprint.
    """
    if length < 4 or length & (length - 1):
        raise ValueError("length must be a power of two, 4 at least")
    values = df.select(F.col(key).alias("key"), F.col(value).cast("binary").alias("value"), *([F.col(rank).alias("rank")] if removable and rank else []))
    if removable:
        # Numbered by rank, so that the least number keeps.
        numbers = ranked_keys(values, "rank" if rank else None).withColumnRenamed("key", "__key")
        values = values.join(numbers, F.col("key").eqNullSafe(F.col("__key")))
    else:
        values = values.withColumn("kid", F.xxhash64("key", F.col("key").isNull()))
    values = values.where(F.octet_length("value") >= length).select("kid", F.xxhash64("value").alias("vh"), "key", "value")
    if removable:
        values = materialize(values, "ranked-values")
    size = PASS_BYTES

    prints = values.select("kid", "value").mapInArrow(_emit_prints(length, size), _PRINTS)
    in_two = materialize(prints.groupBy("fp").agg(F.min("kid").alias("a"), F.max("kid").alias("b")).where("a <> b").select("fp"), "shared-fingerprints")
    runs = values.select("kid", "vh", "value").mapInArrow(_emit_runs(length, size), _RUNS)
    runs = materialize(runs.join(F.broadcast(in_two) if in_two.count() <= BROADCAST_PRINTS else in_two, "fp", "left_semi"), "runs")

    # One row a kind of run: who holds it, and one place where it is.
    kinds = runs.groupBy("ca", "cb").agg(F.min("kid").alias("kmin"), F.max("kid").alias("kmax"), *[F.first(c).alias(c) for c in ("fp", *_KEYS, "place", "windows")])
    kinds = materialize(kinds, "kinds")
    # Where every kind is held by two keys, all its windows are shared; which key keeps one is another matter.
    several = kinds.groupBy("fp").agg(F.count("*").alias("n"), F.bool_or(F.expr("kmin = kmax")).alias("open")).where("n > 1" if removable else "n > 1 and open").select("fp")
    asked = kinds.join(several, "fp", "left_semi").groupBy(*_KEYS).agg(F.collect_list(F.struct("place", "windows", "ca", "cb", "kmin", "kmax")).alias("runs"))
    # Repeated rows have one id and the same windows; one of them will do.
    texts = values.select(*_KEYS, "value").join(asked, list(_KEYS)).select("runs", "value")
    windows = materialize(texts.mapInArrow(_emit_windows(length, size), _WINDOWS), "windows")
    digests = windows.groupBy("da", "db").agg(F.min("kmin").alias("first"), F.max("kmax").alias("other")).where("first <> other")
    if not removable:
        # The windows of a run that two keys hold are all shared.
        windows = windows.where("kmin = kmax")
    bit = F.expr("shiftleft(1L, nth)")
    masks = windows.join(digests, ["da", "db"]).groupBy("ca", "cb").agg(F.bit_or(bit).alias("shared"), F.bit_or(F.when(F.col("first") == F.col("kmin"), bit).otherwise(0)).alias("kept"), F.first("kmin").alias("kmin"))
    every = F.expr("shiftleft(1L, windows) - 1")
    whole = kinds.where("kmin <> kmax").select("ca", "cb", every.alias("shared"), every.alias("kept"), "kmin")
    if removable:
        whole = whole.join(masks.select("ca", "cb"), ["ca", "cb"], "left_anti")
    masks = materialize(whole.unionByName(masks), "masks")

    kept = F.when(F.col("kid") == F.col("kmin"), F.col("kept")).otherwise(F.lit(0))
    hits = runs.join(masks, ["ca", "cb"]).select(*_KEYS, "place", "shared", kept.cast("long").alias("kept"))
    spans = hits.repartition(*_KEYS).sortWithinPartitions(*_KEYS, "place").mapInArrow(_emit_spans(length, removable), "kid long, vh long, span_from long, span_to long")
    names = values.groupBy(*_KEYS).agg(F.first("key").alias("key"), F.first(F.octet_length("value")).cast("long").alias("n_bytes"))
    return spans.join(names, list(_KEYS)).select("key", F.col("vh").alias("value_hash"), "n_bytes", "span_from", "span_to")
