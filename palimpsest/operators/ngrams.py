"""Frequent patterns of a word stream: mining, greedy cover, usage and code lengths."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.coding import huffman

# Fixed values of the dictionary: pattern lengths, words sampled, patterns kept, bytes a pattern costs.
LENGTHS = (64, 32, 16, 8)
SAMPLE_WORDS = 100_000
MAX_PATTERNS = 8192
OVERHEAD = 4


#: Bytes of words that are counted at once.
PASS_BYTES = 8 << 20


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as a number; zeros behind the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    out = np.zeros(len(data), np.uint64)
    for i in range(8):
        out |= padded[i : i + len(data)].astype(np.uint64) << np.uint64(8 * i)
    return out


def _counted(data: np.ndarray, eights: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the stretches of ``n`` bytes that begin at ``at``, the place of one of each kind, and how many there are."""
    if n < 8:
        columns = [eights[at] & np.uint64((1 << 8 * n) - 1)]
    else:
        columns = [eights[at + min(i, n - 8)] for i in range(0, n, 8)]
    h = columns[0].copy()
    for c in columns[1:]:
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + c
    _, first, which, uses = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
    if all((c == c[first][which]).all() for c in columns):
        return at[first], uses
    # Two kinds with one hash: told apart by all their bytes.
    _, first, uses = np.unique(np.stack(columns, 1), axis=0, return_index=True, return_counts=True)
    return at[first], uses


def _count_batches(lengths: tuple[int, ...], pass_bytes: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).drop_null().cast(pa.large_binary())
            offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int64)
            row = 0
            while row < len(words):
                upto = max(row + 1, int(np.searchsorted(offsets, offsets[row] + pass_bytes, "right")) - 1)
                begin, end = int(offsets[row]), int(offsets[upto])
                data = np.frombuffer(words.buffers()[2], np.uint8)[begin:end] if end > begin else np.zeros(0, np.uint8)
                ends = np.repeat(offsets[row + 1 : upto + 1] - begin, np.diff(offsets[row : upto + 1]))
                eights, places = _eights(data), np.arange(len(data))
                for n in lengths:
                    at = places[places + n <= ends]
                    if not len(at) or n < 1:
                        continue
                    at, uses = _counted(data, eights, at, n)
                    rows = data[at[:, None] + np.arange(n)]
                    grams = pa.BinaryArray.from_buffers(pa.binary(), len(at), [None, pa.py_buffer((np.arange(len(at) + 1) * n).astype(np.int32)), pa.py_buffer(rows.tobytes())])
                    yield pa.record_batch([grams, pa.array(uses.astype(np.int64))], names=["ngram", "uses"])
                row = upto

    return work


def sample_words(words: DataFrame, pos: str = "pos", most: int = SAMPLE_WORDS) -> DataFrame:
    """The first ``most`` words by ``pos``, of which a dictionary is mined."""
    return words.orderBy(pos).limit(most)


def mine(words: DataFrame, word: str = "word", lengths: tuple[int, ...] = LENGTHS, most: int = MAX_PATTERNS) -> DataFrame:
    """``ngram, uses, score``: the ``most`` best of those that occur twice or more, at every place of every word.

    The score is (length - 4) * (uses - 1); ties go to the lesser bytes.  Stretches are
    counted column-wise, batch by batch, so the shuffle gets each once a batch.  Null
    words and those shorter than a length have none of it.  ``sample_words`` first where
    a sample is wanted.
    """
    counts = words.select(F.col(word).cast("binary").alias("word")).mapInArrow(_count_batches(tuple(lengths), PASS_BYTES), "ngram binary, uses long")
    counted = counts.groupBy("ngram").agg(F.sum("uses").alias("uses")).where("uses >= 2")
    scored = counted.withColumn("score", (F.octet_length("ngram") - OVERHEAD) * (F.col("uses") - 1))
    return scored.orderBy(F.desc("score"), F.asc("ngram")).limit(most)


def mine_words(words: Iterable[bytes], lengths: tuple[int, ...] = LENGTHS, most: int = MAX_PATTERNS) -> list[bytes]:
    """The same for the words of one file in memory."""
    counts: Counter[bytes] = Counter()
    for i, w in enumerate(words):
        if i == SAMPLE_WORDS:
            break
        for n in lengths:
            counts.update(w[j : j + n] for j in range(len(w) - n + 1))
    best = sorted((-(len(g) - OVERHEAD) * (c - 1), g) for g, c in counts.items() if c >= 2)
    return [g for _, g in best[:most]]


class Cover:
    """Greedy cover: from the left, the longest pattern that begins here, then on behind it."""

    def __init__(self, patterns: Iterable[bytes]):
        self.patterns = list(patterns)
        self.by_length: list[tuple[int, dict[bytes, int]]] = []
        for n in sorted({len(p) for p in self.patterns}, reverse=True):
            self.by_length.append((n, {p: i for i, p in reversed(list(enumerate(self.patterns))) if len(p) == n}))

    def of(self, word: bytes) -> list[tuple[int, int]]:
        """(start, pattern number) of each pattern used."""
        out, at = [], 0
        while at < len(word):
            for n, table in self.by_length:
                if (i := table.get(word[at : at + n])) is not None:
                    out.append((at, i))
                    at += n
                    break
            else:
                at += 1
        return out


def cover_words(words: DataFrame, patterns: list[bytes], pos: str = "pos", word: str = "word") -> DataFrame:
    """``pos, start, pattern_id``: the patterns used in each word.  ``patterns`` is at most MAX_PATTERNS long."""
    shared = words.sparkSession.sparkContext.broadcast(patterns)

    @F.arrow_udf("array<struct<start:int,pattern_id:int>>")
    def cover(column: pa.Array) -> pa.Array:
        c = Cover(shared.value)
        rows = [[{"start": s, "pattern_id": p} for s, p in c.of(w or b"")] for w in column.to_pylist()]
        return pa.array(rows, pa.list_(pa.struct([("start", pa.int32()), ("pattern_id", pa.int32())])))

    return words.select(pos, F.explode(cover(F.col(word))).alias("c")).select(pos, "c.start", "c.pattern_id")


def length_histogram(words: DataFrame, word: str = "word") -> DataFrame:
    """``symbol, uses``: length + 1 of each word, and a terminator (0) for each."""
    lengths = words.where(F.col(word).isNotNull()).select(F.explode(F.array(F.octet_length(word).cast("long") + 1, F.lit(0).cast("long"))).alias("symbol"))
    return lengths.groupBy("symbol").agg(F.count("*").alias("uses"))


def distance_histogram(words: DataFrame, cover: DataFrame, pos: str = "pos", word: str = "word") -> DataFrame:
    """``symbol, uses``: the length histogram with the distances between neighbouring patterns of a word."""
    from pyspark.sql import Window

    steps = cover.select((F.col("start") - F.coalesce(F.lag("start").over(Window.partitionBy(pos).orderBy("start")), F.lit(0)) + 1).cast("long").alias("symbol"))
    both = steps.groupBy("symbol").agg(F.count("*").alias("uses")).unionByName(length_histogram(words, word))
    return both.groupBy("symbol").agg(F.sum("uses").alias("uses"))


def pattern_usage(cover: DataFrame) -> DataFrame:
    """``pattern_id, uses``: patterns the cover never used are left out."""
    return cover.groupBy("pattern_id").agg(F.count("*").alias("uses"))


def code_depths(histogram: DataFrame, symbol: str = "symbol", uses: str = "uses") -> DataFrame:
    """``symbol, uses, depth``: code lengths.  The symbols are lengths or pattern numbers, a bounded alphabet, and are read on the driver."""
    rows = sorted((r[0], r[1]) for r in histogram.select(symbol, uses).collect())
    depths = [(rows[i][0], rows[i][1], depth) for i, depth, _ in huffman([(u, s) for s, u in rows])]
    return histogram.sparkSession.createDataFrame(depths, f"{symbol} long, {uses} long, depth int")
