"""Token ids of a whole corpus by a public tokenizer.

The tokenizer's own library encodes every distinct pre-token once a worker; texts are
cut into pre-tokens column-wise over Arrow batches.  The cut works on an array of
code points and is carried to bytes by a byte-to-character map, so offsets come out
in both.  The tokenizers library alone cuts and encodes 1.3 MB a second and core,
most of it the cut; ids are the same, which the tests hold against it.
"""

from __future__ import annotations

import base64
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENIZER_DIR = "/opt/tokenizers"
TOKENIZER = "byte_bpe_50k"

#: Characters of text that one column-wise pass handles at once; a longer text is cut where pre-tokens end anyway.
PASS_CHARS = 1_000_000
#: Distinct pre-tokens a worker remembers before it starts anew.
MEMO_SIZE = 400_000

_SPACE, _LETTER, _NUMBER, _OTHER = range(4)

# The pattern of byte-level tokenizers, and the contractions it cuts off as words of their own.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


@lru_cache(1)
def _classes() -> np.ndarray:
    """The class of every code point, as the pattern's \\s, \\p{L} and \\p{N} see it."""
    import regex

    table = np.full(0x110000, _OTHER, np.uint8)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    text = "".join(map(chr, points))
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, text):
            table[np.fromiter(map(ord, m.group()), np.int64)] = kind
    return table


def pretoken_starts(points: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin, in code points, of texts laid end to end.

    A pre-token is a contraction; a run of letters, of numbers or of other signs, each
    with one blank before it; or white space, of which the last one before another
    sign stands alone or, if a blank, joins it.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = _classes()[points]
    first = np.zeros(n + 1, bool)  # of a text; also the end of all
    first[text_starts[text_starts < n]] = True
    first[n] = True
    run = first[:n].copy()
    run[1:] |= kind[1:] != kind[:-1]
    start = run.copy()
    space = kind == _SPACE
    # The last white space of a run that goes on in its text begins a pre-token; a blank takes the next run in.
    last = space.copy()
    last[:-1] &= ~space[1:]
    last &= ~first[1:]
    start |= last
    joined = np.flatnonzero(last & (points == 0x20)) + 1
    start[joined] = False
    # Contractions: a run of a single apostrophe that begins a pre-token, then letters.
    ap = np.flatnonzero((points == 0x27) & start & run)
    ap = ap[ap + 1 < n]
    ap = ap[run[ap + 1] & ~first[ap + 1]]
    if len(ap):
        a = points[ap + 1]
        two = np.where(ap + 2 < n, points[np.minimum(ap + 2, n - 1)], 0)
        two = np.where(first[np.minimum(ap + 2, n)], 0, two)
        length = np.zeros(len(ap), np.int64)
        for c in CONTRACTIONS:
            hit = (a == ord(c[1])) & ((two == ord(c[2])) if len(c) == 3 else True) & (length == 0)
            length[hit] = len(c) - 1
        took = length > 0
        at, after = ap[took] + 1, ap[took] + 1 + length[took]
        start[at] = False
        inside = after < n
        start[after[inside]] = True
    return np.flatnonzero(start)


class TokenizerError(ValueError):
    """A tokenizer file that is missing, of a kind that is not known, or not fit for what is asked of it."""


@lru_cache(8)
def tokenizer_file(folder: str, name: str) -> str:
    """The file of a tokenizer: ``name`` with its ending, else the first of .json, .tiktoken, .model that there is."""
    for ending in ("", ".json", ".tiktoken", ".model"):
        path = os.path.join(folder, name + ending)
        if os.path.isfile(path) and path.endswith((".json", ".tiktoken", ".model")):
            return path
    raise TokenizerError(f"no tokenizer {name!r} in {folder}")


@lru_cache(8)
def is_byte_level(folder: str, name: str) -> bool:
    """Whether a tokenizer cuts texts as ``pretoken_starts`` does and its tokens are the bytes of the text.

    Rank files are: they have merges alone and are used with that pattern.  Of the
    library's files, those without a normalizer, with the plain byte-level pre-tokenizer
    and a model that marks no word ends.  All others are left to their library.
    """
    path = tokenizer_file(folder, name)
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        cut, model = held.get("pre_tokenizer") or {}, held["model"]
        plain = held.get("normalizer") is None and cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
        return bool(plain and model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback")))
    return path.endswith(".tiktoken")


def _library(folder: str, name: str):
    """A function from texts to their lists of ids, by the library that the file is for, without special tokens."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ.setdefault("RAYON_NUM_THREADS", "1")
    path = tokenizer_file(folder, name)
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        # Their strings in a text are then ordinary text.
        tokenizer.encode_special_tokens = True
        return lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    if path.endswith(".tiktoken"):
        import tiktoken

        encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=_ranks(path), special_tokens={})
        return lambda texts: encoding.encode_ordinary_batch(texts, num_threads=1)
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda texts: processor.encode(texts, num_threads=1)


@lru_cache(2)
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class LibraryEncoder:
    """Encodes whole texts by their library: for tokenizers that normalise, or cut in a way of their own."""

    def __init__(self, folder: str, name: str):
        self._ids = _library(folder, name)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = self._ids(texts)
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((x for e in ids for x in e), np.int32, int(counts.sum())), counts

    def count(self, texts: list[str]) -> np.ndarray:
        return self.encode(texts)[1]


class Encoder:
    """Encodes texts by a byte-level tokenizer file; one a worker process.  Other files raise TokenizerError."""

    def __init__(self, folder: str = TOKENIZER_DIR, name: str = TOKENIZER):
        if not is_byte_level(folder, name):
            raise TokenizerError(f"{name} is not cut as byte-level tokenizers are")
        self._ids = _library(folder, name)
        self.memo: dict[str, int] = {}
        self._reset()

    def _reset(self) -> None:
        self.memo.clear()
        self.ids: list[np.ndarray] = []
        self.lengths = np.zeros(0, np.int32)
        self.flat = np.zeros(0, np.int32)
        self.begins = np.zeros(1, np.int64)

    def _learn(self, pieces: list[str]) -> None:
        new = [p for p in pieces if p not in self.memo]
        if not new:
            return
        ids = self._ids(new)
        for i, p in enumerate(new, len(self.memo)):
            self.memo[p] = i
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((x for e in ids for x in e), np.int32, int(lengths.sum()))
        self.flat = np.concatenate([self.flat, flat])
        self.begins = np.concatenate([self.begins, self.begins[-1] + np.cumsum(lengths)])

    def pieces(self, texts: list[str]) -> tuple[pa.StringArray, np.ndarray, np.ndarray, np.ndarray]:
        """All pre-tokens of ``texts``, how many each text has, and where each begins in characters and bytes of all."""
        joined = "".join(texts)
        data = joined.encode()
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(sizes)
        starts = pretoken_starts(points, ends - sizes)
        if len(data) == len(points):
            at = starts
        else:
            width = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
            at = (np.cumsum(width) - width)[starts]
        offsets = np.append(at, len(data)).astype(np.int32)
        array = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data))
        counts = np.searchsorted(starts, ends) - np.searchsorted(starts, ends - sizes)
        return array, counts, starts, at

    def _numbers(self, array: pa.StringArray) -> np.ndarray:
        if len(self.memo) > MEMO_SIZE:
            self._reset()
        coded = array.dictionary_encode()
        words = coded.dictionary.to_pylist()
        self._learn(words)
        known = np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))
        return known[coded.indices.to_numpy()] if len(words) else np.zeros(0, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, end to end, and how many each has."""
        ids, counts = [], np.zeros(len(texts), np.int64)
        for rows, pieces in _cut(texts):
            array, in_piece, _, _ = self.pieces(pieces)
            numbers = self._numbers(array)
            lengths = (self.begins[1:] - self.begins[:-1])[numbers]
            ends = np.cumsum(lengths)
            where = np.repeat(self.begins[numbers] - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)
            ids.append(self.flat[where])
            np.add.at(counts, rows, _sums(lengths, in_piece))
        return np.concatenate(ids) if ids else np.zeros(0, np.int32), counts

    def count(self, texts: list[str]) -> np.ndarray:
        """How many ids each text has."""
        counts = np.zeros(len(texts), np.int64)
        for rows, pieces in _cut(texts):
            array, in_piece, _, _ = self.pieces(pieces)
            numbers = self._numbers(array)
            np.add.at(counts, rows, _sums((self.begins[1:] - self.begins[:-1])[numbers], in_piece))
        return counts


#: Places where a pre-token ends whatever comes before and after: before a blank between signs, before the last line end of some.
_SAFE = re.compile(r"(?<=[!-~])(?= [!-~])|(?=\n[!-~])")


def _cut(texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """(rows, pieces) of about PASS_CHARS characters, in order; a text over that comes in pieces.

    A text without a safe place is not cut.
    """
    rows: list[int] = []
    pieces: list[str] = []
    held = 0
    for row, text in enumerate(texts):
        at = 0
        while at < len(text) or not text:
            end = len(text)
            if end - at > PASS_CHARS and (m := _SAFE.search(text, at + PASS_CHARS)):
                end = m.start()
            if held and held + end - at > PASS_CHARS:
                yield rows, pieces
                rows, pieces, held = [], [], 0
            rows.append(row)
            pieces.append(text[at:end])
            held += end - at
            at = end
            if not text:
                break
    if pieces:
        yield rows, pieces


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of neighbouring groups of so many values."""
    upto = np.append(0, np.cumsum(values))
    ends = np.cumsum(counts)
    return upto[ends] - upto[ends - counts]


@lru_cache(2)
def encoder(folder: str, name: str) -> Encoder | LibraryEncoder:
    return (Encoder if is_byte_level(folder, name) else LibraryEncoder)(folder, name)


def _passes(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about PASS_CHARS characters."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    begin = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > PASS_CHARS:
            yield begin, i
            begin, held = i, 0
        held += int(n)
    if begin < len(sizes):
        yield begin, len(sizes)


def _plain(texts: pa.Array) -> list[str]:
    """Null is encoded as the empty text is: to no ids."""
    return pc.fill_null(texts, "").to_pylist()


def encode_column(df: DataFrame, key: str, text: str, folder: str = TOKENIZER_DIR, name: str = TOKENIZER) -> DataFrame:
    """``key, ids``: the ids of each row's text, without special tokens.

    One row for each row of ``df``, repeated keys too; null and empty texts have no ids
    (an empty list).  A text that spells a special token is ordinary text.  Any file of
    the three libraries will do; those that normalise or cut otherwise encode whole
    texts by their library, at its pace.  No shuffle.
    """
    key_type = df.schema[key].dataType
    schema = T.StructType([T.StructField(key, key_type), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(folder, name)
        for batch in batches:
            for lo, hi in _passes(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                ids, counts = enc.encode(_plain(part.column(1)))
                offsets = np.append(0, np.cumsum(counts)).astype(np.int32)
                yield pa.record_batch([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], names=[key, "ids"])

    return df.select(key, text).mapInArrow(work, schema)


def count_tokens(df: DataFrame, text: str, out: str, folder: str = TOKENIZER_DIR, name: str = TOKENIZER) -> DataFrame:
    """``df`` without ``text``, with the number of its ids as ``out``; 0 for null and empty texts."""
    kept = [c for c in df.columns if c != text]
    schema = T.StructType([*[df.schema[c] for c in kept], T.StructField(out, T.LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(folder, name)
        for batch in batches:
            for lo, hi in _passes(batch.column(len(kept))):
                part = batch.slice(lo, hi - lo)
                n = enc.count(_plain(part.column(len(kept)))).astype(np.int64)
                yield pa.record_batch([*part.columns[: len(kept)], pa.array(n)], names=[*kept, out])

    return df.select(*kept, text).mapInArrow(work, schema)


def with_offsets(df: DataFrame, key: str, text: str, folder: str = TOKENIZER_DIR, name: str = TOKENIZER) -> DataFrame:
    """``key, pos, id, byte_from, byte_to, char_from, char_to``: a row an id.

    Byte offsets cut the text's UTF-8 exactly.  Character offsets are those of the
    characters a token touches: one split over several tokens belongs to each of them.
    Null and empty texts give no rows.
    """
    key_type = df.schema[key].dataType
    longs = ("byte_from", "byte_to", "char_from", "char_to")
    schema = T.StructType([T.StructField(key, key_type), T.StructField("pos", T.IntegerType()), T.StructField("id", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in longs]])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(folder, name)
        sizes = np.array([len(b) for b in token_bytes(folder, name)], np.int64)
        for batch in batches:
            for lo, hi in _passes(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                texts = _plain(part.column(1))
                ids, counts = enc.encode(texts)
                begun = 0
                for i, (t, n) in enumerate(zip(texts, counts.tolist())):
                    own = ids[begun : begun + n]
                    begun += n
                    if not n:
                        continue
                    data = np.frombuffer(t.encode(), np.uint8)
                    # The character each byte belongs to: one more at each byte that begins a character.
                    owner = np.cumsum((data & 0xC0) != 0x80) - 1
                    to = np.cumsum(sizes[own])
                    at = to - sizes[own]
                    yield pa.record_batch(
                        [part.column(0).take(pa.array([i] * n)), pa.array(np.arange(n, dtype=np.int32)), pa.array(own), pa.array(at), pa.array(to), pa.array(owner[at]), pa.array(owner[to - 1] + 1)],
                        names=schema.names,
                    )

    return df.select(key, text).mapInArrow(work, schema)


@lru_cache(2)
def token_bytes(folder: str = TOKENIZER_DIR, name: str = TOKENIZER) -> list[bytes]:
    """The bytes of each id: the vocabulary's characters through the reversed byte table.

    The table gives printable bytes their own character and the others, in order, the
    characters from U+0100 on.
    """
    if not is_byte_level(folder, name):
        raise TokenizerError(f"the tokens of {name} are not the bytes of the text")
    path = tokenizer_file(folder, name)
    if path.endswith(".tiktoken"):
        ranks = _ranks(path)
        table = [b""] * (1 + max(ranks.values()))
        for token, rank in ranks.items():
            table[rank] = token
        return table
    own = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    back = {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(others)}
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    table = [b""] * (1 + max(data["model"]["vocab"].values()))
    for word, i in data["model"]["vocab"].items():
        table[i] = bytes(map(back.__getitem__, word)) if all(c in back for c in word) else word.encode()
    return table


def _slices(lists: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about PASS_CHARS ids."""
    begin = held = 0
    for i, n in enumerate(pc.fill_null(pc.list_value_length(lists), 0).to_pylist()):
        if held and held + n > PASS_CHARS:
            yield begin, i
            begin, held = i, 0
        held += n
    if begin < len(lists):
        yield begin, len(lists)


def decode_column(df: DataFrame, key: str, ids: str, out: str = "text", folder: str = TOKENIZER_DIR, name: str = TOKENIZER) -> DataFrame:
    """``key, out``: the text of each list of ids.

    Bytes are put together before they are read as UTF-8, so characters split over
    tokens come back whole; bytes that are no UTF-8 become U+FFFD.  No ids give the
    empty text, a null list gives null, and an id outside the vocabulary raises.  Of a
    tokenizer that does not keep the bytes of a text TokenizerError is raised.
    """
    token_bytes(folder, name)
    schema = T.StructType([df.schema[key], T.StructField(out, T.StringType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.array(token_bytes(folder, name), pa.binary())
        for batch in batches:
            for lo, hi in _slices(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                lists = part.column(1)
                flat = lists.flatten()
                if flat.null_count or len(flat) and not 0 <= pc.min(flat).as_py() <= pc.max(flat).as_py() < len(table):
                    raise ValueError("an id outside the vocabulary")
                taken = table.take(flat)
                data = taken.buffers()[2].to_pybytes() if len(flat) and taken.buffers()[2] else b""
                upto = np.append(0, np.cumsum(pc.binary_length(taken).to_numpy(zero_copy_only=False))).astype(np.int64)
                ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
                cuts = upto[np.append(0, ends).astype(np.int64)].tolist()
                there = lists.is_valid().to_pylist()
                texts = [data[x:y].decode("utf-8", "replace") if ok else None for x, y, ok in zip(cuts, cuts[1:], there)]
                yield pa.record_batch([part.column(0), pa.array(texts, pa.string())], names=[key, out])

    return df.select(key, F.col(ids)).mapInArrow(work, schema)
