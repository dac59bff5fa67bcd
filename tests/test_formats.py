"""Codes, hashes and the foreign file triple."""

import random

import numpy as np
import pyarrow as pa
import pytest

from palimpsest.functions import coding, hashing
from palimpsest.operators.ngrams import Cover
from palimpsest.sources import files, kvseg, triples


@pytest.mark.parametrize(
    ("key", "seed", "h1"),
    [
        (b"hello", 0, 0xCBD8A7B341BD9B02),
        (b"hello, world", 0, 0x342FAC623A5EBC8E),
        (b"19 Jan 2038 at 3:14:07 AM", 0, 0xB89E5988B737AFFC),
        (b"hello", 1, 0xA78DDFF5ADAE8D10),
        (b"hello", 0x2A, 0xC4B8B3C960AF6F08),
        (b"The quick brown fox jumps over the lazy dog.", 0, 0xCD99481F9EE902C9),
        (b"", 0, 0),
    ],
)
def test_murmur_vectors(key, seed, h1):
    assert hashing.murmur3_h1(key, seed) == h1


def test_murmur_mixed_lengths_match_one_by_one():
    rng = random.Random(1)
    keys = [rng.randbytes(rng.randrange(40)) for _ in range(200)]
    assert hashing.murmur3_array(pa.array(keys, pa.binary()), 7).tolist() == [hashing.murmur3_h1(k, 7) for k in keys]


def test_filter_sizes():
    assert hashing.optimal_bits(1_079_554) == 10_347_589
    assert hashing.optimal_bits(338_868_457) == 3_248_073_943


def test_uvarint():
    for hexed, value in (("00", 0), ("01", 1), ("7f", 127), ("8001", 128), ("ff01", 255), ("ac02", 300)):
        assert coding.read_uvarint(bytes.fromhex(hexed)) == (value, len(hexed) // 2)
        assert coding.uvarint(value).hex() == hexed
    assert coding.read_uvarint(b"\x80") == (0, 0)
    assert coding.read_uvarint(b"\x80" * 11) == (0, 0)


def test_select64():
    assert [coding.select64(0b1011, k) for k in range(3)] == [0, 1, 3]
    assert coding.select64(1 << 63, 0) == 63


@pytest.mark.parametrize("values", [[0], [0, 1, 2, 3, 4], [5, 5, 5, 9, 100], [0, 1000, 2000, 3500, 1_000_000], np.cumsum([1 + (i * 2654435761) % 37 for i in range(40_000)]).tolist()])
def test_elias_fano(values):
    ef = coding.EliasFano(coding.ef_encode(values))
    assert ef.values().tolist() == values
    assert ef.get(len(values) - 1) == values[-1]
    with pytest.raises(IndexError):
        ef.get(len(values))


def test_elias_fano_rejects():
    with pytest.raises(coding.FormatError):
        coding.ef_encode([3, 2])
    with pytest.raises(coding.FormatError):
        coding.EliasFano(b"\0" * 8)


def test_huffman_codes_follow_from_depths():
    rng = random.Random(2)
    for n in (1, 2, 3, 50):
        symbols = [(rng.randrange(1, 100), i) for i in range(n)]
        built = coding.huffman(symbols)
        assert coding.codes_from_depths([d for _, d, _ in built]) == [c for _, _, c in built]
        if n > 1:
            assert sum(2.0**-d for _, d, _ in built) == 1.0


WORDS = [
    [],
    [b"hello"],
    [b"", b"", b"\0" * 300, bytes(range(256)), b"x", b"", bytes(range(256))],
    [bytes([i % 251]) * (i % 64) for i in range(2000)],
    [b"account:%04d:balance=0x0000000000000000:nonce=%d" % (i % 64, i % 7) for i in range(1000)],
]


@pytest.mark.parametrize("words", WORDS)
@pytest.mark.parametrize("compress", [False, True])
def test_words_round_trip(words, compress):
    data = kvseg.encode_words(words, compress)
    file = kvseg.WordFile(data)
    assert [w for _, w in file.words()] == words
    assert (file.words_count, file.empty_words_count) == (len(words), sum(not w for w in words))
    for offset, word in list(file.words())[::97]:
        assert file.word(offset)[0] == word


def test_compression_shrinks():
    assert len(kvseg.encode_words(WORDS[4], True)) < len(kvseg.encode_words(WORDS[4]))


def test_version_one_header_and_metadata():
    body = kvseg.encode_words([b"k", b"v"])
    assert list(kvseg.WordFile(b"\x01\x01\x10" + body).pairs()) == [(b"k", b"v")]
    assert kvseg.WordFile(b"\x01\x01\x10" + body).page_values_count == 16
    meta = kvseg.WordFile(b"\x01\x00" + (3).to_bytes(4, "big") + b"abc" + body, has_metadata=True)
    assert meta.metadata == b"abc" and list(meta.pairs()) == [(b"k", b"v")]
    for bad in (b"", b"\0" * 20, body[:30]):
        with pytest.raises(coding.FormatError):
            kvseg.WordFile(bad)


def test_odd_word_count_gives_an_empty_value():
    assert list(kvseg.WordFile(kvseg.encode_words([b"a", b"1", b"b"])).pairs()) == [(b"a", b"1"), (b"b", b"")]


def test_triple(tmp_path):
    pairs = [(b"k%09d" % i, b"v%d" % i) for i in range(3000)]
    out = kvseg.write_triple(str(tmp_path / "d"), pairs, salt=777)
    data = (tmp_path / "d.kv").read_bytes()
    index = kvseg.IndexFile.parse((tmp_path / "d.bt").read_bytes())
    file = kvseg.WordFile(data)
    assert index.key_count == 3000 and index.fanout == 256 and index.key_offset(3000) is None
    for i in (0, 1, 777, 2999):
        assert file.word(index.key_offset(i))[0] == pairs[i][0]
    f = kvseg.FilterFile.parse((tmp_path / "d.kvei").read_bytes())
    assert f.kind == "bloom" and f.contains([k for k, _ in pairs], 777).all()
    assert f.contains([b"x%09d" % i for i in range(2000)], 777).mean() < 0.05
    assert out["kvei"] is not None
    legacy = kvseg.encode_index([0, 5, 9], [b"a", b"b", b"c"], 20)
    assert kvseg.IndexFile.parse(legacy).offsets.values().tolist() == [0, 5, 9]
    assert kvseg.IndexFile.parse(b"").key_count == 0
    for bad in ([(b"b", b"1"), (b"a", b"2")], [(b"b", b"1"), (b"b", b"2")]):
        with pytest.raises(coding.FormatError):
            kvseg.write_triple(str(tmp_path / "e"), bad)


def test_degenerate_filters():
    assert kvseg.FilterFile.parse(b"").kind == "empty"
    assert kvseg.FilterFile.parse(bytes(range(1, 17))).kind == "unsupported"
    assert kvseg.encode_filter([b"one"], 9) == b""
    assert kvseg.FilterFile.parse(bytes(range(1, 17))).contains([b"x"], 1).all()


def test_cover_is_greedy_from_the_left():
    assert Cover([b"abc", b"ab", b"bcd"]).of(b"abcdab") == [(0, 0), (4, 1)]
    assert Cover([]).of(b"abc") == []


def test_data_source(spark, tmp_path):
    kvseg.register(spark)
    df = spark.createDataFrame([(bytearray(b"k%03d" % i), bytearray(b"" if i % 5 == 0 else b"v%d" % i)) for i in range(100)], "key binary, value binary")
    df.repartitionByRange(3, "key").sortWithinPartitions("key").write.format("kvseg").option("salt", "9").mode("append").save(str(tmp_path / "t"))
    again = spark.read.format("kvseg").load(str(tmp_path / "t")).select("key", "value")
    assert again.exceptAll(df).count() == 0 and df.exceptAll(again).count() == 0
    words = spark.read.format("kvseg").option("words", "true").load(str(tmp_path / "t"))
    assert words.count() == 200
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        one = spark.read.format("kvseg").option("pushdown", "true").load(str(tmp_path / "t")).where("key = X'6b303037'")
        assert [bytes(r.value) for r in one.collect()] == [b"v7"]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_triple_reader_and_foreign_stack(spark, tmp_path):
    from palimpsest.sources import triples

    pairs = [(b"k%05d" % i, b"" if i == 7 else b"v%d" % i) for i in range(1000)]
    kvseg.write_triple(str(tmp_path / "d.0-1"), pairs, salt=40, compress=True)
    kvseg.write_triple(str(tmp_path / "d.1-2"), [(b"k00001", b"new"), (b"k00002", b"")], salt=40, layout="legacy")
    r = triples.TripleReader(str(tmp_path / "d.0-1.kv"))
    assert (r.name, r.key_count, r.bloom_active) == ("d.0-1.kv", 1000, False)
    assert not r.enable_bloom(41) and r.enable_bloom(40) and r.bloom_active
    assert r.get(b"k00500") == b"v500" and r.get(b"k00007") == b"" and r.get(b"x") is None
    assert len(r.sample_keys(64)) == 64 and r.sample_keys(2) == [b"k00000", b"k00500"]
    assert triples.search_salt(spark, r, 64) == 40
    (tmp_path / "d.0-1.bt").unlink()
    bare = triples.TripleReader(str(tmp_path / "d.0-1.kv"))
    assert bare.get(b"k00999") == b"v999" and bare.get(b"k00500x") is None and bare.key_count == 1000 and bare.sample_keys(3) == [b"k00000", b"k00001", b"k00002"]
    assert triples.build_index(str(tmp_path / "d.0-1.kv"), str(tmp_path / "d.0-1.bt")) == 1000
    triples.build_filter(str(tmp_path / "d.0-1.kv"), 40, str(tmp_path / "d.0-1.kvei"))
    stack = triples.foreign_stack(spark, str(tmp_path), "d.", salt=40)
    assert stack.get(b"k00001") == b"new" and stack.get(b"k00002") == b"" and stack.get(b"k00003") == b"v3" and stack.bloom_count() == 2
    (tmp_path / "bad.kv").write_bytes(b"\0" * 9)
    about = {x.name: x for x in triples.inspect_files(spark, str(tmp_path)).collect()}
    assert about["d.0-1.kv"].words_count == 2000 and about["d.0-1.kv"].fanout == 256 and about["d.0-1.kv"].filter_kind == "bloom" and about["d.0-1.kv"].sorted
    assert about["d.1-2.kv"].fanout is None and about["d.1-2.kv"].step_from == 1 and about["bad.kv"].error
    c = triples.Cursor(r.words)
    assert c.next() == b"k00000" and c.skip() == 2 and c.has_next()
    at = c.offset
    c.next()
    c.reset(at)
    assert c.next() == b"k00001"
    w = triples.WordWriter(str(tmp_path / "w.kv"))
    for x in (b"a", b"", b"b"):
        w.add(x)
    assert w.words_count == 3 and not (tmp_path / "w.kv").exists()
    w.finish()
    assert [x for _, x in kvseg.WordFile((tmp_path / "w.kv").read_bytes()).words()] == [b"a", b"", b"b"]


def test_random_access_of_a_monotone_sequence():
    rng = random.Random(9)
    for n, step in ((1, 5), (300, 1), (20_000, 37), (40_000, 5000), (3000, 0)):
        values, at = [], 0
        for _ in range(n):
            at += rng.randrange(step + 1) if step else rng.choice([0, 0, 0, 100_000])
            values.append(at)
        ef = coding.EliasFano(coding.ef_encode(values, at + 7))
        assert [ef.get(i) for i in range(0, n, max(1, n // 500))] == values[:: max(1, n // 500)] and ef._all is None
        assert ef.values().tolist() == values
    assert [coding.select64(0b1011, k) for k in range(4)] == [0, 1, 3, 64] and coding.select64(1 << 63, 0) == 63


def test_deep_codes_need_more_than_one_table():
    uses, a, b = [], 1, 1
    for i in range(40):
        uses.append((a, i))
        a, b = b, a + b
    built = coding.huffman(uses)
    assert max(d for _, d, _ in built) > 2 * kvseg._Codes.TABLE_BITS
    codes = kvseg._Codes([d for _, d, _ in built], [i for i, _, _ in built])
    bits = coding.BitWriter()
    order = [i % 40 for i in range(200)]
    code_of = {i: (c, d) for i, d, c in built}
    for i in order:
        bits.put(*code_of[i])
    data, bit, got = bits.flush(), 0, []
    for _ in order:
        i, bit = codes.read(data, bit)
        got.append(i)
    assert got == order
    with pytest.raises(coding.FormatError):
        codes.read(b"", 0)


@pytest.mark.parametrize("compress", [False, True])
def test_skip_reads_no_bytes(compress):
    for words in WORDS:
        file = kvseg.WordFile(kvseg.encode_words(words, compress))
        at = 0
        for w in words:
            n, after = file.skip(at)
            assert (n, after) == (len(w), file.word(at)[1])
            at = after


def folder_pairs(spark, path, **options):
    return sorted((bytes(r.key), bytes(r.value)) for r in spark.read.format("kvseg").options(**options).load(path).collect())


def test_append_and_overwrite(spark, tmp_path):
    kvseg.register(spark)
    frame = lambda *keys: spark.createDataFrame([(k, b"v") for k in keys], "key binary, value binary").coalesce(1)
    path = str(tmp_path / "t")
    write = lambda df, mode, **o: df.sortWithinPartitions("key").write.format("kvseg").options(salt="3", **o).mode(mode).save(path)
    write(frame(b"a", b"b"), "append")
    write(frame(b"c"), "append")
    assert folder_pairs(spark, path) == [(b"a", b"v"), (b"b", b"v"), (b"c", b"v")]
    write(frame(b"d", b"e", b"f").repartitionByRange(2, "key"), "append")
    assert len(folder_pairs(spark, path)) == 6
    write(frame(b"x"), "overwrite")
    assert folder_pairs(spark, path) == [(b"x", b"v")] and len(list((tmp_path / "t").iterdir())) == 3
    # A name is a triple's own: appending onto it fails, overwriting it leaves the others.
    write(frame(b"n1"), "append", name="d.0-1")
    with pytest.raises(Exception, match="there already"):
        write(frame(b"n2"), "append", name="d.0-1")
    assert folder_pairs(spark, path) == [(b"n1", b"v"), (b"x", b"v")]
    write(frame(b"n3", b"n4").repartitionByRange(2, "key"), "overwrite", name="d.0-1")
    assert folder_pairs(spark, path) == [(b"n3", b"v"), (b"n4", b"v"), (b"x", b"v")]
    assert sorted(f.name for f in (tmp_path / "t").iterdir() if f.name.startswith("d.") and f.suffix == ".kv") == ["d.0-1.p00000.kv", "d.0-1.p00001.kv"]
    write(frame(b"n5"), "overwrite", name="d.0-1")
    assert folder_pairs(spark, path) == [(b"n5", b"v"), (b"x", b"v")]
    assert not [f for f in (tmp_path / "t").iterdir() if f.name.startswith(".")]


@pytest.mark.parametrize("layout", ["footer", "legacy"])
def test_files_are_split_by_their_index(spark, tmp_path, layout):
    kvseg.register(spark)
    pairs = [(b"k%05d" % i, b"" if i % 9 == 0 else b"v%d" % i * 5) for i in range(4000)]
    kvseg.write_triple(str(tmp_path / "d"), pairs, layout=layout, compress=True)
    df = spark.read.format("kvseg").option("splitBytes", "9000").load(str(tmp_path))
    assert df.rdd.getNumPartitions() >= 3
    assert folder_pairs(spark, str(tmp_path), splitBytes="9000") == pairs
    words = spark.read.format("kvseg").option("words", "true").option("splitBytes", "9000").load(str(tmp_path))
    assert sorted(r.pos for r in words.collect()) == list(range(8000))
    (tmp_path / "d.bt").unlink()
    assert spark.read.format("kvseg").option("splitBytes", "9000").load(str(tmp_path)).rdd.getNumPartitions() == 1
    assert folder_pairs(spark, str(tmp_path), splitBytes="9000") == pairs


def test_merge_to_a_named_triple(spark, tmp_path):
    from palimpsest.operators.merge import MergeOptions
    from palimpsest.sources import triples

    kvseg.write_triple(str(tmp_path / "d.0-1"), [(b"a", b"1"), (b"b", b"1"), (b"c", b"1")], salt=5)
    kvseg.write_triple(str(tmp_path / "d.1-2"), [(b"b", b""), (b"c", b"2")], salt=5)
    runs = triples.foreign_stack(spark, str(tmp_path), "d.").runs
    triples.merge_triples(runs, str(tmp_path), "d.0-2", MergeOptions(salt=5, fanout=1))
    assert list(triples.TripleReader(str(tmp_path / "d.0-2.kv")).pairs()) == [(b"a", b"1"), (b"c", b"2")]
    r = triples.TripleReader(str(tmp_path / "d.0-2.kv"))
    assert r.index.fanout == 1 and r.enable_bloom(5) and r.get(b"b") is None
    triples.merge_triples(runs, str(tmp_path), "d.1-3")
    assert dict(triples.TripleReader(str(tmp_path / "d.1-3.kv")).pairs())[b"b"] == b""


def test_a_foreign_run_with_a_key_twice(spark, tmp_path):
    from palimpsest.operators.stack import Stack
    from palimpsest.sources import triples

    (tmp_path / "d.0-1.kv").write_bytes(kvseg.encode_words([b"a", b"1", b"a", b"2", b"b", b"3"]))
    got = [(bytes(r.key), bytes(r.value)) for r in Stack([triples.foreign_run(spark, str(tmp_path / "d.0-1.kv"))]).resolve().collect()]
    assert sorted(got) == [(b"a", b"2"), (b"b", b"3")]


def test_filters_without_proof_are_not_used(spark, tmp_path):
    from palimpsest.sources import triples

    kvseg.write_triple(str(tmp_path / "d"), [(b"a", b"1"), (b"b", b"1")], salt=5)
    (tmp_path / "d.kv").write_bytes(kvseg.encode_words([]))
    (tmp_path / "d.bt").unlink()
    assert not triples.TripleReader(str(tmp_path / "d.kv")).enable_bloom(5)


def test_writers_leave_nothing_behind(tmp_path):
    from palimpsest.sources import triples

    with triples.WordWriter(str(tmp_path / "a.kv")) as w:
        w.add(b"x" * 3_000_000)
        w.add(b"y")
    assert list(tmp_path.iterdir()) == []
    with pytest.raises(coding.FormatError):
        kvseg.write_triple(str(tmp_path / "b"), [(b"b", b"1"), (b"a", b"2")])
    assert list(tmp_path.iterdir()) == []
    w = triples.WordWriter(str(tmp_path / "c.kv"), compress=True)
    words = WORDS[4] + [b"z" * 2_500_000, b""]
    for x in words:
        w.add(x)
    w.finish()
    assert [p.name for p in tmp_path.iterdir()] == ["c.kv"]
    assert (tmp_path / "c.kv").read_bytes() == kvseg.encode_words(words, True)
    kvseg.write_triple(str(tmp_path / "none"), [], salt=1)
    assert kvseg.IndexFile.parse((tmp_path / "none.bt").read_bytes()).key_count == 0 and list(kvseg.WordFile((tmp_path / "none.kv").read_bytes()).words()) == []


@pytest.mark.parametrize("compress", [False, True])
@pytest.mark.parametrize("size", [1, 100, 1 << 20])
def test_pairs_are_read_in_blocks(tmp_path, compress, size):
    pairs = [(b"k%05d" % i, [b"", b"http://www.example.com/%d" % i, bytes([i % 256]) * (i % 300)][i % 3]) for i in range(2000)]
    kvseg.write_triple(str(tmp_path / "d"), pairs, compress=compress)
    file = kvseg.WordFile.open(str(tmp_path / "d.kv"))
    assert [p for k, v in file.pair_blocks(size=size) for p in zip(k.to_pylist(), v.to_pylist())] == pairs
    at = [o for o, _ in file.keys()]
    assert [p for k, v in file.pair_blocks(at[7], at[900], size) for p in zip(k.to_pylist(), v.to_pylist())] == pairs[7:900]


def test_ordered_lookups_without_an_index_share_one_scan(tmp_path, monkeypatch):
    kvseg.write_triple(str(tmp_path / "d"), [(b"k%06d" % i, b"v%d" % i) for i in range(20000)], salt=5)
    (tmp_path / "d.bt").unlink()
    r = triples.TripleReader(str(tmp_path / "d.kv"))
    assert r.enable_bloom(5)
    read = []
    monkeypatch.setattr(files, "read_range", lambda path, at, size, f=files.read_range: read.append(size * path.endswith(".kv")) or f(path, at, size))
    probes = [b"k%06d" % i for i in range(0, 30000, 3)] + [b"x"]
    found = [v for i in range(0, len(probes), 500) for v in r.get_many(pa.array(probes[i : i + 500], pa.binary())).to_pylist()]
    assert found == [b"v%d" % i if i < 20000 else None for i in range(0, 30000, 3)] + [None]
    assert sum(read) <= 2 * (tmp_path / "d.kv").stat().st_size
    assert r.get_many(pa.array([b"k000009", None, b"k000003", b"k000003"], pa.binary())).to_pylist() == [b"v9", None, b"v3", b"v3"]


def test_scanned_lookups_of_unordered_keys_are_as_one_by_one(tmp_path):
    files.write(str(tmp_path / "d.kv"), kvseg.encode_words([b"b", b"1", b"b", b"2", b"a", b"3", b"d", b"4", b"c", b"5", b"e"]))
    r = triples.TripleReader(str(tmp_path / "d.kv"))
    keys = [b"a", b"b", b"c", b"d", b"e", b"f"]
    assert r.get_many(pa.array(keys, pa.binary())).to_pylist() == [r.get(k) for k in keys] == [None, b"1", None, b"4", b"", None]


@pytest.mark.parametrize("compress", [False, True])
def test_indexed_lookups_of_many_keys_are_as_one_by_one(tmp_path, monkeypatch, compress):
    random.seed(3)
    pairs = [(b"k%06d" % i, [b"", b"http://www.example.com/%d" % i, bytes([i % 256]) * (i % 30)][i % 3]) for i in range(0, 40000, 2)]
    kvseg.write_triple(str(tmp_path / "d"), pairs, compress=compress, salt=5)
    r = triples.TripleReader(str(tmp_path / "d.kv"))
    near, far = [b"k%06d" % i for i in range(9000, 11000)], [b"", b"k", *(b"k%06d" % i for i in random.sample(range(50000), 30)), b"x"]
    for salt in (None, 5):
        r.salt = salt
        for probes in (near, far, near + far, near[4:5], []):
            assert r.get_many(pa.array(probes, pa.binary())).to_pylist() == [dict(pairs).get(p) for p in probes]
    assert r.get_many(pa.array([b"k000004", None, b"k000001", b"k000004"], pa.binary())).to_pylist() == [r.get(b"k000004"), None, None, r.get(b"k000004")]
    # Keys that lie close together share their searches, and a filter's blocks are read once.
    r = triples.TripleReader(str(tmp_path / "d.kv"))
    assert r.enable_bloom(5)
    words, read = [], []
    monkeypatch.setattr(kvseg.WordFile, "word", lambda self, offset, f=kvseg.WordFile.word: words.append(1) or f(self, offset))
    monkeypatch.setattr(files, "read_range", lambda path, at, size, f=files.read_range: read.append(path) or f(path, at, size))
    assert sum(v is not None for v in r.get_many(pa.array(near, pa.binary())).to_pylist()) == 1000
    assert len(words) < (100 if not compress else 4000) and sum(p.endswith(".kvei") for p in read) <= 1


@pytest.mark.parametrize("compress", [False, True])
def test_pairs_written_many_at_once_are_as_one_by_one(tmp_path, compress):
    pairs = [(b"%07d" % i * (1 + i % 2), [b"", b"http://www.example.com/%d" % i, bytes([i % 256]) * (i % 300)][i % 3]) for i in range(3000)]
    kvseg.write_triple(str(tmp_path / "one"), pairs, compress=compress, salt=5)
    writer = kvseg.TripleWriter(str(tmp_path / "many"), compress, 5)
    for i in range(0, 3000, 700):
        writer.add_all(pa.array([k for k, _ in pairs[i : i + 700]]), pa.array([v or None for _, v in pairs[i : i + 700]], pa.binary()))
    assert writer.key_count == 3000
    writer.finish()
    for ending in ("kv", "bt", "kvei"):
        assert (tmp_path / f"one.{ending}").read_bytes() == (tmp_path / f"many.{ending}").read_bytes()
    left = len(list(tmp_path.iterdir()))
    for keys in ([b"b", b"a"], [b"a", b"a"], [b"a", None]):
        writer = kvseg.TripleWriter(str(tmp_path / "bad"))
        with pytest.raises(coding.FormatError):
            writer.add_all(pa.array(keys, pa.binary()), pa.array([b"1", b"2"]))
        writer.abandon()
    with pytest.raises(coding.FormatError):
        writer = kvseg.TripleWriter(str(tmp_path / "bad"))
        try:
            writer.add_all(pa.array([b"b"]), pa.array([b"1"]))
            writer.add_all(pa.array([b"a"]), pa.array([b"1"]))
        finally:
            writer.abandon()
    assert len(list(tmp_path.iterdir())) == left
