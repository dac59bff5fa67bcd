"""Shared spans, token ids, mixtures and residue."""

import math
import random

import numpy as np
import pytest

from palimpsest.llm import mixture, residue, spans, tokens

SCHEMA = "key binary, value binary, vid int, places string"


def brute_spans(data, length):
    values = {(k, v) for k, v in data if v is not None and len(v) >= length}
    seen = {}
    for k, v in values:
        for i in range(len(v) - length + 1):
            seen.setdefault(v[i : i + length], set()).add(k)
    out = set()
    for k, v in values:
        runs = []
        for i in range(len(v) - length + 1):
            if len(seen[v[i : i + length]]) > 1:
                if runs and i <= runs[-1][1]:
                    runs[-1][1] = i + length
                else:
                    runs.append([i, i + length])
        out |= {(k, len(v), *r) for r in runs}
    return out


def found_spans(df):
    return [(None if r.key is None else bytes(r.key), r.n_bytes, r.span_from, r.span_to) for r in df.collect()]


@pytest.mark.parametrize("length", [8, 64])
def test_shared_spans(spark, length):
    rng = random.Random(length)
    pieces = [rng.randbytes(rng.randrange(length // 2, 3 * length)) for _ in range(12)] + [bytes(2 * length), b"ab" * length]
    data = [(b"none", None), (b"empty", b""), (b"short", b"x"), (None, pieces[0]), (b"dup", pieces[1] * 2), (b"dup", pieces[1] * 2), (b"own", pieces[2]), (b"own", pieces[2] + b"!")]
    for i in range(150):
        value = b"".join(rng.choice([rng.randbytes(rng.randrange(1, length)), rng.choice(pieces), rng.choice(pieces)[: rng.randrange(1, 2 * length)]]) for _ in range(rng.randrange(1, 6)))
        data.append((b"k%d" % i, value))
    df = spark.createDataFrame([(k, v, 1, "x") for k, v in data], SCHEMA)
    got = found_spans(spans.shared_spans(df, "key", "value", length))
    want = brute_spans(data, length)
    assert want and len(got) == len(set(got)) and set(got) == want
    check_removals(spark, data, length, want)


def check_removals(spark, data, length, want):
    """What is cut is part of what is shared, and every shared stretch is whole in some piece that is left."""
    df = spark.createDataFrame([(k, v, 1, "x") for k, v in data], SCHEMA)
    cut = {}
    for r in spans.shared_spans(df, "key", "value", length, removable=True).collect():
        cut.setdefault((None if r.key is None else bytes(r.key), r.n_bytes, r.value_hash), []).append((r.span_from, r.span_to))
    assert all(any(w[0] == k and w[1] == n and w[2] <= a and b <= w[3] for w in want) for (k, n, _), v in cut.items() for a, b in v)
    hashes = {bytes(r.value): r.h for r in df.where("value is not null").select("value", spans.F.xxhash64("value").alias("h")).distinct().collect()}
    seen, left = {}, set()
    for k, v in {(k, v) for k, v in data if v is not None and len(v) >= length}:
        for i in range(len(v) - length + 1):
            seen.setdefault(v[i : i + length], set()).add(k)
        at = 0
        for a, b in [*sorted(cut.get((k, len(v), hashes[v]), [])), (len(v), len(v))]:
            left |= {v[i : i + length] for i in range(at, a - length + 1)}
            at = b
    assert {w for w, keys in seen.items() if len(keys) > 1} <= left
    return cut


def test_removals_of_a_chain_of_overlaps(spark):
    """The middle of three overlapping copies is not cut to pieces too short to hold a stretch."""
    for seed in range(6):
        whole = random.Random(seed).randbytes(300)
        data = [(b"x%d" % seed, whole[:200]), (b"y", whole), (b"z%d" % seed, whole[100:])]
        cut = check_removals(spark, data, 64, brute_spans(data, 64))
        assert sum(b - a for v in cut.values() for a, b in v) >= 200


def test_removals_keep_the_earliest(spark):
    stretch = random.Random(2).randbytes(150)
    rows = [(b"a", stretch, "2024-01-03"), (b"b", b"!" + stretch, "2024-01-01"), (b"c", stretch + b"?", None), (b"b", b"later" + stretch, "2024-02-01")]
    df = spark.createDataFrame(rows, "key binary, value binary, t string").select("key", "value", spans.F.to_timestamp("t").alias("t"))
    got = sorted((bytes(r.key), r.span_from, r.span_to) for r in spans.shared_spans(df, "key", "value", removable=True, rank="t").collect())
    assert got == [(b"a", 0, 150), (b"c", 0, 150)]


def test_values_of_repeated_bytes(spark):
    """Runs of one fingerprint that are longer than a run may be, at other offsets in each."""
    data = [(b"k%d" % i, bytes([i]) * i + bytes(500 + 7 * i) + b"\1\2" * (40 + i) + bytes([i]) * 70) for i in range(1, 6)]
    df = spark.createDataFrame([(k, v, 1, "x") for k, v in data], SCHEMA)
    assert set(found_spans(spans.shared_spans(df, "key", "value"))) == brute_spans(data, 64)
    check_removals(spark, data, 64, brute_spans(data, 64))


def test_values_longer_than_a_pass(spark, monkeypatch):
    monkeypatch.setattr(spans, "PASS_BYTES", 200)
    rng = random.Random(6)
    pieces = [rng.randbytes(rng.randrange(20, 700)) for _ in range(6)]
    data = [(b"k%d" % i, b"".join(rng.choice([rng.randbytes(50), rng.choice(pieces)]) for _ in range(6))) for i in range(40)]
    df = spark.createDataFrame([(k, v, 1, "x") for k, v in data], SCHEMA)
    assert set(found_spans(spans.shared_spans(df, "key", "value", 32))) == brute_spans(data, 32)


def test_shared_spans_of_nothing_and_one_long_value(spark):
    assert spans.shared_spans(spark.createDataFrame([], SCHEMA), "key", "value").count() == 0
    long = random.Random(1).randbytes(3 << 20)
    df = spark.createDataFrame([(b"a", long, 1, ""), (b"b", long[1000:2000], 1, "")], SCHEMA)
    assert sorted(found_spans(spans.shared_spans(df, "key", "value"))) == [(b"a", len(long), 1000, 2000), (b"b", 1000, 0, 1000)]
    with pytest.raises(ValueError):
        spans.shared_spans(df, "key", "value", 65)


TEXTS = [
    None, "", " ", "\n\n", "a", "Hello's you're I'm we'll they've he'd it't ''s 'S 're", "x  y   z\t\tq \n a\n\n\nb  ", "don't!'s don' 's", "<|endoftext|> a<|endoftext|>",
    "naïve café — “quoted” … 12345 ١٢٣ Ⅻ½", "日本語のテキスト 中文 한국어", "🙂👩🏽‍🔬 é ‍  x 　y  z\x85w \x1c\x1d ﻿", "\r\n\r\na\r\n", "a" * 5000, " " * 3000 + "x", "'", "a'", "'s", " 's", "a's'", "!'s", "'ll'", "\x00\x01\x7f",
    "s'", "\t's", "\n're", "1's", "é's", "''ll", "'l", "'v x",
]


def library(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{tokens.TOKENIZER_DIR}/{tokens.TOKENIZER}.json")
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_ids_are_the_librarys(spark):
    rng = random.Random(4)
    signs = list("abS'trelvmd  \n\t!.1é中🙂 ")
    texts = TEXTS + ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.ids for r in tokens.encode_column(df, "doc_id", "text").collect()}
    want = library(texts)
    assert [i for i, w in enumerate(want) if got[i] != w] == []
    counted = {r.doc_id: r.n for r in tokens.count_tokens(df, "text", "n").collect()}
    assert counted == {i: len(w) for i, w in enumerate(want)}


def test_every_white_space_and_letter_class():
    texts = [f"a{chr(c)}b {chr(c)} {chr(c)}{chr(c)}1" for c in [*range(0x3000), *range(0xFE00, 0x10000), *range(0x1F000, 0x1F100)] if not 0xD800 <= c < 0xE000]
    enc = tokens.encoder(tokens.TOKENIZER_DIR, tokens.TOKENIZER)
    ids, counts = enc.encode(texts)
    at = np.append(0, np.cumsum(counts))
    want = library(texts)
    assert [t for i, t in enumerate(texts) if ids[at[i] : at[i + 1]].tolist() != want[i]] == []


def test_texts_longer_than_a_pass(monkeypatch):
    rng = random.Random(7)
    signs = list("abS't  \n\t!.1é中🙂") + [" the", "\n\n  x", " 's"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(400))) for _ in range(300)] + TEXTS[1:]
    enc = tokens.Encoder()
    want = library(texts)
    monkeypatch.setattr(tokens, "PASS_CHARS", 25)
    ids, counts = enc.encode(texts)
    at = np.append(0, np.cumsum(counts))
    assert [t for i, t in enumerate(texts) if ids[at[i] : at[i + 1]].tolist() != want[i]] == []
    assert enc.count(texts).tolist() == counts.tolist()


def test_memo_starts_anew():
    enc = tokens.Encoder()
    size, tokens.MEMO_SIZE = tokens.MEMO_SIZE, 3
    try:
        for texts in (["one two three four"], ["five one"], ["two six seven"]):
            assert enc.encode(texts)[0].tolist() == library(texts)[0]
    finally:
        tokens.MEMO_SIZE = size


def test_round_trip_and_offsets(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    ids = tokens.encode_column(df, "doc_id", "text")
    back = {r.doc_id: r.text for r in tokens.decode_column(ids, "doc_id", "ids").collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}
    by = {}
    for r in tokens.with_offsets(df, "doc_id", "text").orderBy("doc_id", "pos").collect():
        by.setdefault(r.doc_id, []).append(r)
    table = tokens.token_bytes()
    for i, t in enumerate(TEXTS):
        data, at = (t or "").encode(), 0
        for r in by.get(i, []):
            assert r.byte_from == at and data[at : r.byte_to] == table[r.id]
            assert t[r.char_from : r.char_to].encode().find(table[r.id]) >= 0
            at = r.byte_to
        assert at == len(data)
    odd = spark.createDataFrame([(1, None), (2, []), (3, [table.index(b"\xf0")])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in tokens.decode_column(odd, "doc_id", "ids").collect()} == {1: None, 2: "", 3: "�"}
    with pytest.raises(Exception, match="outside the vocabulary"):
        tokens.decode_column(spark.createDataFrame([(1, [99999])], "doc_id long, ids array<int>"), "doc_id", "ids").collect()


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string, file_path string")
    assert tokens.encode_column(none, "doc_id", "text").count() == 0
    assert residue.residue(none).count() == 0


def test_temperature():
    shares = [0.7, 0.2, 0.1]
    assert mixture.tempered(shares, 1.0) == pytest.approx(shares)
    assert mixture.tempered(shares, 0.0) == pytest.approx([1 / 3] * 3)
    a = mixture.exponent_for_entropy(shares, 1.0)
    assert mixture.entropy(mixture.tempered(shares, a)) == pytest.approx(1.0)
    assert mixture.exponent_for_entropy(shares, 0.1) == 1.0


def test_budgets():
    targets = {"a": (0.5, 2), "b": (0.25, 4), "c": (0.25, 1), "never": (0.1, 0)}
    b = mixture.plan_budgets({"a": 1000, "b": 100, "c": 5000, "never": 10}, targets)
    assert b == pytest.approx({"a": 800, "b": 400, "c": 400})
    capped = mixture.plan_budgets({"a": 1000, "b": 100, "c": 5000}, targets, total=3000)
    assert sum(capped.values()) == pytest.approx(3000) and capped["b"] == pytest.approx(400) and capped["a"] < 1500
    assert mixture.plan_budgets({}, targets) == {}


@pytest.mark.parametrize("block_docs", [2000, 7])
def test_mix(spark, block_docs, monkeypatch):
    monkeypatch.setattr(mixture, "BLOCK_DOCS", block_docs)
    rng = random.Random(5)
    sources = ["big"] * 400 + ["mid"] * 150 + ["small"] * 30 + ["other"] * 50 + [None] * 20
    docs = [(i, " ".join(["word"] * rng.randrange(0, 60)) if rng.random() > 0.05 else None, s, "x") for i, s in enumerate(sources)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, block string")
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.15, 4), ("absent", 0.05, 3)], "source string, target_share double, max_repeats int")
    chosen, report = mixture.mix(df, targets)
    rows = chosen.collect()
    assert len({r.doc_id for r in rows}) == len(rows)
    most = {"big": 1, "mid": 2, "small": 4}
    assert all(1 <= r.copies <= most[r.source] and r.n_tokens > 0 and docs[r.doc_id][2] == r.source for r in rows)
    total = sum(r.n_tokens * r.copies for r in rows)
    for s, share in (("big", 0.5), ("mid", 0.3), ("small", 0.15)):
        got = sum(r.n_tokens * r.copies for r in rows if r.source == s)
        # Half a median document, of 29 words.
        assert abs(got - total * share / 0.95) <= 15
    told = {r.source: r for r in report.collect()}
    assert told["absent"].tokens == 0 and math.isclose(sum(r.share for r in told.values()), 1)
    assert told["small"].most_copies == 4
    # The same choice again, whatever the partitions.
    again, _ = mixture.mix(df.repartition(7), targets)
    assert {(r.doc_id, r.copies) for r in again.collect()} == {(r.doc_id, r.copies) for r in rows}


def test_mix_with_a_source_of_one_short_document(spark):
    """Its end would be a mixture too small for a document of any other source."""
    sources = ["tiny"] + ["big"] * 300 + ["mid"] * 100
    df = spark.createDataFrame([(i, " ".join(["word"] * (4 if s == "tiny" else 300)), s) for i, s in enumerate(sources)], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.4, 2), ("tiny", 0.1, 2)], "source string, target_share double, max_repeats int")
    chosen, report = mixture.mix(df, targets)
    share = {r.source: r.share for r in report.collect()}
    assert abs(share["big"] - 0.5) + abs(share["mid"] - 0.4) + abs(share["tiny"] - 0.1) < 0.6
    assert share["mid"] > 0.2 and all(r.copies <= 2 for r in chosen.collect())
    # Large enough sources are mixed as before: the targets are met.
    tokens_of, wants = {"a": 100_000, "b": 50_000}, {"a": (0.5, 1), "b": (0.5, 1)}
    assert mixture.plan_budgets(tokens_of, wants, documents={"a": 1000, "b": 500}) == pytest.approx({"a": 50_000, "b": 50_000})


def test_exponents():
    own, want, can = [0.7, 0.2, 0.1], [0.2, 0.3, 0.5], [700.0, 400.0, 300.0]
    assert mixture.largest_size(own, want, can) == pytest.approx(600)  # the third source gives out first: 300 / 0.5
    assert mixture.exponent_for_repeats(own, want, can, 600) == 1.0
    a = mixture.exponent_for_repeats(own, want, can, 1000)
    assert 0 < a < 1 and mixture._path(own, want, a)[2] * 1000 == pytest.approx(300)
    assert mixture.exponent_for_repeats(own, want, can, 5000) == 0.0
    tempered = mixture.plan_budgets({"a": 700, "b": 200, "c": 100}, {"a": (0.2, 1), "b": (0.3, 9), "c": (0.5, 9)}, total=700, nats=1.0)
    assert mixture.entropy([x / 700 for x in tempered.values()]) == pytest.approx(1.0)


def test_filling_passes_over_what_is_too_long():
    import pyarrow as pa

    docs = pa.table({"doc_id": [1, 2, 3, 4, 5], "turn": [0, 1, 2, 3, 4], "n_tokens": [50, 900, 30, 15, 8], "rest": [120] * 5, "before": [20] * 5})
    assert mixture._fill(docs).column("extra").to_pylist() == [True, False, True, True, True]  # 95 of 100, and the last ends 3 over, which is nearer
    docs = docs.set_column(2, "n_tokens", pa.array([50, 900, 30, 15, 12]))
    assert mixture._fill(docs).column("extra").to_pylist() == [True, False, True, True, False]


def test_order_of_copies(spark):
    chosen = spark.createDataFrame([("a", i, 5, 1 + i % 3) for i in range(300)], "source string, doc_id long, n_tokens long, copies long")
    rows = mixture.in_order(chosen).collect()
    assert len(rows) == sum(1 + i % 3 for i in range(300)) and len({(r["pass"], r.doc_id) for r in rows}) == len(rows)
    first = [r.doc_id for r in sorted(rows, key=lambda r: (r["pass"], r.block, r.turn)) if r["pass"] == 0]
    assert sorted(first) == list(range(300)) and first != sorted(first)


def test_mix_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 1.0, None), (None, None, 1)], "source string, target_share double, max_repeats int")
    chosen, report = mixture.mix(docs, targets)
    assert chosen.count() == 0 and {r.share for r in report.collect()} == {0.0}


CODE = "def walk(node):\n    # Visit the left side first.\n    return node.left\n"
CASES = [
    ("README.md", "# <YOUR PACKAGE HERE>\n\n[INSERT TITLE]\n\n## Install\n\n    get __REPO_SLUG__\n", ["slot"]),
    ("a/package.json", '{\n  "name": "{{ scaffold.app_name }}",\n  "main": "x.js"\n}\n', ["slot"]),
    ("src/a.go", "// Copyright (c) %OWNER_TEAM% All rights reserved.\npackage a\n", ["slot"]),
    ("src/a.py", 'def fill(t):\n    return t.replace("__TITLE__", "x")\n', []),
    ("templates/a.j2", "# {{ title }}\n", []),
    ("a/x.tmpl", "# __AUTHOR__\n", []),
    ("docs/guide.md", "# Writing templates\n\nA slot such as `__AUTHOR__` is replaced:\n\n```\nname: {{ title }}\n```\n\nDone.\n", []),
    ("a.html", "<section *each=\"let x of xs\">\n<h2>{{ x.title }}</h2></section>", []),
    ("a.py", "404: Not Found", ["page"]),
    ("a.js", '{"error":{"code":429,"reason":"Rate limit reached, slow down.","trace":"b3b3bb7485bc390d"}}\n', ["page"]),
    ("a.css", "<html>\n<head><title>403 Forbidden</title></head>\n<body>\n<center><h1>403 Forbidden</h1></center>\n<hr><center>gate/2.5</center>\n</body>\n</html>\n", ["page"]),
    ("a.py", CODE * 5 + "def cut(a\n\n503 Service Unavailable: The origin is down for maintenance and will be back soon. (request 2b6db0f9)\n", ["page"]),
    ("a.html", "<html><head><title>x</title><script src='/a.js'></script></head><body><noscript>Bitte schalten Sie JavaScript ein, um diese Seite zu sehen.</noscript><div id=root></div></body></html>", ["page"]),
    ("a.html", "<html><body><noscript>Please enable JavaScript in your browser.</noscript><h1>Gauges</h1>" + "<p>The gauge reads the valve and tells the pump what to do next.</p>" * 5, []),
    ("a.py", 'from web import Response\n\ndef missing(path):\n    return Response("404 Not Found", 404)\n', []),
    ("docs/codes.md", "| code | name | cause |\n|---|---|---|\n| 404 | Not Found | The valve is shut and the pump is cold. |\n", []),
    ("m.yaml", 'error.valve: "Access denied."\nnotice.pump: "Please turn on JavaScript to view this page."\n', []),
    ("t.js", 'test("x", () => {\n  expect(page.noscript).toBe("You must enable JavaScript.");\n});\n', []),
    ("a.md", "# Valve\n\nLorem ipsum dolor sit amet velit fugiat porta. Ullam sit nunc labore sit magna.\n", ["filler"]),
    ("a.go", "// Placeholder paragraph. Placeholder paragraph. Placehol\n// der paragraph. Placeholder paragraph.\nx := 1\n", ["filler"]),
    ("a.c", "// Add your content here. Coming soon. Replace \n// this paragraph with your own words.\nint x;\n", ["filler"]),
    ("a.json", '{\n  "a": "yada xxx blah TBD yada blah xxx bla blah",\n  "b": "x"\n}\n', ["filler"]),
    ("a.md", "# Pump\n\njalhj jadgs dfkka asa gldjkj hlkdjlh shsadakd gjl shk gadk\n", ["filler"]),
    ("gen.py", 'import random\n\nWORDS = ["lorem", "ipsum", "dolor", "sit", "amet", "velit", "fugiat"]\n\ndef p():\n    return random.choice(WORDS)\n', []),
    ("LICENSE", "Copyright (c) __YEAR__ __AUTHOR__\n", []),
    ("a.py", CODE, []),
    ("a.py", None, []), ("a.py", "", []), ("a.py", " \n\t", []), (None, "Access denied.", ["page"]), (None, "plain words", []),
]


@pytest.mark.parametrize(("path", "text", "kinds"), CASES)
def test_residue(path, text, kinds):
    assert residue.kinds_of(text, path) == kinds


@pytest.mark.parametrize("phrase", ["ダミーテキスト", "示例文本"])
def test_short_filler(phrase):
    for path, text in (("a.md", f"# Pump\n\n{phrase}\n\nThe pump runs.\n"), ("a.html", f"<h1>Pump</h1><p>{phrase}</p><p>The pump runs.</p>"), ("a.json", f'{{\n  "a": "{phrase}",\n  "b": "x"\n}}\n')):
        assert residue.kinds_of(text, path) == ["filler"]
    assert residue.kinds_of("# Pump\n\nx\n\nok\n\nThe word for it is " + phrase + " in that language.\n", "a.md") == []


LATIN = "Lorem ipsum dolor sit amet velit fugiat porta. Ullam sit nunc labore sit magna."
WITHIN_CODE = [
    ("a.py", f'def f():\n    """{LATIN}"""\n    return 1\n', ["filler"]),
    ("a.py", f'# Copyright.\n\n"""The pump and the valve it feeds.\n\n{LATIN}\n"""\nx = 1\n', ["filler"]),
    ("a.py", f'class A:\n    about = "{LATIN}"\n', ["filler"]),
    ("a.js", f"const x = {{ about: '{LATIN}' }};\n", ["filler"]),
    ("a.go", f"x := 1 // {LATIN}\n", ["filler"]),
    ("a.c", f"/*\n{LATIN}\n*/\nint x;\n", ["filler"]),
    ("a.java", f"/**\n * The pump feeds the valve, and the valve feeds all of the gauges behind it.\n *\n * {LATIN}\n */\nint x;\n", ["filler"]),
    ("a.go", f"// The pump feeds the valve, and the valve feeds all of the gauges behind it.\n//\n// {LATIN}\nx := 1\n", ["filler"]),
    ("a.c", "/*\n  Written by __AUTHOR__ for the valve.\n*/\nint x;\n", ["slot"]),
    ("a.go", "x := 1 // kept by %OWNER_TEAM%\n", ["slot"]),
    ("a.py", 'def f():\n    """Written by __AUTHOR__."""\n', ["slot"]),
    ("a.py", 'def f():\n    """Reads __version__ of the module."""\n', []),
    ("a.py", 'def fill(t):\n    """Fill it."""\n    return t.replace("__TITLE__", "# __TITLE__")\n', []),
    ("gen.py", f'import random\n\nTEXT = "{LATIN}"\n\ndef p():\n    return random.choice(TEXT.split())\n', []),
    ("tests/a.js", f"const x = '{LATIN}';\n", []),
    ("a.js", f"show('{LATIN}');\n", []),
    ("a.js", "const label = 'Coming soon';\n", []),
    ("a.js", "const x = `made by ${author}`; // the pump\n", []),
]


@pytest.mark.parametrize(("path", "text", "kinds"), WITHIN_CODE)
def test_residue_within_code(path, text, kinds):
    assert residue.kinds_of(text, path) == kinds


def test_residue_column(spark):
    df = spark.createDataFrame([(i, t, p, "x") for i, (p, t, _) in enumerate(CASES)], "doc_id long, text string, file_path string, kinds string")
    got = {r.doc_id: r.kinds for r in residue.residue(df).collect()}
    assert got == {i: k for i, (_, _, k) in enumerate(CASES) if k}


def test_residue_of_a_very_long_text():
    assert residue.kinds_of(CODE * 30_000 + "\n404: Not Found\n", "a.py") == ["page"]
    assert residue.kinds_of("404 Not Found is what | he says " * 20_000, "a.md") == []


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k", "word_bpe_49k", "piece_bpe_32k"])
def test_ids_of_every_public_tokenizer(spark, name):
    texts = [*TEXTS, "IT'S FINE", "  Two  spaces\tand CASE"]
    want = tokens._library(tokens.TOKENIZER_DIR, name)([t or "" for t in texts])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.ids for r in tokens.encode_column(df, "doc_id", "text", name=name).collect()}
    assert [i for i, w in enumerate(want) if got[i] != w] == []
    assert {r.doc_id: r.n for r in tokens.count_tokens(df, "text", "n", name=name).collect()} == {i: len(w) for i, w in enumerate(want)}
    ids = spark.createDataFrame([(i, w) for i, w in enumerate(want)], "doc_id long, ids array<int>")
    if tokens.is_byte_level(tokens.TOKENIZER_DIR, name):
        assert {r.doc_id: r.text for r in tokens.decode_column(ids, "doc_id", "ids", name=name).collect()} == {i: t or "" for i, t in enumerate(texts)}
    else:
        with pytest.raises(tokens.TokenizerError):
            tokens.decode_column(ids, "doc_id", "ids", name=name)
        with pytest.raises(tokens.TokenizerError):
            tokens.Encoder(name=name)


def test_tokenizers_that_are_not_there(spark, tmp_path):
    with pytest.raises(tokens.TokenizerError):
        tokens.tokenizer_file(tokens.TOKENIZER_DIR, "none")
    (tmp_path / "x.txt").write_text("x")
    with pytest.raises(tokens.TokenizerError):
        tokens.encoder(str(tmp_path), "x.txt")
