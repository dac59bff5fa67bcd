"""Every query with SQL against DuckDB, on the smallest tables."""

import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def normal(found):
    return sorted(tuple("~" if x is None or (isinstance(x, float) and math.isnan(x)) else str(x) for x in r) for r in found)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    want = duck.sql(entry.oracle_sql()[name])
    assert sorted(want.columns) == columns
    assert normal(df.select(*columns).collect()) == normal(want.select(*[f'"{c}"' for c in columns]).fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_patterns_of_all_lengths(spark, duck):
    from palimpsest.operators.ngrams import LENGTHS, OVERHEAD

    words = [w.encode() for (w,) in duck.sql("SELECT concat_ws('|', lpad(CAST(o_custkey AS VARCHAR), 8, '0'), o_orderstatus, o_orderpriority, '0x0000000000000000') FROM orders").fetchall()]
    counts = Counter(w[i : i + n] for w in words for n in LENGTHS for i in range(len(w) - n + 1))
    best = sorted((-(len(g) - OVERHEAD) * (c - 1), g.hex(), c) for g, c in counts.items() if c >= 2)[:100]
    got = entry.queries()["ngram_top_all_lengths"](spark, DATA).collect()
    assert [(-r.score, r.ngram_hex, r.uses) for r in got] == best
    assert sum(len(r.ngram_hex) == 64 for r in got) == 10
