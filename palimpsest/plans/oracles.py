"""SQL that gives what the queries give, for DuckDB over the same tables."""

from __future__ import annotations

USERS = """users AS (
  SELECT 'u' || lpad(CAST(user_id AS VARCHAR), 8, '0') AS k, CASE WHEN event_type = 'error' THEN '' ELSE coalesce(props, '') END AS v,
         datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS s, event_id AS e
  FROM events WHERE user_id IS NOT NULL)"""
BUYERS = """buyers AS (
  SELECT 'c' || lpad(CAST(o_custkey AS VARCHAR), 8, '0') AS k, CASE WHEN o_orderstatus = 'F' THEN '' ELSE o_orderpriority END AS v,
         year(o_orderdate) AS s, o_orderkey AS e
  FROM orders)"""
ORDERS = """dom AS (SELECT 'o' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS k, concat_ws('|', o_orderstatus, o_orderpriority) AS v FROM orders)"""
PAIR = "lower(hex(k)) AS key_hex, lower(hex(v)) AS value_hex"


def _newest(source: str, where: str = "true") -> str:
    return f"SELECT k, v FROM (SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY s DESC, e DESC) AS n FROM {source} WHERE {where}) WHERE n = 1"


_BY_RUN = "per_run AS (SELECT k, v, s FROM (SELECT k, v, s, row_number() OVER (PARTITION BY k, s ORDER BY e DESC) AS n FROM buyers) WHERE n = 1)"
_LAST = "(SELECT max(s) FROM buyers)"
_OFFSET = "CAST(coalesce(sum(strlen(k) + strlen(v)) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS logical_offset"
_NUMBERED = "numbered AS (SELECT k, v, row_number() OVER (ORDER BY k) - 1 AS ordinal FROM dom)"


class Chain:
    """A row of CTEs, each adding a column to the one before; 64-bit arithmetic in UHUGEINT."""

    M = "18446744073709551615::UHUGEINT"

    def __init__(self, *first: str):
        self.ctes = list(first)
        self.at = first[-1].split(" ", 1)[0]
        self.n = 0

    def add(self, expr: str, name: str) -> str:
        self.n += 1
        self.ctes.append(f"c{self.n} AS (SELECT *, {expr} AS {name} FROM {self.at})")
        self.at = f"c{self.n}"
        return name

    def mul(self, x: str, c: int, name: str) -> str:
        # A product of two 64-bit numbers fits 128 bits unsigned.
        return self.add(f"({x} * {c}::UHUGEINT) % 18446744073709551616::UHUGEINT", name)

    def rotl(self, x: str, n: int, name: str) -> str:
        return self.add(f"({x} * {2**n}::UHUGEINT) % 18446744073709551616::UHUGEINT + {x} // {2 ** (64 - n)}::UHUGEINT", name)

    def plus(self, x: str, y: str, name: str) -> str:
        return self.add(f"({x} + {y}) % 18446744073709551616::UHUGEINT", name)

    def xor(self, x: str, y: str, name: str) -> str:
        return self.add(f"xor({x}, {y})", name)

    def shift_xor(self, x: str, n: int, name: str) -> str:
        return self.add(f"xor({x}, {x} // {2**n}::UHUGEINT)", name)

    def final(self, x: str, name: str) -> str:
        x = self.shift_xor(x, 33, f"{name}1")
        x = self.mul(x, 0xFF51AFD7ED558CCD, f"{name}2")
        x = self.shift_xor(x, 33, f"{name}3")
        x = self.mul(x, 0xC4CEB9FE1A85EC53, f"{name}4")
        return self.shift_xor(x, 33, name)

    def select(self, columns: str, tail: str = "") -> str:
        return f"WITH {', '.join(self.ctes)} SELECT {columns} FROM {self.at} {tail}"


def _short_keys(letters: str = "u", salts: str = "SELECT 9 AS salt") -> tuple[str, str, str]:
    """k0: eight-byte keys; k1: each under each salt, with the number of keys of the first letter."""
    union = " UNION ".join(f"SELECT DISTINCT '{x}' || lpad(CAST(user_id AS VARCHAR), 7, '0') AS k FROM events WHERE user_id IS NOT NULL" for x in letters)
    return f"k0 AS ({union})", f"s0 AS ({salts})", "k1 AS (SELECT k, CAST(salt AS UHUGEINT) AS salt, (SELECT count(*) FROM k0 WHERE k LIKE 'u%') AS n FROM k0, s0)"


def _word(first: int, upto: int) -> str:
    """The bytes of k from ``first`` up to ``upto`` as a little-endian number."""
    return " + ".join(f"ascii(substr(k, {i + 1}, 1))::UHUGEINT * {256 ** (i - first)}::UHUGEINT" for i in range(first, upto))


_C1, _C2 = 0x87C37B91114253D5, 0x4CF5AD432745937F


def _mixed(c: Chain, word: str, name: str, a: int, turn: int, b: int) -> str:
    x = c.mul(c.add(word, f"{name}0"), a, f"{name}1")
    return c.mul(c.rotl(x, turn, f"{name}2"), b, f"{name}3")


def _end(c: Chain, h1: str, h2: str, length: int) -> Chain:
    a, b = c.xor(h1, f"{length}::UHUGEINT", "e1"), c.xor(h2, f"{length}::UHUGEINT", "e2")
    a = c.plus(a, b, "e3")
    b = c.plus(a, b, "e4")
    c.plus(c.final(a, "fa"), c.final(b, "fb"), "h")
    return c


def _hash_chain(letters: str = "u", salts: str = "SELECT 9 AS salt", more: tuple[str, ...] = ()) -> Chain:
    """h1 of eight-byte keys under each salt, in column ``h``; ``n`` is the number of keys of the first letter."""
    c = Chain(*_short_keys(letters, salts), *more)
    return _end(c, c.xor("salt", _mixed(c, _word(0, 8), "w", _C1, 31, _C2), "a0"), "salt", 8)


def _long_hash() -> str:
    """h1 of keys of 22 bytes: a block of 16 and a rest of 6."""
    key = lambda x: f"'{x}' || lpad(CAST(user_id AS VARCHAR), 10, '0')"
    c = Chain(f"k1 AS (SELECT DISTINCT {key('u')} || {key('v')} AS k, 9::UHUGEINT AS salt FROM events WHERE user_id IS NOT NULL)")
    a = c.xor("salt", _mixed(c, _word(0, 8), "p", _C1, 31, _C2), "h1a")
    a = c.plus(c.rotl(a, 27, "h1b"), "salt", "h1c")
    a = c.plus(c.mul(a, 5, "h1d"), f"{0x52DCE729}::UHUGEINT", "h1e")
    b = c.xor("salt", _mixed(c, _word(8, 16), "q", _C2, 33, _C1), "h2a")
    b = c.plus(c.rotl(b, 31, "h2b"), a, "h2c")
    b = c.plus(c.mul(b, 5, "h2d"), f"{0x38495AB5}::UHUGEINT", "h2e")
    a = c.xor(a, _mixed(c, _word(16, 22), "r", _C1, 31, _C2), "h1f")
    return _end(c, a, b, 22).select(f"lower(hex(k)) AS key_hex, {_signed('h')} AS h1")


def _bits_chain(letters: str = "u", salts: str = "SELECT 9 AS salt", more: tuple[str, ...] = ()) -> Chain:
    """The filter's three bits of each key, in columns i0 to i2."""
    c = _hash_chain(letters, salts, more)
    c.add("CAST(ceil(-n * ln(0.01) / (ln(2) * ln(2))) AS BIGINT)::UHUGEINT", "m")
    c.xor("1311768467463790320::UHUGEINT", "n::UHUGEINT", "s0")
    h = "h"
    for i in range(3):
        s = c.plus(f"s{i}", "11400714819323198485::UHUGEINT", f"s{i + 1}")
        z = c.shift_xor(s, 30, f"z{i}a")
        z = c.mul(z, 0xBF58476D1CE4E5B9, f"z{i}b")
        z = c.shift_xor(z, 27, f"z{i}c")
        z = c.mul(z, 0x94D049BB133111EB, f"z{i}d")
        z = c.shift_xor(z, 31, f"z{i}")
        r = c.rotl(h, 17, f"r{i}")
        h = c.xor(r, z, f"g{i}")
        c.add(f"CAST({h} % m AS BIGINT)", f"i{i}")
    return c


def _signed(x: str) -> str:
    return f"CAST(CASE WHEN {x} >= 9223372036854775808::UHUGEINT THEN CAST({x} AS HUGEINT) - 18446744073709551616::HUGEINT ELSE CAST({x} AS HUGEINT) END AS BIGINT)"


def _word_or() -> str:
    bits = _bits_chain()
    bits.ctes.append(f"bit AS (SELECT unnest([i0, i1, i2]) AS b FROM {bits.at})")
    bits.ctes.append("w AS (SELECT b // 64 AS word, bit_or(1::UBIGINT << CAST(b % 64 AS UBIGINT)) AS o FROM bit GROUP BY 1)")
    bits.at = "w"
    return bits.select(f"word, {_signed('CAST(o AS UHUGEINT)')} AS bits")


def _contains() -> str:
    c = _bits_chain("ux")
    c.ctes.append(f"bit AS (SELECT DISTINCT unnest([i0, i1, i2]) AS b FROM {c.at} WHERE k LIKE 'u%')")
    return c.select("lower(hex(k)) AS key_hex, i0 IN (SELECT b FROM bit) AND i1 IN (SELECT b FROM bit) AND i2 IN (SELECT b FROM bit) AS maybe")


def _sampled(n: int) -> str:
    """A view of k1 with ``n`` evenly spaced keys marked, for the chains."""
    return f"k2 AS (SELECT k1.*, (SELECT list(i * (SELECT count(*) FROM k0) // least({n}, (SELECT count(*) FROM k0))) FROM range(least({n}, (SELECT count(*) FROM k0))) AS t(i)) AS wanted FROM k1)", (
        "k3 AS (SELECT k, salt, n, list_contains(wanted, dense_rank() OVER (PARTITION BY salt ORDER BY k) - 1) AS sampled FROM k2)"
    )


def _held_under(own: int, salts: str, n: int) -> Chain:
    """Column ``held``: whether a key's bits under a salt are all in the filter built with ``own``; ``sampled``: one of n keys."""
    c = _bits_chain("u", f"SELECT {own} AS salt UNION {salts}", _sampled(n))
    c.ctes.append(f"bit AS MATERIALIZED (SELECT DISTINCT unnest([i0, i1, i2]) AS b FROM {c.at} WHERE salt = {own})")
    c.ctes.append(f"held AS (SELECT k, salt, sampled, i0 IN (SELECT b FROM bit) AND i1 IN (SELECT b FROM bit) AND i2 IN (SELECT b FROM bit) AS held FROM {c.at} WHERE sampled)")
    c.at = "held"
    return c


_GRAM_WORDS = "words AS (SELECT o_orderkey AS pos, hex(concat_ws('|', lpad(CAST(o_custkey AS VARCHAR), 8, '0'), o_orderstatus, o_orderpriority, '0x0000000000000000')) AS w FROM orders)"


def _grams(n: int) -> str:
    return f"SELECT substr(w, 2 * i + 1, {2 * n}) AS g, {n} AS n FROM words, unnest(range(0, length(w) // 2 - {n} + 1)) AS t(i) WHERE length(w) // 2 >= {n}"


_ALL_GRAMS = " UNION ALL ".join(map(_grams, (64, 32, 16, 8)))
_DICTIONARY = f"""{_GRAM_WORDS.replace("words AS", "every AS")}, words AS (SELECT * FROM every ORDER BY pos LIMIT 100000), g AS ({_ALL_GRAMS}),
best AS (SELECT g, n, (n - 4) * (count(*) - 1) AS score FROM g GROUP BY g, n HAVING count(*) >= 2 ORDER BY score DESC, g LIMIT 8192),
dict AS (SELECT g, n, row_number() OVER (ORDER BY score DESC, g) - 1 AS pid FROM best)"""
# From the left: the longest pattern that begins here, else a byte on.
_COVER = f"""{_DICTIONARY},
walk(pos, w, here, begun, pid, going) AS (
  SELECT pos, w, 0, 0, CAST(-1 AS BIGINT), length(w) > 0 FROM every
  UNION ALL
  SELECT x.pos, x.w, x.here + coalesce(x.n, 1), x.here, coalesce(x.pid, -1), 2 * (x.here + coalesce(x.n, 1)) < length(x.w) FROM (
    SELECT walk.pos, walk.w, walk.here, coalesce(a.n, b.n, c.n, d.n) AS n, coalesce(a.pid, b.pid, c.pid, d.pid) AS pid FROM walk
    LEFT JOIN dict a ON a.n = 64 AND a.g = substr(walk.w, 2 * walk.here + 1, 128) LEFT JOIN dict b ON b.n = 32 AND b.g = substr(walk.w, 2 * walk.here + 1, 64)
    LEFT JOIN dict c ON c.n = 16 AND c.g = substr(walk.w, 2 * walk.here + 1, 32) LEFT JOIN dict d ON d.n = 8 AND d.g = substr(walk.w, 2 * walk.here + 1, 16)
    WHERE walk.going) x),
cover AS (SELECT pos, begun AS start, pid FROM walk WHERE pid >= 0)"""
_LENGTHS = "SELECT CAST(symbol AS BIGINT) AS symbol, count(*) AS uses FROM (SELECT strlen(o_orderpriority) + 1 AS symbol FROM orders UNION ALL SELECT 0 FROM orders) GROUP BY 1"
# The two rarest are joined, again and again; a leaf goes before a joined one as rare, leaves by their bits reversed.
_HUFFMAN = f"""h AS ({_LENGTHS}),
leaves AS (SELECT {{'w': CAST(uses AS BIGINT), 'kind': 0, 'o': list_sum([((symbol >> i) & 1)::UHUGEINT * (2::UHUGEINT ** (63 - i))::UHUGEINT FOR i IN range(8)]), 'm': [symbol]}} AS x FROM h),
join_up(i, q, m) AS (
  SELECT 0, (SELECT list_sort(list(x)) FROM leaves), CAST([] AS BIGINT[])
  UNION ALL
  SELECT i + 1, list_sort(list_concat(q[3:], [{{'w': q[1].w + q[2].w, 'kind': 1, 'o': CAST(i AS DOUBLE), 'm': list_concat(q[1].m, q[2].m)}}])), list_concat(q[1].m, q[2].m) FROM join_up WHERE len(q) > 1)"""

_STEP = """steps AS (
  SELECT *, list_filter(string_split(coalesce(name, ''), '.'), lambda x: regexp_full_match(x, '[0-9]{1,18}-[0-9]{1,18}'))[1] AS seg FROM step_files)"""
_DELETION = "(coalesce(lower(trim(op)) IN ('d', 'del', 'delete', 'remove'), false) OR value IS NULL OR octet_length(value) = 0)"
_STATE = f"""won AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY domain_name, key ORDER BY step DESC, txn DESC, change_id DESC) AS n FROM kv_changes) WHERE n = 1),
job AS (SELECT domain_name, coalesce(drop_deleted, true) AND coalesce(coalesce(range_from,
    CAST(split_part(list_filter(string_split(coalesce(out_name, ''), '.'), lambda x: regexp_full_match(x, '[0-9]{{1,18}}-[0-9]{{1,18}}'))[1], '-', 1) AS BIGINT)) = 0, false) AS drops FROM merge_jobs),
state AS (SELECT won.*, {_DELETION} AS deleted FROM won LEFT JOIN job USING (domain_name) WHERE NOT ({_DELETION} AND coalesce(drops, false)))"""

_STEP_OF = "list_filter(string_split({0}, '.'), lambda x: regexp_full_match(x, '[0-9]{{1,18}}-[0-9]{{1,18}}'))[1]"
_WALK = "regexp_replace(regexp_replace(q, '^(/[.][.])+(/|$)', '/'), '/[^/]+/[.][.](/|$)', '/')"
_PATHS = f"""listed AS (SELECT kv FROM flush_files UNION SELECT kv FROM flush_records),
walk(kv, q, n) AS (
  SELECT kv, regexp_replace(regexp_replace('/' || regexp_replace(kv, '^\\s+|\\s+$', '', 'g'), '/+', '/', 'g'), '(/[.])+(/|$)', '/', 'g'), 0 FROM listed WHERE kv IS NOT NULL
  UNION ALL SELECT kv, {_WALK}, n + 1 FROM walk WHERE {_WALK} <> q),
paths AS (SELECT kv, rtrim(arg_max(q, n), '/') AS path FROM walk GROUP BY kv),
small AS (SELECT DISTINCT domain_name, path, {_STEP_OF.format("split_part(path, '/', -1)")} AS seg FROM flush_files JOIN paths USING (kv) WHERE kv_bytes < 16384 AND path LIKE '%.kv')"""
_ONCE = """once AS (SELECT domain_name, CAST(split_part(seg, '-', 1) AS BIGINT) AS a, CAST(split_part(seg, '-', 2) AS BIGINT) AS b, key, value, min(row_id) AS row_id
  FROM flush_records JOIN paths USING (kv) JOIN small USING (path) GROUP BY ALL)"""

ORACLE = {
    "scan_pairs": f"WITH {ORDERS} SELECT {PAIR} FROM dom",
    "point_get": f"WITH {ORDERS} SELECT {PAIR} FROM dom WHERE k = 'o0000000042'",
    "get_absent": f"WITH {ORDERS} SELECT {PAIR} FROM dom WHERE k = 'nothing'",
    "batch_get": f"WITH {ORDERS}, p AS (SELECT DISTINCT 'o' || lpad(CAST(l_orderkey * 3 AS VARCHAR), 10, '0') AS k FROM lineitem) SELECT {PAIR} FROM p LEFT JOIN dom USING (k)",
    "key_range": f"WITH {ORDERS} SELECT {PAIR} FROM dom WHERE k >= 'o0000000100' AND k < 'o0000000200'",
    "prefix_scan": f"WITH {ORDERS} SELECT {PAIR} FROM dom WHERE k LIKE 'o00000001%'",
    "first_rows": f"WITH {ORDERS} SELECT {PAIR} FROM dom ORDER BY k LIMIT 5",
    "stack_newest_wins": f"WITH {USERS} SELECT {PAIR} FROM ({_newest('users')})",
    "stack_buyers": f"WITH {BUYERS} SELECT {PAIR} FROM ({_newest('buyers')})",
    "stack_get_many": f"WITH {BUYERS}, p AS (SELECT DISTINCT 'c' || lpad(CAST(c_custkey * 2 AS VARCHAR), 8, '0') AS k FROM customer) SELECT {PAIR} FROM p LEFT JOIN ({_newest('buyers')}) USING (k)",
    "merge_keep": f"WITH {USERS} SELECT {PAIR} FROM ({_newest('users')})",
    "merge_drop_from_zero": f"WITH {USERS} SELECT {PAIR} FROM ({_newest('users')}) WHERE v <> ''",
    "merge_buyers_range_from": f"WITH {BUYERS} SELECT {PAIR} FROM ({_newest('buyers')}) WHERE v <> ''",
    "as_of_step": f"WITH {BUYERS} SELECT {PAIR} FROM ({_newest('buyers', 's <= 1997')})",
    "override_antijoin": f"WITH {BUYERS} SELECT {PAIR} FROM ({_newest('buyers')})",
    "shared_keys": f"WITH {BUYERS} SELECT lower(hex(k)) AS key_hex FROM (SELECT k FROM buyers WHERE s < {_LAST} INTERSECT SELECT k FROM buyers WHERE s = {_LAST})",
    "semi_exists": f"WITH {BUYERS} SELECT lower(hex(k)) AS key_hex FROM (SELECT k FROM buyers WHERE s < {_LAST} INTERSECT SELECT k FROM buyers WHERE s = {_LAST})",
    "anti_missing": f"WITH {BUYERS} SELECT lower(hex(k)) AS key_hex FROM (SELECT k FROM buyers WHERE s < {_LAST} EXCEPT SELECT k FROM buyers WHERE s = {_LAST})",
    "files_key_counts": f"WITH {BUYERS}, f AS (SELECT s, count(DISTINCT k) AS c FROM buyers GROUP BY s) SELECT 'v1.1-buyers.' || s || '-' || (s + 1) || '.kv' AS name, row_number() OVER (ORDER BY s) - 1 AS rank, c AS key_count FROM f",
    "union_key_count": f"WITH {BUYERS} SELECT count(DISTINCT k) AS keys FROM buyers",
    "smallest_run": f"WITH {BUYERS}, f AS (SELECT 'v1.1-buyers.' || s || '-' || (s + 1) || '.kv' AS name, count(DISTINCT k) AS key_count FROM buyers GROUP BY s) SELECT * FROM f ORDER BY key_count, name LIMIT 1",
    "ordinals": f"WITH {ORDERS}, {_NUMBERED} SELECT {PAIR}, ordinal FROM numbered",
    "nth_key": f"WITH {ORDERS}, {_NUMBERED} SELECT {PAIR}, ordinal FROM numbered WHERE ordinal = 777",
    "every_mth_key": f"WITH {ORDERS}, {_NUMBERED} SELECT lower(hex(k)) AS key_hex, ordinal FROM numbered WHERE ordinal % 256 = 0",
    "offsets_prefix_sum": f"WITH {ORDERS}, {_NUMBERED} SELECT lower(hex(k)) AS key_hex, ordinal, {_OFFSET} FROM numbered",
    "evenly_spaced_sample": f"WITH {ORDERS}, {_NUMBERED} SELECT lower(hex(k)) AS key_hex, ordinal FROM numbered WHERE ordinal IN (SELECT i * (SELECT count(*) FROM dom) // 64 FROM range(64) AS t(i))",
    "stride_sample": f"WITH {ORDERS}, {_NUMBERED} SELECT lower(hex(k)) AS key_hex, ordinal FROM numbered WHERE ordinal % 100 = 0 ORDER BY ordinal LIMIT 50",
    "order_violations": "SELECT pos, lower(hex(k)) AS key_hex FROM (SELECT event_id AS pos, 'u' || lpad(CAST(user_id AS VARCHAR), 8, '0') AS k, lag('u' || lpad(CAST(user_id AS VARCHAR), 8, '0')) OVER (ORDER BY event_id) AS p FROM events WHERE user_id IS NOT NULL) WHERE k <= p",
    "repeated_keys": "SELECT lower(hex('l' || lpad(CAST(l_orderkey AS VARCHAR), 10, '0') || 'n' || lpad(CAST(l_linenumber AS VARCHAR), 3, '0'))) AS key_hex, count(*) AS copies FROM lineitem GROUP BY 1 HAVING count(*) > 1",
    "inspect_counts": f"WITH {BUYERS}, {_BY_RUN} SELECT 'v1.1-buyers.' || s || '-' || (s + 1) || '.kv' AS name, count(*) * 2 AS words_count, CAST(count(*) FILTER (v = '') AS BIGINT) AS empty_words_count, count(*) AS key_count FROM per_run GROUP BY s",
    "length_histogram": "SELECT CAST(symbol AS BIGINT) AS symbol, count(*) AS uses FROM (SELECT strlen(o_orderpriority) + 1 AS symbol FROM orders UNION ALL SELECT 0 FROM orders) GROUP BY 1",
    "step_names": f"WITH {_STEP} SELECT file_id, CAST(split_part(seg, '-', 1) AS BIGINT) AS step_from, CAST(split_part(seg, '-', 2) AS BIGINT) AS step_to FROM steps",
    "murmur3_h1": _hash_chain().select(f"lower(hex(k)) AS key_hex, {_signed('h')} AS h1"),
    "bloom_bits": _bits_chain().select("lower(hex(k)) AS key_hex, unnest([i0, i1, i2]) AS bit"),
    "bloom_word_or": _word_or(),
    "bloom_contains": _contains(),
    "salt_validate": _held_under(9, "SELECT unnest([9, 10]) AS salt", 64).select("CAST(salt AS BIGINT) AS salt, bool_and(held) AS valid", "GROUP BY 1"),
    "find_salt": _held_under(5003, "SELECT i AS salt FROM range(6144) AS t(i)", 16).select("min(salt) AS salt", "").replace("SELECT min(salt) AS salt FROM held", "SELECT CAST(min(salt) AS BIGINT) AS salt FROM (SELECT salt FROM held GROUP BY salt HAVING bool_and(held))"),
    "salt_file": "SELECT 'whole' AS file, CAST(887699001 AS BIGINT) AS salt UNION ALL SELECT 'missing', NULL",
    "murmur3_long_keys": _long_hash(),
    "ngram_top_patterns": f"WITH {_GRAM_WORDS}, g AS ({_ALL_GRAMS}), c AS (SELECT g, n, count(*) AS uses FROM g GROUP BY g, n HAVING count(*) >= 2) SELECT lower(g) AS ngram_hex, uses, (n - 4) * (uses - 1) AS score FROM c ORDER BY score DESC, g LIMIT 8192",
    "ngram_top_all_lengths": f"WITH {_GRAM_WORDS}, g AS ({_grams(64)} UNION ALL {_grams(32)} UNION ALL {_grams(16)} UNION ALL {_grams(8)}), c AS (SELECT g, n, count(*) AS uses FROM g GROUP BY g, n HAVING count(*) >= 2) SELECT lower(g) AS ngram_hex, uses, (n - 4) * (uses - 1) AS score FROM c ORDER BY score DESC, g LIMIT 100",
    "write_and_inspect": f"WITH {ORDERS} SELECT 'v1.1-orders.0-16.kv' AS name, CAST(0 AS BIGINT) AS step_from, CAST(16 AS BIGINT) AS step_to, 2 * count(*) AS words_count, CAST(0 AS BIGINT) AS empty_words_count, count(*) AS key_count, CAST(sum(strlen(k) + strlen(v)) AS BIGINT) AS logical_bytes, CAST(256 AS BIGINT) AS fanout, 'bloom' AS filter_kind, true AS filter_accelerates, CAST(9 AS BIGINT) AS salt, true AS has_bytes FROM dom",
    "recode_identity": "SELECT count(*) AS source_rows, count(*) AS read_rows, CAST(0 AS BIGINT) AS differing FROM orders",
    "codec_round_trip": "SELECT count(*) AS source_rows, count(*) AS read_rows, CAST(0 AS BIGINT) AS differing FROM orders",
    "greedy_cover": f"WITH RECURSIVE {_COVER} SELECT pos, CAST(start AS INTEGER) AS start, CAST(pid AS INTEGER) AS pattern_id FROM cover",
    "pattern_usage": f"WITH RECURSIVE {_COVER} SELECT CAST(pid AS INTEGER) AS pattern_id, count(*) AS uses FROM cover GROUP BY 1",
    "distance_histogram": f"""WITH RECURSIVE {_COVER},
d AS (SELECT start - lag(start, 1, 0) OVER (PARTITION BY pos ORDER BY start) + 1 AS symbol FROM cover UNION ALL SELECT length(w) // 2 + 1 FROM every UNION ALL SELECT 0 FROM every)
SELECT CAST(symbol AS BIGINT) AS symbol, count(*) AS uses FROM d GROUP BY 1""",
    "huffman_depths": f"WITH RECURSIVE {_HUFFMAN}, parts AS (SELECT unnest(m) AS symbol FROM join_up) SELECT h.symbol, h.uses, CAST(count(parts.symbol) AS INTEGER) AS depth FROM h LEFT JOIN parts USING (symbol) GROUP BY ALL",
    "domain_get": f"WITH {ORDERS} SELECT {PAIR} FROM dom WHERE k IN ('o0000000042', 'nothing')",
    "domain_range": f"WITH {ORDERS} SELECT {PAIR} FROM dom WHERE k >= 'o0000000100' AND k < 'o0000000200'",
    "domain_prefix": f"WITH {ORDERS} SELECT {PAIR} FROM dom WHERE k LIKE 'o00000001%'",
    "domain_nth": f"WITH {ORDERS}, {_NUMBERED} SELECT {PAIR}, ordinal FROM numbered WHERE ordinal IN (0, 5, 777)",
    "domain_ordinals": f"WITH {ORDERS}, {_NUMBERED} SELECT lower(hex(k)) AS key_hex, ordinal, {_OFFSET} FROM numbered",
    "domain_nodes": f"WITH {ORDERS}, {_NUMBERED}, o AS (SELECT k, ordinal, {_OFFSET} FROM numbered) SELECT lower(hex(k)) AS key_hex, ordinal, logical_offset FROM o WHERE ordinal % 256 = 0",
    "domain_batch_get": f"WITH {ORDERS}, p AS (SELECT DISTINCT 'o' || lpad(CAST(l_orderkey * 3 AS VARCHAR), 10, '0') AS k FROM lineitem) SELECT {PAIR} FROM p LEFT JOIN dom USING (k)",
    "stack_get": f"WITH {BUYERS} SELECT {PAIR} FROM ({_newest('buyers')}) WHERE k IN ('c00000000', 'c00000001', 'c00000002', 'c00000042', 'c00000077', 'nothing')",
    "stack_written": f"WITH {BUYERS} SELECT {PAIR} FROM ({_newest('buyers')})",
    "stack_shape": f"WITH {BUYERS} SELECT count(DISTINCT s) AS runs, false AS empty, count(DISTINCT s) AS filters_in_use, CAST(9 AS BIGINT) AS salt FROM buyers",
    "stack_find": f"WITH {BUYERS}, r AS (SELECT count(DISTINCT s) AS runs FROM buyers) SELECT 'find' AS policy, CAST(9 AS BIGINT) AS salt, runs AS filters_in_use FROM r UNION ALL SELECT 'none', NULL, 0",
    "stack_readers": f"WITH {BUYERS}, f AS (SELECT DISTINCT CAST(s AS BIGINT) AS s FROM buyers) SELECT 'v1.1-buyers.' || s || '-' || (s + 1) || '.kv' AS name, row_number() OVER (ORDER BY s) - 1 AS rank, s AS step_from, s + 1 AS step_to, true AS filter_in_use, CAST(9 AS BIGINT) AS salt FROM f",
    "rejected_writes": "SELECT * FROM (VALUES ('repeated', 'DomainError'), ('null', 'DomainError'), ('no runs', 'StackError')) AS t(\"case\", result)",
    "foreign_scan": f"WITH {ORDERS} SELECT {PAIR} FROM dom",
    "foreign_metadata": f"WITH {ORDERS} SELECT {PAIR} FROM dom",
    "foreign_words": f"WITH {ORDERS}, {_NUMBERED} SELECT 2 * ordinal AS pos, lower(hex(k)) AS word_hex FROM numbered UNION ALL SELECT 2 * ordinal + 1, lower(hex(v)) FROM numbered",
    "foreign_cursor": f"WITH {ORDERS}, {_NUMBERED} SELECT 2 * ordinal AS pos, strlen(k) AS length, true AS same FROM numbered UNION ALL SELECT 2 * ordinal + 1, strlen(v), true FROM numbered",
    "foreign_get_indexed": f"WITH {ORDERS}, p AS (SELECT 'o' || lpad(CAST(o_orderkey * 2 AS VARCHAR), 10, '0') AS k FROM orders) SELECT {PAIR}, true AS filtered FROM p LEFT JOIN dom USING (k)",
    "foreign_get_scanned": f"WITH {ORDERS}, p AS (SELECT 'o' || lpad(CAST(o_orderkey * 2 AS VARCHAR), 10, '0') AS k FROM orders WHERE o_orderkey % 500 = 0) SELECT {PAIR}, true AS filtered FROM p LEFT JOIN dom USING (k)",
    "foreign_headers": """SELECT name, CAST(0 AS BIGINT) AS step_from, CAST(b AS BIGINT) AS step_to, CAST(v AS INTEGER) AS version, CAST(p AS INTEGER) AS page_values_count, 2 * n AS words_count, CAST(0 AS BIGINT) AS empty_words_count,
  n AS key_count, CAST(f AS BIGINT) AS fanout, kind AS filter_kind, true AS sorted
FROM (VALUES ('v1.1-orders.0-16.kv', 16, 0, 0, 256, 'bloom'), ('paged.0-1.kv', 1, 1, 16, NULL, NULL), ('plain.0-1.kv', 1, 1, 0, 64, NULL)) AS t(name, b, v, p, f, kind), (SELECT count(*) AS n FROM orders)""",
    "foreign_filter": _contains(),
    "foreign_stack": f"WITH {BUYERS}, p AS (SELECT DISTINCT 'c' || lpad(CAST(c_custkey * 2 AS VARCHAR), 8, '0') AS k FROM customer) SELECT {PAIR} FROM p LEFT JOIN ({_newest('buyers')}) USING (k)",
    "foreign_merge": f"WITH {USERS} SELECT {PAIR} FROM ({_newest('users')}) WHERE v <> ''",
    "word_files": f"WITH {_GRAM_WORDS} SELECT lower(w) AS word_hex, count(*) AS copies, (SELECT count(*) FROM words) AS written, CAST(0 AS BIGINT) AS left_over FROM words GROUP BY w",
    "smallest_by_bytes": f"WITH {BUYERS}, {_BY_RUN} SELECT 'v1.1-buyers.' || s || '-' || (s + 1) || '.kv' AS name, CAST(sum(strlen(k) + strlen(v)) AS BIGINT) AS bytes FROM per_run GROUP BY s ORDER BY bytes, name LIMIT 1",
    "uvarints_read": "SELECT o_orderkey, o_orderkey * 1000003 AS number, o_orderkey * 1000003 AS again, CAST(0 AS BIGINT) AS cut FROM orders",
    "elias_fano_get": f"WITH {ORDERS}, {_NUMBERED}, o AS (SELECT ordinal, {_OFFSET} FROM numbered) SELECT * FROM o WHERE ordinal % 7 = 3",
    "select_bits": "SELECT o_orderkey, CAST(coalesce(list_filter(range(64), lambda i: (o_orderkey >> CAST(i AS INTEGER)) & 1 = 1)[3], 64) AS INTEGER) AS place FROM orders",
    "lockstep_positions": f"""WITH {_GRAM_WORDS}, c AS (SELECT pos, CASE WHEN pos % 1000 = 7 THEN hex('other') ELSE w END AS w FROM words WHERE pos <= (SELECT max(pos) FROM words) - 3)
SELECT pos, lower(words.w) AS left_word_hex, lower(c.w) AS right_word_hex FROM words FULL JOIN c USING (pos) WHERE words.w IS DISTINCT FROM c.w""",
    "stream_upserts": f"WITH {_STATE} SELECT domain_name, lower(hex(key)) AS key_hex, change_id FROM won",
    "merge_written": f"WITH {USERS} SELECT {PAIR} FROM ({_newest('users')}) WHERE v <> ''",
    "stack_filtered_get_many": f"WITH {BUYERS}, p AS (SELECT DISTINCT 'c' || lpad(CAST(c_custkey * 2 AS VARCHAR), 8, '0') AS k FROM customer) SELECT {PAIR} FROM p LEFT JOIN ({_newest('buyers')}) USING (k)",
    "uvarints": "SELECT o_orderkey, lower(CASE WHEN o_orderkey < 128 THEN printf('%02x', o_orderkey) WHEN o_orderkey < 16384 THEN printf('%02x%02x', o_orderkey % 128 + 128, o_orderkey // 128) ELSE printf('%02x%02x%02x', o_orderkey % 128 + 128, o_orderkey // 128 % 128 + 128, o_orderkey // 16384) END) AS code FROM orders",
    "elias_fano_offsets": f"WITH {ORDERS}, {_NUMBERED} SELECT ordinal, {_OFFSET} FROM numbered",
    "foreign_inspect": "SELECT 2 * count(*) AS words_count, CAST(0 AS BIGINT) AS empty_words_count, count(*) AS key_count, true AS sorted, CAST(0 AS BIGINT) AS errors FROM orders",
    "p1_found": f"""WITH {_STEP}, r AS (SELECT domain_name, coalesce(range_from, CAST(split_part(seg, '-', 1) AS BIGINT)) AS a, CAST(split_part(seg, '-', 2) AS BIGINT) AS b FROM steps WHERE seg IS NOT NULL),
m AS (SELECT *, max(b) OVER (PARTITION BY domain_name ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r WHERE a < b),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY domain_name ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT 'period' AS kind, domain_name, min(a) AS step_from, max(b) AS step_to FROM i GROUP BY domain_name, island
UNION ALL SELECT 'gap', domain_name, reach, a FROM m WHERE a > reach""",
    "p2_found": f"WITH {_STATE} SELECT domain_name, lower(hex(key)) AS key_hex, change_id FROM state",
    "p2_state": f"WITH {_STATE} SELECT domain_name, lower(hex(key)) AS key_hex, CASE WHEN deleted THEN '' ELSE lower(hex(value)) END AS value_hex, deleted FROM state",
    "p3_found": f"WITH RECURSIVE {_PATHS}, {_ONCE} SELECT DISTINCT row_id FROM once",
    "p3_files": f"WITH RECURSIVE {_PATHS}, {_ONCE} SELECT count(*) AS rows, true AS whole FROM once",
    "p3_index": f"""WITH RECURSIVE {_PATHS} SELECT 'held' AS kind, true AS maybe, count(DISTINCT key) AS keys FROM flush_records JOIN paths USING (kv) JOIN small USING (path)""",
    "p3_listing": f"""WITH RECURSIVE {_PATHS},
f AS (SELECT domain_name, path, count(bt) AS bt, count(kvei) AS kvei, max(key_count) AS kc FROM flush_files JOIN paths USING (kv) WHERE kv_bytes < 16384 AND path LIKE '%.kv' GROUP BY 1, 2),
r AS (SELECT path, count(*) AS n FROM flush_records JOIN paths USING (kv) GROUP BY 1)
SELECT domain_name, count(*) AS small_files, count(*) FILTER (bt = 0) AS without_bt, count(*) FILTER (kvei = 0) AS without_kvei, CAST(coalesce(sum(n), 0) AS BIGINT) AS records, CAST(coalesce(sum(kc), 0) AS BIGINT) AS listed_keys FROM f LEFT JOIN r USING (path) GROUP BY 1""",
    "p5_found": """WITH l AS (SELECT DISTINCT name, key, value, 1 AS here FROM pairs_left), r AS (SELECT DISTINCT name, key, value, 1 AS here FROM pairs_right),
j AS (SELECT coalesce(l.name, r.name) AS name, coalesce(l.key, r.key) AS key, l.here AS a, r.here AS b, l.value AS x, r.value AS y FROM l FULL JOIN r ON l.name = r.name AND l.key = r.key),
h AS (SELECT DISTINCT side, name, words_count AS w, empty_words_count AS e, 1 AS here FROM seg_counts),
k AS (SELECT coalesce(p.name, q.name) AS name, p.here AS a, q.here AS b, p.w AS pw, q.w AS qw, p.e AS pe, q.e AS qe FROM (SELECT * FROM h WHERE side = 'left') p FULL JOIN (SELECT * FROM h WHERE side = 'right') q ON p.name = q.name)
SELECT name, lower(hex(key)) AS key_hex, CASE WHEN a IS NULL OR b IS NULL THEN 'key' ELSE 'value' END AS field_name, CASE WHEN b IS NULL THEN 'only_left' WHEN a IS NULL THEN 'only_right' ELSE 'differs' END AS diff_kind FROM j WHERE a IS NULL OR b IS NULL OR x IS DISTINCT FROM y
UNION ALL SELECT name, '', 'name', CASE WHEN b IS NULL THEN 'only_left' ELSE 'only_right' END FROM k WHERE a IS NULL OR b IS NULL
UNION ALL SELECT name, '', 'words_count', 'differs' FROM k WHERE a = 1 AND b = 1 AND pw IS DISTINCT FROM qw
UNION ALL SELECT name, '', 'empty_words_count', 'differs' FROM k WHERE a = 1 AND b = 1 AND pe IS DISTINCT FROM qe""",
}
ORACLE["stream_intervals"] = ORACLE["p1_found"]
