"""The queries of the training-data problems, and SQL for those it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import mixture, residue, spans, tokens
from palimpsest.session import table


def _key_hex():
    return F.lower(F.hex("key")).alias("key_hex")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_spans(table(spark, sf_dir, "code_values"), "key", "value").select(_key_hex(), "span_from", "span_to").distinct()


def p4_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each value is shared: a row for each key and value that shares anything."""
    found = spans.shared_spans(table(spark, sf_dir, "code_values"), "key", "value")
    sums = found.groupBy("key", "value_hash", "n_bytes").agg(F.sum(F.col("span_to") - F.col("span_from")).alias("shared_bytes"))
    return sums.select(_key_hex(), "n_bytes", "shared_bytes", (F.col("shared_bytes") / F.col("n_bytes")).alias("shared_part"))


def p4_removals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stretches to cut so that each is left whole where it was loaded first."""
    return spans.shared_spans(table(spark, sf_dir, "code_values"), "key", "value", removable=True, rank="loaded_at").select(_key_hex(), "span_from", "span_to").distinct()


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_column(table(spark, sf_dir, "documents"), "doc_id", "text")


def p6_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose ids do not decode to their text (null as empty): none."""
    docs = table(spark, sf_dir, "documents")
    back = tokens.decode_column(p6_ids(spark, sf_dir), "doc_id", "ids")
    want = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("want"))
    return back.select("doc_id", F.xxhash64("text").alias("have")).join(want, "doc_id").where("have <> want").select("doc_id")


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mixture.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[1]


def p7_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each source keeps its repeats and reaches its target."""
    return mixture.checked(*_mix(spark, sf_dir))


def p7_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each copy in the mixture with its pass, block and turn."""
    return mixture.in_order(_mix(spark, sf_dir)[0])


def p7_tempered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of a mixture as large as the named sources, the exponent bisected to the repetition limit."""
    return mixture.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), total="corpus")[1]


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue(table(spark, sf_dir, "documents")).select("doc_id").distinct()


def p8_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by kind of residue."""
    found = residue.residue(table(spark, sf_dir, "documents")).select(F.explode("kinds").alias("kind"))
    return found.groupBy("kind").agg(F.count("*").alias("documents"))


QUERIES = {f.__name__: f for f in (p4_found, p4_shared, p4_removals, p6_ids, p6_round_trip, p7_mix, p7_shares, p7_checks, p7_order, p7_tempered, p8_found, p8_kinds)}
def _runs(windows: str, name: str) -> str:
    """Windows put together to maximal stretches ``a`` to ``b``."""
    return f"""{name}_m AS (SELECT key, h, n, i, CASE WHEN i - lag(i) OVER (PARTITION BY key, h ORDER BY i) <= 64 THEN 0 ELSE 1 END AS new FROM {windows}),
{name}_r AS (SELECT key, h, n, i, sum(new) OVER (PARTITION BY key, h ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM {name}_m),
{name} AS (SELECT key, h, n, min(i) AS a, max(i) + 64 AS b FROM {name}_r GROUP BY key, h, n, run)"""


_WINDOWS = """v AS (SELECT DISTINCT key, value, hex(value) AS h, octet_length(value) AS n FROM code_values WHERE octet_length(value) >= 64),
w AS (SELECT key, h, n, i, md5(substr(h, 2 * i + 1, 128)) AS g FROM v, unnest(range(0, n - 63)) AS t(i)),
x AS (SELECT * FROM w WHERE g IN (SELECT g FROM w GROUP BY g HAVING count(DISTINCT key) > 1))"""
_SPANS = f"{_WINDOWS}, {_runs('x', 's')}"
# A stretch is kept by the key of the least number; what lies in no kept stretch of its own value is cut.
_CUT = f"""{_SPANS},
num AS (SELECT key, row_number() OVER (ORDER BY coalesce(min(loaded_at), TIMESTAMP '9999-01-01'), key) AS no FROM code_values GROUP BY key),
own AS (SELECT x.*, no = min(no) OVER (PARTITION BY g) AS mine FROM x JOIN num ON num.key IS NOT DISTINCT FROM x.key),
mine AS (SELECT DISTINCT key, h, n, i FROM own WHERE mine), {_runs('mine', 'k')},
bytes AS (SELECT key, h, unnest(range(a, b)) AS p FROM s EXCEPT SELECT key, h, unnest(range(a, b)) FROM k),
isle AS (SELECT key, h, p, p - row_number() OVER (PARTITION BY key, h ORDER BY p) AS isle FROM bytes)"""

ORACLE: dict[str, str] = {
    "p4_found": f"WITH {_SPANS} SELECT DISTINCT lower(hex(key)) AS key_hex, a AS span_from, b AS span_to FROM s",
    "p4_shared": f"WITH {_SPANS} SELECT lower(hex(key)) AS key_hex, n AS n_bytes, CAST(sum(b - a) AS BIGINT) AS shared_bytes, sum(b - a) / n AS shared_part FROM s GROUP BY key, h, n",
    "p4_removals": f"WITH {_CUT} SELECT DISTINCT lower(hex(key)) AS key_hex, min(p) AS span_from, max(p) + 1 AS span_to FROM isle GROUP BY key, h, isle",
    "p7_checks": "SELECT source, true AS within_repeats, true AS near_target FROM mix_targets",
    "p6_round_trip": "SELECT CAST(0 AS BIGINT) AS doc_id WHERE false",
}
