"""Sources mixed to target shares of token size, with capped repeats.

Weights lie on the path between the sources' own token shares and the target shares,
``own^(1-a) * target^a``, normalised: a = 0 is the corpus as it is, a = 1 the target.
For a size, the exponent is bisected to the largest at which no source must repeat its
documents more often than it may.  Without a given size, that is bisected too: the
largest at which the exponent is still 1, so that the targets themselves are met.
Weights become token budgets; a budget is realised as whole passes over the source and a
part of a random permutation, block by block, filled up in the block where it ends.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.tokens import TOKENIZER, TOKENIZER_DIR, count_tokens
from palimpsest.session import materialize

#: Documents of a permutation block to aim at; a block is the unit that a running sum is taken over.
BLOCK_DOCS = 2000
#: Steps of the bisection: the exponent is exact to 2^-60.
STEPS = 60


def tempered(shares: list[float], exponent: float) -> list[float]:
    """Shares raised to ``exponent`` and normalised; zero shares stay zero."""
    logs = [exponent * math.log(s) if s > 0 else -math.inf for s in shares]
    top = max(logs)
    raised = [math.exp(x - top) for x in logs]
    return [x / sum(raised) for x in raised]


def entropy(shares: list[float]) -> float:
    return -sum(s * math.log(s) for s in shares if s > 0)


def exponent_for_entropy(shares: list[float], target: float) -> float:
    """The exponent in [0, 1] at which the tempered shares have ``target`` nats, the nearer end if none has."""
    lo, hi = 0.0, 1.0  # entropy falls from log(n) as the exponent grows
    if target <= entropy(tempered(shares, 1.0)):
        return 1.0
    for _ in range(STEPS):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if entropy(tempered(shares, mid)) > target else (lo, mid)
    return hi


def _path(own: list[float], target: list[float], a: float) -> list[float]:
    logs = [(1 - a) * math.log(o) + a * math.log(t) for o, t in zip(own, target)]
    top = max(logs)
    raised = [math.exp(x - top) for x in logs]
    return [x / sum(raised) for x in raised]


def exponent_for_repeats(own: list[float], target: list[float], can: list[float], size: float) -> float:
    """The largest exponent in [0, 1] at which ``size`` tokens take from no source more than it ``can`` give; 0 if none."""
    fits = lambda a: all(w * size <= c * (1 + 1e-12) for w, c in zip(_path(own, target, a), can))
    lo, hi = 0.0, 1.0
    for _ in range(STEPS):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if fits(mid) else (lo, mid)
    return 1.0 if fits(1.0) else lo


def largest_size(own: list[float], target: list[float], can: list[float]) -> float:
    """The largest size, in tokens, at which the exponent is 1."""
    lo, hi = 0.0, 2 * sum(can)
    for _ in range(STEPS + 20):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if exponent_for_repeats(own, target, can, mid) >= 1.0 else (lo, mid)
    return lo


def plan_budgets(
    tokens: dict[str, int], targets: dict[str, tuple[float, int]], total: int | None = None, documents: dict[str, int] | None = None, nats: float | None = None
) -> dict[str, float]:
    """Tokens each source should give.  ``targets``: share and most repeats of a source.

    With ``total`` the exponent moves from the targets towards the corpus until the
    repeats suffice; where they do not even at its end, each source gives what it may.
    Without it the mixture is as large as the exponent stays 1: every source that has
    tokens gets its target share among those that do.  With ``nats`` the targets are not
    used but for their names and repeats: the sources' own shares are tempered to that
    entropy, and to ``total`` or as large as they can be.

    Given the number of ``documents`` of each source, the size is instead that of the
    sources at whose end the shares are least off, by the repeats and by what whole
    documents miss of the budgets (a quarter of one on average).  It is another than the
    first only where the first is too small for whole documents.
    """
    names = [s for s, (share, most) in sorted(targets.items()) if share and share > 0 and most and most > 0 and tokens.get(s, 0) > 0]
    if not names:
        return {}
    can = [float(tokens[s] * targets[s][1]) for s in names]
    have = sum(tokens[s] for s in names)
    own = [tokens[s] / have for s in names]
    weight = sum(targets[s][0] for s in names)
    want = [targets[s][0] / weight for s in names]
    if nats is not None:
        want = tempered(own, exponent_for_entropy(own, nats))

    def at(size: float) -> dict[str, float]:
        a = exponent_for_repeats(own, want, can, size)
        return {s: min(c, w * size) for s, c, w in zip(names, can, _path(own, want, a))}

    if total is not None:
        return at(total)
    first = largest_size(own, want, can)
    if documents is None:
        return at(first)
    missed = sum(tokens[s] / documents[s] for s in names) / 4

    def off(budgets: dict[str, float]) -> float:
        size = sum(budgets.values())
        return sum(abs(budgets[s] / size - w) for s, w in zip(names, want)) + missed / size

    return min(map(at, [first, *sorted(c / w for c, w in zip(can, want))[1:]]), key=off)


def _fill(docs: pa.Table) -> pa.Table:
    """Of one block's documents, in turn, those that fit what is left of the budget; last, one more or one less where that ends nearer.

    A document that is too long is passed over for later ones.
    """
    order = np.lexsort((docs.column("doc_id").to_numpy(), docs.column("turn").to_numpy()))
    sizes = docs.column("n_tokens").to_numpy()[order]
    left = docs.column("rest")[0].as_py() - docs.column("before")[0].as_py()
    taken = np.zeros(len(sizes), bool)
    for i, n in enumerate(sizes.tolist()):
        if n <= left:
            taken[i], left = True, left - n
    if left and not taken.all():
        over = np.flatnonzero(~taken)
        i = over[np.argmin(np.abs(sizes[over] - left))]
        taken[i] = abs(int(sizes[i]) - left) < left
    extra = np.zeros(len(sizes), bool)
    extra[order] = taken
    return docs.append_column("extra", pa.array(extra))


def mix(
    documents: DataFrame, targets: DataFrame, total: int | str | None = None, seed: int = 17, folder: str = TOKENIZER_DIR, name: str = TOKENIZER, nats: float | None = None
) -> tuple[DataFrame, DataFrame]:
    """The selection (``source, doc_id, n_tokens, copies``) and the report of shares reached.

    Sources are matched by exact name; a null source, or one without a target, gives
    nothing, and a target without documents is reported with nothing reached.  Documents
    of no tokens (null and empty texts) are never chosen.  No document is given more
    often than its source's max_repeats (null, zero or less: never).  Empty tables give no rows.

    ``total``: tokens of the mixture, ``"corpus"`` for all that the named sources have, or
    none for as many as meet the targets; ``nats``: an entropy to temper the sources to instead.

    The targets are as many as there are sources in a mixture, a list made by hand; it
    is read on the driver, and so are the token totals of those sources and no others.
    Block sums, not documents, are put in order, and a running sum is only taken inside
    the one block of a source in which its budget ends, which is filled document by document.
    """
    spark = documents.sparkSession
    wanted = {r.source: (r.target_share or 0.0, r.max_repeats or 0) for r in targets.where("source is not null").select("source", "target_share", "max_repeats").collect()}
    named = F.broadcast(targets.select("source").where("source is not null").distinct())
    counted = count_tokens(documents.select("doc_id", "source", "text").join(named, "source", "left_semi"), "text", "n_tokens", folder, name).where("n_tokens > 0")
    ordered = counted.withColumn("turn", F.xxhash64(F.lit(seed), "doc_id"))
    ordered = materialize(ordered, "mixture")
    sums = {r.source: (r.n, r.t) for r in ordered.groupBy("source").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t")).collect()}
    have = {s: t for s, (_, t) in sums.items()}
    budgets = plan_budgets(have, wanted, sum(have.values()) if total == "corpus" else total, {s: n for s, (n, _) in sums.items()}, nats)

    plan = []
    for s, b in budgets.items():
        n, t = sums[s]
        whole = min(wanted[s][1], int(b // t))
        rest = 0 if whole == wanted[s][1] else round(b - whole * t)
        plan.append((s, whole, rest, max(1, n // BLOCK_DOCS)))
    plan_df = F.broadcast(spark.createDataFrame(plan, "source string, whole long, rest long, n_blocks long"))
    # The permutation: by hash, cut into blocks of equal hash ranges.
    docs = ordered.join(plan_df, "source").withColumn("block", F.expr("cast(floor((turn / 18446744073709551616D + 0.5D) * n_blocks) as long)"))
    before = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = docs.groupBy("source", "rest", "block").agg(F.sum("n_tokens").alias("in_block"))
    blocks = blocks.withColumn("before", F.coalesce(F.sum("in_block").over(before), F.lit(0)))
    # A block's sum is a row for BLOCK_DOCS documents; only the block where a budget ends is looked into.
    full = blocks.select("source", "block", "before", (F.col("before") + F.col("in_block") <= F.col("rest")).alias("all_in"), ((F.col("before") < F.col("rest")) & (F.col("before") + F.col("in_block") > F.col("rest"))).alias("ends_in"))
    placed = docs.join(full, ["source", "block"])
    ending = placed.where("ends_in").select("source", "doc_id", "n_tokens", "turn", "whole", "rest", "block", "before")
    # A block of one source each: some BLOCK_DOCS documents, of which only numbers are here.
    inside = ending.groupBy("source").applyInArrow(_fill, T.StructType([*ending.schema.fields, T.StructField("extra", T.BooleanType())]))
    kept = ("source", "doc_id", "n_tokens", "whole", "extra")
    placed = placed.where("not ends_in").withColumn("extra", F.col("all_in")).select(*kept).unionByName(inside.select(*kept))
    chosen = placed.select("source", "doc_id", "n_tokens", (F.col("whole") + F.col("extra").cast("long")).alias("copies")).where("copies > 0")

    reached = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies"), F.count("*").alias("documents"))
    report = targets.select("source", "target_share", "max_repeats").join(F.broadcast(reached), "source", "left")
    given = F.coalesce("tokens", F.lit(0)).cast("long")
    report = report.select(
        "source",
        "target_share",
        "max_repeats",
        given.alias("tokens"),
        F.coalesce("documents", F.lit(0)).cast("long").alias("documents"),
        F.coalesce("most_copies", F.lit(0)).cast("long").alias("most_copies"),
        F.coalesce(F.try_divide(given, F.sum(given).over(Window.partitionBy())), F.lit(0.0)).alias("share"),
    )
    return chosen, report


def in_order(chosen: DataFrame, seed: int = 17) -> DataFrame:
    """A row a copy of each chosen document: ``source, doc_id, pass, block, turn``, to be read in the order of the last three.

    In each pass over the sources the documents lie in blocks, and the blocks and what is
    in them are permuted anew; a document comes once a pass.  Passes are as many as the
    most repeats.  No shuffle: a reader sorts, or reads block by block.
    """
    copies = chosen.select("source", "doc_id", F.explode(F.sequence(F.lit(0), (F.col("copies") - 1).cast("int"))).alias("pass"))
    # Blocks by hash, as many at any size.
    block = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(4096))
    return copies.select("source", "doc_id", "pass", F.xxhash64(F.lit(seed), "pass", block).alias("block"), F.xxhash64(F.lit(seed + 1), "pass", "doc_id").alias("turn"))


def checked(chosen: DataFrame, report: DataFrame) -> DataFrame:
    """``source, within_repeats, near_target`` of each target: no document too often, and no farther from its share than half a median document.

    The share is that among the sources that have documents; of a source without any nothing is asked.
    """
    sizes = chosen.groupBy("source").agg((F.median("n_tokens") / 2).alias("half"))
    everything = F.sum("tokens").over(Window.partitionBy())
    there = F.sum(F.when(F.col("tokens") > 0, F.col("target_share"))).over(Window.partitionBy())
    told = report.join(F.broadcast(sizes), "source", "left").withColumn("off", F.abs(F.col("tokens") - everything * F.col("target_share") / there))
    near = (F.col("tokens") == 0) | (F.col("off") <= F.col("half"))
    return told.select("source", (F.col("most_copies") <= F.coalesce("max_repeats", F.lit(0))).alias("within_repeats"), near.alias("near_target"))
