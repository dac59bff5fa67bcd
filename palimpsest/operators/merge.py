"""Compaction: many runs into one, newest wins, deletions dropped where nothing older can be below."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.steps import step_range
from palimpsest.operators.domain import DEFAULT_FANOUT, DomainError, DomainPaths, write_domain
from palimpsest.operators.stack import Run, newest_of, with_rank


@dataclass
class MergeOptions:
    """range_from: the start of the result's range; else that in its name, else unknown.  The others are ``write_domain``'s."""

    drop_deleted: bool = True
    range_from: int | None = None
    salt: int | None = None
    fanout: int = DEFAULT_FANOUT
    compress: bool = False


def drops_deleted(out_name: str, options: MergeOptions) -> bool:
    start = options.range_from
    if start is None and (steps := step_range(out_name)):
        start = steps[0]
    return options.drop_deleted and start == 0


def merge_runs(runs: Sequence[Run], out_name: str, options: MergeOptions | None = None, checked: bool = False) -> DataFrame:
    """``key, value`` of the merged run.

    The winner is chosen first and dropped afterwards, so a deletion never lets an older
    value through.  ``checked``: check that no run has a key twice (DomainError), as a write would.
    """
    options = options or MergeOptions()
    if checked and not all(r.base for r in runs):
        # A run written as a domain was checked then.
        rows = with_rank(runs, "merge")
        if bad := rows.groupBy("rank", "key").count().where("count > 1").limit(1).collect():
            raise DomainError(f"keys must be strictly increasing: {bad[0].key!r} twice in a run")
    won = newest_of(runs, "merge")
    return won.where(F.octet_length("value") > 0) if drops_deleted(out_name, options) else won


def merge(runs: Sequence[Run], out_base: str, options: MergeOptions | None = None) -> DomainPaths:
    """The merged run written as a domain under ``out_base``."""
    options = options or MergeOptions()
    merged = merge_runs(runs, out_base.rpartition("/")[2] + ".kv", options, checked=True)
    return write_domain(merged, out_base, options.salt, options.fanout, options.compress)
