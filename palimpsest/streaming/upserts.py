"""Streams of changes and of published files into standing tables."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from palimpsest.operators.changes import VersionedTable
from palimpsest.operators.intervals import IntervalMap


def stream_into(changes: DataFrame, table: VersionedTable, checkpoint: str, **options: str) -> StreamingQuery:
    """Applies each micro-batch of a change stream to ``table`` as one version.

    A version keeps the number of the batch it took, under the checkpoint's name, so a
    batch that a restarted stream hands over again is not applied twice.
    """

    def apply(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            table.apply(batch, checkpoint, number)

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).options(**options).trigger(availableNow=True).start()


def stream_periods(intervals: DataFrame, entity: str, lo: str, hi: str) -> DataFrame:
    """For each entity that a micro-batch changes, its periods and gaps so far, as lists.

    ``entity, period_from, period_to, gap_from, gap_to`` (arrays); use update mode.  The
    state of an entity is its disjoint-interval map, so it grows with its gaps, not with
    its files.
    """

    def update(key: tuple[Any], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        starts, ends = state.get if state.exists else ([], [])
        held = IntervalMap(list(starts), list(ends))
        for frame in frames:
            for a, b in zip(frame[lo], frame[hi]):
                if pd.notna(a) and pd.notna(b):
                    held.insert(int(a), int(b))
        state.update((held.starts, held.ends))
        gaps = held.gaps()
        yield pd.DataFrame({entity: [key[0]], "period_from": [held.starts], "period_to": [held.ends], "gap_from": [[g[0] for g in gaps]], "gap_to": [[g[1] for g in gaps]]})

    out = f"{entity} string, period_from array<long>, period_to array<long>, gap_from array<long>, gap_to array<long>"
    return intervals.select(entity, lo, hi).groupBy(entity).applyInPandasWithState(update, out, "starts array<long>, ends array<long>", "update", GroupStateTimeout.NoTimeout)
