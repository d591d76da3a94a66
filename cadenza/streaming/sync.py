"""Structured Streaming over the sync log: an extension, as the archive has no streams of its own."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def deduplicated(log: DataFrame, key: str, at: str, delay: str = "1 hour") -> DataFrame:
    """Each idempotency key once, with state only as long as the watermark allows."""
    return log.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def counted(log: DataFrame, at: str, key: str, size: str = "5 minutes", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Events per window and key; late rows within the delay are counted."""
    w = F.window(at, size, slide) if slide else F.window(at, size)
    return log.withWatermark(at, delay).groupBy(w, key).agg(F.count("*").alias("n"))


def sessions(log: DataFrame, at: str, key: str, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    return log.withWatermark(at, delay).groupBy(F.session_window(at, gap), key).agg(F.count("*").alias("n"))


def replayed(log: DataFrame, entity: str, base_rev: str, order: str) -> DataFrame:
    """Accepted and rejected entries: (entity, order, base, applied, rev), revision kept as state.

    Inside one batch an entity's entries are taken in order; an entry is applied if
    its base is the entity's revision, which then rises by one.
    """

    def fold(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rev = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values(order)
        out = []
        for o, b in zip(rows[order], rows[base_rev]):
            ok = b == rev
            rev += bool(ok)
            out.append((key[0], o, b, bool(ok), rev))
        state.update((int(rev),))
        yield pd.DataFrame(out, columns=["entity", "seq", "base", "applied", "rev"])

    return log.groupBy(entity).applyInPandasWithState(fold, "entity long, seq long, base long, applied boolean, rev long", "rev long", "append", GroupStateTimeout.NoTimeout)
