"""Streams: pages of statements folded into headers as they come, and events in windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from foliospark.operators.bank import header
from foliospark.ship import ship

_FIELDS = ("bank_name", "account_holder", "account_number", "account_type", "ifsc_code", "micr_code", "period_from", "period_to")


def fold_pages(pages: DataFrame) -> DataFrame:
    """Headers of statements from a stream of pages (stmt_id, page, text): the first value of each field stays.

    State is one row a statement; each batch of pages updates it and emits what is known.
    """
    ship(pages.sparkSession)
    found = header(pages).select("stmt_id", "page", *_FIELDS)
    columns = ", ".join(f"{f} string" for f in _FIELDS)

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = list(state.get) if state.exists else [None] * len(_FIELDS) + [0]
        for batch in batches:
            for row in batch.sort_values("page").itertuples(index=False):
                known[:-1] = [old if old is not None else (new if isinstance(new, str) else None) for old, new in zip(known[:-1], row[2:], strict=True)]
                known[-1] += 1
        state.update(tuple(known))
        yield pd.DataFrame([(key[0], *known)], columns=["stmt_id", *_FIELDS, "pages"])

    return found.groupBy("stmt_id").applyInPandasWithState(fold, f"stmt_id long, {columns}, pages long", f"{columns}, pages long", "update", GroupStateTimeout.NoTimeout)


def per_window(events: DataFrame, length: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Count and sum of each type and window of event time; what comes later than ``late`` is left out."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Runs of a user's events without a gap."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "n", "value")
