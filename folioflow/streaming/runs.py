"""Streams of pages and messages: counted runs, latest times, windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def counted_runs(items: DataFrame, key: str, runs: int) -> DataFrame:
    """A stream of items less those whose key has been seen ``runs`` times: key, ``run``.

    State is one counter for each key, kept by Spark with the stream.
    """
    kind = items.schema[key].dataType.simpleString()

    def count(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = state.get[0] if state.exists else 0
        n = sum(len(b) for b in batches)
        allowed = max(0, min(n, runs - seen))
        state.update((seen + n,))
        yield pd.DataFrame({key: [group[0]] * allowed, "run": range(seen + 1, seen + allowed + 1)})

    return items.groupBy(key).applyInPandasWithState(count, f"{key} {kind}, run long", "seen long", "append", GroupStateTimeout.NoTimeout)


def latest(items: DataFrame, key: str, time: str = "ts") -> DataFrame:
    """The last time of each key, for incremental crawls; update mode."""
    return items.groupBy(key).agg(F.max(time).alias("latest"))


def fresh(stream: DataFrame, known: DataFrame, key: str, time: str = "ts", crawled: str = "crawled") -> DataFrame:
    """Stream rows that are new or newer than the static table of known keys."""
    k = known.select(key, F.col(crawled).alias("__crawled"))
    return stream.join(k, key, "left").where(F.col("__crawled").isNull() | (F.col(time) > F.col("__crawled"))).drop("__crawled")


def windowed(stream: DataFrame, length: str, slide: str | None = None, late: str = "1 hour", by: str = "event_type", time: str = "ts") -> DataFrame:
    """Counts by tumbling or sliding window and key, with a bound on lateness. An extension."""
    return stream.withWatermark(time, late).groupBy(F.window(time, length, slide or length), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), by, "n")


def sessions(stream: DataFrame, gap: str, late: str = "1 hour", by: str = "user_id", time: str = "ts") -> DataFrame:
    """Counts by session window and key. An extension."""
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap), by).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), by, "n")


def apply_actions(actions: DataFrame, act: Callable[[DataFrame, int], None], checkpoint: str):
    """Start a query that hands each batch of action rows to ``act`` and stops when no more are there."""
    return actions.writeStream.foreachBatch(act).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
