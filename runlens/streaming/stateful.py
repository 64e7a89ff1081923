"""Per-key state machines: fixed hit windows and the missing-row timer.

Both need the RocksDB state store, which :func:`rocksdb_state` selects for the
queries started inside it.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows of state of the missing-row timers.
SHARES = 1024


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Queries started in this block keep their state in RocksDB."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(key, before)


class HitCounter(StatefulProcessor):
    """Fixed window per key: (start, hits). Emits every window a batch touched,
    with its hits so far; the latest row per (key, start) is the current one."""

    def __init__(self, window_ms: int):
        self.window_ms = window_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.window = handle.getValueState("window", "start long, hits long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # One pair of integers per distinct millisecond of this batch.
        moments = pd.concat([frame.groupby("ms")["n"].sum() for frame in rows]).groupby(level=0).sum()
        at, n = moments.index.to_numpy(), moments.to_numpy()
        start, hits = self.window.get() if self.window.exists() else (None, 0)
        out, i = [], 0
        while i < len(at):
            if start is None or at[i] >= start + self.window_ms:
                start, hits = int(at[i]), 0
            end = int(np.searchsorted(at, start + self.window_ms))
            hits += int(n[i:end].sum())
            out.append((key[0], start, hits))
            i = end
        self.window.update((start, hits))
        yield pd.DataFrame(out, columns=["key", "start_ms", "hits"])

    def close(self) -> None:
        pass


def hit_windows(log: DataFrame, key: str, moment: str, window: dt.timedelta) -> DataFrame:
    """Streaming fixed windows; update mode."""
    size = int(window.total_seconds() * 1000)
    rows = log.select(F.col(key).alias("key"), F.unix_millis(moment).alias("ms"), F.lit(1).cast("bigint").alias("n"))
    return rows.groupBy("key").transformWithStateInPandas(
        statefulProcessor=HitCounter(size), outputStructType="key string, start_ms long, hits long",
        outputMode="Update", timeMode="None")


class MissingTimer(StatefulProcessor):
    """Grace periods of the open executions of one share of the ids that the source no longer shows.

    The first missing sighting of an id starts its grace period, a later sighting in time ends it, and when event
    time has passed its end the status is declared unknown. The state is the ids that wait, with the moment since
    when, as two runs of 64-bit integers; one timer stands at the earliest end.
    """

    def __init__(self, grace_ms: int):
        self.grace_ms = grace_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", "ids binary, since binary, nameless long, due long")

    def _load(self) -> tuple[dict[int | None, int], int | None]:
        if not self.waiting.exists():
            return {}, None
        ids, since, nameless, due = self.waiting.get()
        waiting = dict(zip(np.frombuffer(ids, np.int64).tolist(), np.frombuffer(since, np.int64).tolist()))
        if nameless is not None:
            waiting[None] = nameless
        return waiting, due

    def _store(self, waiting: dict[int | None, int], due: int | None) -> None:
        """Keep what waits; ``due`` is the timer that stands."""
        first = min(waiting.values()) + self.grace_ms if waiting else None
        if first != due:
            if due is not None:
                self.handle.deleteTimer(due)
            if first is not None:
                self.handle.registerTimer(first)
        if not waiting:
            self.waiting.clear()
            return
        named = {i: at for i, at in waiting.items() if i is not None}
        self.waiting.update((np.fromiter(named, np.int64, len(named)).tobytes(),
                             np.fromiter(named.values(), np.int64, len(named)).tobytes(), waiting.get(None), first))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # A null id is an execution of its own. Ids come as text, since pandas has no whole numbers beside a null.
        sightings = pd.concat([f[["id", "at_ms", "found"]] for f in rows]).sort_values("at_ms", kind="stable")
        waiting, due = self._load()
        for name, at, found in zip(sightings["id"].tolist(), sightings["at_ms"].tolist(), sightings["found"].tolist()):
            name = int(name) if isinstance(name, str) else None
            since = waiting.get(name)
            if since is None:
                if not found:
                    waiting[name] = at
            elif found and at < since + self.grace_ms:
                # Sighted again in time; one that is overdue is about to be declared.
                del waiting[name]
        self._store(waiting, due)
        yield pd.DataFrame(columns=["id", "missing_since_ms", "status"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        waiting, _ = self._load()
        # As for timers: what ends before the watermark has run out.
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs() + 1)
        over = {name: at for name, at in waiting.items() if at + self.grace_ms < now}
        # The timer that fired is removed by Spark.
        self._store({name: at for name, at in waiting.items() if name not in over}, None)
        yield pd.DataFrame({"id": pd.array(list(over), "Int64"), "missing_since_ms": list(over.values()),
                            "status": ["unknown"] * len(over)})

    def close(self) -> None:
        pass


def missing_timers(sightings: DataFrame, grace: dt.timedelta, lateness: str = "10 minutes",
                   only: Column | None = None, shares: int = SHARES) -> DataFrame:
    """Ids whose grace period ran out. ``sightings``: ``id``, ``at``, ``found``.

    Rows that fail ``only`` move the clock but are not tracked. The state has one row for each of ``shares`` shares of
    the ids, dealt by digest, so that calls of the state store grow with the shares and not with the ids.
    """
    rows = sightings.withWatermark("at", lateness)
    if only is not None:
        # Mentions the clock column, or the filter would be moved before it.
        rows = rows.filter(F.when(F.col("at").isNotNull(), only))
    rows = rows.select(F.pmod(F.xxhash64("id"), F.lit(shares)).alias("share"), F.col("id").cast("string").alias("id"), "at",
                       F.unix_millis("at").alias("at_ms"), "found")
    return rows.groupBy("share").transformWithStateInPandas(
        statefulProcessor=MissingTimer(int(grace.total_seconds() * 1000)),
        outputStructType="id long, missing_since_ms long, status string",
        outputMode="Append", timeMode="EventTime")
