"""Audits over an access log: severity and fixed-window hit limits."""

from __future__ import annotations

import datetime as dt
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from runlens.session import shared_dir

# --- fixed values: limiter name -> (window, allowed hits) ----------------------
LIMITS = {
    "login-account": (dt.timedelta(minutes=15), 10),
    "login-ip": (dt.timedelta(minutes=15), 30),
    "ai": (dt.timedelta(minutes=1), 5),
    "sync": (dt.timedelta(minutes=1), 2),
    "api": (dt.timedelta(minutes=1), 300),
    "health": (dt.timedelta(minutes=1), 120),
}
SLOW_MS = 2_000
# -------------------------------------------------------------------------------


def severity(status: Column, aborted: Column, millis: Column) -> Column:
    return (F.when((status >= 500) | aborted, "error")
            .when(status >= 400, "warn")
            .when(millis >= SLOW_MS, "warn")
            .otherwise("info"))


def _first_at_or_after(probes: DataFrame, hits: DataFrame, probe: str) -> DataFrame:
    """Per probe the earliest hit of the same key and slot that is not before it.

    Probes and hits share one window per (key, slot). A slot is one window length
    and hits are whole milliseconds, so a frame has a bounded number of rows no
    matter how hot the key is.
    """
    both = probes.select("key", "slot", F.col(probe).alias("at"), "ms", F.lit(None).cast("bigint").alias("hit")) \
        .unionByName(hits.select("key", "slot", F.col("ms").alias("at"),
                                 F.lit(None).cast("bigint").alias("ms"), F.col("ms").alias("hit")))
    later = W.partitionBy("key", "slot").orderBy(F.desc("at")).rangeBetween(
        W.unboundedPreceding, W.currentRow)
    return (both.withColumn("target", F.min("hit").over(later))
            .filter(F.col("ms").isNotNull()).select("key", "ms", "target"))


def window_starts(spark: SparkSession, hits: DataFrame, window: dt.timedelta) -> DataFrame:
    """Hits that open a window: the first hit of a key, and every first hit at or
    after the end of the window before it.

    Which hit opens a window depends on all earlier ones, yet nothing here walks a
    key in one task. Time is cut into slots of one window length, so each slot
    holds at most one start. Every hit gets a pointer to the hit that would open
    the next window (it lies in the next two slots, or the chain ends there), hits
    after a silence of a full window are known starts, and the pointers are
    doubled until all starts are reached: log2 of the longest chain rounds, each
    an equi-join on (key, ms). ``hits``: ``key``, ``ms`` (distinct), ``slot``.
    """
    size = int(window.total_seconds() * 1000)
    shared_dir(spark)
    slots = hits.groupBy("key", "slot").agg(F.min("ms").alias("first"), F.max("ms").alias("last"))
    before = slots.select("key", (F.col("slot") + 1).alias("slot"), F.col("last").alias("prev_last"))
    roots = (slots.join(before, ["key", "slot"], "left")
             .filter(F.col("prev_last").isNull() | (F.col("first") - F.col("prev_last") >= size))
             .select("key", F.col("first").alias("ms")))

    # Next opener: in the following slot at or after the window's end, else the
    # first hit of the slot after that, else a later hit that is a root anyway.
    probes = hits.select("key", "ms", (F.col("slot") + 1).alias("slot"), (F.col("ms") + size).alias("end"))
    near = _first_at_or_after(probes, hits, "end")
    after = slots.select("key", (F.col("slot") - 2).alias("slot"), F.col("first").alias("_far"))
    jumps = (hits.join(near, ["key", "ms"]).join(after, ["key", "slot"], "left")
             .select("key", "ms", F.coalesce("target", "_far").alias("target"))
             .filter(F.col("target").isNotNull())
             # A known start needs no pointer; without these, chains never meet.
             .join(roots.withColumnRenamed("ms", "target"), ["key", "target"], "left_anti")
             .checkpoint())
    reached = roots.checkpoint()
    with ThreadPoolExecutor(2) as jobs:
        while not jumps.isEmpty():
            step = reached.join(jumps, ["key", "ms"]).select("key", F.col("target").alias("ms"))
            hop = jumps.select("key", F.col("ms").alias("target"), F.col("target").alias("_next"))
            doubled = jumps.join(hop, ["key", "target"]).select("key", "ms", F.col("_next").alias("target"))
            # Neither needs the other, so both jobs run at once.
            step, jumps = jobs.map(lambda df: df.checkpoint(), (step, doubled))
            reached = reached.union(step)
    return reached


def fixed_windows(spark: SparkSession, log: DataFrame, key: str, moment: str,
                  window: dt.timedelta, limit: int) -> DataFrame:
    """Fixed windows of each key: start, end, hits, and hits beyond the limit.

    A window opens at the first hit and the next one at the first hit at or after
    its end, on a millisecond clock. Hits of one millisecond are counted first,
    so a burst is one row from then on.
    """
    size = int(window.total_seconds() * 1000)
    counted = (log.select(F.col(key).alias("key"), F.unix_millis(moment).alias("ms"))
               .filter(F.col("key").isNotNull() & F.col("ms").isNotNull())
               .groupBy("key", "ms").agg(F.count("*").alias("n")))
    slot = ((F.col("ms") - F.pmod("ms", F.lit(size))) / F.lit(size)).cast("bigint")
    hits = counted.withColumn("slot", slot).checkpoint()
    starts = window_starts(spark, hits.select("key", "ms", "slot"), window)
    by_slot = starts.select("key", slot.alias("slot"), F.col("ms").alias("start"))
    earlier = by_slot.select("key", (F.col("slot") + 1).alias("slot"), F.col("start").alias("prev_start"))
    # A hit belongs to the start in its own slot if that is not later, otherwise
    # to the one in the slot before.
    owner = F.when(F.col("start") <= F.col("ms"), F.col("start")).otherwise(F.col("prev_start"))
    placed = (hits.join(by_slot, ["key", "slot"], "left").join(earlier, ["key", "slot"], "left")
              .withColumn("window_start", owner))
    return placed.groupBy("key", "window_start").agg(F.sum("n").alias("hits")).select(
        "key",
        F.timestamp_millis("window_start").alias("window_start"),
        F.timestamp_millis(F.col("window_start") + size).alias("expires_at"),
        "hits",
        F.greatest(F.col("hits") - limit, F.lit(0)).alias("blocked"))
