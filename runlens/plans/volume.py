"""Five-minute volume series, its cache, drill-down and resampling."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions.timegrid import bucket_index, duration_seconds, floor_to_step, spine, ts
from runlens.operators.scope import EVERYTHING, Scope
from runlens.operators.filters import before
from runlens.operators.upsert import changed_rows, insert_missing
from runlens.params import VOLUME_BUCKETS, VOLUME_STEP, BadRequest, clamp_int, parse_iso_date, parse_range
from runlens.plans.listing import named

STEP_SECONDS = int(VOLUME_STEP.total_seconds())


def rolling_origin(as_of: dt.datetime) -> dt.datetime:
    """First bucket of the 24 hours that end with the current one."""
    return floor_to_step(as_of, VOLUME_STEP) - (VOLUME_BUCKETS - 1) * VOLUME_STEP


def volume_series(executions: DataFrame, origin: dt.datetime, scope: Scope = EVERYTHING,
                  buckets: int = VOLUME_BUCKETS) -> DataFrame:
    """Executions started per five-minute bucket, empty buckets included."""
    rows = executions.filter(before("started_at", origin, origin + buckets * VOLUME_STEP))
    counts = scope.narrow(rows, "workflow_id").groupBy(
        bucket_index(F.col("started_at"), origin, STEP_SECONDS).alias("bucket_idx")
    ).agg(F.count("*").alias("started_count"))
    grid = spine(executions.sparkSession, origin, STEP_SECONDS, buckets, "timestamp")
    return grid.join(counts, "bucket_idx", "left").select(
        "timestamp", F.coalesce("started_count", F.lit(0)).alias("started_count"))


def execution_volume(executions: DataFrame, cache: DataFrame | None, as_of: dt.datetime,
                     start: object = None, end: object = None, scope: Scope = EVERYTHING) -> DataFrame:
    """The volume report. Without a range: the cached rolling day, recounted for a
    restricted user because the cache is instance-wide. With one: 288 buckets
    from its start (the end is validated, not used as a bound)."""
    if start and end:
        return volume_series(executions, parse_range(start, end)[0], scope)
    if scope.restricted or cache is None:
        return volume_series(executions, rolling_origin(as_of), scope)
    return cache.select("timestamp", "started_count").orderBy("timestamp")


def refreshed_cache(executions: DataFrame, cache: DataFrame, as_of: dt.datetime) -> DataFrame:
    """The cache after one cycle: recomputed buckets over the ones still in range."""
    origin = rolling_origin(as_of)
    live = cache.filter(F.col("timestamp") >= ts(origin))
    return insert_missing(volume_series(executions, origin), live, "timestamp")


def merged_cache(cache: DataFrame, before: DataFrame, after: DataFrame, as_of: dt.datetime) -> DataFrame:
    """The cache after one cycle from what changed alone: rows count in the bucket of their start, and no longer
    in the one they had ``before``. Buckets that came into range are empty until something counts in them."""
    origin = rolling_origin(as_of)
    window = _in_window(origin)
    signed = before.filter(window).select("started_at", F.lit(-1).alias("n")).union(after.filter(window).select("started_at", F.lit(1).alias("n")))
    moved = signed.groupBy(bucket_index(F.col("started_at"), origin, STEP_SECONDS).alias("bucket_idx")).agg(F.sum("n").alias("moved"))
    grid = spine(cache.sparkSession, origin, STEP_SECONDS, VOLUME_BUCKETS, "timestamp")
    return (grid.join(moved, "bucket_idx", "left").join(cache.select("timestamp", F.col("started_count").alias("known")), "timestamp", "left")
            .select("timestamp", (F.coalesce("known", F.lit(0)) + F.coalesce("moved", F.lit(0))).alias("started_count")))


def _in_window(origin: dt.datetime) -> Column:
    return before("started_at", origin, origin + VOLUME_BUCKETS * VOLUME_STEP)


def changed_buckets(executions: DataFrame, cache: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Buckets whose cached count is absent or out of date."""
    return changed_rows(cache, volume_series(executions, rolling_origin(as_of)),
                        "timestamp", ["started_count"])


def volume_details(executions: DataFrame, workflows: DataFrame, time: object, as_of: dt.datetime,
                   window_minutes: object = None, scope: Scope = EVERYTHING, n: int | None = None) -> DataFrame:
    """The executions, or the newest ``n``, that started in a window; open ones run until now."""
    start = parse_iso_date(time)
    if start is None:
        raise BadRequest("time must be a valid ISO date")
    span = dt.timedelta(minutes=clamp_int(window_minutes, 1, None, 5))
    rows = scope.narrow(executions.filter(before("started_at", start, start + span)), "workflow_id")
    stop = F.coalesce(F.col("stopped_at"), ts(as_of))
    shown = (named(rows, workflows, "workflow_name").select(
        "workflow_name", "workflow_id", F.col("id").alias("exec_id"), "status", "started_at",
        "stopped_at", duration_seconds(F.col("started_at"), stop).alias("current_duration"))
        .orderBy(F.desc("started_at"), F.desc("exec_id")))
    return shown if n is None else shown.limit(n)


def resample(series: DataFrame, origin: dt.datetime, minutes: int, as_of: dt.datetime) -> DataFrame:
    """Sums over blocks of ``minutes``, counted from the first point; a block
    appears once it is over. The series is dense, so positions are arithmetic."""
    seconds = minutes * 60
    block = bucket_index(F.col("timestamp"), origin, seconds)
    start = F.timestamp_micros(F.unix_micros(ts(origin)) + block * F.lit(seconds * 1_000_000))
    return (series.groupBy(start.alias("timestamp"))
            .agg(F.sum("started_count").alias("started_count"))
            .filter(F.col("timestamp") <= ts(as_of - dt.timedelta(minutes=minutes))))
