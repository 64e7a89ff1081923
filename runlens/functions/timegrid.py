"""Durations, buckets and dense grids in whole microseconds."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MICROS = 1_000_000


def epoch_micros(moment: dt.datetime) -> int:
    moment = moment if moment.tzinfo else moment.replace(tzinfo=dt.timezone.utc)
    delta = moment - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)
    return (delta.days * 86_400 + delta.seconds) * MICROS + delta.microseconds


def ts(moment: dt.datetime) -> Column:
    """A timestamp literal that does not depend on the driver's clock zone."""
    return F.timestamp_micros(F.lit(epoch_micros(moment)))


def duration_micros(start: Column, stop: Column) -> Column:
    return F.unix_micros(stop) - F.unix_micros(start)


def duration_seconds(start: Column, stop: Column) -> Column:
    return duration_micros(start, stop) / F.lit(1e6)


def average_seconds(start: Column, stop: Column) -> Column:
    """Mean duration. Whole microseconds are averaged as doubles: exact up to 2^53,
    so the result does not depend on the order of the partial sums, and no
    overflow beyond that."""
    return F.avg(duration_micros(start, stop).cast("double")) / F.lit(1e6)


def bucket_index(moment: Column, origin: dt.datetime, step_seconds: int) -> Column:
    """Index of the bucket holding ``moment``; integer arithmetic, so an instant
    exactly on a boundary opens the new bucket."""
    size = F.lit(step_seconds * MICROS)
    offset = F.unix_micros(moment) - F.lit(epoch_micros(origin))
    return ((offset - F.pmod(offset, size)) / size).cast("bigint")


def floor_to_step(moment: dt.datetime, step: dt.timedelta) -> dt.datetime:
    micros = epoch_micros(moment)
    size = int(step.total_seconds()) * MICROS
    return dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(
        microseconds=micros - micros % size)


def floor_column(moment: Column, step_seconds: int) -> Column:
    """Timestamp floored to a multiple of ``step_seconds`` since the epoch."""
    micros = F.unix_micros(moment)
    return F.timestamp_micros(micros - F.pmod(micros, F.lit(step_seconds * MICROS)))


def spine(spark: SparkSession, origin: dt.datetime, step_seconds: int, buckets: int,
          name: str = "time_val") -> DataFrame:
    """The dense grid: one row per bucket. Callers pass a bounded bucket count."""
    index = F.col("id")
    start = F.timestamp_micros(F.lit(epoch_micros(origin)) + index * F.lit(step_seconds * MICROS))
    return spark.range(0, buckets, 1, 1).select(index.alias("bucket_idx"), start.alias(name))


def round_half_up(value: Column, digits: int = 0) -> Column:
    """Rounding with ties toward plus infinity, as the dashboards show it."""
    scale = float(10 ** digits)
    rounded = F.floor(value * F.lit(scale) + F.lit(0.5))
    return rounded if digits == 0 else rounded / F.lit(scale)


def change_pct(current: Column, previous: Column) -> Column:
    """Period-over-period change: 100 from nothing to something, 0 when both are empty."""
    grew = (current - previous).cast("double") / previous.cast("double") * F.lit(100.0)
    return (F.when(previous > 0, grew)
            .when(current > 0, F.lit(100.0))
            .otherwise(F.lit(0.0)))
