"""Table care: retention, re-derivation, repairs, history and completeness."""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from runlens.functions.errors import change_kind, resolve
from runlens.functions.timegrid import ts
from runlens.schemas import OPEN_STATUSES

INPUT_RETENTION_DAYS = 0  # keep
STACK_RETENTION_DAYS = 0


# --- retention ------------------------------------------------------------------

def retention_cutoff(days: object, as_of: dt.datetime) -> dt.datetime | None:
    """Cut-off instant; anything but a positive finite number of days keeps all."""
    try:
        number = float(days)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return None
    if not math.isfinite(number) or number <= 0:
        return None
    return as_of - dt.timedelta(days=number)


def expire_detail(errors: DataFrame, as_of: dt.datetime, input_days: object = INPUT_RETENTION_DAYS,
                  stack_days: object = STACK_RETENTION_DAYS) -> DataFrame:
    """Clear the two heavy columns of old rows; the rows themselves stay."""
    updates = {}
    for column, days in (("input_data", input_days), ("error_stack", stack_days)):
        cutoff = retention_cutoff(days, as_of)
        if cutoff is not None:
            old = F.coalesce(F.col("timestamp") < ts(cutoff), F.lit(False))
            updates[column] = F.when(~old, F.col(column))
    return errors.withColumns(updates) if updates else errors


def is_expiring(as_of: dt.datetime, input_days: object = INPUT_RETENTION_DAYS,
                stack_days: object = STACK_RETENTION_DAYS) -> Column:
    """Rows that :func:`expire_detail` would change."""
    condition = F.lit(False)
    for column, days in (("input_data", input_days), ("error_stack", stack_days)):
        cutoff = retention_cutoff(days, as_of)
        if cutoff is not None:
            condition |= (F.col("timestamp") < ts(cutoff)) & F.col(column).isNotNull()
    return condition


def expired_counts(errors: DataFrame, as_of: dt.datetime, input_days: object = INPUT_RETENTION_DAYS,
                   stack_days: object = STACK_RETENTION_DAYS) -> DataFrame:
    """How many values :func:`expire_detail` clears, per column."""
    def count(column: str, days: object, name: str) -> Column:
        cutoff = retention_cutoff(days, as_of)
        if cutoff is None:
            return F.lit(0).cast("bigint").alias(name)
        return F.count_if((F.col("timestamp") < ts(cutoff)) & F.col(column).isNotNull()).alias(name)

    return errors.agg(count("input_data", input_days, "purged_input"),
                      count("error_stack", stack_days, "purged_stack"))


# --- re-derivation ----------------------------------------------------------------

def rederive(errors: DataFrame) -> DataFrame:
    """Every error with its stored values (``old_*``) next to the re-derived ones."""
    kept = errors.withColumns({
        "old_message": F.col("error_message"), "old_type": F.col("error_type"),
        "old_category": F.col("error_category")})
    return resolve(kept)


def rederived_changes(errors: DataFrame) -> DataFrame:
    """Errors whose class, message or category differs under the current rules."""
    rows = rederive(errors)
    same = (F.col("error_message").eqNullSafe(F.col("old_message"))
            & F.col("error_type").eqNullSafe(F.coalesce("old_type", F.lit("")))
            & F.col("error_category").eqNullSafe(F.col("old_category")))
    return rows.filter(~same).withColumn(
        "change_kind", change_kind(F.col("old_message"), F.col("old_type"),
                                   F.col("error_message"), F.col("error_type")))


def reclassify(errors: DataFrame, stored_version: int, rules_version: int) -> DataFrame | None:
    """Changed rows when the stored rule version is not the current one, else None."""
    if stored_version == rules_version:
        return None
    return rederived_changes(errors)


def change_histogram(changes: DataFrame) -> DataFrame:
    return changes.groupBy("change_kind").agg(F.count("*").alias("rows"))


def category_moves(changes: DataFrame) -> DataFrame:
    """Movement matrix between categories."""
    return (changes.filter(~F.col("old_category").eqNullSafe(F.col("error_category")))
            .groupBy("old_category", F.col("error_category").alias("new_category"))
            .agg(F.count("*").alias("rows")))


def first_examples(changes: DataFrame, by: list[str], n: int) -> DataFrame:
    """First ``n`` rows per group by id. Spark trims each group to ``n`` before
    the shuffle, so a hot group costs no more than a cold one."""
    rank = F.row_number().over(W.partitionBy(*by).orderBy("id"))
    return changes.withColumn("example_no", rank).filter(F.col("example_no") <= n)


# --- repairs ----------------------------------------------------------------------

def repair(executions: DataFrame) -> DataFrame:
    """Drop rows without any timestamp, take the stop for a missing start, and
    give up on rows that started, never stopped and still claim to be open."""
    started, stopped = F.col("started_at"), F.col("stopped_at")
    stuck = started.isNotNull() & stopped.isNull() & F.col("status").isin(OPEN_STATUSES)
    return (executions.filter(started.isNotNull() | stopped.isNotNull())
            .withColumns({"status": F.when(stuck, "crashed").otherwise(F.col("status")),
                          "started_at": F.coalesce(started, stopped)}))


def repair_survey(executions: DataFrame) -> DataFrame:
    """What :func:`repair` would touch: one pass, one row."""
    started, stopped = F.col("started_at"), F.col("stopped_at")
    return executions.agg(
        F.count_if(started.isNull() & stopped.isNull()).alias("empty_rows"),
        F.count_if(started.isNull() & stopped.isNotNull()).alias("salvageable_rows"),
        F.count_if(started.isNotNull() & stopped.isNull()).alias("never_stopped_rows"),
        F.count_if(started.isNotNull() & stopped.isNull()
                   & F.col("status").isin(OPEN_STATUSES)).alias("stuck_rows"))


# --- history and completeness -------------------------------------------------------

def keep_last(df: DataFrame, n: int | None = None, key: str = "id") -> DataFrame:
    """Rows whose key is within ``n`` of the greatest key; all without ``n``."""
    if n is None:
        return df
    newest = df.agg(F.max(key)).scalar()
    return df.filter(F.col(key) > newest - F.lit(n))


def fingerprint(df: DataFrame, columns: list[str], time_column: str = "started_at") -> DataFrame:
    """Row count, earliest start and an order-free digest of ``columns``.

    The 64-bit row hashes are added as decimals: a bigint sum would overflow.
    """
    digest = F.sum(F.xxhash64(*columns).cast("decimal(38,0)"))
    return df.agg(F.count("*").alias("row_count"), F.min(time_column).alias("first_started"),
                  digest.alias("digest"))


def completeness(source: DataFrame, copy: DataFrame, columns: list[str]) -> DataFrame:
    """Source and copy side by side: counts, first start, and whether they agree."""
    sides = fingerprint(source, columns).withColumn("side", F.lit("source")).unionByName(
        fingerprint(copy, columns).withColumn("side", F.lit("copy")))

    def of(side: str, column: str) -> Column:
        return F.max(F.when(F.col("side") == side, F.col(column)))

    return sides.agg(
        of("source", "row_count").alias("source_rows"), of("copy", "row_count").alias("copy_rows"),
        of("source", "first_started").alias("source_first"),
        of("copy", "first_started").alias("copy_first"),
        (of("source", "row_count") == of("copy", "row_count")).alias("same_count"),
        of("source", "digest").eqNullSafe(of("copy", "digest")).alias("same_content"))
