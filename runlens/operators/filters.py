"""Predicates of the execution reads."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions.timegrid import duration_seconds, ts
from runlens.params import BadRequest, parse_iso_date
from runlens.schemas import LISTING_STATUSES


def within(column: str, start: dt.datetime, end: dt.datetime) -> Column:
    """Inclusive range on the bare column, so it reaches the Parquet scan."""
    return (F.col(column) >= ts(start)) & (F.col(column) <= ts(end))


def before(column: str, start: dt.datetime, end: dt.datetime) -> Column:
    """Half-open range ``[start, end)``."""
    return (F.col(column) >= ts(start)) & (F.col(column) < ts(end))


def for_workflow_name(executions: DataFrame, workflows: DataFrame, name: str | None) -> DataFrame:
    """Executions of the workflows with this name. Names are not unique, and an
    execution of an unknown workflow drops out only when a name is asked for."""
    if not name:
        return executions
    ids = workflows.filter(F.col("name") == name).select(F.col("id").alias("workflow_id"))
    return executions.join(ids, "workflow_id", "left_semi")


def not_deleted(df: DataFrame) -> DataFrame:
    """Drop soft-deleted rows where the source marks them."""
    return df.filter(F.col("deleted_at").isNull()) if "deleted_at" in df.columns else df


def listing_filter(*, exec_id: int | None = None, status: str | None = None,
                   started_from: object = None, started_to: object = None,
                   min_duration: float | None = None) -> Column:
    """Composite optional filter of the execution listing.

    Both timestamps must be present; the upper bound applies to the start.
    """
    if status and status not in LISTING_STATUSES:
        raise BadRequest(f"no such status to filter by: {status}")
    condition = F.col("started_at").isNotNull() & F.col("stopped_at").isNotNull()
    if exec_id is not None:
        condition &= F.col("id") == exec_id
    if status:
        condition &= F.col("status") == status
    for bound, compare in ((started_from, Column.__ge__), (started_to, Column.__le__)):
        if bound:
            moment = parse_iso_date(bound)
            if moment is None:
                raise BadRequest(f"not a valid date: {str(bound)[:60]}")
            condition &= compare(F.col("started_at"), ts(moment))
    if min_duration and min_duration > 0:
        condition &= duration_seconds(F.col("started_at"), F.col("stopped_at")) >= min_duration
    return condition


def name_or_id_contains(needle: str, name: str = "name", key: str = "id") -> Column:
    text = F.lit(needle.strip().lower())
    return F.contains(F.lower(name), text) | F.contains(F.lower(key), text)
