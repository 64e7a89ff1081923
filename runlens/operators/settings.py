"""Batch validation of settings and requests, with a reason per rejected row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions.text import safe_timestamp
from runlens.operators.scope import EVERYTHING, Scope
from runlens.operators.upsert import latest_by_key, upsert
from runlens.params import MAX_HOURLY_RATE, MAX_SAVED_SECONDS, BadRequest
from runlens.schemas import LISTING_STATUSES


def check_date_pairs(requests: DataFrame, start: str = "start_date", end: str = "end_date") -> DataFrame:
    """Requests with parsed bounds and a ``reject_reason`` (NULL when usable)."""
    has_start = F.coalesce(F.col(start), F.lit("")) != ""
    has_end = F.coalesce(F.col(end), F.lit("")) != ""
    lo, hi = safe_timestamp(F.col(start)), safe_timestamp(F.col(end))
    return requests.withColumns({"start_at": lo, "end_at": hi}).withColumn(
        "reject_reason",
        F.when(has_start != has_end, "bounds must be given together")
        .when(has_start & F.col("start_at").isNull(), "start is not a valid date")
        .when(has_end & F.col("end_at").isNull(), "end is not a valid date")
        .when(F.col("start_at") > F.col("end_at"), "start must be before end"))


def check_statuses(requests: DataFrame, status: str = "status") -> DataFrame:
    """Listing requests with a ``reject_reason``; no status at all is fine."""
    asked = F.nullif(F.col(status), F.lit(""))
    return requests.withColumn("reject_reason", F.when(~asked.isin(LISTING_STATUSES), "no such status"))


def check_settings(entries: DataFrame, zones: list[str]) -> DataFrame:
    """Global settings with a ``reject_reason``. Only ``timezone`` is known."""
    key, value = F.col("key"), F.col("value")
    return entries.withColumn(
        "reject_reason",
        F.when(F.coalesce(key, F.lit("")) == "", "key is required")
        .when(key != "timezone", "unknown key")
        .when(value.isNull() | (F.length(value) > 64) | ~value.isin(zones), "not a time zone"))


def check_roi_entries(entries: DataFrame, workflows: DataFrame, scope: Scope = EVERYTHING) -> DataFrame:
    """ROI entries with ``reject_reason``. Unknown and invisible workflows get the
    same answer, so ids of other projects cannot be probed."""
    known = workflows.select(F.col("id").alias("_known")).distinct()
    joined = scope.allowed(entries).join(known, F.col("workflow_id") == F.col("_known"), "left")
    seconds = F.col("saved_time_seconds").cast("double")
    rate = F.coalesce(F.col("hourly_rate"), F.lit(0.0)).cast("double")

    def outside(value: Column, limit: float) -> Column:
        return value.isNull() | F.isnan(value) | (value < 0) | (value > limit)

    reason = (
        F.when(F.coalesce("workflow_id", F.lit("")) == "", "workflow_id is required")
        .when(outside(seconds, MAX_SAVED_SECONDS), "saved_time_seconds out of range")
        .when(outside(rate, MAX_HOURLY_RATE), "hourly_rate out of range")
        .when(F.col("_known").isNull() | ~F.col("visible"), "unknown workflow"))
    return (joined.withColumns({"hourly_rate": rate, "reject_reason": reason})
            .drop("_known", "visible"))


def update_roi_settings(current: DataFrame, entries: DataFrame, workflows: DataFrame,
                        scope: Scope = EVERYTHING, position: str = "position", shown: int = 20) -> DataFrame:
    """All-or-nothing upsert: one bad entry refuses the whole request.

    Entries may number themselves in a column ``position``; of several for one workflow the last one counts.
    Seconds keep their fraction. The refusal names up to ``shown`` entries and how many there are.
    """
    if position not in entries.columns:
        entries = entries.withColumn(position, F.monotonically_increasing_id())
    checked = check_roi_entries(entries, workflows, scope)
    refused = checked.filter("reject_reason is not null")
    first = refused.limit(shown).collect()
    if first:
        reasons = "; ".join(f"{r.workflow_id} ({r.reject_reason})" for r in first)
        raise BadRequest(f"{refused.count()} entries cannot be stored, among them {reasons}")
    accepted = latest_by_key(checked, "workflow_id", [position]).select(
        "workflow_id", F.col("saved_time_seconds").cast("double").alias("saved_time_seconds"), "hourly_rate")
    return upsert(current, accepted, "workflow_id")
