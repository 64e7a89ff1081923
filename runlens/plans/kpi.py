"""Key figures, status timeline with forecast, and workflow shares."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from runlens.functions.timegrid import (
    average_seconds,
    bucket_index,
    change_pct,
    epoch_micros,
    round_half_up,
    spine,
)
from runlens.operators.filters import for_workflow_name, within
from runlens.operators.scope import EVERYTHING, Scope
from runlens.params import ReportRange

REST_LABEL = "Rest Workflows"
PARETO_CUT = 9_000  # ninety percent in hundredths of a percent


def kpi_summary(executions: DataFrame, workflows: DataFrame, period: ReportRange,
                workflow: str | None = None, scope: Scope = EVERYTHING) -> DataFrame:
    """Total, errors and mean duration of the period, each count against the period
    before. One scan over both periods; ``error`` counts status 'error' only."""
    rows = executions.filter(within("started_at", period.prev_start, period.end))
    rows = scope.narrow(for_workflow_name(rows, workflows, workflow), "workflow_id")
    now = within("started_at", period.start, period.end)
    failed = F.col("status") == "error"
    sums = rows.agg(
        F.count_if(now).alias("total"),
        F.count_if(now & failed).alias("error"),
        average_seconds(F.when(now, F.col("started_at")), F.col("stopped_at")).alias("avg_duration"),
        F.count_if(~now).alias("prev_total"),
        F.count_if(~now & failed).alias("prev_error"))
    return sums.select(
        "total", "error", "avg_duration",
        change_pct(F.col("total"), F.col("prev_total")).alias("trend_total_pct"),
        change_pct(F.col("error"), F.col("prev_error")).alias("trend_error_pct"))


def status_timeline(executions: DataFrame, workflows: DataFrame, period: ReportRange,
                    workflow: str | None = None, scope: Scope = EVERYTHING) -> DataFrame:
    """Dense hour or day grid of success and non-success counts.

    ``error_count`` is everything that is not a success, which is more than the
    KPI's error count; a NULL status counts in neither.
    """
    rows = executions.filter(within("started_at", period.start, period.end))
    rows = scope.narrow(for_workflow_name(rows, workflows, workflow), "workflow_id")
    counts = rows.groupBy(
        bucket_index(F.col("started_at"), period.origin, period.step_seconds).alias("bucket_idx")
    ).agg(F.count_if(F.col("status") == "success").alias("success_count"),
          F.count_if(F.col("status") != "success").alias("error_count"))
    grid = spine(executions.sparkSession, period.origin, period.step_seconds, period.bucket_count)
    return grid.join(counts, "bucket_idx", "left").select(
        "bucket_idx", "time_val",
        F.coalesce("success_count", F.lit(0)).alias("success_count"),
        F.coalesce("error_count", F.lit(0)).alias("error_count"))


def with_forecast(timeline: DataFrame, period: ReportRange) -> DataFrame:
    """The timeline with the success count of the bucket in progress projected:
    the mean of its linear extrapolation and of the two buckets before it.

    The window runs over the grid only, at most 98 rows.
    """
    last = period.bucket_count - 1
    elapsed = (epoch_micros(period.end) - epoch_micros(period.origin)) / 1e6 - last * period.step_seconds
    hours, minutes = elapsed / 3600, elapsed / 60 % 60
    if period.unit == "day":
        factor = 24.0 / hours if 1 < hours < 23 else None
    else:
        factor = 60.0 / minutes if 5 < minutes < 58 else None
    if last < 2 or factor is None or not 0 < elapsed <= period.step_seconds:
        return timeline
    order = W.orderBy("bucket_idx")
    previous = (F.lag("success_count", 1).over(order) + F.lag("success_count", 2).over(order)) / F.lit(2.0)
    projected = round_half_up((F.col("success_count") * F.lit(factor) + previous) / F.lit(2.0))
    return timeline.withColumn("_projected", projected).withColumn(
        "success_count",
        F.when(F.col("bucket_idx") == last, F.col("_projected")).otherwise(F.col("success_count"))
    ).drop("_projected")


def workflow_share(executions: DataFrame, workflows: DataFrame, period: ReportRange,
                   workflow: str | None = None, scope: Scope = EVERYTHING) -> DataFrame:
    """Executions per workflow and their share of all of them.

    Counted per id before the names are joined, so a workflow with a third of all
    executions is one row by then; the total is a scalar subquery.
    """
    rows = scope.narrow(executions.filter(within("started_at", period.start, period.end)), "workflow_id")
    counted = rows.groupBy("workflow_id").agg(F.count("*").alias("execution_count"))
    named = workflows.filter(F.col("name") == workflow) if workflow else workflows
    per_workflow = counted.join(
        named.select(F.col("id").alias("workflow_id"), F.col("name").alias("workflow_name")),
        "workflow_id")
    total = per_workflow.agg(F.sum("execution_count")).scalar()
    share = F.col("execution_count") * F.lit(100.0) / F.nullif(total, F.lit(0))
    return per_workflow.select(
        "workflow_id", "workflow_name", "execution_count",
        round_half_up(share, 2).alias("percentage")).orderBy(F.desc("execution_count"), "workflow_id")


def pareto(shares: DataFrame) -> DataFrame:
    """Workflows by count until ninety percent are covered, the rest as one row.

    Shares are whole hundredths of a percent. Those of at least 0.01 number at
    most 20,000 however many workflows there are, so the running sum over them
    is small; workflows that round to 0.00 cannot move it and are compared with
    its final value.
    """
    points = F.coalesce(F.round(F.col("percentage") * 100), F.lit(0)).cast("bigint")
    rows = shares.withColumn("points", points)
    visible = rows.filter("points > 0")
    running = W.orderBy(F.desc("execution_count"), "workflow_id").rowsBetween(W.unboundedPreceding, -1)
    ranked = visible.withColumn("covered", F.coalesce(F.sum("points").over(running), F.lit(0)))
    covered_all = F.coalesce(visible.agg(F.sum("points")).scalar(), F.lit(0))
    tail = rows.filter("points = 0").withColumn("covered", covered_all)
    kept = F.col("covered") < PARETO_CUT
    return (ranked.unionByName(tail)
            .groupBy(F.when(kept, F.col("workflow_id")).alias("workflow_id"),
                     F.when(kept, F.col("workflow_name")).otherwise(REST_LABEL).alias("label"))
            .agg(F.sum("execution_count").alias("execution_count"))
            .orderBy(F.col("workflow_id").isNull(), F.desc("execution_count"), "workflow_id"))


def first_execution_date(executions: DataFrame, scope: Scope = EVERYTHING) -> DataFrame:
    return scope.narrow(executions, "workflow_id").agg(F.min("started_at").alias("first_date"))
