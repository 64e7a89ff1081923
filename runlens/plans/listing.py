"""Execution listings and top-N tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.functions.timegrid import duration_micros, duration_seconds, ts
from runlens.operators.filters import listing_filter
from runlens.operators.scope import EVERYTHING, Scope
from runlens.params import clamp_int

TOP_N = 10
RECENT = dt.timedelta(days=7)


def named(rows: DataFrame, workflows: DataFrame, name: str = "name") -> DataFrame:
    """Rows with the workflow's name; unknown workflows drop out. No hint: Spark
    broadcasts the workflow table when its size allows and otherwise shuffles,
    splitting a hot workflow at run time."""
    return rows.join(workflows.select(F.col("id").alias("workflow_id"), F.col("name").alias(name)),
                     "workflow_id")


def execution_listing(executions: DataFrame, workflows: DataFrame, *, workflow: str | None = None,
                      limit: object = None, offset: object = None,
                      after: tuple[dt.datetime, int] | None = None,
                      scope: Scope = EVERYTHING, **filters: object) -> DataFrame:
    """Newest finished executions, filtered and paged.

    Without ``limit`` every row is listed. ``after`` is the (start, id) of the last row of the previous page: unlike an
    offset it costs the same on every page.
    """
    rows = scope.narrow(executions.filter(listing_filter(**filters)), "workflow_id")
    if after is not None:
        moment, last_id = after
        rows = rows.filter((F.col("started_at") < ts(moment))
                           | ((F.col("started_at") == ts(moment)) & (F.col("id") < last_id)))
    chosen = workflows.filter(F.col("name") == workflow) if workflow else workflows
    page = named(rows, chosen).select(
        "name", "status", "started_at", "stopped_at", F.col("id").alias("exec_id"),
        duration_seconds(F.col("started_at"), F.col("stopped_at")).alias("duration"))
    page = page.orderBy(F.desc("started_at"), F.desc("exec_id"))
    skip = clamp_int(offset, 0, None, 0)
    if skip:
        page = page.offset(skip)
    return page if limit in (None, "") else page.limit(clamp_int(limit, 1, None, 1))


def slowest_workflows(executions: DataFrame, workflows: DataFrame, as_of: dt.datetime,
                      scope: Scope = EVERYTHING, n: int = TOP_N) -> DataFrame:
    """The ``n`` workflows with the longest mean run of the last seven days."""
    rows = executions.filter((F.col("started_at") > ts(as_of - RECENT)) & F.col("stopped_at").isNotNull())
    length = duration_micros(F.col("started_at"), F.col("stopped_at")).cast("double")
    stats = scope.narrow(rows, "workflow_id").groupBy("workflow_id").agg(
        (F.avg(length) / F.lit(1e6)).alias("avg_duration"), F.count("*").alias("total_runs"))
    return (named(stats, workflows).select("workflow_id", "name", "avg_duration", "total_runs")
            .orderBy(F.desc("avg_duration"), "workflow_id").limit(n))


def error_hotspots(executions: DataFrame, workflows: DataFrame, as_of: dt.datetime,
                   scope: Scope = EVERYTHING, n: int = TOP_N) -> DataFrame:
    """The ``n`` workflows with the most errors of the last seven days, with their rate."""
    rows = scope.narrow(executions.filter(F.col("started_at") > ts(as_of - RECENT)), "workflow_id")
    stats = rows.groupBy("workflow_id").agg(
        F.count_if(F.col("status") == "error").alias("error_count"), F.count("*").alias("total_runs"))
    rate = F.try_divide(F.col("error_count") * F.lit(100.0), F.col("total_runs"))
    return (named(stats.filter("error_count > 0"), workflows)
            .select("workflow_id", "name", "error_count", "total_runs", rate.alias("error_rate"))
            .orderBy(F.desc("error_count"), "workflow_id").limit(n))


def workflow_picker(shares: DataFrame, n: int = 15) -> DataFrame:
    """The most active workflows, for a drop-down."""
    return (shares.select("workflow_id", "workflow_name", "execution_count")
            .orderBy(F.desc("execution_count"), "workflow_id").limit(n))
