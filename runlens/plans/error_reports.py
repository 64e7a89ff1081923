"""Error intelligence: summary, breakdowns, health, groups and drill-downs."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from runlens.functions.errors import health_band, is_structural, is_transient
from runlens.functions.text import error_summary
from runlens.functions.timegrid import change_pct, round_half_up, ts
from runlens.operators.filters import within
from runlens.operators.scope import EVERYTHING, Scope
from runlens.params import BadRequest, ReportRange, parse_range
from runlens.plans.listing import named
from runlens.schemas import ALL_CATEGORIES

# --- fixed values ----------------------------------------------------------------
DRILLDOWN = dt.timedelta(days=7)
ACTIVE = dt.timedelta(hours=24)
# ------------------------------------------------------------------------------

GROUP_KEYS = ["error_category", "node_name", "error_summary"]


def error_totals(errors: DataFrame, executions: DataFrame, period: ReportRange,
                 scope: Scope = EVERYTHING) -> DataFrame:
    """Summary row. Errors of both periods are first counted per workflow, node and
    category, so the two distinct counts run over that small table."""
    rows = errors.filter(within("timestamp", period.prev_start, period.end))
    now = within("timestamp", period.start, period.end)
    cells = scope.narrow(rows, "workflow_id").groupBy("workflow_id", "node_name", "error_category").agg(
        F.count_if(now).alias("n"), F.count_if(~now).alias("prev_n"))
    hit = F.col("n") > 0

    def total(condition=None):
        value = F.col("n") if condition is None else F.when(condition, F.col("n")).otherwise(0)
        return F.coalesce(F.sum(value), F.lit(0))

    sums = cells.agg(
        total().alias("total_errors"),
        F.count_distinct(F.when(hit, F.col("workflow_id"))).alias("affected_workflows"),
        F.count_distinct(F.when(hit, F.col("node_name"))).alias("unique_failing_nodes"),
        total(is_transient(F.col("error_category"))).alias("transient_count"),
        total(is_structural(F.col("error_category"))).alias("structural_count"),
        F.coalesce(F.sum("prev_n"), F.lit(0)).alias("prev_errors"))
    runs = scope.narrow(executions.filter(within("started_at", period.start, period.end)), "workflow_id")
    rate = F.try_divide(F.col("total_errors") * F.lit(100.0), F.col("total_executions"))
    return (sums.withColumn("total_executions", runs.agg(F.count("*")).scalar()).select(
        "total_errors", "affected_workflows", "unique_failing_nodes", "transient_count",
        "structural_count", "total_executions",
        round_half_up(F.coalesce(rate, F.lit(0.0)), 1).alias("error_rate"),
        round_half_up(change_pct(F.col("total_errors"), F.col("prev_errors")), 1).alias("trend_pct")))


def category_breakdown(errors: DataFrame, period: ReportRange, scope: Scope = EVERYTHING) -> DataFrame:
    rows = scope.narrow(errors.filter(within("timestamp", period.start, period.end)), "workflow_id")
    return (rows.groupBy("error_category").agg(F.count("*").alias("count"))
            .orderBy(F.desc("count"), "error_category"))


def daily_trend(errors: DataFrame, period: ReportRange, scope: Scope = EVERYTHING) -> DataFrame:
    """Errors per UTC day, one column per category; an absent pair stays NULL."""
    rows = scope.narrow(errors.filter(within("timestamp", period.start, period.end)), "workflow_id")
    return (rows.groupBy(F.to_date("timestamp").alias("day"))
            .pivot("error_category", ALL_CATEGORIES).count().orderBy("day"))


def workflow_health(executions: DataFrame, workflows: DataFrame, period: ReportRange,
                    scope: Scope = EVERYTHING, n: int | None = None) -> DataFrame:
    """Workflows with errors, the least healthy first; with ``n`` only so many."""
    rows = scope.narrow(executions.filter(within("started_at", period.start, period.end)), "workflow_id")
    stats = rows.groupBy("workflow_id").agg(
        F.count_if(F.col("status") == "error").alias("error_count"), F.count("*").alias("total_runs"))
    score = round_half_up(
        (F.lit(1.0) - F.col("error_count").cast("double") / F.col("total_runs")) * F.lit(100), 1)
    ranked = (named(stats.filter("error_count > 0"), workflows)
            .withColumn("health_score", score)
            .withColumn("health_band", health_band(F.col("health_score")))
            .select("workflow_id", "name", "error_count", "total_runs", "health_score", "health_band")
            .orderBy("health_score", "workflow_id"))
    return ranked if n is None else ranked.limit(n)


def error_groups(errors: DataFrame, workflows: DataFrame, period: ReportRange, as_of: dt.datetime,
                 scope: Scope = EVERYTHING, n: int | None = None, names: int | None = None) -> DataFrame:
    """Groups of alike errors, the largest first; with ``n`` only so many.

    Alike: same category, node and message. Errors are folded once per group, workflow and node type, on a
    digest of the message and with counters that hash aggregation updates in place; workflow names are joined
    to that small table. A group lists its workflows' names in order, with ``names`` only the first of them.
    The node type is the one of the group's latest error.
    """
    rows = scope.narrow(errors.filter(within("timestamp", period.start, period.end)), "workflow_id")
    folded = (rows.withColumn("error_summary", error_summary(F.col("error_message")))
              .withColumn("digest", F.sha2("error_summary", 256))
              .groupBy("error_category", "node_name", "digest", "workflow_id", "node_type")
              .agg(F.count("*").alias("n"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"),
                   F.first("error_summary").alias("error_summary")))
    latest = F.max(F.struct("last", "node_type"))
    every = F.array_sort(F.collect_set("workflow_name"))
    last_seen = F.col("latest.last")
    groups = (named(folded, workflows, "workflow_name").groupBy("error_category", "node_name", "digest").agg(
        F.first("error_summary").alias("error_summary"), latest.alias("latest"), F.sum("n").alias("count"),
        F.count_distinct("workflow_id").alias("affected_workflows"), F.min("first").alias("first_seen"),
        (every if names is None else F.slice(every, 1, names)).alias("workflow_names"))
        .select(*GROUP_KEYS, F.col("latest.node_type").alias("node_type"), "count", "affected_workflows",
                "first_seen", last_seen.alias("last_seen"), "workflow_names",
                F.when(last_seen >= ts(as_of - ACTIVE), "active").otherwise("recurring").alias("status"))
        .orderBy(F.desc("count"), *[F.asc_nulls_first(k) for k in GROUP_KEYS]))
    return groups if n is None else groups.limit(n)


def node_distribution(errors: DataFrame, as_of: dt.datetime, scope: Scope = EVERYTHING) -> DataFrame:
    """Errors per failing node of the last seven days, for every workflow."""
    rows = scope.narrow(errors.filter(F.col("timestamp") > ts(as_of - DRILLDOWN)), "workflow_id")
    return rows.groupBy("workflow_id", "node_name").agg(F.count("*").alias("count"))


def source_distribution(errors: DataFrame, as_of: dt.datetime, scope: Scope = EVERYTHING,
                        n: int | None = None) -> DataFrame:
    """Errors per upstream branch for every workflow; with ``n`` only the branches with most."""
    recent = errors.filter((F.col("timestamp") > ts(as_of - DRILLDOWN)) & (F.col("source_node") != ""))
    counts = scope.narrow(recent, "workflow_id").groupBy(
        "workflow_id", "source_node", "source_output_index").agg(F.count("*").alias("count"))
    if n is None:
        return counts
    rank = F.row_number().over(W.partitionBy("workflow_id").orderBy(
        F.desc("count"), "source_node", "source_output_index"))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= n).drop("rank")


def raw_errors(errors: DataFrame, scope: Scope = EVERYTHING, n: int | None = None) -> DataFrame:
    """The errors of every workflow, or the newest ``n`` of each. Spark trims each workflow to ``n``
    rows before the shuffle, so a hot workflow does not pile up in one task."""
    rows = scope.narrow(errors, "workflow_id")
    if n is not None:
        rank = F.row_number().over(W.partitionBy("workflow_id").orderBy(F.desc("timestamp"), F.desc("id")))
        rows = rows.withColumn("rank", rank).filter(F.col("rank") <= n)
    return rows.select(
        F.col("id").alias("exec_id"), "workflow_id", "node_name", "node_type", "error_message",
        "error_stack", "source_node", F.col("source_output_index").alias("branch"),
        F.col("timestamp").alias("started_at"))


def workflow_drilldown(errors: DataFrame, workflows: DataFrame, workflow_id: str, as_of: dt.datetime,
                       scope: Scope = EVERYTHING) -> dict[str, DataFrame]:
    """The drill-down of one workflow; every part is empty when it is not visible."""
    mine = errors.filter(F.col("workflow_id") == workflow_id)
    info = scope.narrow(workflows.filter(F.col("id") == workflow_id), "id").select("name")
    return {
        "workflow": info,
        "node_distribution": node_distribution(mine, as_of, scope).orderBy(F.desc("count"), "node_name"),
        "source_distribution": source_distribution(mine, as_of, scope),
        "raw_errors": raw_errors(mine, scope).orderBy(F.desc("started_at"), F.desc("exec_id")),
    }


def group_executions(errors: DataFrame, workflows: DataFrame, *, category: str, node_name: str,
                     summary: str, start: object, end: object, scope: Scope = EVERYTHING,
                     n: int | None = None) -> DataFrame:
    """The executions of one error group, newest first; with ``n`` only so many."""
    if not (category and node_name and summary and start and end):
        raise BadRequest("category, node, summary and range are all needed")
    lo, hi = parse_range(start, end)
    rows = errors.filter(
        within("timestamp", lo, hi) & (F.col("error_category") == category)
        & (F.col("node_name") == node_name) & (error_summary(F.col("error_message")) == summary))
    shown = (named(scope.narrow(rows, "workflow_id"), workflows, "workflow_name")
             .select(F.col("id").alias("exec_id"), "timestamp", "workflow_name")
             .orderBy(F.desc("timestamp"), F.desc("exec_id")))
    return shown if n is None else shown.limit(n)
