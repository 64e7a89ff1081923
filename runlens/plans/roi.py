"""Return on investment: settings table, totals, per workflow, estimates."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions.timegrid import round_half_up, ts
from runlens.operators.filters import name_or_id_contains
from runlens.operators.scope import EVERYTHING, Scope
from runlens.params import lookback_start

SETTINGS_WINDOW = dt.timedelta(days=30)

# Fixed values of the saved-time estimate.
PER_MONTH = {"day": 30.0, "week": 30.0 / 7.0, "month": 1.0}
UNIT_SECONDS = {"hours": 3600, "minutes": 60}


def with_settings(workflows: DataFrame, settings: DataFrame) -> DataFrame:
    """Workflows with their settings, zero where none are stored."""
    stored = settings.select(F.col("workflow_id").alias("_wf"), "saved_time_seconds", "hourly_rate")
    return (workflows.join(stored, F.col("id") == F.col("_wf"), "left")
            .select("id", "name",
                    F.coalesce("saved_time_seconds", F.lit(0)).alias("saved_time_seconds"),
                    F.coalesce("hourly_rate", F.lit(0.0)).alias("hourly_rate")))


def roi_settings(workflows: DataFrame, settings: DataFrame, executions: DataFrame, as_of: dt.datetime,
                 scope: Scope = EVERYTHING) -> DataFrame:
    """Every workflow with its settings and successful runs, ever and in 30 days.
    Runs are counted per workflow before the join, so workflows without any keep
    a zero row and hot ones are one row."""
    runs = executions.filter(F.col("status") == "success").groupBy("workflow_id").agg(
        F.count("*").alias("_all"),
        F.count_if(F.col("started_at") >= ts(as_of - SETTINGS_WINDOW)).alias("_recent"))
    base = with_settings(scope.narrow(workflows, "id"), settings)
    return base.join(runs, base["id"] == runs["workflow_id"], "left").select(
        "id", "name", "saved_time_seconds", "hourly_rate",
        F.coalesce("_all", F.lit(0)).alias("execution_count"),
        F.coalesce("_recent", F.lit(0)).alias("executions_30d")).orderBy("name", "id")


def _successes(executions: DataFrame, preset: str | None, as_of: dt.datetime, scope: Scope) -> DataFrame:
    start = lookback_start(preset, as_of=as_of)
    rows = executions.filter(F.col("status") == "success")
    if start is not None:
        rows = rows.filter(F.col("started_at") >= ts(start))
    return scope.narrow(rows, "workflow_id").groupBy("workflow_id").agg(F.count("*").alias("executions"))


def roi_per_workflow(executions: DataFrame, workflows: DataFrame, settings: DataFrame, *,
                     preset: str | None = None, as_of: dt.datetime, scope: Scope = EVERYTHING) -> DataFrame:
    """Runs, seconds and money saved of every known workflow with a successful run."""
    counted = _successes(executions, preset, as_of, scope)
    base = with_settings(workflows, settings)
    seconds = F.col("executions") * F.col("saved_time_seconds")
    return counted.join(base, counted["workflow_id"] == base["id"]).select(
        "id", "name", "executions", seconds.alias("time_saved_seconds"),
        (seconds * F.col("hourly_rate") / F.lit(3600.0)).alias("money_saved"),
        (seconds * F.col("hourly_rate")).alias("rate_seconds"))


def roi_totals(per_workflow: DataFrame) -> DataFrame:
    """Totals over :func:`roi_per_workflow`. Dividing once at the end keeps the
    money sum free of per-row rounding."""
    return per_workflow.agg(
        F.coalesce(F.sum("executions"), F.lit(0)).alias("total_executions"),
        F.sum("time_saved_seconds").alias("total_time_saved_seconds"),
        (F.sum("rate_seconds") / F.lit(3600.0)).alias("total_money_saved"))


def roi_top(per_workflow: DataFrame) -> DataFrame:
    """Only workflows that saved time, the most first."""
    return (per_workflow.filter("time_saved_seconds > 0").drop("rate_seconds")
            .orderBy(F.desc("time_saved_seconds"), "id"))


def sort_settings(rows: DataFrame, mode: str = "name_asc") -> DataFrame:
    """The four orders of the settings screen; any other leaves the order alone."""
    orders: dict[str, list[Column]] = {
        "name_asc": [F.asc("name")], "name_desc": [F.desc("name")],
        "execs_desc": [F.desc("execution_count")], "time_desc": [F.desc("saved_time_seconds")],
    }
    return rows.orderBy(*orders[mode], "id") if mode in orders else rows


def search_settings(rows: DataFrame, needle: str) -> DataFrame:
    return rows.filter(name_or_id_contains(needle))


def saved_seconds_estimate(frequency: Column, per: Column, duration: Column, unit: Column,
                           executions_30d: Column) -> Column:
    """Seconds saved per run, from how often and how long people did the work."""
    per_month = (F.when(per == "day", PER_MONTH["day"]).when(per == "week", PER_MONTH["week"])
                 .otherwise(PER_MONTH["month"]))
    seconds = F.when(unit == "hours", UNIT_SECONDS["hours"]).otherwise(UNIT_SECONDS["minutes"])
    total = frequency * per_month * duration * seconds
    return round_half_up(total / F.greatest(F.lit(1), executions_30d))
