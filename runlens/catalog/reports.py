"""Analytical reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlens.catalog.reads import member_scope
from runlens.catalog.registry import query
from runlens.operators.care import keep_last
from runlens.params import metrics_range
from runlens.plans import error_reports, history, kpi, listing, roi, volume
from runlens.sources.sample import AS_OF

WEEK = metrics_range(as_of=AS_OF)
HOURS = metrics_range("2024-01-28T10:20:00Z", "2024-01-30T13:30:00Z", as_of=AS_OF)
LONG = metrics_range("2023-11-01T00:00:00Z", "2024-01-30T13:30:00Z", as_of=AS_OF)
NAME = "Customer#000000005"
DAY = "2024-01-29T00:00:00Z"

_IN_WEEK = "started_at >= TIMESTAMP '2024-01-24' AND started_at <= TIMESTAMP '2024-01-31'"
_ERR_WEEK = "\"timestamp\" >= TIMESTAMP '2024-01-24' AND \"timestamp\" <= TIMESTAMP '2024-01-31'"
_MICROS = "(epoch_us(stopped_at) - epoch_us(started_at))"
_ONLY_NAMED = f"workflow_id IN (SELECT id FROM workflow_entity WHERE name = '{NAME}')"
_SCOPED = "workflow_id IN (SELECT workflow_id FROM visible)"


def _summary_sql(start: str, end: str, prev: str, extra: str = "true") -> str:
    return f"""
SELECT total, error, avg_duration,
  CASE WHEN prev_total > 0 THEN CAST(total - prev_total AS DOUBLE) / CAST(prev_total AS DOUBLE) * CAST(100 AS DOUBLE)
       WHEN total > 0 THEN CAST(100 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS trend_total_pct,
  CASE WHEN prev_error > 0 THEN CAST(error - prev_error AS DOUBLE) / CAST(prev_error AS DOUBLE) * CAST(100 AS DOUBLE)
       WHEN error > 0 THEN CAST(100 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS trend_error_pct
FROM (
  SELECT count(*) FILTER (started_at >= TIMESTAMP '{start}') AS total,
    count(*) FILTER (started_at >= TIMESTAMP '{start}' AND status = 'error') AS error,
    avg({_MICROS}) FILTER (started_at >= TIMESTAMP '{start}') / CAST(1000000 AS DOUBLE) AS avg_duration,
    count(*) FILTER (started_at < TIMESTAMP '{start}') AS prev_total,
    count(*) FILTER (started_at < TIMESTAMP '{start}' AND status = 'error') AS prev_error
  FROM execution_entity
  WHERE started_at >= TIMESTAMP '{prev}' AND started_at <= TIMESTAMP '{end}' AND {extra})"""


def _timeline_sql(origin: str, step: int, n: int, start: str, end: str, extra: str = "true") -> str:
    return f"""
SELECT g.i AS bucket_idx, TIMESTAMP '{origin}' + to_seconds(g.i * {step}) AS time_val,
  coalesce(s, 0) AS success_count, coalesce(f, 0) AS error_count
FROM (SELECT unnest(generate_series(CAST(0 AS BIGINT), {n - 1})) AS i) g
LEFT JOIN (
  SELECT (epoch_us(started_at) - epoch_us(TIMESTAMP '{origin}')) // {step * 1_000_000} AS i,
    count(*) FILTER (status = 'success') AS s, count(*) FILTER (status <> 'success') AS f
  FROM execution_entity
  WHERE started_at >= TIMESTAMP '{start}' AND started_at <= TIMESTAMP '{end}' AND {extra}
  GROUP BY 1) c ON c.i = g.i"""


@query("r1a_kpi_summary", _summary_sql("2024-01-24", "2024-01-31", "2024-01-17"))
def _(t):
    return kpi.kpi_summary(t.executions, t.workflows, WEEK)


@query("r1a_kpi_summary_workflow", _summary_sql("2024-01-24", "2024-01-31", "2024-01-17", _ONLY_NAMED))
def _(t):
    return kpi.kpi_summary(t.executions, t.workflows, WEEK, NAME)


@query("r1a_kpi_summary_scoped", _summary_sql("2024-01-24", "2024-01-31", "2024-01-17", _SCOPED))
def _(t):
    return kpi.kpi_summary(t.executions, t.workflows, WEEK, scope=member_scope(t))


@query("r1a_kpi_summary_capped",
       _summary_sql("2023-11-01", "2024-01-30 13:30:00", "2023-08-02 10:30:00"))
def _(t):
    return kpi.kpi_summary(t.executions, t.workflows, LONG)


@query("r1b_status_timeline_days", _timeline_sql("2024-01-24", 86_400, 8, "2024-01-24", "2024-01-31"))
def _(t):
    return kpi.status_timeline(t.executions, t.workflows, WEEK)


@query("r1b_status_timeline_hours", _timeline_sql(
    "2024-01-28 10:00:00", 3_600, 52, "2024-01-28 10:20:00", "2024-01-30 13:30:00", _SCOPED))
def _(t):
    return kpi.status_timeline(t.executions, t.workflows, HOURS, scope=member_scope(t))


@query("r1c_forecast_hours", f"""
, timeline AS ({_timeline_sql("2024-01-28 10:00:00", 3_600, 52, "2024-01-28 10:20:00", "2024-01-30 13:30:00")})
SELECT bucket_idx, time_val, CASE WHEN bucket_idx = 51 THEN CAST(floor((success_count * CAST(2 AS DOUBLE)
    + (lag(success_count, 1) OVER (ORDER BY bucket_idx) + lag(success_count, 2) OVER (ORDER BY bucket_idx)) / CAST(2 AS DOUBLE))
    / CAST(2 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS BIGINT) ELSE success_count END AS success_count, error_count
FROM timeline""")
def _(t):
    return kpi.with_forecast(kpi.status_timeline(t.executions, t.workflows, HOURS), HOURS)


@query("r1c_forecast_days", f"""
, timeline AS ({_timeline_sql("2023-11-01", 86_400, 91, "2023-11-01", "2024-01-30 13:30:00")})
SELECT bucket_idx, time_val, CASE WHEN bucket_idx = 90 THEN CAST(floor((success_count * (CAST(24 AS DOUBLE) / CAST(13.5 AS DOUBLE))
    + (lag(success_count, 1) OVER (ORDER BY bucket_idx) + lag(success_count, 2) OVER (ORDER BY bucket_idx)) / CAST(2 AS DOUBLE))
    / CAST(2 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS BIGINT) ELSE success_count END AS success_count, error_count
FROM timeline""")
def _(t):
    return kpi.with_forecast(kpi.status_timeline(t.executions, t.workflows, LONG), LONG)


_SHARE = f"""shares AS (
  SELECT w.id AS workflow_id, w.name AS workflow_name, count(*) AS execution_count,
    floor(count(*) * CAST(100 AS DOUBLE) / nullif(sum(count(*)) OVER (), 0) * CAST(100 AS DOUBLE) + CAST(0.5 AS DOUBLE))
      / CAST(100 AS DOUBLE) AS percentage
  FROM execution_entity e JOIN workflow_entity w ON e.workflow_id = w.id
  WHERE {_IN_WEEK} GROUP BY w.id, w.name)"""


@query("r1d_workflow_share", f", {_SHARE} SELECT * FROM shares ORDER BY execution_count DESC, workflow_id")
def _(t):
    return kpi.workflow_share(t.executions, t.workflows, WEEK)


@query("r1e_pareto", f"""
, {_SHARE}, running AS (
  SELECT *, coalesce(sum(CAST(round(percentage * 100) AS BIGINT)) OVER (
    ORDER BY execution_count DESC, workflow_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS covered
  FROM shares)
SELECT * FROM (
  SELECT CASE WHEN covered < 9000 THEN workflow_id END AS workflow_id,
    CASE WHEN covered < 9000 THEN workflow_name ELSE 'Rest Workflows' END AS label,
    CAST(sum(execution_count) AS BIGINT) AS execution_count
  FROM running GROUP BY 1, 2)
ORDER BY workflow_id IS NULL, execution_count DESC, workflow_id""")
def _(t):
    return kpi.pareto(kpi.workflow_share(t.executions, t.workflows, WEEK))


@query("r2_execution_listing", f"""
SELECT w.name, e.status, e.started_at, e.stopped_at, e.id AS exec_id, {_MICROS} / CAST(1000000 AS DOUBLE) AS duration
FROM execution_entity e JOIN workflow_entity w ON e.workflow_id = w.id
WHERE started_at IS NOT NULL AND stopped_at IS NOT NULL AND status = 'success'
  AND started_at <= TIMESTAMP '2024-01-30' AND {_MICROS} / CAST(1000000 AS DOUBLE) >= 2.5
ORDER BY started_at DESC, exec_id DESC LIMIT 50 OFFSET 25""")
def _(t):
    return listing.execution_listing(t.executions, t.workflows, status="success", limit="50", offset="25",
                                     started_to="2024-01-30", min_duration=2.5)


@query("r2_execution_listing_keyset", f"""
SELECT w.name, e.status, e.started_at, e.stopped_at, e.id AS exec_id, {_MICROS} / CAST(1000000 AS DOUBLE) AS duration
FROM execution_entity e JOIN workflow_entity w ON e.workflow_id = w.id
WHERE stopped_at IS NOT NULL AND started_at < TIMESTAMP '2024-01-15'
ORDER BY started_at DESC, exec_id DESC LIMIT 1000""")
def _(t):
    return listing.execution_listing(t.executions, t.workflows, limit=1000,
                                     after=(AS_OF.replace(day=15), -1))


@query("r3_slowest", f"""
SELECT w.id AS workflow_id, w.name, avg({_MICROS}) / CAST(1000000 AS DOUBLE) AS avg_duration, count(*) AS total_runs
FROM execution_entity e JOIN workflow_entity w ON e.workflow_id = w.id
WHERE started_at > TIMESTAMP '2024-01-24' AND stopped_at IS NOT NULL
GROUP BY 1, 2 ORDER BY avg_duration DESC, workflow_id LIMIT 10""")
def _(t):
    return listing.slowest_workflows(t.executions, t.workflows, AS_OF)


@query("r4_error_hotspots", """
SELECT w.id AS workflow_id, w.name, count(*) FILTER (status = 'error') AS error_count, count(*) AS total_runs,
  count(*) FILTER (status = 'error') * CAST(100 AS DOUBLE) / count(*) AS error_rate
FROM execution_entity e JOIN workflow_entity w ON e.workflow_id = w.id
WHERE started_at > TIMESTAMP '2024-01-24' GROUP BY 1, 2 HAVING error_count > 0
ORDER BY error_count DESC, workflow_id LIMIT 10""")
def _(t):
    return listing.error_hotspots(t.executions, t.workflows, AS_OF)


@query("r5_roi_settings", """
SELECT w.id, w.name, coalesce(s.saved_time_seconds, 0) AS saved_time_seconds,
  coalesce(s.hourly_rate, 0) AS hourly_rate, count(e.id) AS execution_count,
  count(e.id) FILTER (e.started_at >= TIMESTAMP '2024-01-01') AS executions_30d
FROM workflow_entity w LEFT JOIN workflow_settings s ON w.id = s.workflow_id
LEFT JOIN execution_entity e ON w.id = e.workflow_id AND e.status = 'success'
GROUP BY 1, 2, 3, 4 ORDER BY name, id""")
def _(t):
    return roi.roi_settings(t.workflows, t.settings, t.executions, AS_OF)


_ROI_FROM = """
FROM execution_entity e JOIN workflow_entity w ON e.workflow_id = w.id
LEFT JOIN workflow_settings s ON w.id = s.workflow_id
WHERE e.status = 'success'"""


@query("r6a_roi_totals", f"""
SELECT count(*) AS total_executions, CAST(sum(coalesce(s.saved_time_seconds, 0)) AS BIGINT) AS total_time_saved_seconds,
  sum(coalesce(s.saved_time_seconds, 0) * coalesce(s.hourly_rate, 0)) / CAST(3600 AS DOUBLE) AS total_money_saved
{_ROI_FROM}""")
def _(t):
    return roi.roi_totals(roi.roi_per_workflow(t.executions, t.workflows, t.settings, as_of=AS_OF))


@query("r6a_roi_totals_48h_scoped", f"""
SELECT count(*) AS total_executions, CAST(sum(coalesce(s.saved_time_seconds, 0)) AS BIGINT) AS total_time_saved_seconds,
  sum(coalesce(s.saved_time_seconds, 0) * coalesce(s.hourly_rate, 0)) / CAST(3600 AS DOUBLE) AS total_money_saved
{_ROI_FROM} AND e.started_at >= TIMESTAMP '2024-01-29' AND e.{_SCOPED}""")
def _(t):
    return roi.roi_totals(roi.roi_per_workflow(t.executions, t.workflows, t.settings, preset="48h",
                                               as_of=AS_OF, scope=member_scope(t)))


@query("r6b_roi_workflows", f"""
SELECT w.id, w.name, count(*) AS executions, count(*) * coalesce(s.saved_time_seconds, 0) AS time_saved_seconds,
  count(*) * coalesce(s.saved_time_seconds, 0) * coalesce(s.hourly_rate, 0) / CAST(3600 AS DOUBLE) AS money_saved
{_ROI_FROM} AND e.started_at >= TIMESTAMP '2024-01-24'
GROUP BY w.id, w.name, s.saved_time_seconds, s.hourly_rate HAVING time_saved_seconds > 0 ORDER BY time_saved_seconds DESC, w.id""")
def _(t):
    return roi.roi_top(roi.roi_per_workflow(t.executions, t.workflows, t.settings, preset="7d", as_of=AS_OF))


def _series_sql(origin: str, extra: str = "true") -> str:
    return f"""
SELECT TIMESTAMP '{origin}' + to_seconds(g.i * 300) AS "timestamp", coalesce(n, 0) AS started_count
FROM (SELECT unnest(generate_series(CAST(0 AS BIGINT), 287)) AS i) g LEFT JOIN (
  SELECT (epoch_us(started_at) - epoch_us(TIMESTAMP '{origin}')) // 300000000 AS i, count(*) AS n
  FROM execution_entity WHERE started_at >= TIMESTAMP '{origin}'
    AND started_at < TIMESTAMP '{origin}' + INTERVAL 1 DAY AND {extra} GROUP BY 1) c ON c.i = g.i"""


@query("r7_volume_of_day", _series_sql("2024-01-29"))
def _(t):
    return volume.execution_volume(t.executions, None, AS_OF, DAY, "2024-01-29T12:00:00Z")


@query("r7_volume_cached", _series_sql("2024-01-30 00:05:00"))
def _(t):
    cache = volume.refreshed_cache(t.executions, volume.volume_series(t.source, volume.rolling_origin(AS_OF)), AS_OF)
    return volume.execution_volume(t.executions, cache, AS_OF)


@query("c3_volume_restricted", _series_sql("2024-01-30 00:05:00", _SCOPED))
def _(t):
    cache = volume.volume_series(t.executions, volume.rolling_origin(AS_OF))
    return volume.execution_volume(t.executions, cache, AS_OF, scope=member_scope(t))


@query("r8_volume_details", """
SELECT w.name AS workflow_name, w.id AS workflow_id, e.id AS exec_id, status, started_at, stopped_at,
  (epoch_us(coalesce(stopped_at, TIMESTAMP '2024-01-31')) - epoch_us(started_at)) / CAST(1000000 AS DOUBLE) AS current_duration
FROM execution_entity e JOIN workflow_entity w ON e.workflow_id = w.id
WHERE started_at >= TIMESTAMP '2024-01-29 08:00:00' AND started_at < TIMESTAMP '2024-01-29 14:00:00'
ORDER BY started_at DESC, exec_id DESC""")
def _(t):
    return volume.volume_details(t.executions, t.workflows, "2024-01-29T08:00:00Z", AS_OF, "360")


@query("r9_resampled_volume", f"""
, series AS ({_series_sql("2024-01-30 00:05:00")})
SELECT "timestamp", started_count FROM (
  SELECT TIMESTAMP '2024-01-30 00:05:00' + to_seconds(
      (epoch_us("timestamp") - epoch_us(TIMESTAMP '2024-01-30 00:05:00')) // 1800000000 * 1800) AS "timestamp",
    CAST(sum(started_count) AS BIGINT) AS started_count FROM series GROUP BY 1)
WHERE "timestamp" + INTERVAL 30 MINUTE <= TIMESTAMP '2024-01-31'""")
def _(t):
    origin = volume.rolling_origin(AS_OF)
    return volume.resample(volume.volume_series(t.executions, origin), origin, 30, AS_OF)


@query("r10_first_execution", f"SELECT min(started_at) AS first_date FROM execution_entity WHERE {_SCOPED}")
def _(t):
    return kpi.first_execution_date(t.executions, member_scope(t))


def _error_totals_sql(extra: str = "true") -> str:
    return f"""
SELECT total_errors, affected_workflows, unique_failing_nodes, transient_count, structural_count, total_executions,
  floor(coalesce(total_errors * CAST(100 AS DOUBLE) / nullif(total_executions, 0), 0) * 10 + CAST(0.5 AS DOUBLE)) / CAST(10 AS DOUBLE) AS error_rate,
  floor((CASE WHEN prev > 0 THEN CAST(total_errors - prev AS DOUBLE) / CAST(prev AS DOUBLE) * CAST(100 AS DOUBLE)
    WHEN total_errors > 0 THEN CAST(100 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) * 10 + CAST(0.5 AS DOUBLE)) / CAST(10 AS DOUBLE) AS trend_pct
FROM (SELECT count(*) AS total_errors, count(DISTINCT workflow_id) AS affected_workflows,
    count(DISTINCT node_name) AS unique_failing_nodes,
    count(*) FILTER (error_category IN ('rate_limit', 'network', 'upstream')) AS transient_count,
    count(*) FILTER (error_category IN ('auth', 'config', 'data', 'logic')) AS structural_count
  FROM errors WHERE {_ERR_WEEK} AND {extra}),
 (SELECT count(*) AS prev FROM errors
  WHERE "timestamp" >= TIMESTAMP '2024-01-17' AND "timestamp" < TIMESTAMP '2024-01-24' AND {extra}),
 (SELECT count(*) AS total_executions FROM execution_entity WHERE {_IN_WEEK} AND {extra})"""


@query("r11a_error_totals", _error_totals_sql())
def _(t):
    return error_reports.error_totals(t.errors, t.executions, WEEK)


@query("r11a_error_totals_scoped", _error_totals_sql(_SCOPED))
def _(t):
    return error_reports.error_totals(t.errors, t.executions, WEEK, member_scope(t))


@query("r11b_category_breakdown", f"""
SELECT error_category, count(*) AS "count" FROM errors WHERE {_ERR_WEEK} GROUP BY 1 ORDER BY "count" DESC, error_category""")
def _(t):
    return error_reports.category_breakdown(t.errors, WEEK)


@query("r11c_daily_trend", """
SELECT CAST("timestamp" AS DATE) AS day, """ + ", ".join(
    f"nullif(count(*) FILTER (error_category = '{c}'), 0) AS {c}" for c in error_reports.ALL_CATEGORIES) + f"""
FROM errors WHERE {_ERR_WEEK} GROUP BY 1 ORDER BY day""")
def _(t):
    return error_reports.daily_trend(t.errors, WEEK)


@query("r11d_workflow_health", f"""
SELECT *, CASE WHEN health_score < 80 THEN 'red' WHEN health_score < 95 THEN 'orange' ELSE 'green' END AS health_band
FROM (SELECT w.id AS workflow_id, w.name, count(*) FILTER (status = 'error') AS error_count, count(*) AS total_runs,
    floor((CAST(1 AS DOUBLE) - CAST(count(*) FILTER (status = 'error') AS DOUBLE) / count(*)) * 100 * CAST(10 AS DOUBLE)
      + CAST(0.5 AS DOUBLE)) / CAST(10 AS DOUBLE) AS health_score
  FROM execution_entity e JOIN workflow_entity w ON e.workflow_id = w.id
  WHERE {_IN_WEEK} GROUP BY 1, 2 HAVING error_count > 0)
ORDER BY health_score, workflow_id""")
def _(t):
    return error_reports.workflow_health(t.executions, t.workflows, WEEK)


@query("r11e_error_groups", f"""
, grouped AS (
  SELECT error_category, node_name, error_message AS error_summary,
    arg_max(node_type, ROW("timestamp", node_type)) AS node_type,
    count(*) AS "count", count(DISTINCT workflow_id) AS affected_workflows, min("timestamp") AS first_seen,
    max("timestamp") AS last_seen, list_sort(list(DISTINCT w.name)) AS names
  FROM errors e JOIN workflow_entity w ON e.workflow_id = w.id WHERE {_ERR_WEEK} GROUP BY 1, 2, 3)
SELECT error_category, node_name, error_summary, node_type, "count", affected_workflows, first_seen, last_seen,
  array_to_string(names, ', ') AS workflow_names,
  CASE WHEN last_seen >= TIMESTAMP '2024-01-30' THEN 'active' ELSE 'recurring' END AS status
FROM grouped
ORDER BY "count" DESC, error_category, node_name, error_summary NULLS FIRST""")
def _(t):
    groups = error_reports.error_groups(t.errors, t.workflows, WEEK, AS_OF)
    return groups.withColumn("workflow_names", F.concat_ws(", ", "workflow_names"))


@query("r12_node_distribution", """
SELECT workflow_id, node_name, count(*) AS "count" FROM errors
WHERE "timestamp" > TIMESTAMP '2024-01-24' GROUP BY 1, 2""")
def _(t):
    return error_reports.node_distribution(t.errors, AS_OF)


@query("r12_source_distribution", """
SELECT workflow_id, source_node, source_output_index, count(*) AS "count"
FROM errors WHERE source_node <> '' AND "timestamp" > TIMESTAMP '2024-01-24' GROUP BY 1, 2, 3""")
def _(t):
    return error_reports.source_distribution(t.errors, AS_OF)


@query("r12_raw_errors", """
SELECT id AS exec_id, workflow_id, node_name, node_type, error_message, error_stack, source_node,
  source_output_index AS branch, "timestamp" AS started_at FROM errors""")
def _(t):
    return error_reports.raw_errors(t.errors)


@query("r12_workflow_drilldown", """
SELECT w.name, node_name, count(*) AS "count" FROM errors e JOIN workflow_entity w ON w.id = e.workflow_id
WHERE e.workflow_id = '5' AND "timestamp" > TIMESTAMP '2024-01-24' GROUP BY 1, 2""")
def _(t):
    parts = error_reports.workflow_drilldown(t.errors, t.workflows, "5", AS_OF)
    return listing.named(parts["node_distribution"], t.workflows).select("name", "node_name", "count")


@query("r13_group_executions", """
SELECT e.id AS exec_id, "timestamp", w.name AS workflow_name
FROM errors e JOIN workflow_entity w ON e.workflow_id = w.id
WHERE "timestamp" >= TIMESTAMP '2024-01-05' AND "timestamp" <= TIMESTAMP '2024-01-31' AND error_category = 'auth'
  AND node_name = 'node_2' AND error_message = 'Not authenticated'
ORDER BY "timestamp" DESC, exec_id DESC""")
def _(t):
    return error_reports.group_executions(
        t.errors, t.workflows, category="auth", node_name="node_2", summary="Not authenticated",
        start="2024-01-05T00:00:00Z", end="2024-01-31T00:00:00Z")


_RUNS = """runs AS (SELECT o_orderkey AS id, o_orderdate AS started_at,
  CASE WHEN o_orderstatus = 'P' THEN 'failed' ELSE 'ok' END AS status,
  CAST(floor(o_totalprice * 1000) AS BIGINT) AS replica_bytes FROM orders)"""


def _runs(t):
    return t.raw("orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("started_at"),
        F.when(F.col("o_orderstatus") == "P", "failed").otherwise("ok").alias("status"),
        F.floor(F.col("o_totalprice") * 1000).alias("replica_bytes"))


@query("r14_sync_history", f"""
, {_RUNS}
SELECT *, floor(replica_bytes / CAST(1048576 AS DOUBLE) * 10 + CAST(0.5 AS DOUBLE)) / CAST(10 AS DOUBLE) AS replica_mb
FROM runs ORDER BY id DESC LIMIT 20""")
def _(t):
    return history.sync_history(_runs(t))


@query("w7_m10_keep_last", f", {_RUNS} SELECT id FROM runs WHERE id > (SELECT max(id) FROM runs) - 500")
def _(t):
    return keep_last(_runs(t), 500).select("id")


@query("r16_recent_context", """
SELECT conv_id, role, text, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations)
WHERE rn <= 3""")
def _(t):
    chat = history.recent_context(t.raw("conversations"), "conv_id", "turn", 3)
    return chat.withColumn("position", F.col("position").cast("bigint"))


@query("r16_chat_history", """
SELECT conv_id, role, text, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position
FROM conversations QUALIFY position <= 50""")
def _(t):
    chat = history.conversation_history(t.raw("conversations"), "conv_id", "turn")
    return chat.withColumn("position", F.col("position").cast("bigint"))


@query("r17_guarded_select", """
SELECT total_rows, status, n FROM (
  SELECT status, count(*) AS n FROM execution_entity GROUP BY 1),
 (SELECT count(DISTINCT status) AS total_rows FROM execution_entity)""")
def _(t):
    rows, total = history.guarded_select(
        t.spark, "SELECT status, count(*) AS n FROM execution_entity GROUP BY status ORDER BY n DESC",
        {"execution_entity": t.executions})
    return rows.withColumn("total_rows", total.scalar())
