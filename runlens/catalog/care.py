"""Upserts, queue, retention, repairs and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlens.catalog.reads import member_scope
from runlens.catalog.registry import query
from runlens.functions.payload import extract
from runlens.functions.timegrid import floor_column
from runlens.operators import accesslog, care, queue, settings, sync
from runlens.operators.upsert import (
    different_rows,
    ERROR_RULES,
    EXECUTION_RULES,
    insert_missing,
    latest_by_key,
    upsert,
)
from runlens.plans import volume
from runlens.sources.readers import payloads_for
from runlens.sources.sample import AS_OF


@query("m1_execution_upsert", """
SELECT coalesce(r.id, s.id) AS id, CASE WHEN r.id IS NOT NULL THEN r.workflow_id ELSE s.workflow_id END AS workflow_id,
  CASE WHEN s.id IS NOT NULL THEN s.status ELSE r.status END AS status,
  CASE WHEN s.id IS NOT NULL THEN coalesce(s.started_at, r.started_at) ELSE r.started_at END AS started_at,
  CASE WHEN s.id IS NOT NULL THEN s.stopped_at ELSE r.stopped_at END AS stopped_at,
  CASE WHEN s.id IS NOT NULL THEN s.mode ELSE r.mode END AS mode,
  CASE WHEN s.id IS NULL THEN r.missing_since END AS missing_since,
  r.analytics_status, r.analytics_attempts, r.analytics_next_attempt
FROM replica r FULL JOIN source s ON r.id = s.id""")
def _(t):
    return upsert(t.replica, t.source, "id", EXECUTION_RULES)


@query("m1_latest_delivery", """
SELECT user_id AS id, status, started_at FROM (
  SELECT CAST(workflow_id AS BIGINT) AS user_id, status, started_at,
    row_number() OVER (PARTITION BY workflow_id ORDER BY started_at DESC, id DESC) AS rn FROM execution_entity)
WHERE rn = 1""")
def _(t):
    deliveries = t.executions.select(F.col("workflow_id").cast("bigint").alias("id"), "status", "started_at",
                                     F.col("id").alias("seq"))
    return latest_by_key(deliveries, "id", ["started_at", "seq"]).select("id", "status", "started_at")


@query("m2_workflow_upsert", """
SELECT coalesce(o.id, n.id) AS id, coalesce(n.name, o.name) AS name, coalesce(n.active, o.active) AS active
FROM (SELECT CAST(c_custkey AS VARCHAR) AS id, 'old ' || c_name AS name, c_acctbal < 0 AS active
      FROM customer WHERE c_mktsegment <> 'BUILDING') o
FULL JOIN (SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, c_acctbal >= 0 AS active
      FROM customer WHERE c_mktsegment <> 'MACHINERY') n ON o.id = n.id""")
def _(t):
    customers = t.raw("customer")
    key, balance = F.col("c_custkey").cast("string").alias("id"), F.col("c_acctbal")
    old = customers.filter("c_mktsegment <> 'BUILDING'").select(
        key, F.concat(F.lit("old "), F.col("c_name")).alias("name"), (balance < 0).alias("active"))
    new = customers.filter("c_mktsegment <> 'MACHINERY'").select(
        key, F.col("c_name").alias("name"), (balance >= 0).alias("active"))
    return upsert(old, new, "id")


@query("m3_refresh_open", """
SELECT r.id, CASE WHEN s.id IS NOT NULL THEN s.status
    WHEN r.missing_since <= TIMESTAMP '2024-01-30 23:00:00' THEN 'unknown' ELSE r.status END AS status,
  coalesce(r.started_at, s.started_at) AS started_at,
  CASE WHEN s.id IS NOT NULL THEN s.stopped_at ELSE r.stopped_at END AS stopped_at,
  CASE WHEN s.id IS NOT NULL THEN s.mode ELSE r.mode END AS mode,
  CASE WHEN s.id IS NULL THEN coalesce(r.missing_since, TIMESTAMP '2024-01-31') END AS missing_since
FROM replica r LEFT JOIN source s ON r.id = s.id WHERE r.status IN ('new', 'running', 'waiting')""")
def _(t):
    return sync.refresh_open(t.replica, t.source, AS_OF).select(
        "id", "status", "started_at", "stopped_at", "mode", "missing_since")


_CACHE = """cached AS (
  SELECT to_timestamp(epoch_us(started_at) // 300000000 * 300) AT TIME ZONE 'UTC' AS "timestamp",
    count(*) AS started_count FROM source WHERE started_at >= TIMESTAMP '2024-01-29' GROUP BY 1)"""
_SERIES = """series AS (
  SELECT TIMESTAMP '2024-01-30 00:05:00' + to_seconds(g.i * 300) AS "timestamp", coalesce(n, 0) AS started_count
  FROM (SELECT unnest(generate_series(CAST(0 AS BIGINT), 287)) AS i) g LEFT JOIN (
    SELECT (epoch_us(started_at) - epoch_us(TIMESTAMP '2024-01-30 00:05:00')) // 300000000 AS i, count(*) AS n
    FROM execution_entity WHERE started_at >= TIMESTAMP '2024-01-30 00:05:00' GROUP BY 1) c ON c.i = g.i)"""


def _cached(t):
    """A cache counted before some executions were known."""
    rows = t.source.filter(F.col("started_at") >= F.lit("2024-01-29").cast("timestamp"))
    return rows.groupBy(floor_column(F.col("started_at"), volume.STEP_SECONDS).alias("timestamp")).agg(F.count("*").alias("started_count"))


@query("m5_changed_buckets", f"""
, {_CACHE}, {_SERIES}
SELECT s."timestamp", s.started_count FROM series s LEFT JOIN cached c ON c."timestamp" = s."timestamp"
WHERE c.started_count IS DISTINCT FROM s.started_count""")
def _(t):
    return volume.changed_buckets(t.executions, _cached(t), AS_OF)


@query("m5_refreshed_cache", f", {_SERIES} SELECT * FROM series")
def _(t):
    return volume.refreshed_cache(t.executions, _cached(t), AS_OF)


@query("m5_merged_deltas", f"""
, {_SERIES.replace("execution_entity", "source")} SELECT * FROM series""")
def _(t):
    """The cache of an earlier copy, brought up to date by what differs between the copies alone."""
    old = t.replica.select("id", "started_at")
    new = t.source.select("id", "started_at")
    cache = volume.volume_series(old, volume.rolling_origin(AS_OF))
    gone = old.join(new, "id", "left_anti")
    changed = different_rows(old, new)
    return volume.merged_cache(cache, old.join(changed, "id", "left_semi").union(gone), changed, AS_OF)


@query("m6_enqueue", """
SELECT r.id, CASE WHEN s.id IS NOT NULL THEN 'pending' ELSE analytics_status END AS analytics_status,
  CASE WHEN s.id IS NOT NULL THEN 0 ELSE analytics_attempts END AS analytics_attempts,
  CASE WHEN s.id IS NULL THEN analytics_next_attempt END AS analytics_next_attempt
FROM replica r LEFT JOIN (SELECT id FROM source WHERE status = 'error') s ON s.id = r.id""")
def _(t):
    failed = t.source.filter("status = 'error'")
    return queue.enqueue(t.replica, failed.union(failed)).select("id", "analytics_status", "analytics_attempts", "analytics_next_attempt")


@query("m6_outcomes", """
SELECT id, CASE WHEN id NOT IN (SELECT id FROM source) THEN 'vanished' WHEN id % 10 = 7 THEN 'retry'
  ELSE 'done' END AS outcome
FROM error_candidates""")
def _(t):
    asked = t.executions.filter("status = 'error'").select("id")
    read = payloads_for(t.payloads, t.source, asked)
    return queue.outcomes(asked, read, extract(read, with_subtrees=False))


@query("m6_settle", """
SELECT id,
  CASE WHEN o = 'done' THEN 'done' WHEN o IN ('vanished', 'oversized') THEN 'failed'
       WHEN o = 'retry' AND analytics_attempts + 1 >= 5 THEN 'failed' ELSE analytics_status END AS analytics_status,
  CASE WHEN o = 'retry' THEN analytics_attempts + 1 ELSE analytics_attempts END AS analytics_attempts,
  CASE WHEN o = 'done' THEN NULL
       WHEN o = 'retry' AND analytics_attempts + 1 < 5
         THEN TIMESTAMP '2024-01-31' + to_minutes(CAST(least(pow(2, analytics_attempts + 1), 360) AS BIGINT))
       ELSE analytics_next_attempt END AS analytics_next_attempt
FROM (SELECT r.*, CASE e.mode WHEN 'click' THEN 'done' WHEN 'error' THEN 'retry' WHEN 'view' THEN 'vanished'
        WHEN 'purchase' THEN 'oversized' END AS o FROM replica r JOIN execution_entity e ON e.id = r.id)""")
def _(t):
    mode = F.col("mode")
    kinds = (F.when(mode == "click", queue.DONE).when(mode == "error", queue.RETRY)
             .when(mode == "view", queue.VANISHED).when(mode == "purchase", queue.OVERSIZED))
    results = t.executions.select("id", kinds.alias("outcome")).filter("outcome is not null")
    return queue.settle(t.replica, results, AS_OF).select(
        "id", "analytics_status", "analytics_attempts", "analytics_next_attempt")


@query("m7_error_upsert", """
SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NOT NULL THEN o.workflow_id ELSE n.workflow_id END AS workflow_id,
  CASE WHEN n.id IS NOT NULL THEN n.error_message ELSE o.error_message END AS error_message,
  CASE WHEN n.id IS NOT NULL THEN n.error_category ELSE o.error_category END AS error_category,
  coalesce(n.http_code, o.http_code) AS http_code,
  CASE WHEN o.id IS NOT NULL THEN o."timestamp" ELSE n."timestamp" END AS "timestamp"
FROM (SELECT id, 'w' AS workflow_id, 'old' AS error_message, 'unknown' AS error_category, CAST(418 AS BIGINT) AS http_code,
        TIMESTAMP '2024-01-01' AS "timestamp" FROM errors WHERE error_category <> 'auth') o
FULL JOIN (SELECT * FROM errors WHERE error_category <> 'unknown') n ON o.id = n.id""")
def _(t):
    columns = ["id", "workflow_id", "error_message", "error_category", "http_code", "timestamp"]
    old = t.errors.filter("error_category <> 'auth'").select(
        "id", F.lit("w").alias("workflow_id"), F.lit("old").alias("error_message"),
        F.lit("unknown").alias("error_category"), F.lit(418).cast("bigint").alias("http_code"),
        F.lit("2024-01-01").cast("timestamp").alias("timestamp"))
    return upsert(old, t.errors.filter("error_category <> 'unknown'").select(columns), "id", ERROR_RULES)


def _detailed(t):
    return t.errors.withColumn("input_data", F.when(F.col("id") % 2 == 0, "{}"))


@query("m8_expired_detail", """
SELECT id, CASE WHEN "timestamp" >= TIMESTAMP '2024-01-21' AND id % 2 = 0 THEN '{}' END AS input_data,
  CASE WHEN "timestamp" >= TIMESTAMP '2024-01-11' THEN error_stack END AS error_stack FROM errors""")
def _(t):
    return care.expire_detail(_detailed(t), AS_OF, 10, "20").select("id", "input_data", "error_stack")


@query("m8_expired_counts", """
SELECT count(*) FILTER ("timestamp" < TIMESTAMP '2024-01-21' AND id % 2 = 0) AS purged_input,
  CAST(0 AS BIGINT) AS purged_stack FROM errors""")
def _(t):
    return care.expired_counts(_detailed(t), AS_OF, 10, "typo")


@query("m9_backfill", """
SELECT r.id, CASE WHEN r.mode IS NULL THEN s.mode ELSE r.mode END AS mode
FROM replica r LEFT JOIN source s ON r.id = s.id""")
def _(t):
    return sync.backfill(t.replica, t.source, ["mode"]).select("id", "mode")


@query("m9_backfill_chunk", "SELECT id FROM replica WHERE id > 100 AND mode IS NULL ORDER BY id")
def _(t):
    return sync.backfill_chunk(t.replica, 100)


@query("m11_repair", """
SELECT id, CASE WHEN started_at IS NOT NULL AND stopped_at IS NULL AND status IN ('new', 'running', 'waiting')
    THEN 'crashed' ELSE status END AS status, coalesce(started_at, stopped_at) AS started_at, stopped_at
FROM replica WHERE started_at IS NOT NULL OR stopped_at IS NOT NULL""")
def _(t):
    return care.repair(t.replica).select("id", "status", "started_at", "stopped_at")


@query("m11_repair_survey", """
SELECT count(*) FILTER (started_at IS NULL AND stopped_at IS NULL) AS empty_rows,
  count(*) FILTER (started_at IS NULL AND stopped_at IS NOT NULL) AS salvageable_rows,
  count(*) FILTER (started_at IS NOT NULL AND stopped_at IS NULL) AS never_stopped_rows,
  count(*) FILTER (started_at IS NOT NULL AND stopped_at IS NULL AND status IN ('new', 'running', 'waiting')) AS stuck_rows
FROM replica""")
def _(t):
    return care.repair_survey(t.replica)


@query("m12_seed_queue", """
SELECT id, CASE WHEN status IN ('error', 'crashed') THEN
  CASE WHEN EXISTS (SELECT 1 FROM errors a WHERE a.id = e.id AND a.error_category <> 'unparsed') THEN 'done' ELSE 'pending' END
  END AS analytics_status FROM execution_entity e""")
def _(t):
    bare = t.executions.withColumn("analytics_status", F.lit(None).cast("string"))
    return sync.seed_queue(bare, t.errors.filter("error_category <> 'unparsed'")).select("id", "analytics_status")


_ENTRIES = """entries AS (SELECT CAST(p_partkey AS VARCHAR) AS workflow_id, p_retailprice * 50 AS saved_time_seconds,
  CASE WHEN p_size % 7 <> 0 THEN (p_size - 10) * CAST(4000 AS DOUBLE) END AS hourly_rate FROM part)"""


def _entries(t):
    return t.raw("part").select(
        F.col("p_partkey").cast("string").alias("workflow_id"),
        (F.col("p_retailprice") * 50).alias("saved_time_seconds"),
        F.when(F.col("p_size") % 7 != 0, (F.col("p_size") - 10) * F.lit(4000.0)).alias("hourly_rate"))


@query("m13_checked_settings", f"""
, {_ENTRIES}
SELECT workflow_id, CASE
  WHEN saved_time_seconds < 0 OR saved_time_seconds > 86400 THEN 'saved_time_seconds out of range'
  WHEN coalesce(hourly_rate, 0) < 0 OR coalesce(hourly_rate, 0) > 100000 THEN 'hourly_rate out of range'
  WHEN workflow_id NOT IN (SELECT id FROM workflow_entity) OR workflow_id NOT IN (SELECT workflow_id FROM visible)
    THEN 'unknown workflow' END AS reject_reason
FROM entries""")
def _(t):
    return settings.check_roi_entries(_entries(t), t.workflows, member_scope(t)).select("workflow_id", "reject_reason")


_REQUEST = """request AS (
  SELECT row_number() OVER (ORDER BY p_partkey) AS position, CAST(p_partkey % 60 AS VARCHAR) AS workflow_id,
    p_size + CAST(0.5 AS DOUBLE) AS saved_time_seconds,
    CASE WHEN p_size % 7 <> 0 THEN CAST(p_size AS DOUBLE) END AS hourly_rate
  FROM part WHERE p_partkey % 60 <> 0)"""


@query("m13_updated_settings", f"""
, {_REQUEST}, last_entries AS (
  SELECT workflow_id, saved_time_seconds, coalesce(hourly_rate, 0) AS hourly_rate FROM request
  QUALIFY row_number() OVER (PARTITION BY workflow_id ORDER BY position DESC) = 1)
SELECT coalesce(n.workflow_id, o.workflow_id) AS workflow_id,
  coalesce(n.saved_time_seconds, CAST(o.saved_time_seconds AS DOUBLE)) AS saved_time_seconds,
  coalesce(n.hourly_rate, o.hourly_rate) AS hourly_rate
FROM workflow_settings o FULL JOIN last_entries n ON o.workflow_id = n.workflow_id""")
def _(t):
    key = F.col("p_partkey")
    request = t.raw("part").filter(key % 60 != 0).select(
        key.alias("position"), (key % 60).cast("string").alias("workflow_id"),
        (F.col("p_size") + F.lit(0.5)).alias("saved_time_seconds"),
        F.when(F.col("p_size") % 7 != 0, F.col("p_size").cast("double")).alias("hourly_rate"))
    current = t.settings.withColumn("saved_time_seconds", F.col("saved_time_seconds").cast("double"))
    return settings.update_roi_settings(current, request, t.workflows)


@query("m15_carried_over", f"""
, {_CACHE}, {_SERIES}
SELECT * FROM series UNION ALL
SELECT * FROM cached WHERE "timestamp" NOT IN (SELECT "timestamp" FROM series)""")
def _(t):
    fresh = volume.volume_series(t.executions, volume.rolling_origin(AS_OF))
    return insert_missing(fresh, _cached(t), "timestamp")


@query("m17_severity", """
SELECT event_id AS id, CASE WHEN event_type = 'error' OR value > 400 THEN 'error' WHEN event_type = 'signup' THEN 'warn'
  WHEN value * 20 >= 2000 THEN 'warn' ELSE 'info' END AS level FROM events""")
def _(t):
    status = F.when(F.col("event_type") == "error", 503).when(F.col("event_type") == "signup", 404).otherwise(200)
    return t.raw("events").select(
        F.col("event_id").alias("id"),
        accesslog.severity(status, F.col("value") > 400, F.col("value") * 20).alias("level"))
