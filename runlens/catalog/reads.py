"""Sources, sinks, predicates and joins."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens.catalog.registry import query
from runlens.functions import text, timegrid
from runlens.functions.payload import capped, trace_lookup
from runlens.operators import arrivals, care, filters, queue, settings, sync
from runlens.operators.scope import access_graph, resolve_scope
from runlens.operators.upsert import upsert
from runlens.params import metrics_range
from runlens.plans import kpi, listing, roi
from runlens.schemas import EXECUTION, WORKFLOW, coerce, conform
from runlens.session import work_path
from runlens.sources import readers
from runlens.sources.sample import AS_OF, SampleTables

USER = "7"


def member_scope(t: SampleTables):
    return resolve_scope(t.shared_workflow, t.project_relation, user_id=USER, role="global:member")


# --- sources and sinks ----------------------------------------------------------

@query("s1_workflow_snapshot", """
SELECT id, name, active, CAST(NULL AS BOOLEAN) AS is_archived, CAST(NULL AS BIGINT) AS trigger_count
FROM workflow_entity""")
def _(t):
    return conform(readers.source_workflows(t.workflows), WORKFLOW).select(
        "id", "name", "active", "is_archived", "trigger_count")


@query("s2_initial_load", """
SELECT * FROM execution_entity""")
def _(t):
    return sync.initial_load(readers.source_executions(t.executions))


@query("s3_incremental_read", """
SELECT * FROM source
WHERE id > least((SELECT max(id) FROM replica), (SELECT max(id) FROM source))
  OR (id >= (SELECT min(id) FROM replica) AND id NOT IN (SELECT id FROM replica))""")
def _(t):
    low, mark = t.replica.agg(F.min("id")).first()[0], sync.high_water(t.replica, t.source).first()["high_water"]
    blocks = arrivals.arrived(arrivals.blocks(t.spark, low, mark), t.replica, AS_OF)
    return sync.incremental(t.source, mark, arrivals.asked(blocks, AS_OF, None))


@query("s4_watermark_clamp", """
SELECT max(id) + 1000000000 AS local_max, (SELECT max(id) FROM source) AS source_max,
  least(max(id) + 1000000000, (SELECT max(id) FROM source)) AS high_water
FROM replica""")
def _(t):
    stray = t.replica.select((F.col("id") + 1_000_000_000).alias("id"))
    return sync.high_water(stray, t.source)


@query("s5_lookup_by_ids", """
SELECT * FROM source
WHERE id IN (SELECT id FROM replica WHERE status IN ('new', 'running', 'waiting'))""")
def _(t):
    return sync.lookup(t.source, sync.open_rows(t.replica))


@query("s6_size_capped_payload", """
SELECT doc_id, CAST(strlen(text) AS BIGINT) AS data_bytes,
  md5(text) AS text_digest
FROM documents""")
def _(t):
    rows = capped(t.raw("documents").select("doc_id", F.col("text").alias("data")))
    return rows.select("doc_id", "data_bytes", F.md5("data").alias("text_digest"))


@query("s7_schema_probe", """
SELECT id, workflow_id, status, started_at, stopped_at, mode, CAST(NULL AS TIMESTAMP) AS created_at,
  CAST(NULL AS BOOLEAN) AS finished, CAST(NULL AS BIGINT) AS json_size_bytes,
  CAST(NULL AS VARCHAR) AS retry_of
FROM execution_entity""")
def _(t):
    return conform(readers.source_executions(t.executions), EXECUTION).select(
        "id", "workflow_id", "status", "started_at", "stopped_at", "mode", "created_at", "finished",
        "json_size_bytes", "retry_of")


@query("s8_trace_lookup", """
SELECT id AS execution_id, workflow_id, node_name,
  coalesce(nullif(error_message, ''), 'Unknown error detail') AS message
FROM error_candidates WHERE id % 10 <> 7""")
def _(t):
    ids = t.executions.filter("status = 'error'")
    return trace_lookup(readers.payloads_for(t.payloads, t.executions, ids))


@query("s8_full_trace", """
SELECT id AS execution_id, coalesce(nullif(error_message, ''), 'Unknown error detail') AS message,
  error_message AS trace_message, error_stack AS trace_stack, node_name AS trace_node, node_type AS trace_type,
  source_node AS trace_source, CAST(id AS VARCHAR) AS trace_input, '2' AS trace_retries
FROM error_candidates WHERE id % 10 <> 7""")
def _(t):
    ids = t.executions.filter("status = 'error'")
    traces = trace_lookup(readers.payloads_for(t.payloads, t.executions, ids), full=True)

    def at(path: str, name: str):
        """A member of the trace, which is one object or a list of one."""
        return F.coalesce(*[F.get_json_object("full_error", f"${start}.{path}") for start in ("", "[0]")]).alias(name)

    frame = "executionData.nodeExecutionStack[0]"
    return traces.select(
        "execution_id", "message", at("resultData.error.message", "trace_message"), at("resultData.error.stack", "trace_stack"),
        at("resultData.error.node.name", "trace_node"), at("resultData.error.node.type", "trace_type"),
        at(f"{frame}.source.main[0].previousNode", "trace_source"), at(f"{frame}.data.row", "trace_input"),
        at("executionData.metadata.retries", "trace_retries"))


@query("s9_keyed_upsert", """
SELECT coalesce(n.workflow_id, o.workflow_id) AS workflow_id,
  CASE WHEN n.workflow_id IS NOT NULL THEN n.saved_time_seconds ELSE o.saved_time_seconds END AS saved_time_seconds,
  CASE WHEN n.workflow_id IS NOT NULL THEN n.hourly_rate ELSE o.hourly_rate END AS hourly_rate
FROM workflow_settings o FULL JOIN (
  SELECT CAST(c_custkey AS VARCHAR) AS workflow_id, CAST(c_custkey % 100 AS BIGINT) AS saved_time_seconds,
    CAST(20.0 AS DOUBLE) AS hourly_rate FROM customer WHERE c_acctbal > 0) n
ON o.workflow_id = n.workflow_id""")
def _(t):
    incoming = t.raw("customer").filter("c_acctbal > 0").select(
        F.col("c_custkey").cast("string").alias("workflow_id"),
        (F.col("c_custkey") % 100).alias("saved_time_seconds"), F.lit(20.0).alias("hourly_rate"))
    return upsert(t.settings, incoming, "workflow_id")


@query("s10_json_dump", """
SELECT id, workflow_id, error_type, error_message, error_category, http_code FROM errors""")
def _(t):
    path = work_path(t.spark, "json")
    rows = t.errors.select("id", "workflow_id", "error_type", "error_message", "error_category", "http_code")
    readers.write_json(rows, path)
    return t.spark.read.schema(rows.schema).json(path)


@query("s11_csv_extract", """
SELECT id AS exec_id, node_name, nullif(error_message, '') AS error_message,
  nullif(error_stack, '') AS error_stack, nullif(source_node, '') AS source_node FROM errors""")
def _(t):
    path = work_path(t.spark, "csv")
    rows = t.errors.select(F.col("id").alias("exec_id"), *[
        text.blank_to_null(F.col(c)).alias(c)
        for c in ("node_name", "error_message", "error_stack", "source_node")])
    readers.write_csv(rows, path)
    return readers.read_csv(t.spark, path, rows.schema)


@query("s12_access_graph", """
SELECT 'share' AS kind, workflow_id AS a, project_id AS b, role FROM shared_workflow
UNION ALL SELECT 'member', project_id, user_id, min(role) FROM project_relation GROUP BY project_id, user_id
UNION ALL SELECT 'old share', CAST(c_custkey AS VARCHAR), 'user:' || CAST(c_nationkey AS VARCHAR), 'editor' FROM customer
UNION ALL SELECT DISTINCT 'old member', 'user:' || CAST(c_nationkey AS VARCHAR), CAST(c_nationkey AS VARCHAR),
  'project:personalOwner' FROM customer
UNION ALL SELECT DISTINCT 'old project', 'user:' || CAST(c_nationkey AS VARCHAR),
  'Personal (' || CAST(c_nationkey AS VARCHAR) || ')', 'personal' FROM customer""")
def _(t):
    graph = access_graph(t.project, t.project_relation, t.shared_workflow)
    shares = t.shared_workflow.select("workflow_id", F.col("project_id").alias("user_id"),
                                      F.lit("editor").alias("role"))
    old = access_graph(None, None, shares)

    def flat(kind, df):
        a, b, c = df.columns
        return df.select(F.lit(kind).alias("kind"), F.col(a).alias("a"), F.col(b).alias("b"), F.col(c).alias("role"))

    return (flat("share", graph["shared_workflow"]).union(flat("member", graph["project_relation"]))
            .union(flat("old share", old["shared_workflow"])).union(flat("old member", old["project_relation"]))
            .union(flat("old project", old["project"])))


# --- predicates ------------------------------------------------------------------

@query("p1_p2_periods", """
SELECT id, CASE WHEN started_at >= TIMESTAMP '2024-01-24' THEN 'current' ELSE 'previous' END AS period
FROM execution_entity
WHERE started_at >= TIMESTAMP '2024-01-17' AND started_at <= TIMESTAMP '2024-01-31'""")
def _(t):
    p = metrics_range(as_of=AS_OF)
    now = t.executions.filter(filters.within("started_at", p.start, p.end))
    past = t.executions.filter(filters.before("started_at", p.prev_start, p.start))
    return now.select("id", F.lit("current").alias("period")).union(
        past.select("id", F.lit("previous").alias("period")))


@query("p4_listing_filter", """
SELECT id, status, started_at FROM execution_entity
WHERE started_at IS NOT NULL AND stopped_at IS NOT NULL AND status = 'success'
  AND started_at >= TIMESTAMP '2024-01-10' AND started_at <= TIMESTAMP '2024-01-20 12:00:00'
  AND (epoch_us(stopped_at) - epoch_us(started_at)) / 1e6 >= 30""")
def _(t):
    keep = filters.listing_filter(status="success", started_from="2024-01-10",
                                  started_to="2024-01-20T12:00:00Z", min_duration=30.0)
    return t.executions.filter(keep).select("id", "status", "started_at")


@query("p6_workflow_name", """
SELECT e.id FROM execution_entity e JOIN workflow_entity w ON e.workflow_id = w.id
WHERE w.name = 'Customer#000000005'""")
def _(t):
    return filters.for_workflow_name(t.executions, t.workflows, "Customer#000000005").select("id")


@query("p8_soft_delete", """SELECT id FROM execution_entity WHERE mode <> 'view'""")
def _(t):
    marked = t.executions.withColumn("deleted_at", F.when(F.col("mode") == "view", F.col("started_at")))
    return filters.not_deleted(marked).select("id")


@query("p9_named_source", """SELECT id, source_node FROM errors WHERE source_node <> ''""")
def _(t):
    return t.errors.filter(F.col("source_node") != "").select("id", "source_node")


@query("p10_group_key", """
SELECT id FROM errors WHERE error_message = 'something went wrong'""")
def _(t):
    return t.errors.filter(text.error_summary(F.col("error_message")) == "something went wrong").select("id")


@query("p11_due", """
SELECT id FROM replica WHERE analytics_status = 'pending'
  AND (analytics_next_attempt IS NULL OR analytics_next_attempt <= TIMESTAMP '2024-01-31')
""")
def _(t):
    return queue.due(t.replica, AS_OF)


@query("p13_search", """
SELECT id, name FROM workflow_entity WHERE contains(lower(name), '12') OR contains(lower(id), '12')""")
def _(t):
    return t.workflows.filter(filters.name_or_id_contains(" 12 ")).select("id", "name")


# --- joins ---------------------------------------------------------------------

@query("j1_named_executions", """
SELECT e.id, w.name FROM execution_entity e JOIN workflow_entity w ON e.workflow_id = w.id""")
def _(t):
    return listing.named(t.executions, t.workflows).select("id", "name")


@query("j2_settings_or_zero", """
SELECT w.id, w.name, coalesce(s.saved_time_seconds, 0) AS saved_time_seconds,
  coalesce(s.hourly_rate, 0) AS hourly_rate
FROM workflow_entity w LEFT JOIN workflow_settings s ON w.id = s.workflow_id""")
def _(t):
    return roi.with_settings(t.workflows, t.settings)


@query("j6_payload_owner", """
SELECT id AS execution_id, workflow_id, started_at FROM execution_entity WHERE status = 'error'""")
def _(t):
    rows = readers.payloads_for(t.payloads, t.executions, t.executions.filter("status = 'error'"))
    return rows.filter("data_bytes > 0").select("execution_id", "workflow_id", "started_at")


@query("j7_vanished", """
SELECT id FROM replica WHERE status IN ('new', 'running', 'waiting') AND id NOT IN (SELECT id FROM source)""")
def _(t):
    return sync.vanished(sync.open_rows(t.replica), t.source)


@query("j9_change_detection", """
SELECT s.id, r.id IS NULL AS is_new, r.id IS NULL OR r.status <> s.status AS is_changed,
  (r.id IS NULL OR r.status <> s.status) AND s.status IN ('error', 'crashed') AS needs_analytics
FROM source s LEFT JOIN replica r ON r.id = s.id""")
def _(t):
    return sync.detect_changes(t.source, t.replica).select("id", "is_new", "is_changed", "needs_analytics")


@query("j11_requested_visibility", """
SELECT CAST(o_custkey AS VARCHAR) AS workflow_id,
  CAST(o_custkey AS VARCHAR) IN (SELECT workflow_id FROM visible) AS visible
FROM (SELECT DISTINCT o_custkey FROM orders)""")
def _(t):
    ids = t.raw("orders").select(F.col("o_custkey").cast("string").alias("workflow_id")).distinct()
    return member_scope(t).allowed(ids).select("workflow_id", "visible")


@query("u1_failed_ids", """
SELECT id FROM source WHERE status = 'error' UNION SELECT id FROM replica WHERE status = 'error'""")
def _(t):
    failed = F.col("status") == "error"
    return sync.failed_ids(t.source.filter(failed), t.replica.filter(failed))


@query("c2_scoped_reads", """
SELECT 'executions' AS part, count(*) AS n FROM execution_entity WHERE workflow_id IN (SELECT workflow_id FROM visible)
UNION ALL SELECT 'errors', count(*) FROM errors WHERE workflow_id IN (SELECT workflow_id FROM visible)
UNION ALL SELECT 'workflows', count(*) FROM workflow_entity WHERE id IN (SELECT workflow_id FROM visible)""")
def _(t):
    scope = member_scope(t)

    def count(part, df, key):
        return scope.narrow(df, key).agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), "n")

    return (count("executions", t.executions, "workflow_id")
            .union(count("errors", t.errors, "workflow_id"))
            .union(count("workflows", t.workflows, "id")))


# --- scalar functions --------------------------------------------------------------

@query("f1_open_durations", """
SELECT id, (epoch_us(coalesce(stopped_at, TIMESTAMP '2024-01-31')) - epoch_us(started_at)) / 1e6 AS seconds
FROM execution_entity""")
def _(t):
    stop = F.coalesce(F.col("stopped_at"), timegrid.ts(AS_OF))
    return t.executions.select("id", timegrid.duration_seconds(F.col("started_at"), stop).alias("seconds"))


@query("f5_step_floor", """
SELECT event_id AS id, make_timestamp(epoch_us(ts) - epoch_us(ts) % 300000000) AS bucket FROM events""")
def _(t):
    return t.executions.select("id", timegrid.floor_column(F.col("started_at"), 300).alias("bucket"))


_DATE_TEXT = ("CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') || 'T10:30:00Z' "
              "WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') WHEN 2 THEN '2026-13-45' "
              "WHEN 3 THEN '0202-01-01T00:00:00Z' WHEN 4 THEN 'foo' ELSE '3000-01-01T00:00:00Z' END")


def _date_text(t: SampleTables):
    shape, day = F.col("o_orderkey") % 6, F.col("o_orderdate")
    return t.raw("orders").select(
        "o_orderkey",
        F.when(shape == 0, F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T10:30:00Z")))
        .when(shape == 1, F.date_format(day, "yyyy-MM-dd HH:mm:ss"))
        .when(shape == 2, "2026-13-45").when(shape == 3, "0202-01-01T00:00:00Z")
        .when(shape == 4, "foo").otherwise("3000-01-01T00:00:00Z").alias("value"))


@query("f9_safe_dates", """
SELECT o_orderkey, CASE WHEN o_orderdate >= TIMESTAMP '2000-01-01' THEN CASE o_orderkey % 6
  WHEN 0 THEN date_trunc('day', o_orderdate) + INTERVAL 10 HOUR + INTERVAL 30 MINUTE
  WHEN 1 THEN date_trunc('second', o_orderdate) END END AS parsed
FROM orders""")
def _(t):
    return _date_text(t).select("o_orderkey", text.safe_timestamp(F.col("value")).alias("parsed"))


@query("f10_render_time", """
SELECT event_id AS id, strftime(ts + INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S') AS shown FROM events""")
def _(t):
    return t.executions.select("id", text.render_time(
        F.col("started_at"), "Europe/Athens", "yyyy-MM-dd HH:mm:ss").alias("shown"))


@query("f16_saved_time_estimate", """
SELECT w.id, CAST(floor((CAST(w.id AS BIGINT) % 20)
    * CASE CAST(w.id AS BIGINT) % 3 WHEN 0 THEN 30.0 WHEN 1 THEN CAST(30 AS DOUBLE) / 7 ELSE 1.0 END
    * (CAST(w.id AS BIGINT) % 9) * CASE WHEN CAST(w.id AS BIGINT) % 2 = 0 THEN 3600 ELSE 60 END
    / greatest(1, coalesce(n, 0)) + 0.5) AS BIGINT) AS saved_seconds
FROM workflow_entity w
LEFT JOIN (SELECT workflow_id, count(*) AS n FROM execution_entity WHERE status = 'success'
           AND started_at >= TIMESTAMP '2024-01-01' GROUP BY 1) e ON e.workflow_id = w.id""")
def _(t):
    rows = roi.roi_settings(t.workflows, t.settings, t.executions, AS_OF)
    i = F.col("id").cast("bigint")
    per = F.when(i % 3 == 0, "day").when(i % 3 == 1, "week").otherwise("month")
    unit = F.when(i % 2 == 0, "hours").otherwise("minutes")
    return rows.select("id", roi.saved_seconds_estimate(
        i % 20, per, i % 9, unit, F.col("executions_30d")).alias("saved_seconds"))


@query("f17_bigint_text", """
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderkey WHEN 1 THEN -o_orderkey END AS coerced FROM orders""")
def _(t):
    digits = F.col("o_orderkey").cast("string")
    raw = (F.when(F.col("o_orderkey") % 4 == 0, digits)
           .when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit("-"), digits))
           .when(F.col("o_orderkey") % 4 == 2, F.concat(F.lit(" "), digits))
           .otherwise(F.concat(digits, F.lit("x"))))
    rows = t.raw("orders").select("o_orderkey", raw.alias("raw"))
    return rows.select("o_orderkey", coerce(F.col("raw"), T.StringType(), T.LongType()).alias("coerced"))


@query("f18_hashed_keys", """
SELECT c_custkey, substr(sha256('login-account:' || '10.0.0.' || CAST(c_custkey % 256 AS VARCHAR) || '|'
  || substr(sha256(lower(c_name)), 1, 16)), 1, 32) AS key FROM customer""")
def _(t):
    address = F.concat(F.lit("10.0.0."), (F.col("c_custkey") % 256).cast("string"))
    padded = F.concat(F.lit("  "), F.col("c_name"), F.lit("\n"))
    return t.raw("customer").select("c_custkey", text.hashed_key(
        "login-account", text.account_key(address, padded)).alias("key"))


@query("f19_backoff", """
SELECT id, TIMESTAMP '2024-01-31' + to_minutes(CAST(least(pow(2, id % 12), 360) AS BIGINT)) AS next_attempt
FROM execution_entity""")
def _(t):
    return t.executions.select("id", queue.next_attempt(F.col("id") % 12, AS_OF).alias("next_attempt"))


@query("f22_redacted_log", """
SELECT event_id AS id, CASE event_id % 3
  WHEN 0 THEN '{"user":' || CAST(user_id AS VARCHAR) || ',"Token":"[redacted]","kind":"' || event_type || '"}'
  WHEN 1 THEN '{"user":' || CAST(user_id AS VARCHAR) || ',"nested":{"apiKey":"[redacted]","keep":"' || event_type
    || '"},"list":[{"password":"[redacted]"}]}'
  ELSE '{"user":' || CAST(user_id AS VARCHAR) || ',"kind":"' || event_type || '"}' END AS line
FROM events""")
def _(t):
    user, kind = F.col("user_id").cast("string"), F.col("event_type")
    head = F.concat(F.lit('{"user":'), user)
    line = (
        F.when(F.col("event_id") % 3 == 0, F.concat(head, F.lit(',"Token":"a\\"b'), user, F.lit('","kind":"'), kind, F.lit('"}')))
        .when(F.col("event_id") % 3 == 1, F.concat(head, F.lit(',"nested":{"apiKey":{"deep":1},"keep":"'), kind,
                                                   F.lit('"},"list":[{"password":"p"}]}')))
        .otherwise(F.concat(head, F.lit(',"kind":"'), kind, F.lit('"}'))))
    return t.raw("events").select(F.col("event_id").alias("id"), text.redact_json(line).alias("line"))


# --- ordering helpers --------------------------------------------------------------

@query("t6_settings_by_time", """
SELECT id, name, saved_time_seconds FROM (
  SELECT w.id, w.name, coalesce(s.saved_time_seconds, 0) AS saved_time_seconds
  FROM workflow_entity w LEFT JOIN workflow_settings s ON w.id = s.workflow_id)
WHERE contains(lower(name), '7') OR contains(lower(id), '7')
ORDER BY saved_time_seconds DESC, id""")
def _(t):
    rows = roi.search_settings(roi.with_settings(t.workflows, t.settings), "7")
    return roi.sort_settings(rows, "time_desc").select("id", "name", "saved_time_seconds")


def _ordered(mode: str, order: str) -> None:
    @query(f"t6_settings_{mode}", f"""
SELECT w.id, w.name, coalesce(s.saved_time_seconds, 0) AS saved_time_seconds, count(e.id) AS execution_count
FROM workflow_entity w LEFT JOIN workflow_settings s ON w.id = s.workflow_id
LEFT JOIN execution_entity e ON w.id = e.workflow_id AND e.status = 'success'
GROUP BY 1, 2, 3 ORDER BY {order}, w.id""")
    def _(t):
        rows = roi.roi_settings(t.workflows, t.settings, t.executions, AS_OF)
        return roi.sort_settings(rows, mode).select("id", "name", "saved_time_seconds", "execution_count")


for _mode, _order in (("name_asc", "w.name"), ("name_desc", "w.name DESC"), ("execs_desc", "execution_count DESC")):
    _ordered(_mode, _order)


@query("p5_bad_status", """
SELECT event_id AS id, CASE WHEN event_type NOT IN ('success', 'error', 'canceled', 'crashed', 'running')
  THEN 'no such status' END AS reject_reason FROM events""")
def _(t):
    asked = t.raw("events").select(F.col("event_id").alias("id"), F.col("event_type").alias("status"))
    return settings.check_statuses(asked).select("id", "reject_reason")


def _member(name: str, expected: str, **who) -> None:
    @query(name, f"SELECT workflow_id, count(*) AS executions FROM execution_entity WHERE {expected} GROUP BY 1")
    def _(t):
        scope = resolve_scope(t.shared_workflow, t.project_relation, **who)
        return scope.narrow(t.executions, "workflow_id").groupBy("workflow_id").agg(F.count("*").alias("executions"))


_member("c1_scope_of_owner", "true", user_id="nobody", role="global:owner")
_member("c1_scope_of_member", "workflow_id IN (SELECT workflow_id FROM visible)", user_id="7")
_member("c1_scope_of_stranger", "false", user_id="nobody")


@query("c1_scope_without_memberships", "SELECT count(*) AS executions FROM execution_entity")
def _(t):
    scope = resolve_scope(t.shared_workflow, t.project_relation.limit(0), user_id="nobody")
    return scope.narrow(t.executions, "workflow_id").agg(F.count("*").alias("executions"))


@query("r15_completeness_of_equals", """
SELECT count(*) AS source_rows, count(*) AS copy_rows, min(started_at) AS source_first, min(started_at) AS copy_first,
  true AS same_count, true AS same_content FROM replica""")
def _(t):
    return care.completeness(t.replica, t.replica.repartition(3), ["id", "workflow_id", "status"])


@query("t7_picker", """
SELECT w.id AS workflow_id, w.name AS workflow_name, count(*) AS execution_count
FROM execution_entity e JOIN workflow_entity w ON e.workflow_id = w.id
WHERE e.started_at >= TIMESTAMP '2024-01-24' AND e.started_at <= TIMESTAMP '2024-01-31'
GROUP BY 1, 2 ORDER BY execution_count DESC, workflow_id LIMIT 15""")
def _(t):
    return listing.workflow_picker(kpi.workflow_share(t.executions, t.workflows, metrics_range(as_of=AS_OF)))


@query("m14_date_pairs", """
SELECT o_orderkey, CASE
  WHEN (o_orderkey % 5 = 0) <> (o_orderkey % 7 = 0) THEN 'bounds must be given together'
  WHEN o_orderkey % 5 = 0 THEN NULL
  WHEN o_orderkey % 6 > 1 OR o_orderdate < TIMESTAMP '2000-01-01' THEN 'start is not a valid date'
  WHEN o_orderkey % 2 = 0 AND o_orderkey % 6 = 0 AND date_trunc('day', o_orderdate) + INTERVAL 630 MINUTE > TIMESTAMP '2001-01-01'
    THEN 'start must be before end'
  WHEN o_orderkey % 6 = 1 AND o_orderdate > TIMESTAMP '2001-01-01' THEN 'start must be before end'
  END AS reject_reason
FROM orders""")
def _(t):
    key = F.col("o_orderkey")
    rows = _date_text(t).select(
        "o_orderkey", F.when(key % 5 != 0, F.col("value")).alias("start_date"),
        F.when(key % 7 != 0, "2001-01-01T00:00:00Z").otherwise("").alias("end_date"))
    return settings.check_date_pairs(rows).select("o_orderkey", "reject_reason")


@query("m14_setting_entries", """
SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'key is required' WHEN c_custkey % 4 = 1 THEN 'unknown key'
  WHEN c_custkey % 8 < 4 THEN 'not a time zone' END AS reject_reason FROM customer""")
def _(t):
    key = F.col("c_custkey")
    rows = t.raw("customer").select(
        "c_custkey",
        F.when(key % 4 == 0, "").when(key % 4 == 1, F.col("c_name")).otherwise("timezone").alias("key"),
        F.when(key % 8 < 4, "Mars/Olympus_Mons").otherwise("Europe/Athens").alias("value"))
    return settings.check_settings(rows, ["Europe/Athens", "UTC"]).select("c_custkey", "reject_reason")


@query("r15_completeness", """
SELECT (SELECT count(*) FROM source) AS source_rows, (SELECT count(*) FROM replica) AS copy_rows,
  (SELECT min(started_at) FROM source) AS source_first, (SELECT min(started_at) FROM replica) AS copy_first,
  (SELECT count(*) FROM source) = (SELECT count(*) FROM replica) AS same_count, false AS same_content""")
def _(t):
    return care.completeness(t.source, t.replica, ["id", "workflow_id", "status"])
