"""Golden results over the forty-execution seed, and invariants between reports."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fixed import AS_OF, rows
from runlens import params
from runlens.operators.scope import Scope, resolve_scope
from runlens.params import BadRequest
from runlens.plans import error_reports, history, kpi, listing, roi, volume

WEEK = params.metrics_range(as_of=AS_OF)
SCHEMA = "id long, workflow_id string, status string, started_at timestamp, stopped_at timestamp"


def test_seed_totals(spark, seed):
    executions, workflows = seed
    summary = kpi.kpi_summary(executions, workflows, WEEK).first()
    assert (summary.total, summary.error, summary.avg_duration) == (40, 8, 2.5)
    assert (summary.trend_total_pct, summary.trend_error_pct) == (100.0, 100.0)
    assert rows(kpi.workflow_share(executions, workflows, WEEK), "workflow_name", "execution_count", "percentage") == [
        ("Alpha", 20, 50.0), ("Beta", 20, 50.0)]
    assert listing.execution_listing(executions, workflows, limit=50).count() == 40
    assert listing.slowest_workflows(executions, workflows, AS_OF).count() == 2
    settings = spark.createDataFrame([("wf-a", 60, 30.0)], "workflow_id string, saved_time_seconds long, hourly_rate double")
    per_workflow = roi.roi_per_workflow(executions, workflows, settings, as_of=AS_OF)
    totals = roi.roi_totals(per_workflow).first()
    assert (totals.total_executions, totals.total_time_saved_seconds, totals.total_money_saved) == (32, 960, 8.0)
    assert roi.roi_top(per_workflow).count() == 1
    assert roi.roi_settings(workflows, settings, executions, AS_OF).count() == 2


def test_chart_and_details_agree(seed):
    executions, workflows = seed
    start = AS_OF - dt.timedelta(hours=3)
    series = volume.execution_volume(executions, None, AS_OF, start, AS_OF).collect()
    assert len(series) == 288 and sum(r.started_count for r in series) == 40
    filled = [r for r in series if r.started_count]
    assert filled
    for r in filled[:5]:
        details = volume.volume_details(executions, workflows, r.timestamp, AS_OF).collect()
        assert len(details) == r.started_count
        assert all(d.started_at >= r.timestamp for d in details)


def test_timeline_splits_by_success_only(spark):
    at = AS_OF - dt.timedelta(hours=1)
    data = [(i, "w", s, at, None) for i, s in enumerate(["success", "error", "canceled", "running", None])]
    executions = spark.createDataFrame(data, SCHEMA)
    workflows = spark.createDataFrame([], "id string, name string")
    timeline = kpi.status_timeline(executions, workflows, WEEK)
    assert timeline.count() == 8
    assert tuple(timeline.agg(F.sum("success_count"), F.sum("error_count")).first()) == (1, 3)


def test_boundary_opens_the_next_bucket(spark):
    origin = dt.datetime(2026, 8, 20, tzinfo=dt.timezone.utc)
    edges = [(i, "w", "success", origin + dt.timedelta(minutes=5 * i), None) for i in range(289)]
    series = volume.volume_series(spark.createDataFrame(edges, SCHEMA), origin).collect()
    assert [r.started_count for r in series] == [1] * 288


@pytest.mark.parametrize("end, forecast", [
    ("2026-08-20T12:30:00", 34), ("2026-08-20T12:04:00", 20), ("2026-08-20T12:59:00", 20), ("2026-08-20T12:00:00", None)])
def test_forecast_of_the_bucket_in_progress(spark, end, forecast):
    r = params.metrics_range("2026-08-20T08:00:00", end, as_of=AS_OF)
    data = [(b, None, c, 0) for b, c in zip(range(r.bucket_count), [5, 5, 20, 36, 20])]
    timeline = spark.createDataFrame(data, "bucket_idx long, time_val timestamp, success_count long, error_count long")
    last = kpi.with_forecast(timeline, r).orderBy(F.desc("bucket_idx")).first()
    # (20 * 2 + (36 + 20) / 2) / 2
    assert forecast is None or last.success_count == forecast


def test_pareto_keeps_zero_shares_out_of_the_running_sum(spark):
    data = [("a", "A", 8000, 80.0), ("b", "B", 1500, 15.0), ("c", "C", 499, 4.99), ("d", "D", 1, 0.0)]
    shares = spark.createDataFrame(data, "workflow_id string, workflow_name string, execution_count long, percentage double")
    assert rows(kpi.pareto(shares), "label", "execution_count") == [("A", 8000), ("B", 1500), ("Rest Workflows", 500)]
    tiny = shares.withColumn("percentage", F.lit(0.0))
    assert kpi.pareto(tiny).count() == 4


def test_two_workflows_with_one_name_stay_apart(spark):
    at = AS_OF - dt.timedelta(hours=1)
    executions = spark.createDataFrame([(1, "x", "error", at, at), (2, "y", "error", at, at), (3, "zz", "error", at, at)], SCHEMA)
    workflows = spark.createDataFrame([("x", "Same"), ("y", "Same")], "id string, name string")
    assert rows(kpi.workflow_share(executions, workflows, WEEK), "workflow_id", "percentage") == [("x", 50.0), ("y", 50.0)]
    assert kpi.kpi_summary(executions, workflows, WEEK).first().total == 3
    assert kpi.kpi_summary(executions, workflows, WEEK, "Same").first().total == 2
    assert rows(listing.error_hotspots(executions, workflows, AS_OF), "workflow_id", "error_rate") == [("x", 100.0), ("y", 100.0)]


def test_empty_input(spark):
    executions = spark.createDataFrame([], SCHEMA)
    workflows = spark.createDataFrame([], "id string, name string")
    s = kpi.kpi_summary(executions, workflows, WEEK).first()
    assert (s.total, s.error, s.avg_duration, s.trend_total_pct) == (0, 0, None, 0.0)
    assert kpi.workflow_share(executions, workflows, WEEK).count() == 0
    assert kpi.first_execution_date(executions).first().first_date is None


def test_bad_requests(seed):
    executions, workflows = seed
    with pytest.raises(BadRequest):
        listing.execution_listing(executions, workflows, status="not-a-status")
    with pytest.raises(BadRequest):
        listing.execution_listing(executions, workflows, started_from="foo")
    with pytest.raises(BadRequest):
        volume.volume_details(executions, workflows, "nonsense", AS_OF)
    with pytest.raises(BadRequest):
        error_reports.group_executions(executions, workflows, category="", node_name="n", summary="s", start="a", end="b")


def test_paging_by_offset_and_by_key_agree(seed):
    executions, workflows = seed
    whole = [r.exec_id for r in listing.execution_listing(executions, workflows, limit=40).collect()]
    by_offset = [r.exec_id for r in listing.execution_listing(executions, workflows, limit=10, offset=10).collect()]
    first = listing.execution_listing(executions, workflows, limit=10).collect()[-1]
    by_key = [r.exec_id for r in listing.execution_listing(
        executions, workflows, limit=10, after=(first.started_at.astimezone(dt.timezone.utc), first.exec_id)).collect()]
    assert whole[10:20] == by_offset == by_key


def test_scope(spark, seed):
    executions, workflows = seed
    shares = spark.createDataFrame([("wf-a", "p1", "r"), ("wf-a", "p2", "r")], "workflow_id string, project_id string, role string")
    members = spark.createDataFrame([("p1", "u1", "r"), ("p2", "u1", "r")], "project_id string, user_id string, role string")
    nobody = members.filter("false")
    owner = resolve_scope(shares, members, user_id="u9", role="global:owner")
    open_to_all = resolve_scope(shares, nobody, user_id="u1", role="global:member")
    u1 = resolve_scope(shares, members, user_id="u1")
    stranger = resolve_scope(shares, members, user_id="u9")
    assert (owner.restricted, open_to_all.restricted, u1.restricted) == (False, False, True)

    def total(scope: Scope) -> int:
        return kpi.kpi_summary(executions, workflows, WEEK, scope=scope).first().total

    assert [total(s) for s in (owner, open_to_all, u1, stranger)] == [40, 40, 20, 0]
    series = volume.execution_volume(executions, volume.volume_series(executions, volume.rolling_origin(AS_OF)), AS_OF, scope=u1)
    assert series.agg(F.sum("started_count")).first()[0] == 20
    assert rows(u1.allowed(workflows.select(F.col("id").alias("workflow_id")))) == [("wf-a", True), ("wf-b", False)]


def error_rows(spark, data):
    return spark.createDataFrame(data, "id long, workflow_id string, node_name string, node_type string, "
                                       "error_category string, error_message string, timestamp timestamp")


def test_error_groups(spark):
    at = AS_OF - dt.timedelta(days=2)
    long_text = "x" * 200
    data = [(i, f"w{i % 5}", "n", "old" if i < 9 else "new", "data", long_text, at + dt.timedelta(minutes=i))
            for i in range(10)]
    data += [(50, "w0", "n", "t", "auth", None, AS_OF - dt.timedelta(hours=1)), (51, "gone", "n", "t", "auth", "m", at)]
    workflows = spark.createDataFrame([(f"w{i}", f"Name, {9 - i}") for i in range(5)], "id string, name string")
    got = {r.error_category: r for r in error_reports.error_groups(
        error_rows(spark, data), workflows, params.error_range(as_of=AS_OF), AS_OF).collect()}
    assert len(got) == 2
    group = got["data"]
    assert (group["count"], group.affected_workflows, group.node_type, group.error_summary) == (10, 5, "new", long_text)
    assert group.workflow_names == [f"Name, {i}" for i in range(5, 10)]
    assert (group.status, got["auth"].status, got["auth"]["count"]) == ("recurring", "active", 1)


def test_error_totals_without_executions(spark):
    executions = spark.createDataFrame([], SCHEMA)
    data = [(1, "w", "n", "t", "network", "m", AS_OF)]
    got = error_reports.error_totals(error_rows(spark, data), executions, params.error_range(as_of=AS_OF)).first()
    assert (got.total_errors, got.transient_count, got.structural_count, got.error_rate, got.trend_pct) == (1, 1, 0, 0.0, 100.0)


def test_resampling_hides_the_open_block(spark):
    origin = volume.rolling_origin(AS_OF)
    series = volume.volume_series(spark.createDataFrame([(1, "w", "s", AS_OF, None)], SCHEMA), origin)
    whole = volume.resample(series, origin, 5, AS_OF)
    assert (series.count(), whole.count()) == (288, 287)
    later = AS_OF + dt.timedelta(minutes=30)
    assert volume.resample(series, origin, 30, later).agg(F.sum("started_count")).first()[0] == 1


def test_settings_orders(spark):
    data = [("1", "b", 5, 1), ("2", "a", 1, 9), ("3", "c", 9, 5)]
    df = spark.createDataFrame(data, "id string, name string, execution_count long, saved_time_seconds long")
    order = {m: [r.id for r in roi.sort_settings(df, m).collect()] for m in ("name_asc", "name_desc", "execs_desc", "time_desc")}
    assert order == {"name_asc": ["2", "1", "3"], "name_desc": ["3", "1", "2"], "execs_desc": ["3", "1", "2"],
                     "time_desc": ["2", "3", "1"]}


@pytest.mark.parametrize("text", [
    "SELECT reflect('java.lang.System', 'getProperty', 'user.dir')", "SELECT java_method ('java.util.UUID', 'randomUUID')",
    "SELECT * FROM parquet.`/root`", "SELECT * FROM other", "SELECT (SELECT max(id) FROM json.`/x`) FROM executions",
    "WITH a AS (SELECT * FROM csv.`/x`) SELECT * FROM a", "SELECT * FROM range(5)", "SELECT 1 FROM executions WHERE id IN (SELECT id FROM secrets)",
    "SELECT 'CTE [secrets]' AS a, h.* FROM secrets h", "WITH a AS (WITH secrets AS (SELECT 1 AS id) SELECT * FROM secrets) SELECT * FROM a, secrets",
    "WITH a AS (SELECT * FROM secrets), secrets AS (SELECT 1 AS id) SELECT * FROM a", "SELECT * FROM executions WHERE EXISTS (WITH x AS (SELECT 1) SELECT * FROM secrets)",
    "SELECT * FROM default.executions", "SELECT * FROM executions, LATERAL (SELECT * FROM secrets)", "SELECT * FROM IDENTIFIER('secrets')",
    "SELECT * FROM executions ORDER BY (SELECT max(id) FROM secrets)", "SELECT `reflect`('java.lang.System', 'exit')",
    "WITH a AS (SELECT 1) INSERT INTO executions SELECT * FROM a", "SELECT id FROM executions UNION ALL SELECT id FROM secrets",
    "SELECT count(*) FILTER (WHERE id IN (SELECT id FROM secrets)) FROM executions", "SELECT * FROM executions |> JOIN secrets USING (id)",
    "SELECT transform(array(1), x -> x + (SELECT max(id) FROM secrets)) FROM executions", "DELETE FROM executions", "SELECT 1 FROM executions WHERE ("])
def test_guard_refuses(spark, seed, text):
    with pytest.raises(BadRequest):
        history.guarded_select(spark, text, {"executions": seed[0]})


def test_guard_answers(spark, seed):
    executions, workflows = seed
    tables = {"executions": executions, "workflows": workflows}
    got, total = history.guarded_select(spark, "WITH n AS (SELECT workflow_id, count(*) AS c FROM executions GROUP BY 1) "
                                               "SELECT name, c FROM n JOIN workflows ON id = workflow_id", tables, n=1)
    assert got.count() == 1 and total.first()[0] == 2
    assert history.guarded_select(spark, "SELECT * FROM executions", tables)[0].count() == 40
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("guarded_")]
    for text in ("SELECT 'drop', 'reflect(1)', `workflow_id` FROM executions", "WITH a AS (SELECT 1 AS x), b AS (SELECT * FROM a) SELECT * FROM b, a",
                 "WITH a AS (WITH b AS (SELECT * FROM executions) SELECT * FROM b) SELECT count(*) FROM a HAVING count(*) > 1",
                 "SELECT id, row_number() OVER w AS r FROM executions WINDOW w AS (ORDER BY id) LIMIT 3 OFFSET 1",
                 "SELECT e.id, x FROM executions e LATERAL VIEW explode(array(1, 2)) AS x WHERE e.id IN (SELECT id FROM executions)",
                 "SELECT status FROM executions EXCEPT SELECT name FROM workflows", "SELECT v.a FROM VALUES (1), (2) AS v(a)",
                 "SELECT * FROM EXECUTIONS e JOIN workflows w ON e.workflow_id = w.id"):
        assert history.guarded_select(spark, text, tables)[0].count() >= 1, text
    with pytest.raises(BadRequest):
        history.guarded_select(spark, "SELECT 1", tables, scope=Scope(workflows.selectExpr("id AS visible_workflow_id")))


def test_limits_are_the_callers(spark, seed):
    executions, workflows = seed
    assert listing.execution_listing(executions, workflows).count() == 40
    assert listing.execution_listing(executions, workflows, limit=3).count() == 3
    long = spark.createDataFrame([(i, "wf-a", "n", "t", "x" * 300 + str(i % 70), "auth", AS_OF) for i in range(200)],
                                 "id long, workflow_id string, node_name string, node_type string, error_message string, "
                                 "error_category string, timestamp timestamp")
    groups = error_reports.error_groups(long, workflows, WEEK, AS_OF)
    assert groups.count() == 70 and error_reports.error_groups(long, workflows, WEEK, AS_OF, n=2, names=1).count() == 2
