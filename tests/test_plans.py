"""What the optimizer makes of the reports."""

from __future__ import annotations

import os

import pytest

from runlens import params
from runlens.operators.scope import Scope, visible_workflows
from runlens.plans import error_reports, history, kpi, listing, roi, volume
from runlens.sources.sample import AS_OF, SampleTables

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="sample tables not present")
WEEK = params.metrics_range(as_of=AS_OF)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Executions and errors as stored tables, the way the reports meet them."""
    root, sample = tmp_path_factory.mktemp("stored"), SampleTables(spark, FOLDER)
    for name in ("executions", "errors", "workflows", "settings", "shared_workflow", "project_relation"):
        getattr(sample, name).write.parquet(f"{root}/{name}")
    return {name: spark.read.parquet(f"{root}/{name}") for name in os.listdir(root)}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def reports(t):
    e, w, x, s = t["executions"], t["workflows"], t["errors"], t["settings"]
    scope = Scope(visible_workflows(t["shared_workflow"], t["project_relation"], "7"))
    shares = kpi.workflow_share(e, w, WEEK)
    return {
        "summary": kpi.kpi_summary(e, w, WEEK), "scoped": kpi.kpi_summary(e, w, WEEK, scope=scope),
        "timeline": kpi.with_forecast(kpi.status_timeline(e, w, WEEK), WEEK), "shares": shares,
        "pareto": kpi.pareto(shares), "listing": listing.execution_listing(e, w, status="success", limit=20),
        "slowest": listing.slowest_workflows(e, w, AS_OF), "hotspots": listing.error_hotspots(e, w, AS_OF),
        "roi": roi.roi_totals(roi.roi_per_workflow(e, w, s, as_of=AS_OF)),
        "volume": volume.volume_series(e, volume.rolling_origin(AS_OF)),
        "totals": error_reports.error_totals(x, e, WEEK), "trend": error_reports.daily_trend(x, WEEK),
        "health": error_reports.workflow_health(e, w, WEEK, n=15),
        "groups": error_reports.error_groups(x, w, WEEK, AS_OF, n=50), "raw": error_reports.raw_errors(x),
    }


def test_no_report_multiplies_rows_or_leaves_the_jvm(stored):
    for name, df in reports(stored).items():
        text = plan(df)
        assert "CartesianProduct" not in text and "NestedLoop" not in text, name
        assert "Python" not in text, name


def test_time_bounds_reach_the_scan(stored):
    named = reports(stored)
    for name in ("summary", "scoped", "timeline", "shares", "slowest", "hotspots", "volume", "health"):
        assert "GreaterThan" in plan(named[name]).split("PushedFilters", 1)[1].split("]", 1)[0] or \
            "started_at" in plan(named[name]).split("PushedFilters", 1)[1].split("]", 1)[0], name
    for name in ("trend", "groups"):
        assert "PushedFilters: [IsNotNull(timestamp), GreaterThanOrEqual(timestamp" in plan(named[name]), name


def test_only_needed_columns_are_read(stored):
    summary = plan(reports(stored)["summary"])
    assert "ReadSchema: struct<status:string,started_at:timestamp,stopped_at:timestamp>" in summary


def test_top_n_is_not_a_full_sort(stored):
    named = reports(stored)
    for name in ("listing", "slowest", "hotspots", "health", "groups"):
        assert "TakeOrderedAndProject" in plan(named[name]), name


def test_groups_are_trimmed_before_the_shuffle(spark, stored):
    assert "WindowGroupLimit" in plan(error_reports.raw_errors(stored["errors"], n=200))
    chat = SampleTables(spark, FOLDER).raw("conversations")
    assert "WindowGroupLimit" in plan(history.recent_context(chat, "conv_id", "turn"))


def test_counting_comes_before_the_name_join(stored):
    text = plan(reports(stored)["shares"])
    # The aggregate sits below the join in the tree, so it is printed after it.
    assert text.index("Join") < text.index("HashAggregate(keys=[workflow_id")
