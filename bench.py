"""Wall seconds of the headline queries; prints one JSON line.

Each query is planned and run once to warm the JVM up and then timed, written to
Spark's no-op sink so that nothing but the query itself is measured.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from runlens.catalog import QUERIES  # noqa: E402
from runlens.session import build_session  # noqa: E402

HEADLINE = [
    "r1a_kpi_summary", "r1b_status_timeline_hours", "r1c_forecast_days", "r1d_workflow_share",
    "r1e_pareto", "r2_execution_listing", "r3_slowest", "r4_error_hotspots", "r5_roi_settings",
    "r6a_roi_totals", "r6b_roi_workflows", "r7_volume_of_day", "r8_volume_details",
    "r9_resampled_volume", "r11a_error_totals", "r11c_daily_trend", "r11d_workflow_health",
    "r11e_error_groups", "r12_raw_errors", "r13_group_executions", "c2_scoped_reads",
    "e2_extract_errors", "e7_classify_texts", "e9_rederived_changes", "m1_execution_upsert", "m9_backfill",
    "m3_refresh_open", "m5_changed_buckets", "m6_settle", "m16_fixed_windows", "i3_volume_stream",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": cpus,
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g")})
    spark.sparkContext.setLogLevel("OFF")

    def run(name: str) -> float:
        begun = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - begun

    cold = {name: round(run(name), 3) for name in HEADLINE}
    warm = {name: round(run(name), 3) for name in HEADLINE}
    print(json.dumps({
        "metric": "total warm wall time of the headline queries",
        "value": round(sum(warm.values()), 3), "unit": "sec", "queries": warm, "cold": cold,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
