"""Stored tables, merge rules and the whole sync cycle."""

from __future__ import annotations

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from fixed import AS_OF, rows
from runlens import schemas
from runlens.functions.errors import RULES_VERSION
from runlens.operators import arrivals, care, queue, settings, sync
from runlens.operators.scope import access_graph
from runlens.operators.upsert import EXECUTION_RULES, changed_rows, latest_by_key, upsert
from runlens.params import BadRequest
from runlens.plans import sync_cycle, volume
from runlens.plans.sync_cycle import Options, Replica, Source, run_cycle
from runlens.schemas import conform
from runlens.sources.readers import source_executions
from runlens.sources.store import BlockTable, VersionedTable

H = dt.timedelta(hours=1)
BASE = "id long, workflow_id string, status string, started_at timestamp, stopped_at timestamp"


def execs(spark, data, extra=""):
    return spark.createDataFrame(data, BASE + extra)


def test_conform_pads_and_coerces(spark):
    df = spark.createDataFrame([(1, "12"), (2, "x"), (3, " 4"), (4, "-5")], "id long, json_size_bytes string")
    out = conform(df, schemas.EXECUTION)
    assert out.schema == schemas.EXECUTION
    assert rows(out, "id", "json_size_bytes", "mode") == [(1, 12, None), (2, None, None), (3, None, None), (4, -5, None)]
    probed = source_executions(execs(spark, []).withColumn("mode", F.lit("x")).withColumn("other", F.lit(1)))
    assert probed.columns == ["id", "workflow_id", "status", "started_at", "stopped_at", "mode"]


def test_upsert_twice_is_upsert_once(spark):
    old = conform(execs(spark, [(1, "a", "running", AS_OF, None), (2, "b", "new", None, None)]), schemas.EXECUTION)
    new = execs(spark, [(2, "z", "success", None, AS_OF), (3, "c", "error", AS_OF, AS_OF)])
    once = upsert(old.withColumn("missing_since", F.col("started_at")), new, "id", EXECUTION_RULES)
    twice = upsert(once, new, "id", EXECUTION_RULES)
    assert rows(once) == rows(twice)
    assert rows(once, "id", "workflow_id", "status") == [(1, "a", "running"), (2, "b", "success"), (3, "c", "error")]


def test_start_is_kept_when_the_source_has_none(spark):
    old = execs(spark, [(1, "a", "error", AS_OF, AS_OF)])
    new = execs(spark, [(1, "a", "error", None, AS_OF)])
    assert upsert(old, new, "id", EXECUTION_RULES).first().started_at is not None


def test_latest_delivery_wins(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 3), (1, "c", 2), (2, None, 1)], "id long, v string, seq long")
    assert rows(latest_by_key(df, "id", ["seq"])) == [(1, "b", 3), (2, None, 1)]


def test_changed_rows_are_null_safe(spark):
    old = spark.createDataFrame([(1, None), (2, 5), (3, 7)], "k long, v long")
    new = spark.createDataFrame([(1, None), (2, None), (3, 7), (4, None)], "k long, v long")
    assert rows(changed_rows(old, new, "k", ["v"])) == [(2, None), (4, None)]


def test_block_table_touches_only_its_blocks(spark, tmp_path):
    table = BlockTable(spark, str(tmp_path / "t"), schemas.EXECUTION, block_size=10)
    assert table.read().count() == 0
    table.upsert(execs(spark, [(i, "w", "new", None, None) for i in range(25)]))
    before = set(os.listdir(tmp_path / "t" / "id_block=0"))
    table.upsert(execs(spark, [(24, "w", "success", AS_OF, AS_OF), (31, "w", "error", AS_OF, None)]), EXECUTION_RULES)
    assert set(os.listdir(tmp_path / "t" / "id_block=0")) == before
    assert table.read().count() == 26
    assert rows(table.read(above_id=20).filter("status <> 'new'"), "id", "status") == [(24, "success"), (31, "error")]
    table.upsert(execs(spark, []))
    assert table.read().count() == 26


def test_block_table_may_be_fed_from_itself(spark, tmp_path):
    table = BlockTable(spark, str(tmp_path / "t"), schemas.EXECUTION, block_size=10)
    table.upsert(execs(spark, [(i, "w", "running", AS_OF, None) for i in range(15)]))
    table.upsert(care.repair(table.read()))
    assert rows(table.read().groupBy("status").count()) == [("crashed", 15)]


def test_versioned_table_ignores_unfinished_versions(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "s"), schemas.SETTINGS, keep=2)
    for n in range(4):
        table.replace(spark.createDataFrame([("k", str(n))], schemas.SETTINGS))
    assert table.versions() == [3, 4]
    (tmp_path / "s" / "v=9").mkdir()
    assert table.read().first().value == "3"
    table.replace(table.read())
    assert table.versions() == [4, 10]


def test_open_rows_refresh(spark):
    open_data = [(1, "a", "running", AS_OF, None, None), (2, "a", "waiting", None, None, None),
                 (3, "a", "running", AS_OF, None, AS_OF - 2 * H), (4, "a", "new", AS_OF, None, AS_OF - H / 2),
                 (5, "a", "success", AS_OF, AS_OF, None)]
    local = execs(spark, open_data, ", missing_since timestamp")
    source = execs(spark, [(1, "a", "error", AS_OF - H, AS_OF), (2, "a", "running", AS_OF - H, None)])
    got = {r.id: r for r in sync.refresh_open(local, source, AS_OF).collect()}
    assert sorted(got) == [1, 2, 3, 4]
    assert (got[1].status, got[2].status, got[3].status, got[4].status) == ("error", "running", "unknown", "new")
    utc = [got[i].started_at.astimezone(dt.timezone.utc) for i in (1, 2)]
    assert utc == [AS_OF, AS_OF - H]
    assert got[1].missing_since is None and got[4].missing_since.astimezone(dt.timezone.utc) == AS_OF - H / 2


def test_watermark_on_an_empty_copy(spark):
    empty, source = execs(spark, []), execs(spark, [(7, "a", "new", AS_OF, None)])
    assert sync.high_water(empty, source).first().high_water is None
    assert sync.high_water(source, empty).first().high_water == 7


def test_queue_gives_up_at_the_fifth_attempt(spark):
    data = [(i, "a", "error", AS_OF, AS_OF, "pending", attempts, None) for i, attempts in enumerate([0, 3, 4, 2, None])]
    table = execs(spark, data, ", analytics_status string, analytics_attempts long, analytics_next_attempt timestamp")
    results = spark.createDataFrame([(0, "retry"), (1, "retry"), (2, "retry"), (3, "done"), (4, "oversized")], "id long, outcome string")
    got = {r.id: (r.analytics_status, r.analytics_attempts, r.analytics_next_attempt) for r in queue.settle(table, results, AS_OF).collect()}
    assert [v[:2] for _, v in sorted(got.items())] == [
        ("pending", 1), ("pending", 4), ("failed", 5), ("done", 2), ("failed", None)]
    assert got[1][2].astimezone(dt.timezone.utc) == AS_OF + dt.timedelta(minutes=16)
    far = spark.range(1).select(queue.next_attempt(F.lit(30), AS_OF)).first()[0]
    assert far.astimezone(dt.timezone.utc) == AS_OF + dt.timedelta(hours=6)


def test_repair_cases(spark):
    df = execs(spark, [(1, "a", "error", None, None), (2, "a", "error", None, AS_OF), (3, "a", "running", AS_OF, None),
                       (4, "a", "canceled", AS_OF, None)])
    assert rows(care.repair(df), "id", "status") == [(2, "error"), (3, "crashed"), (4, "canceled")]
    assert tuple(care.repair_survey(df).first()) == (1, 1, 2, 1)


def test_completeness_notices_one_changed_value(spark):
    a = execs(spark, [(i, "a", "new", AS_OF, None) for i in range(5)])
    b = a.withColumn("status", F.when(F.col("id") == 3, "x").otherwise(F.col("status")))
    assert care.completeness(a, a, a.columns).first().same_content is True
    got = care.completeness(a, b, a.columns).first()
    assert got.same_count is True and got.same_content is False


def test_access_graph_without_known_columns(spark):
    assert access_graph(None, None, spark.createDataFrame([("a",)], "workflow_id string")) is None


def test_settings_are_all_or_nothing(spark):
    workflows = spark.createDataFrame([("wf-a", "Alpha")], "id string, name string")
    current = spark.createDataFrame([("wf-a", 1.0, 1.0)], schemas.WORKFLOW_SETTINGS)
    entry = "workflow_id string, saved_time_seconds double, hourly_rate double"
    good = spark.createDataFrame([("wf-a", 120.0, None)], entry)
    assert rows(settings.update_roi_settings(current, good, workflows)) == [("wf-a", 120.0, 0.0)]
    for bad in (("wf-a", -1.0, 1.0), ("wf-a", 86401.0, 1.0), ("wf-a", 1.0, 100001.0), (None, 1.0, 1.0),
                ("nope", 1.0, 1.0), ("wf-a", float("nan"), 1.0), ("wf-a", None, 1.0)):
        with pytest.raises(BadRequest):
            settings.update_roi_settings(current, good.union(spark.createDataFrame([bad], entry)), workflows)


PAYLOAD = '[{"resultData":"1"},{"error":"2","lastNodeExecuted":"3"},{"message":"4"},"Node","%s"]'


@pytest.fixture
def cycle(spark, tmp_path):
    workflows = spark.createDataFrame([("a", "A", True)], "id string, name string, active boolean")
    shares = spark.createDataFrame([("a", "u1", "r")], "workflow_id string, user_id string, role string")

    def source(data, payloads, extra=""):
        return Source(workflows, execs(spark, data, extra),
                      spark.createDataFrame(payloads, "execution_id long, data string"), shares)

    return Replica(spark, str(tmp_path / "replica"), block_size=100), source


def state(replica, *columns):
    return rows(replica.executions.read(), "id", *columns)


def test_cycle_end_to_end(spark, cycle):
    replica, source = cycle
    day = dt.timedelta(days=1)
    data = [(10, "a", "success", AS_OF - 20 * day, AS_OF), (600, "a", "error", AS_OF - H, AS_OF),
            (601, "a", "running", AS_OF - H, None), (602, "a", "crashed", AS_OF, AS_OF), (603, "a", "error", AS_OF, AS_OF)]
    payloads = [(600, PAYLOAD % "Not authenticated"), (603, "broken")]
    first = run_cycle(replica, source(data, payloads), AS_OF)
    assert (first.status, first.error) == ("ok", None)
    assert state(replica, "status", "analytics_status", "analytics_attempts") == [
        (10, "success", None, None), (600, "error", "done", 0), (601, "running", None, None), (602, "crashed", "failed", 0), (603, "error", "pending", 1)]
    assert first.counts["executions"] == 5 and first.counts["errors"] == 3
    assert rows(replica.errors.read(), "id", "error_category") == [(600, "auth")]
    assert rows(replica["project_relation"].read(), "project_id", "user_id") == [("user:u1", "u1")]
    assert replica["volume"].read().agg(F.sum("started_count")).first()[0] == 4

    # A late commit with a lower id, an execution that failed, one that vanished.
    later = AS_OF + dt.timedelta(minutes=5)
    data2 = [*data[1:2], *data[3:], (590, "a", "success", AS_OF, AS_OF), (604, "a", "error", later, later)]
    second = run_cycle(replica, source(data2, [*payloads, (604, PAYLOAD % "x timeout")]), later)
    assert second.status == "ok"
    assert second.counts["executions"] == 2 and second.counts["errors"] == 1
    assert state(replica, "status", "analytics_status") == [
        (10, "success", None), (590, "success", None), (600, "error", "done"), (601, "running", None), (602, "crashed", "failed"),
        (603, "error", "pending"), (604, "error", "done")]
    missing = {r.id: r.missing_since for r in replica.executions.read().collect()}
    assert missing[601] is not None and missing[600] is None

    # Nothing new: the copy does not change, and the vanished row runs out of grace.
    third = run_cycle(replica, source(data2, [*payloads, (604, PAYLOAD % "x timeout")]), later + 2 * H)
    assert third.counts["executions"] == 0
    assert dict(state(replica, "status"))[601] == "unknown"
    runs = replica["sync_runs"].read().orderBy("id").collect()
    assert [r.status for r in runs] == ["ok"] * 3 and runs[-1].replica_bytes > 0


def test_cycle_survives_a_stray_id_and_records_failure(spark, cycle):
    replica, source = cycle
    data = [(1, "a", "success", AS_OF, AS_OF)]
    run_cycle(replica, source(data, []), AS_OF)
    replica.executions.upsert(execs(spark, [(10**9, "a", "success", AS_OF, AS_OF)]))
    run_cycle(replica, source([*data, (2, "a", "success", AS_OF, AS_OF)], []), AS_OF)
    assert 2 in dict(state(replica, "status"))
    broken = source(data, [])
    broken.executions = broken.executions.drop("id")
    failed = run_cycle(replica, broken, AS_OF)
    assert failed.status == "failed" and failed.error
    assert [r.status for r in replica["sync_runs"].read().orderBy("id").collect()] == ["ok", "ok", "failed"]


def test_cycle_retention_reclassification_and_backfill(spark, cycle):
    replica, source = cycle
    old = AS_OF - dt.timedelta(days=40)
    replica.executions.upsert(execs(spark, [(5, "a", "success", old, old), (6, "a", "success", old, old)]))
    stale = spark.createDataFrame([(5, "a", "TypeError", "TypeError: real\n at", "unknown", "{}", old)],
                                  "id long, workflow_id string, error_message string, error_stack string, "
                                  "error_category string, input_data string, timestamp timestamp")
    replica.errors.upsert(stale)
    data = [(5, "a", "success", old, old, "manual"), (700, "a", "success", AS_OF, AS_OF, "trigger")]
    result = run_cycle(replica, source(data, [], ", mode string"), AS_OF, Options(input_days=30))
    assert result.status == "ok"
    assert (result.counts["reclassified"], result.counts["purged_input"], result.counts["purged_stack"]) == (1, 1, 0)
    assert rows(replica.errors.read(), "error_message", "error_type", "input_data") == [("real", "TypeError", None)]
    assert state(replica, "mode") == [(5, "manual"), (6, None), (700, "trigger")]
    assert replica.setting(sync_cycle.VERSION_KEY) == str(RULES_VERSION)
    assert replica.setting(sync_cycle.BACKFILL_KEY) == "done"
    again = run_cycle(replica, source(data, [], ", mode string"), AS_OF)
    assert (again.counts["reclassified"], again.counts["backfilled"], again.counts["purged_input"]) == (0, 0, 0)


def test_batch_limit_leaves_the_rest_queued(spark, cycle):
    replica, source = cycle
    data = [(i, "a", "error", AS_OF, AS_OF) for i in range(1, 6)]
    payloads = [(i, PAYLOAD % "boom") for i in range(1, 6)]
    result = run_cycle(replica, source(data, payloads), AS_OF, Options(batch_limit=2))
    assert (result.counts["analytics_done"], result.counts["analytics_queued"]) == (2, 3)
    assert rows(replica.errors.read(), "id") == [(1,), (2,)]


def test_bitmaps_of_ids(spark):
    ids = spark.createDataFrame([(5,), (6,), (9,), (32_768,), (32_769,), (99_999,), (7_000_000,)], "id long")
    left = arrivals.arrived(arrivals.blocks(spark, 5, 100_000), ids, AS_OF)
    assert rows(left, "bucket", "low", "high") == [(1, 5, 32_768), (2, 32_769, 65_536), (3, 65_537, 98_304), (4, 98_305, 100_000)]
    assert rows(left, F.bitmap_count("bits")) == [(0,), (1,), (1,), (4,)]
    source = spark.range(0, 200_000)
    got = {r.id for r in arrivals.late_rows(source, left).collect()}
    assert got == set(range(5, 100_001)) - {r.id for r in ids.collect()}
    # What comes closes its block, and a complete block is forgotten.
    more = arrivals.arrived(left, spark.range(5, 98_305), AS_OF)
    assert rows(more, "bucket") == [(4,)]
    assert arrivals.arrived(more, spark.range(98_305, 100_001), AS_OF).count() == 0
    assert arrivals.blocks(spark, 3, 2).count() == 0 and arrivals.late_rows(source, more.limit(0)).count() == 0


def test_many_blocks_are_asked_by_their_outer_bounds(spark, monkeypatch):
    monkeypatch.setattr(arrivals, "RANGES", 1)
    left = arrivals.arrived(arrivals.blocks(spark, 1, 100_000), spark.range(1, 50_000), AS_OF)
    assert arrivals.late_rows(spark.range(0, 300_000), left).count() == 50_001


def test_late_commits_come_however_late(spark, cycle):
    replica, source = cycle
    data = [(1, "a", "success", AS_OF, AS_OF), (5_000_000, "a", "success", AS_OF, AS_OF)]
    run_cycle(replica, source(data, []), AS_OF)
    data += [(2_000_000, "a", "success", AS_OF, AS_OF), (5_000_001, "a", "error", AS_OF, AS_OF)]
    assert run_cycle(replica, source(data, [(5_000_001, PAYLOAD % ("x" * 6_000_000))]), AS_OF).counts["executions"] == 2
    assert [r[0] for r in state(replica, "status")] == [1, 2_000_000, 5_000_000, 5_000_001]
    assert run_cycle(replica, source(data, []), AS_OF).counts["executions"] == 0


def test_last_setting_wins_and_keeps_its_fraction(spark):
    workflows = spark.createDataFrame([("a", "A", True), ("b", "B", True)], "id string, name string, active boolean")
    current = spark.createDataFrame([("a", 60.0, 1.0)], "workflow_id string, saved_time_seconds double, hourly_rate double")
    entries = spark.createDataFrame([(1, "b", 5.0, 1.0), (3, "a", 0.9, None), (2, "a", 7.0, 9.0)] + [(10 + i, "b", float(i), 2.0) for i in range(1500)],
                                    "position int, workflow_id string, saved_time_seconds double, hourly_rate double")
    assert rows(settings.update_roi_settings(current, entries, workflows)) == [("a", 0.9, 0.0), ("b", 1499.0, 2.0)]


def _files(replica):
    """Data files of the copy, without the record of runs."""
    found = {}
    for folder, _, names in os.walk(replica.root):
        if "sync_runs" not in folder:
            found.update({os.path.join(folder, n): os.stat(os.path.join(folder, n)).st_mtime_ns for n in names if n.startswith("part-")})
    return found


def test_an_idle_cycle_writes_nothing_and_reads_nothing_below_the_mark(spark, cycle, monkeypatch):
    replica, source = cycle
    data = [(1, "a", "success", AS_OF, AS_OF), (3, "a", "running", AS_OF, None), (600, "a", "error", AS_OF, AS_OF), (603, "a", "error", AS_OF, AS_OF)]
    payloads = [(600, PAYLOAD % "boom"), (603, "broken")]
    run_cycle(replica, source(data, payloads), AS_OF)
    before = _files(replica)
    second = dt.timedelta(seconds=1)
    assert run_cycle(replica, source(data, payloads), AS_OF + second).status == "ok"
    assert _files(replica) == before
    # Ids that stayed away for long are no longer asked for, but audits still find them.
    asked = []
    monkeypatch.setattr(sync, "late_rows", lambda rows, blocks: asked.append(blocks.count()) or arrivals.late_rows(rows, blocks))
    patient = Options(gap_patience=H, audit_every=dt.timedelta(days=3))
    run_cycle(replica, source(data, payloads), AS_OF + 2 * H, patient)
    assert asked == [0]
    late = [*data, (77, "a", "success", AS_OF, AS_OF)]
    assert run_cycle(replica, source(late, payloads), AS_OF + 3 * H, patient).counts["executions"] == 0
    assert run_cycle(replica, source(late, payloads), AS_OF + dt.timedelta(days=4), patient).counts["executions"] == 1
    assert asked[-1] > 0 and 77 in dict(state(replica, "status"))


def test_volume_takes_over_changes_alone(spark, cycle, monkeypatch):
    replica, source = cycle
    counted = []
    real = sync_cycle.refreshed_cache
    monkeypatch.setattr(sync_cycle, "refreshed_cache", lambda *a: counted.append(1) or real(*a))
    minute = dt.timedelta(minutes=1)
    data = [(i, "a", "running" if i % 3 else "success", AS_OF - i * minute, None) for i in range(1, 40)]
    run_cycle(replica, source(data, []), AS_OF)
    data = [*data[:30], *[(i, "a", "success", AS_OF - i * 7 * minute, AS_OF) for i in range(40, 60)], (60, "a", "success", None, None)]
    at = AS_OF + 11 * minute
    run_cycle(replica, source(data, []), at)

    def same():
        want = volume.volume_series(replica.executions.read(), volume.rolling_origin(at))
        assert rows(replica["volume"].read()) == rows(want)

    same()
    assert len(counted) == 1
    # A cycle that ends between the rows and the cache makes the next one count again.
    monkeypatch.setattr(sync_cycle, "_refresh_volume", lambda *a: 1 / 0)
    data.append((61, "a", "success", AS_OF, AS_OF))
    assert run_cycle(replica, source(data, []), at).status == "failed"
    monkeypatch.undo()
    data.append((62, "a", "success", AS_OF, AS_OF))
    run_cycle(replica, source(data, []), at)
    same()


def test_a_backfill_goes_on_where_it_was_cut_off(spark, cycle, monkeypatch):
    replica, source = cycle
    old = [(i, "a", "success", AS_OF, AS_OF) for i in (5, 105, 205, 305)]
    replica.executions.upsert(execs(spark, old))
    given = source([(*r, f"m{r[0]}") for r in old], [], ", mode string")
    real, done = replica.executions.upsert, []

    def failing(rows_, rules=None):
        if "mode" in rows_.columns and rows_.columns == ["id", "mode"]:
            if len(done) == 2:
                raise RuntimeError("lost")
            done.append([r.id for r in rows_.collect()])
        real(rows_, rules)

    monkeypatch.setattr(replica.executions, "upsert", failing)
    assert run_cycle(replica, given, AS_OF).status == "failed"
    assert done == [[305], [205]] and replica.setting(sync_cycle.BACKFILL_KEY) == "2"
    assert dict(state(replica, "mode")) == {5: None, 105: None, 205: "m205", 305: "m305"}
    done.clear()
    assert run_cycle(replica, given, AS_OF).status == "ok"
    assert done == [[105], [5]] and replica.setting(sync_cycle.BACKFILL_KEY) == "done"
    assert dict(state(replica, "mode")) == {i: f"m{i}" for i in (5, 105, 205, 305)}
