"""Streaming upsert over several batches, replays included."""

from __future__ import annotations

import datetime as dt
from collections import Counter

from fixed import AS_OF, rows
from runlens import schemas
from runlens.sources.store import BlockTable
from runlens.streaming import stateful, sync_stream

SCHEMA = "id long, workflow_id string, status string, started_at timestamp, stopped_at timestamp"


def test_batches_merge_by_id(spark, tmp_path):
    source, table = tmp_path / "in", BlockTable(spark, str(tmp_path / "t"), schemas.EXECUTION, block_size=10)

    def deliver(*data):
        spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(str(source))

    def drain(checkpoint="cp"):
        stream = sync_stream.file_stream(spark, str(source), spark.createDataFrame([], SCHEMA).schema, files_per_trigger=1)
        sync_stream.upsert_stream(stream, table, str(tmp_path / checkpoint)).awaitTermination()

    deliver((1, "a", "running", AS_OF, None), (1, "a", "success", AS_OF, AS_OF), (12, "a", "running", AS_OF, None))
    drain()
    deliver((12, "a", "error", None, AS_OF + dt.timedelta(seconds=1)))
    drain()
    expected = [(1, "success"), (12, "error")]
    assert rows(table.read(), "id", "status") == expected
    assert table.read().filter("started_at is null").count() == 0
    # A lost checkpoint delivers everything again, with the same outcome.
    drain("other")
    assert rows(table.read(), "id", "status") == expected


def timers_of(spark, tmp_path, name, sightings, grace=60, **more):
    """(id, since in seconds) of the timers that run out; one batch for each list of (id, second, found)."""
    source, out = str(tmp_path / f"{name}-in"), str(tmp_path / f"{name}-out")
    schema = "id long, at timestamp, found boolean"
    for batch in sightings:
        data = [(i, AS_OF + dt.timedelta(seconds=at), found) for i, at, found in batch]
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(source)
    stream = sync_stream.file_stream(spark, source, spark.createDataFrame([], schema).schema, files_per_trigger=1)
    timers = stateful.missing_timers(stream, dt.timedelta(seconds=grace), lateness="0 seconds", **more)
    with stateful.rocksdb_state(spark):
        sync_stream.to_parquet(timers, out, str(tmp_path / f"{name}-cp")).awaitTermination()
    start = int(AS_OF.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
    got = spark.read.schema("id long, missing_since_ms long, status string").parquet(out).collect()
    assert {r.status for r in got} <= {"unknown"}
    return Counter((r.id, (r.missing_since_ms - start) / 1000) for r in got)


def test_missing_timers_share_their_state(spark, tmp_path):
    """Ids of one share wait, are sighted again and run out on their own, over several batches."""
    none = (None, 2, False)
    first = [(1, 0, False), (2, 1, False), (2, 30, True), (3, 5, False), (4, 40, False), none, (1, 10, False), (3, 6, False)]
    second = [(4, 50, True), (5, 50, False), (2, 50, False), (6, 50, True), (9, 64.999, True)]
    third = [(5, 109, True), (7, 65, False), (9, 110.001, True)]
    got = timers_of(spark, tmp_path, "a", [first, second, third], shares=1)
    # 3 runs out at 65 s, 2 at 110 s; 5 was seen in time, and 7 still waits.
    assert got == Counter([(1, 0.0), (3, 5.0), (2, 50.0), (None, 2.0)])
    assert timers_of(spark, tmp_path, "b", [first, second, third], shares=64) == got


def test_missing_timers_run_out_before_the_watermark(spark, tmp_path):
    ids = [(i, i / 1000, False) for i in range(300)]
    got = timers_of(spark, tmp_path, "c", [ids, [(999, 60.1, True)]], shares=4)
    # The clock stands at 60.1 s: what ends before has run out, what ends then has not.
    assert got == Counter((i, i / 1000) for i in range(100))
