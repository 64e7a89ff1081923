"""Streaming queries: they run over the event file until it is used up."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from runlens.catalog.registry import ORACLE_SQL, query
from runlens.operators import accesslog
from runlens.schemas import EXECUTION_BASE, EXECUTION_OPTIONAL
from runlens.session import work_path
from runlens.sources.sample import SampleTables, executions_of
from runlens.sources.store import BlockTable
from runlens.streaming import stateful, sync_stream


def _events(t: SampleTables):
    return sync_stream.file_stream(t.spark, t.path, t.raw("events").schema, pattern="events.parquet")


BATCHES = 3
#: Files of a batch, written and read by as many tasks.
FILES = 4


def _live(t: SampleTables, replay: bool = False):
    """Executions as a stream of several batches: the same projection as the batch view.

    Every batch spans the whole time, so all rows of a later batch are late. With ``replay`` the first batch
    is delivered once more at the end.
    """
    path, events = work_path(t.spark, "arrivals"), t.raw("events")
    for number in [*range(BATCHES), *([0] if replay else [])]:
        events.where(F.col("event_id") % BATCHES == number).repartition(FILES).write.mode("append").parquet(path)
    return executions_of(sync_stream.file_stream(t.spark, path, events.schema, files_per_trigger=FILES))


def _finish(stream) -> None:
    stream.awaitTermination()


@query("i1_i2_stream_upsert", "SELECT id, workflow_id, status, started_at, stopped_at, mode FROM execution_entity")
def _(t):
    path = work_path(t.spark, "table")
    schema = EXECUTION_BASE.__class__(EXECUTION_BASE.fields + EXECUTION_OPTIONAL.fields[:1])
    table = BlockTable(t.spark, path, schema)
    _finish(sync_stream.upsert_stream(_live(t), table, work_path(t.spark, "checkpoint")))
    return table.read()


@query("i3_volume_stream", """
SELECT make_timestamp(epoch_us(started_at) - epoch_us(started_at) % 300000000) AS "timestamp", count(*) AS started_count
FROM execution_entity GROUP BY 1""")
def _(t):
    path = work_path(t.spark, "volume")
    with stateful.rocksdb_state(t.spark):
        _finish(sync_stream.to_updates(sync_stream.volume_stream(_live(t)), path, work_path(t.spark, "checkpoint")))
    return sync_stream.latest_updates(t.spark, path, "timestamp", "timestamp timestamp, started_count bigint")


@query("i4_distinct_deliveries", "SELECT id, status FROM execution_entity")
def _(t):
    path = work_path(t.spark, "distinct")
    again = _live(t, replay=True).select("id", "status")
    with stateful.rocksdb_state(t.spark):
        _finish(sync_stream.to_parquet(sync_stream.distinct_deliveries(again), path, work_path(t.spark, "checkpoint")))
    return t.spark.read.schema("id bigint, status string").parquet(path)


@query("i5_missing_timer", """
SELECT event_id AS id, date_trunc('milliseconds', ts) AS missing_since, 'unknown' AS status FROM events
WHERE event_type = 'signup' AND event_id % 3 <> 0
  AND ts + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")
def _(t):
    """Open executions go missing at their start; every third is sighted again
    half an hour later."""
    path = work_path(t.spark, "timers")
    events = _events(t)
    at = F.col("ts").cast("timestamp")
    open_rows = F.col("event_type") == "signup"
    both = events.select(
        F.col("event_id").alias("id"), open_rows.alias("is_open"),
        F.explode(F.when(open_rows & (F.col("event_id") % 3 == 0), F.array(
            F.struct(at.alias("at"), F.lit(False).alias("found")),
            F.struct((at + F.make_dt_interval(mins=F.lit(30))).alias("at"), F.lit(True).alias("found"))))
            .when(open_rows, F.array(F.struct(at.alias("at"), F.lit(False).alias("found"))))
            # Finished executions only move the clock.
            .otherwise(F.array(F.struct(at.alias("at"), F.lit(True).alias("found"))))).alias("s"))
    sightings = both.select("id", "is_open", "s.at", "s.found").filter(
        F.col("at") <= F.lit(_last(t)).cast("timestamp"))
    timers = stateful.missing_timers(sightings, dt.timedelta(hours=1), only=F.col("is_open"))
    with stateful.rocksdb_state(t.spark):
        _finish(sync_stream.to_parquet(timers, path, work_path(t.spark, "checkpoint")))
    return t.spark.read.schema("id bigint, missing_since_ms bigint, status string").parquet(path).select(
        "id", F.timestamp_millis("missing_since_ms").alias("missing_since"), "status")


def _last(t: SampleTables) -> str:
    return str(t.raw("events").agg(F.max("ts").cast("string")).first()[0])


def _windows_sql(key: str, minutes: int, limit: int) -> str:
    size = minutes * 60_000
    return f"""
, hits AS (SELECT {key} AS key, epoch_us(ts) // 1000 AS ms, count(*) AS n FROM events GROUP BY 1, 2),
starts (key, ms) AS (
  SELECT key, min(ms) FROM hits GROUP BY key
  UNION ALL
  SELECT s.key, min(h.ms) FROM starts s JOIN hits h ON h.key = s.key AND h.ms >= s.ms + {size} GROUP BY s.key, s.ms)
SELECT h.key, make_timestamp(s.ms * 1000) AS window_start, make_timestamp((s.ms + {size}) * 1000) AS expires_at,
  CAST(sum(n) AS BIGINT) AS hits, CAST(greatest(sum(n) - {limit}, 0) AS BIGINT) AS blocked
FROM hits h ASOF JOIN starts s ON h.key = s.key AND h.ms >= s.ms GROUP BY 1, 2, 3"""


@query("m16_fixed_windows", _windows_sql("event_type", 15, 1))
def _(t):
    return accesslog.fixed_windows(t.spark, t.raw("events").withColumn("ts", F.col("ts").cast("timestamp")),
                                   "event_type", "ts", dt.timedelta(minutes=15), 1)


@query("m16_fixed_windows_per_user", _windows_sql("CAST(user_id AS VARCHAR)", 1440, 3))
def _(t):
    log = t.raw("events").select(F.col("user_id").cast("string").alias("user"), F.col("ts").cast("timestamp").alias("ts"))
    return accesslog.fixed_windows(t.spark, log, "user", "ts", dt.timedelta(days=1), 3)


@query("i6_window_stream", _windows_sql("event_type", 15, 1).replace(
    "s.ms * 1000) AS window_start, make_timestamp((s.ms + 900000) * 1000) AS expires_at",
    "s.ms * 1000) AS window_start").replace(
    ", CAST(greatest(sum(n) - 1, 0) AS BIGINT) AS blocked", "").replace("GROUP BY 1, 2, 3", "GROUP BY 1, 2"))
def _(t):
    path = work_path(t.spark, "windows")
    log = _events(t).select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    windows = stateful.hit_windows(log, "event_type", "ts", dt.timedelta(minutes=15))

    def store(batch, batch_id):
        batch.withColumn("batch", F.lit(batch_id)).write.mode("append").parquet(path)

    with stateful.rocksdb_state(t.spark):
        _finish(windows.writeStream.outputMode("update").foreachBatch(store)
                .option("checkpointLocation", work_path(t.spark, "checkpoint"))
                .trigger(availableNow=True).start())
    rows = t.spark.read.schema("key string, start_ms bigint, hits bigint, batch bigint").parquet(path)
    return rows.groupBy("key", F.timestamp_millis("start_ms").alias("window_start")).agg(
        F.max_by("hits", "batch").alias("hits"))


for _name in ("m16_fixed_windows", "m16_fixed_windows_per_user", "i6_window_stream"):
    ORACLE_SQL[_name] = ORACLE_SQL[_name].replace("WITH workflow_entity", "WITH RECURSIVE workflow_entity", 1)
