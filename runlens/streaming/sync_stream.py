"""The sync as a stream: files in, keyed table out, one checkpoint per writer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from runlens.operators.upsert import EXECUTION_RULES, latest_by_key
from runlens.sources.store import BlockTable


def file_stream(spark: SparkSession, path: str, schema: T.StructType, *, pattern: str | None = None,
                files_per_trigger: int | None = None) -> DataFrame:
    """New Parquet files of a folder."""
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def upsert_stream(executions: DataFrame, table: BlockTable, checkpoint: str,
                  order: tuple[str, ...] = ("stopped_at", "started_at")) -> StreamingQuery:
    """Merge every micro-batch into the table and stop when the input is used up.

    Of several deliveries of one id within a batch the finished one counts.

    A batch that is replayed after a failure merges the same rows again, with the
    same result. Late rows need no watermark here: they are merged by id.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        table.upsert(latest_by_key(batch, "id", list(order)), EXECUTION_RULES)

    return (executions.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def volume_stream(executions: DataFrame, width: str = "5 minutes") -> DataFrame:
    """Starts per five-minute window, for :func:`to_updates`.

    There is no watermark: a row counts however late it comes. The state has one row per window, about a
    hundred thousand for a year, and counts are folded on the map side before they reach it.
    """
    counted = executions.groupBy(F.window("started_at", width)).agg(F.count("*").alias("started_count"))
    return counted.select(F.col("window.start").alias("timestamp"), "started_count")


def distinct_deliveries(executions: DataFrame) -> DataFrame:
    """Each execution id once, however often and however late it is delivered again.

    The state holds every id, so it belongs into RocksDB (``stateful.rocksdb_state``).
    """
    return executions.dropDuplicates(["id"])


def to_parquet(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return (stream.writeStream.format("parquet").outputMode("append").option("path", path)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def to_updates(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """The groups each batch changed, in a folder per batch that a repeated batch writes anew."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (stream.writeStream.outputMode("update").foreachBatch(write)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def latest_updates(spark: SparkSession, path: str, key: str, shape: str) -> DataFrame:
    """The last state of every group that :func:`to_updates` wrote."""
    rows = spark.read.schema(f"{shape}, batch bigint").parquet(path)
    others = [c for c in rows.columns if c not in (key, "batch")]
    return rows.groupBy(key).agg(*[F.max_by(c, "batch").alias(c) for c in others])
