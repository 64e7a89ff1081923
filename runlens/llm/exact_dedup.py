"""Exact deduplication as a stateful stream.

New files pass through a streaming aggregation whose state, kept in RocksDB and never
expired, holds per digest the number of rows, the largest stable id and the locator of
that row's content (file and row in it). Copies are counted on the map side, so a text
that makes up a third of all rows is one row per task at the state. A restart with the
same checkpoint goes on where it stopped.

The state names rows, not contents. Every row whose digest was met before is checked
byte by byte against the content found at the locator; the kept content of a large group
is spread over salted copies for that join. Rows that only share a digest are grouped by
their full text instead.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.llm.registry import query, stored
from runlens.session import work_path

ROWS_PER_SALT = 1000
# Changes are logged instead of whole stores, and a store is closed when its task ends: an executor
# holds open only the stores of the tasks it runs, however many partitions the state has.
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}


@contextmanager
def disk_state(spark: SparkSession) -> Iterator[None]:
    """Streams started in this block keep their state in RocksDB."""
    before = {key: spark.conf.get(key, None) for key in STATE_SETTINGS}
    for key, value in STATE_SETTINGS.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _located(rows: DataFrame, text: str, row_id: str, digest) -> DataFrame:
    """(digest, row, text): ``row`` orders by id, then by where the content lies; nulls come first."""
    body = F.coalesce(F.col(text), F.lit(""))
    row = F.struct(F.col(row_id).alias("id"), F.col("_metadata.file_path").alias("file"),
                   F.col("_metadata.row_index").alias("position"))
    return rows.select(digest(body).alias("digest"), row.alias("row"), body.alias("body"))


def run_stream(spark: SparkSession, path: str, checkpoint: str, updates: str, *, text: str = "text",
               row_id: str = "doc_id", digest=sha256, files_per_batch: int | None = None) -> None:
    """Take in the files that the checkpoint has not seen; write each batch's changed groups to ``updates``.

    A batch that is repeated after a failure overwrites its own folder.
    """
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    exact = f"{path[:-1]}[{path[-1]}]"  # as a pattern, so that a single file may stand there too
    groups = (_located(reader.parquet(exact), text, row_id, digest).groupBy("digest")
              .agg(F.count("*").alias("group_size"), F.max("row").alias("keep")))

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{updates}/batch={number}")

    with disk_state(spark):
        running = (groups.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
                   .trigger(availableNow=True).foreachBatch(write).start())
        running.awaitTermination()


def groups_of(spark: SparkSession, updates: str) -> DataFrame:
    """The state as of the last batch: (digest, group_size, keep)."""
    shape = ("digest binary, group_size long, keep struct<id: long, file: string, position: long>, batch long")
    latest = F.max(F.struct("group_size", "keep")).alias("last")
    return (spark.read.schema(shape).parquet(updates).groupBy("digest").agg(latest)
            .select("digest", "last.group_size", "last.keep"))


def collided(rows: DataFrame, groups: DataFrame, rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """Digests of groups in which a row's bytes differ from those of the row that is kept."""
    many = groups.where("group_size > 1").withColumn("salts", (F.col("group_size") / rows_per_salt).cast("int") + 1)
    hits = stored(rows.join(many, "digest"), "dedup-hits")
    kept = (hits.where(F.col("row") == F.col("keep"))
            .select("digest", F.col("body").alias("kept_body"),
                    F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")))
    others = (hits.where(F.col("row") != F.col("keep"))
              .withColumn("salt", F.pmod(F.xxhash64("row"), F.col("salts")).cast("int")))
    return others.join(kept, ["digest", "salt"]).where(F.col("body") != F.col("kept_body")).select("digest").distinct()


def deduplicate(spark: SparkSession, path: str, *, checkpoint: str | None = None, updates: str | None = None,
                text: str = "text", row_id: str = "doc_id", digest=sha256,
                files_per_batch: int | None = None) -> DataFrame:
    """One row per row of the Parquet data at ``path``: id, keep_id, group_size, kept, text_sha256.

    A null text counts as empty. The row with the largest id stays; of rows that share this id, the
    one in the last file and at the last position. A null id loses against any other, and a group of
    null ids has a null keep_id. Other columns are not read. An empty table gives an empty result.
    """
    checkpoint = checkpoint or work_path(spark, "dedup-state")
    updates = updates or work_path(spark, "dedup-groups")
    run_stream(spark, path, checkpoint, updates, text=text, row_id=row_id, digest=digest,
               files_per_batch=files_per_batch)
    rows = _located(spark.read.parquet(path), text, row_id, digest)
    try:
        groups = stored(groups_of(spark, updates), "dedup-latest")
    except Exception as error:  # an empty input makes no batch, so no folder
        if "PATH_NOT_FOUND" not in str(error):
            raise
        groups = spark.createDataFrame([], "digest binary, group_size long, keep struct<id: long, file: string, position: long>")
    clashes = stored(collided(rows, groups), "dedup-clashes")
    sha = (F.lower(F.hex("digest")) if digest is sha256 else F.sha2("body", 256)).alias("text_sha256")
    found = rows.join(groups, "digest").select("digest", "row", "keep", "group_size", sha)
    if not clashes.isEmpty():
        unlike = rows.join(clashes, "digest", "left_semi")
        own = unlike.groupBy("digest", "body").agg(F.count("*").alias("group_size"), F.max("row").alias("keep"))
        found = found.join(clashes, "digest", "left_anti").unionByName(
            unlike.join(own, ["digest", "body"]).select("digest", "row", "keep", "group_size", sha))
    return found.select(F.col("row.id").alias(row_id), F.col("keep.id").alias("keep_id"), "group_size",
                        (F.col("row") == F.col("keep")).alias("kept"), "text_sha256")


@query("op3_exact_dedup", """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
""")
def op3_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return deduplicate(spark, f"{folder}/documents.parquet")
