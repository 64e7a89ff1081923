"""Where the copied tables live: plain Parquet folders.

Two kinds. Big keyed tables are partitioned by a block of their id. The block of
a row never changes, so an upsert rewrites the blocks of the ids it carries and
nothing else, a repeated batch rewrites the same blocks with the same rows, and
ids, being handed out in time order, keep started_at ranges narrow per file for
row-group pruning. Small tables are written whole to a new version folder;
readers take the newest one whose write was completed.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens.operators.upsert import Rule, upsert
from runlens.schemas import conform

BLOCK = "id_block"


class BlockTable:
    """A big table keyed by ``id`` in blocks of ``block_size`` ids."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType,
                 block_size: int = 10_000_000):
        self.spark, self.path, self.schema, self.block_size = spark, path, schema, block_size

    def _exists(self) -> bool:
        return any(name.startswith(f"{BLOCK}=") for name in _children(self.spark, self.path))

    def blocks(self) -> list[int]:
        """Numbers of the blocks that have rows, in order."""
        return sorted(int(n.partition("=")[2]) for n in _children(self.spark, self.path) if n.startswith(f"{BLOCK}="))

    def block(self, number: int) -> DataFrame:
        """Rows of one block; only its folder is read."""
        return self._files().filter(F.col(BLOCK) == number).select(*self.schema.fieldNames())

    def of_ids(self, ids: DataFrame) -> DataFrame:
        """Rows of a set of ids; only the folders of their blocks are read."""
        blocks = [r[0] for r in ids.select(self._block().alias("b")).distinct().collect()]
        if not blocks or not self._exists():
            return self.spark.createDataFrame([], self.schema)
        rows = self._files().filter(F.col(BLOCK).isin(blocks)).select(*self.schema.fieldNames())
        return rows.join(ids.select("id"), "id", "left_semi")

    def read(self, above_id: int | None = None) -> DataFrame:
        """The table, or only ids above a bound, which also skips whole blocks."""
        if not self._exists():
            return self.spark.createDataFrame([], self.schema)
        rows = self._files()
        if above_id is not None:
            rows = rows.filter((F.col(BLOCK) >= above_id // self.block_size) & (F.col("id") > above_id))
        return rows.select(*self.schema.fieldNames())

    def _files(self) -> DataFrame:
        stored = T.StructType([*self.schema.fields, T.StructField(BLOCK, T.LongType())])
        return self.spark.read.schema(stored).parquet(self.path)

    def _block(self):
        return ((F.col("id") - F.pmod("id", F.lit(self.block_size))) / F.lit(self.block_size)).cast("bigint")

    def write(self, df: DataFrame) -> None:
        """Replace the blocks present in ``df``; other blocks are untouched.

        Rows are spread by block and by a slice of the id, so that one busy block
        is still written by several tasks, and sorted by id within each file.
        """
        slices = F.pmod(F.xxhash64("id"), F.lit(8))
        rows = conform(df, self.schema).withColumn(BLOCK, self._block())
        (rows.repartition(F.col(BLOCK), slices).sortWithinPartitions(BLOCK, "id")
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(BLOCK).parquet(self.path))

    def upsert(self, incoming: DataFrame, rules: Mapping[str, Rule] | None = None) -> None:
        """Merge ``incoming`` (each id once) by id.

        The list of touched blocks is the only thing the driver sees: incoming
        ids divided by the block size. It prunes the stored side to the folders
        that will be rewritten.
        """
        if not self._exists():
            self.write(conform(incoming, self.schema))
            return
        blocks = [r[0] for r in incoming.select(self._block().alias("b")).distinct().collect()]
        if not blocks:
            return
        stored = self._files().filter(F.col(BLOCK).isin(blocks)).select(*self.schema.fieldNames())
        self.write(upsert(stored, incoming, "id", rules))


class VersionedTable:
    """A small table, replaced as a whole by every write."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keep: int = 3):
        self.spark, self.path, self.schema, self.keep = spark, path, schema, keep

    def versions(self) -> list[int]:
        folders = _children(self.spark, self.path)
        numbers = [int(name[2:]) for name in folders if name.startswith("v=")]
        return sorted(n for n in numbers if _completed(self.spark, f"{self.path}/v={n}"))

    def read(self) -> DataFrame:
        done = self.versions()
        if not done:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v={done[-1]}")

    def put(self, df: DataFrame) -> bool:
        """Write the next version if it has other rows than the last one; says whether it did."""
        rows = conform(df, self.schema)
        if self.versions() and _digest(self.read()) == _digest(rows):
            return False
        self.replace(rows)
        return True

    def replace(self, df: DataFrame) -> None:
        """Write the next version; a failed write leaves the last one in force."""
        taken = [int(n[2:]) for n in _children(self.spark, self.path) if n.startswith("v=")]
        conform(df, self.schema).write.parquet(f"{self.path}/v={max(taken, default=0) + 1}")
        for old in self.versions()[:-self.keep]:
            _remove(self.spark, f"{self.path}/v={old}")


def _digest(df: DataFrame) -> tuple:
    """Number of rows and two sums of 64-bit digests over all values and nulls, whatever the order; one pass without a shuffle of rows."""
    values = [F.col(c) for c in df.columns] + [F.col(c).isNull() for c in df.columns]
    return tuple(df.agg(F.count("*"), *[F.sum(F.xxhash64(F.lit(seed), *values).cast("decimal(38,0)")) for seed in (1, 2)]).first())


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    handle = jvm.org.apache.hadoop.fs.Path(path)
    return handle.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), handle


def _completed(spark: SparkSession, path: str) -> bool:
    fs, _ = _fs(spark, path)
    return fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS"))


def _children(spark: SparkSession, path: str) -> list[str]:
    fs, handle = _fs(spark, path)
    if not fs.exists(handle):
        return []
    return [status.getPath().getName() for status in fs.listStatus(handle)]


def _remove(spark: SparkSession, path: str) -> None:
    fs, handle = _fs(spark, path)
    fs.delete(handle, True)


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes below a folder."""
    fs, handle = _fs(spark, path)
    return fs.getContentSummary(handle).getLength() if fs.exists(handle) else 0
