"""Registration of the text operators' queries, and what they share."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.session import work_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
_OPEN: list[list[str]] = []
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ZSTD = "zstd"


def query(name: str, sql: str | None = None):
    """Register a function of (spark, folder of the tables) under ``name``."""

    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql is not None:
            ORACLE_SQL[name] = sql.strip()
        return build

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting that holds inside the block alone."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def stored(df: DataFrame, purpose: str, compression: str | None = None) -> DataFrame:
    """``df`` written to the shared folder and read again: the lineage ends there."""
    spark = df.sparkSession
    path = work_path(spark, purpose)
    # Once the table is written nothing reads the shuffles that made it; Spark deletes their files when the write ends.
    with setting(spark, CLEANUP, "true"):
        df.write.parquet(path, compression=compression)
    for made in _OPEN:
        made.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def remove(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete work tables; a path that is gone already is no error."""
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables from ``stored`` whose readers are all done: what was made of them has been written in turn."""
    for df in tables:
        remove(df.sparkSession, [df.stored_at])


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs, which it does when the driver's JVM collects their plans."""
    gc.collect()
    spark._jvm.System.gc()


@contextmanager
def noted() -> Iterator[list[str]]:
    """The list of the tables that ``stored`` writes inside the block."""
    made: list[str] = []
    _OPEN.append(made)
    try:
        yield made
    finally:
        _OPEN.remove(made)


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus
