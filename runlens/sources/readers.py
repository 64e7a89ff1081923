"""Source readers and export writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens.functions.payload import capped
from runlens.schemas import (
    EXECUTION_BASE,
    EXECUTION_OPTIONAL,
    WORKFLOW_BASE,
    WORKFLOW_OPTIONAL,
    conform,
    present_columns,
)


def jdbc_table(spark: SparkSession, url: str, table: str, *, lower: int | None = None,
               upper: int | None = None, partitions: int = 64, **options: str) -> DataFrame:
    """A source table over JDBC. With id bounds the read is split into ranges of
    the primary key; filters and column lists are pushed to the source."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if lower is not None and upper is not None:
        reader = reader.options(partitionColumn="id", lowerBound=str(lower),
                                upperBound=str(upper), numPartitions=str(partitions))
    return reader.load()


def probed(df: DataFrame, base: T.StructType, optional: T.StructType) -> DataFrame:
    """The base columns, which must exist, and whichever optional columns this
    source has. A soft-delete marker is kept for the filter that needs it."""
    lacking = [name for name in base.fieldNames() if name not in df.columns]
    if lacking:
        raise ValueError(f"source lacks {', '.join(lacking)}")
    have = present_columns(df, optional)
    fields = [*base.fields, *(f for f in optional.fields if f.name in have)]
    if "deleted_at" in df.columns:
        fields.append(T.StructField("deleted_at", T.TimestampType()))
    return conform(df, T.StructType(fields))


def source_executions(df: DataFrame) -> DataFrame:
    return probed(df, EXECUTION_BASE, EXECUTION_OPTIONAL)


def source_workflows(df: DataFrame) -> DataFrame:
    return probed(df, WORKFLOW_BASE, WORKFLOW_OPTIONAL)


def payloads_for(payloads: DataFrame, executions: DataFrame, ids: DataFrame,
                 cap: int | None = None) -> DataFrame:
    """Payloads of a set of execution ids, with workflow and start.

    The ids narrow both sides first. What is left is spread by id, because
    decoding is costly and a file's row group would otherwise be one task; the
    join to the owners uses the same partitioning. The number of partitions is
    given, or adaptive execution would merge them again: payloads compress well
    and look small.
    """
    wanted = ids.select("id")
    partitions = int(payloads.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    narrowed = (payloads.join(wanted.withColumnRenamed("id", "execution_id"), "execution_id", "left_semi")
                .repartition(partitions, "execution_id"))
    owners = (executions.join(wanted, "id", "left_semi")
              .select(F.col("id").alias("execution_id"), "workflow_id", "started_at"))
    return capped(narrowed, cap).join(owners, "execution_id")


def write_json(df: DataFrame, path: str) -> None:
    """Debug dump: one JSON object per line, absent values left out."""
    df.write.mode("errorifexists").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Audit extract with a header; line breaks and quotes inside values survive."""
    (df.write.mode("errorifexists").option("header", True).option("escape", '"')
     .option("quoteAll", True).csv(path))


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return (spark.read.schema(schema).option("header", True).option("escape", '"')
            .option("multiLine", True).csv(path))
