"""The corpus pipeline: five stages over ``documents``, each reading what the one before kept."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.llm import decontamination, jaccard_join, mixing, sharding, toxicity
from runlens.llm.registry import noted, release, remove, stored, table

#: Rows of whole texts that Spark hands to Python at a time; its own default is sized for narrow rows.
ARROW_ROWS = "1000"
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
_made: list[str] = []


def tidy(stage: Callable) -> Callable:
    """A stage that begins by deleting the work tables of those before it, unless its ``docs`` still read them.

    What earlier stages return has been written by then, or is read through ``docs``.
    """
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        files = docs.inputFiles()
        # A path without scheme is found inside the name of a file with one.
        gone = [path for path in _made if not any(path.split(":", 1)[-1].strip("/") in f for f in files)]
        remove(spark, gone)
        _made[:] = [path for path in _made if path not in gone]
        release(spark)
        with noted() as made:
            out = stage(spark, docs, sf_dir)
        _made.extend(made)
        return out

    return run_stage


@tidy
def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled examples call toxic go."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    docs = docs.select(*COLUMNS)
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


@tidy
def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the documents that n-gram Jaccard links connect, the one with the smallest id stays."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    groups = jaccard_join.join(docs.select("doc_id", "text"))
    stays = stored(groups.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
                   .select(F.col("doc_id").alias("stays")).distinct(), "near-copies")
    return docs.select(*COLUMNS).join(stays, F.col("doc_id").eqNullSafe(F.col("stays")), "left_semi")


@tidy
def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return decontamination.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


@tidy
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and with those of their words, as the mix takes them."""
    return mixing.mixed_documents(docs.select(*COLUMNS))


@tidy
def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shards of near-equal bytes; the last stage, so ``shard`` and ``slot`` follow the columns of documents."""
    return sharding.shard(docs.select(*COLUMNS))


STAGES = [
    ("toxicity", toxicity_stage),
    ("n-gram Jaccard join", near_copies_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mixing_stage),
    ("sharding", sharding_stage),
]

# Model scores, random draws and sampled splitters have no SQL; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name.replace(" ", "-"))
    return docs
