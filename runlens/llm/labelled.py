"""The labelled examples that models of document texts learn from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.registry import remainder, stored

FOLDS = 5


def examples(docs: DataFrame, labels: DataFrame, label: str, limit: int, *, text: str = "text",
             row_id: str = "doc_id", folds: int = FOLDS) -> DataFrame:
    """(id, text, y) of at most ``limit`` labelled ids outside the held-out fold, in the order of a digest of the id.

    Ids without a label are left out, an id labelled twice takes the larger label, a null text is empty.
    The limit bounds what is broadcast to the scan of the documents.
    """
    known = (labels.where(F.col(label).isNotNull() & F.col(row_id).isNotNull() & (remainder(F.col(row_id), folds) != 0))
             .groupBy(F.col(row_id).alias("id")).agg(F.max(label).cast("int").alias("y"))
             .orderBy(F.xxhash64("id"), "id").limit(limit))
    rows = docs.select(F.col(row_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return stored(rows.join(F.broadcast(known), "id"), "examples")

