"""Quality by logistic regression over hashed word n-grams, learned with FTRL-proximal.

Features are runs of one and two tokens, hashed into 2**18 dimensions with the
logarithm of their count and scaled to length one. A pair of equal tokens counts as one
and the same feature whatever the token, so that stuttering text has a feature of its own.

Training reads at most ``MAX_EXAMPLES`` labelled documents (a digest of the id decides
which), split over a fixed number of shards. Each shard follows the regularised leader
document by document; after each pass the shards' states are averaged and the next pass
starts there. States have a fixed number of dimensions, whatever the corpus. Scores are
sparse dot products of whole texts with the weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.llm import bytes as B
from runlens.llm.labelled import examples
from runlens.llm.registry import query, remainder, stored, table

BITS = 18
MAX_EXAMPLES = 6144
SHARDS = 8
PASSES = 3
UPDATES = 30_000
ALPHA, BETA, L1, L2 = 3.0, 1.0, 0.01, 0.01
THRESHOLD = 0.3
_SAME = B.U64(0x7F4A7C159E3779B9)
_SHIFT = B.U64(64 - BITS)


def features(run: B.Run) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, dimension, value) triples, grouped by document in order."""
    w = B.tokens(run)
    keys = [w.doc.astype(B.U64) << B.U64(BITS) | B.mix(w.ids) >> _SHIFT]
    if len(w.ids) > 1:
        pair = B.mix(w.ids[:-1] + B.U64(1)) ^ w.ids[1:]
        pair = B.mix(np.where(w.ids[:-1] == w.ids[1:], _SAME, pair))
        inside = w.doc[:-1] == w.doc[1:]
        keys.append((w.doc[:-1].astype(B.U64) << B.U64(BITS) | pair >> _SHIFT)[inside])
    key, count = np.unique(np.concatenate(keys), return_counts=True)
    doc = (key >> B.U64(BITS)).astype(np.int64)
    value = np.log1p(count)
    norm = np.sqrt(np.bincount(doc, value * value, run.n))
    return doc, (key & B.U64((1 << BITS) - 1)).astype(np.int64), value / norm[doc]


def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The leader's weights: zero inside the L1 ball, shrunk by the accumulated gradients outside."""
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def follow(z: np.ndarray, n: np.ndarray, rows: list) -> None:
    """One pass over (y, dimensions, values); ``z`` and ``n`` are updated in place."""
    for y, at, x in rows:
        w = weights(z[at], n[at])
        p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
        g = (p - y) * x
        grown = n[at] + g * g
        z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / ALPHA * w
        n[at] = grown


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", limit: int = MAX_EXAMPLES,
          shards: int = SHARDS, passes: int = PASSES, **names) -> np.ndarray:
    """Weights of the 2**18 dimensions and the intercept; all zero when nothing is labelled."""
    size = (1 << BITS) + 1

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, ids = batch["y"].to_numpy(zero_copy_only=False), batch["id"].to_numpy(zero_copy_only=False)
            for run in B.slices(batch["text"]):
                doc, at, x = features(run)
                cut = np.searchsorted(doc, np.arange(run.n + 1))
                own = slice(run.first, run.first + run.n)
                yield pa.RecordBatch.from_pydict({
                    "id": ids[own], "y": y[own],
                    "at": [np.append(at[a:b], size - 1).astype(np.int32) for a, b in zip(cut[:-1], cut[1:])],
                    "x": [np.append(x[a:b], 1.0).astype(np.float32) for a, b in zip(cut[:-1], cut[1:])]})

    rows = stored(examples(docs, labels, label, limit, **names)
                  .mapInArrow(vectors, "id long, y int, at array<int>, x array<float>")
                  .withColumn("shard", F.pmod(F.xxhash64("id", F.lit(5)), F.lit(shards))), "vectors")
    z, n = np.zeros(size), np.zeros(size)
    for number in range(passes):
        z0, n0 = z, n

        def one_shard(rows: pd.DataFrame) -> pd.DataFrame:
            z, n = z0.copy(), n0.copy()
            ids = rows["id"].to_numpy(np.int64).view(B.U64)
            # Few examples are gone through several times, so that a shard always makes about as many updates.
            for turn in range(min(max(UPDATES // (passes * len(rows)), 1), 40)):
                order = np.argsort(B.mix(ids + B.U64(number * 64 + turn)), kind="stable")
                follow(z, n, [(rows.y.iat[i], rows["at"].iat[i], rows.x.iat[i]) for i in order])
            seen = np.flatnonzero((n != n0) | (z != z0))
            return pd.DataFrame({"at": seen, "dz": z[seen] - z0[seen], "dn": n[seen] - n0[seen]})

        steps = (rows.groupBy("shard").applyInPandas(one_shard, "at long, dz double, dn double")
                 .groupBy("at").agg(F.sum("dz").alias("dz"), F.sum("dn").alias("dn")).toPandas())
        z, n = z.copy(), n.copy()
        z[steps["at"]] += steps.dz / shards
        n[steps["at"]] += steps.dn / shards
    return weights(z, n)


def score(docs: DataFrame, w: np.ndarray, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """(id, score) of every document: the chance of label 1. A null or empty text scores by the intercept."""
    w32 = w.astype(np.float32)

    def dot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in B.slices(batch[1]):
                doc, at, x = features(run)
                total = np.bincount(doc, w32[at] * x, run.n) + float(w32[-1])
                yield pa.RecordBatch.from_arrays(
                    [batch[0].slice(run.first, run.n), pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))))],
                    names=["id", "score"])

    kind = docs.schema[row_id].dataType.simpleString()
    return docs.select(F.col(row_id).alias("id"), F.col(text).cast("string").alias("text")) \
        .mapInArrow(dot, f"id {kind}, score double").withColumnRenamed("id", row_id)


@query("op5_quality")
def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    w = train(docs, table(spark, folder, "labels"))
    return score(docs, w).select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score",
                                 (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
