"""A mix of sources in target weights, made of fixed-length word blocks.

The documents of a source stand in a pseudorandom order and their words are packed
end to end into blocks of ``block_words``. The mix is a list of slots, dealt over
output shards: each shard's source counts are a multinomial draw whose chances are
what the sources still have to give, and a draw beyond that is drawn again from the
others, so that the counts add up to the quotas. The s-th slot of a source is its
block number ``permutation(s mod blocks)``; each pass over the blocks has its own
permutation. Slots and blocks meet in a join on (source, block).

Quotas are water-filled: weights 5, 2, 1, repeating over the sources in code point
order (null last), and no source gives more than ``max_epochs`` times its words.
No block is used more often than that, hence no document either.

The driver holds one row per source and per (shard, source); the number of sources
is checked against ``MAX_SOURCES``. Everything per document, block or slot is a join
or a window over a bounded run of rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens.llm.registry import query, stored, table

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
BLOCK_WORDS = 128
SLOTS_PER_SHARD = 8192
MAX_SOURCES = 1_000_000
ROWS_PER_RUN = 4000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: dict, weights=WEIGHTS, max_epochs: float = MAX_EPOCHS, share: float = 1.0) -> dict:
    """Words wanted of each source: by weight, at most ``max_epochs`` times its size, the excess dealt out again."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-32-be"))
    order += [None] if None in sizes else []
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out: dict = {}
    left, open_ = share * sum(sizes.values()), list(order)
    while open_:
        whole = sum(weight[s] for s in open_)
        capped = [s for s in open_ if left * weight[s] / whole > max_epochs * sizes[s]]
        if not capped:
            out |= {s: left * weight[s] / whole for s in open_}
            break
        for s in capped:
            out[s] = float(max_epochs * sizes[s])
            left -= out[s]
        open_ = [s for s in open_ if s not in capped]
    return out


def draw_counts(quotas: np.ndarray, slots_per_shard: int, seed: int) -> np.ndarray:
    """(shards, sources) counts: multinomial draws per shard that use the quotas up exactly."""
    rng = np.random.default_rng(seed)
    left = quotas.astype(np.int64).copy()
    out = []
    while left.sum():
        want = min(slots_per_shard, int(left.sum()))
        got = np.zeros_like(left)
        while want:
            free = left - got
            step = np.minimum(rng.multinomial(want, free / free.sum()), free)
            got += step
            want -= int(step.sum())
        left -= got
        out.append(got)
    return np.array(out, np.int64).reshape(len(out), len(quotas))


def permute(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of 0..size-1 for each key: a Feistel network, walked until it falls inside."""
    half = np.maximum((np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64) + 1) // 2, 1).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.astype(np.uint64), np.arange(len(index))
    limit, key = size.astype(np.uint64), key.astype(np.uint64)
    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo]
        left, right = out[todo] >> h, out[todo] & m
        for turn in range(4):
            f = (right + k) * np.uint64(0x9E3779B97F4A7C15 + 2 * turn)
            f ^= f >> np.uint64(29)
            f *= np.uint64(0xBF58476D1CE4E5B9)
            f ^= f >> np.uint64(32)
            left, right = right, left ^ (f & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= limit[todo]]
    return out.astype(np.int64)


def _laid_out(docs: DataFrame, runs: int) -> DataFrame:
    """``docs`` with ``_at``, the offset of the document's first word inside its source."""
    key = F.xxhash64(F.col("_id"), F.lit(61))
    rows = docs.withColumns({"_key": key, "_run": F.pmod(F.shiftright(key, 20), F.lit(runs))})
    per_run = rows.groupBy("_source", "_run").agg(F.sum("_size").alias("_words"))
    before = F.sum("_words").over(Window.partitionBy("_source").orderBy("_run")) - F.col("_words")
    per_run = per_run.select("_source", "_run", before.alias("_before"))
    inner = Window.partitionBy("_source", "_run").orderBy("_key", "_id", "_size", "_digest", "_row").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_within", F.coalesce(F.sum("_size").over(inner), F.lit(0)))
    return rows.join(per_run, ["_source", "_run"]).withColumn("_at", F.col("_before") + F.col("_within")) \
        .drop("_key", "_run", "_before", "_within")


def plan(docs: DataFrame, source: str = "source", row_id: str = "doc_id", text: str = "text",
         weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, block_words: int = BLOCK_WORDS,
         slots_per_shard: int = SLOTS_PER_SHARD, seed: int = 17, key: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents with sizes and targets, pieces of documents in blocks, slots of the mix).

    Pieces: source number, block, row, id, first word, words. Slots: source number, block, mix shard,
    slot. A null or empty text has no words and is never taken; a null source is a source of its
    own; rows that share an id are rows of their own, told apart by ``_row``: the column ``key``, whose
    values differ, or a number given here. An empty table gives three empty results.
    """
    spark = docs.sparkSession
    rows = stored(docs.select(F.col(row_id).alias("_id"), F.col(source).alias("_name"),
                              word_count(F.col(text)).alias("_size"), F.xxhash64(text).alias("_digest"),
                              (F.col(key) if key else F.monotonically_increasing_id()).alias("_row")), "mix-sizes")
    per_source = rows.groupBy("_name").agg(F.sum("_size").alias("words"), F.count("*").alias("rows"))
    held = per_source.limit(MAX_SOURCES + 1).collect()
    if len(held) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: group them before mixing")
    sizes = {r["_name"]: r["words"] for r in held}
    wanted = targets(sizes, weights, max_epochs)
    names = list(wanted)
    blocks = np.array([-(-sizes[s] // block_words) for s in names], np.int64)
    # The last block of a source is partly filled, so words, not blocks, are what the quota counts.
    mean = np.array([sizes[s] / b if b else 1.0 for s, b in zip(names, blocks)])
    quotas = np.minimum(np.rint(np.array([wanted[s] for s in names]) / mean), max_epochs * blocks).astype(np.int64) \
        if names else np.zeros(0, np.int64)
    counts = draw_counts(quotas, slots_per_shard, seed)
    runs = max(1, max((r["rows"] for r in held), default=0) // ROWS_PER_RUN * 2 + 1)
    numbered = spark.createDataFrame([(n, i, int(sizes[n]), float(wanted[n])) for i, n in enumerate(names)],
                                     "_of string, _source int, source_size long, target double")
    rows = rows.join(numbered, F.col("_name").eqNullSafe(F.col("_of"))).drop("_of")
    laid = _laid_out(rows, runs)
    step = F.lit(block_words)
    first_block = F.floor(F.col("_at") / step)
    last_block = F.floor((F.col("_at") + F.col("_size") - 1) / step)
    block = F.explode(F.sequence(first_block, last_block)).alias("block")
    begin = F.greatest(F.col("block") * step, F.col("_at"))
    end = F.least((F.col("block") + 1) * step, F.col("_at") + F.col("_size"))
    pieces = (laid.where("_size > 0").select("_source", "_row", "_id", "_at", "_size", block)
              .select("_source", "block", "_row", "_id", (begin - F.col("_at")).alias("first_word"),
                      (end - begin).alias("n_words")))
    slots = _slots(spark, counts, blocks, seed)
    return rows, pieces, slots


def _slots(spark: SparkSession, counts: np.ndarray, blocks: np.ndarray, seed: int) -> DataFrame:
    """One row per slot of the mix with the block that fills it."""
    before = np.cumsum(counts, axis=0) - counts if len(counts) else counts
    dealt = [(int(s), int(c), int(before[s, c]), int(counts[s, c]), int(blocks[c]))
             for s in range(len(counts)) for c in np.flatnonzero(counts[s])]
    shape = "mix_shard int, _source int, first long, n long, blocks long"
    rows = spark.createDataFrame(dealt, shape)
    if len(dealt) > 64:
        rows = rows.repartition(min(len(dealt) // 64 + 1, 2000))

    @F.pandas_udf(T.LongType())
    def to_block(number: pd.Series, size: pd.Series, source: pd.Series) -> pd.Series:
        number, size = number.to_numpy(np.int64), size.to_numpy(np.int64)
        key = (source.to_numpy(np.uint64) * np.uint64(0xD1342543DE82EF95) + (number // size).astype(np.uint64)
               * np.uint64(0xA0761D6478BD642F) + np.uint64(seed))
        return pd.Series(permute(number % size, size, key))

    slot = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("slot")
    return rows.select("mix_shard", "_source", "first", "blocks", slot) \
        .withColumn("block", to_block(F.col("first") + F.col("slot"), "blocks", "_source")) \
        .select("mix_shard", "_source", "slot", "block")


def mixed_blocks(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: (mix_shard, source number, slot, block) with the pieces that fill the block."""
    _, pieces, slots = plan(docs, **options)
    return slots.hint("merge").join(pieces, ["_source", "block"])


def taken_pieces(docs: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """(documents, pieces with ``uses``): how often the mix uses each block, joined by index."""
    rows, pieces, slots = plan(docs, **options)
    uses = slots.groupBy("_source", "block").agg(F.count("*").alias("uses"))
    # The plan sees few runs of slots before they are exploded and would broadcast what grows with the corpus.
    return rows, pieces.join(uses.hint("merge"), ["_source", "block"])


def mixed_documents(docs: DataFrame, text: str = "text", row_id: str = "doc_id", source: str = "source",
                    max_epochs: int = MAX_EPOCHS, **options) -> DataFrame:
    """The mix as documents: row u of a document holds the words of it that are used u times or more.

    Rows that share an id are documents of their own: where there are such, ``docs`` is written with a number per row.
    Words keep their order and are joined by one space where words between them are missing; a
    document used whole keeps its text as it is, spacing included. ``n_chars`` follows the text.
    """
    columns, key = docs.columns, row_id
    if not docs.groupBy(row_id).count().where("count > 1").isEmpty():
        docs, key = stored(docs.withColumn("_mix_row", F.monotonically_increasing_id()), "mix-rows"), "_mix_row"
    _, used = taken_pieces(docs, text=text, row_id=row_id, source=source, max_epochs=max_epochs, key=key, **options)
    copies = (used.select("_row", "first_word", "n_words", F.explode(F.sequence(F.lit(1), F.col("uses").cast("int"))).alias("_copy"))
              .groupBy("_row", "_copy").agg(F.sum("n_words").alias("_kept"),
                                           F.collect_set(F.struct("first_word", "n_words")).alias("_parts")))
    words = F.regexp_extract_all(F.col(text), F.lit(f"({WORD})"), F.lit(1))
    part = F.transform(F.array_sort("_parts"), lambda p: F.slice(
        F.col("_words"), (p["first_word"] + 1).cast("int"), p["n_words"].cast("int")))
    joined = F.array_join(F.flatten(part), " ")
    out = docs.join(copies, F.col(key).eqNullSafe(F.col("_row")))
    partly = F.col("_kept") < word_count(F.col(text))
    body = F.when(~partly, F.col(text)).otherwise(joined)
    out = out.withColumn("_words", F.when(partly, words)).withColumn(text, body)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length(text).cast(docs.schema["n_chars"].dataType))
    return out.select(*columns)


@query("op6_mixing")
def op6_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    rows, used = taken_pieces(docs)
    taken = used.groupBy("_row").agg(F.sum(F.col("n_words") * F.col("uses")).alias("taken"))
    return rows.join(taken, "_row", "left").select(
        F.col("_id").alias("doc_id"), F.col("_size").alias("size"), "source_size", "target",
        F.coalesce("taken", F.lit(0)).alias("taken"))
