"""Removal of every byte that a string of ``WIDTH`` bytes covers which also starts elsewhere.

The corpus is parsed into phrases at rolling-digest triggers (``phrases``): equal strings lie in phrases
with the same trigger at the same place, so a string repeats only if its phrase's trigger does. What is
compared is the dictionary of distinct phrases, not the corpus:

1. Parse: phrases whose trigger occurs once hold no repeat and are left behind.
2. Dictionary: phrases of the others are grouped by all bytes their strings cover. All strings of a phrase
   that occurs twice repeat.
3. Suffixes: phrases that share a trigger with different neighbours are ordered by their suffixes around it,
   first in pieces of ``STEP`` starts, where a whole piece either repeats, cannot repeat or is left over, then
   single starts of what is left over. One phrase of each dictionary entry takes part.
4. The spans found are merged per document and its kept bytes are put together.

Order among unequal suffixes decides nothing here, so they are brought together by 128-bit digests of
``WIDTH`` bytes instead of a global lexicographic order, whose sort would move every suffix of the corpus.
Every grouping folds its key on the map side; nothing is gathered per passage.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.llm import bytes as B
from runlens.llm.phrases import phrases, pieces, string_digests
from runlens.llm.registry import query, stored, table

WIDTH = 200
STEP = 16
FILTER_BITS = 27
BROADCAST_IDS = 1_000_000
_PHRASE = "uid long, low long, high long, core long, whole long"


def _parsed(rows: DataFrame, width: int, filter_words) -> DataFrame:
    """Phrases (uid, low, high, core, whole); with a filter only those whose trigger may occur twice."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = filter_words.value
        for batch in batches:
            uid = batch["uid"].to_numpy(zero_copy_only=False)
            for run in B.slices(batch["text"]):
                p = phrases(run, width, width // 2)
                slot = p.core >> B.U64(64 - FILTER_BITS)
                keep = (bits[(slot >> B.U64(6)).astype(np.int64)] >> (slot & B.U64(63)) & B.U64(1)).astype(bool)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x[keep]) for x in (uid[run.first + p.doc], p.low, p.high, B.signed(p.core), B.signed(p.whole))],
                    names=["uid", "low", "high", "core", "whole"])

    return rows.select("uid", "text").mapInArrow(emit, _PHRASE)


def _repeated_triggers(rows: DataFrame, width: int) -> DataFrame:
    """(core): digests of the triggers that occur more than once, summed per batch before the shuffle."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            core = [phrases(run, width, width // 2).core for run in B.slices(batch["text"])]
            if core:
                key, n = np.unique(np.concatenate(core), return_counts=True)
                yield pa.RecordBatch.from_pydict({"core": B.signed(key), "n": n.astype(np.int32)})

    return rows.select("text").mapInArrow(count, "core long, n int").groupBy("core").agg(F.sum("n").alias("n")) \
        .where("n > 1").select("core")


def _filter_words(cores: DataFrame):
    """A bitmap of 2**FILTER_BITS bits that has every repeated trigger; it only saves moving the others."""
    slot = F.shiftrightunsigned("core", 64 - FILTER_BITS)
    got = cores.groupBy(F.shiftright(slot, 6).alias("at")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(core, {64 - FILTER_BITS}) & 63 as int))")).alias("bits")).toArrow()
    words = np.zeros(1 << (FILTER_BITS - 6), B.U64)
    words[got["at"].to_numpy()] = got["bits"].to_numpy().view(B.U64)
    return cores.sparkSession.sparkContext.broadcast(words)


def _around(texts: DataFrame, entries: DataFrame, emit, shape: str) -> DataFrame:
    """``emit`` over the texts with the list of their dictionary entries."""
    lists = entries.groupBy("uid").agg(F.collect_list(F.struct("core", "whole", "low", "high", *[
        c for c in entries.columns if c == "k"])).alias("entries"))
    return texts.join(lists, "uid").select("uid", "text", "entries").mapInArrow(emit, shape)


def _located(batch: pa.RecordBatch):
    """Runs of the batch with their entries: (run, row, entry columns), positions counted in the run."""
    lists = batch["entries"]
    offsets, flat = np.asarray(lists.offsets), lists.values
    names = [flat.type.field(i).name for i in range(flat.type.num_fields)]
    columns = {n: np.asarray(flat.field(i)) for i, n in enumerate(names)}
    for run in B.slices(batch["text"], 1 << 20):
        a, b = offsets[run.first], offsets[run.first + run.n]
        row = np.repeat(np.arange(run.n), np.diff(offsets[run.first:run.first + run.n + 1]))
        yield run, row, {n: c[a:b] for n, c in columns.items()}


def repeats(docs: DataFrame, text: str = "text", row_id: str = "doc_id", width: int = WIDTH, step: int = STEP) -> tuple[DataFrame, DataFrame]:
    """(rows with uid, spans of repeated bytes (uid, low, high) that may overlap).

    ``uid`` is a digest of id and text; rows that agree in both share it, and each counts as an occurrence.
    """
    rows = docs.select(F.col(row_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")) \
        .withColumn("uid", F.xxhash64(F.col("id"), F.col("text")))
    cores = stored(_repeated_triggers(rows, width), "phrase-triggers")
    parsed = _parsed(rows, width, _filter_words(cores))
    live = stored(parsed.join(cores, "core"), "phrases")

    entry = F.min(F.struct("uid", "low", "high")).alias("at")
    book = stored(live.groupBy("core", "whole").agg(F.count("*").alias("n"), entry), "phrase-book")
    crowded = book.groupBy("core").agg(F.count("*").alias("ways")).where("ways > 1").select("core")
    shared = stored(book.join(crowded, "core").select("core", "whole", "n", "at.*"), "phrase-shared")

    twice = book.where("n > 1").select("core", "whole")
    whole = live.join(twice, ["core", "whole"]).select("uid", "low", (F.col("high") + width).alias("high"))

    touched = shared.select("uid").distinct()
    few = touched.count() <= BROADCAST_IDS
    texts = stored(rows.select("uid", "text").join(F.broadcast(touched) if few else touched, "uid"), "phrase-texts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid = batch["uid"].to_numpy(zero_copy_only=False)
            for run, row, e in _located(batch):
                base = run.starts[row]
                p = pieces(run, base + e["low"], base + e["high"], width, width // 2, step)
                at = base[p.phrase]
                yield pa.RecordBatch.from_pydict({
                    "uid": uid[run.first + row[p.phrase]], "core": e["core"][p.phrase], "phrase": e["whole"][p.phrase],
                    "k": p.k, "piece": B.signed(p.core), "whole": B.signed(p.whole), "low": p.low - at, "high": p.high - at})

    cuts = stored(_around(texts, shared, cut, "uid long, core long, phrase long, k long, piece long, whole long, low long, high long")
                  .dropDuplicates(["core", "phrase", "k"]), "phrase-pieces")
    # One phrase per dictionary entry: two rows here are two different phrases.
    same = cuts.groupBy("core", "piece", "k", "whole").agg(F.count("*").alias("n"), F.min(F.struct("uid", "phrase")).alias("who"))
    same = stored(same, "phrase-same")
    met = cuts.join(same.where("n > 1").select("core", "piece", "k", "whole"), ["core", "piece", "k", "whole"]) \
        .select("uid", "low", (F.col("high") + width).alias("high"))
    open_ = same.groupBy("core", "piece", "k").agg(F.count("*").alias("ways")).where("ways > 1").select("core", "piece", "k")
    left = stored(cuts.join(open_, ["core", "piece", "k"]).select(
        "uid", F.col("piece").alias("core"), F.col("whole"), "low", "high", F.col("k")), "phrase-left")

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid = batch["uid"].to_numpy(zero_copy_only=False)
            for run, row, e in _located(batch):
                count = e["high"] - e["low"] + 1
                of = np.repeat(np.arange(len(count)), count)
                start = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + e["low"][of]
                yield pa.RecordBatch.from_pydict({
                    "uid": uid[run.first + row[of]], "piece": e["core"][of], "low": start,
                    "string": B.signed(string_digests(run, start + run.starts[row[of]], width))})

    single = stored(_around(texts, left, spell, "uid long, piece long, low long, string long").distinct(), "phrase-strings")
    again = single.groupBy("piece", "string").agg(F.count("*").alias("n")).where("n > 1").select("piece", "string")
    alone = single.join(again, ["piece", "string"]).select("uid", "low", (F.col("low") + width).alias("high"))
    return rows, stored(whole.unionByName(met).unionByName(alone), "repeated-spans")


def remove_repeats(docs: DataFrame, text: str = "text", row_id: str = "doc_id", width: int = WIDTH,
                   with_bytes: bool = False, **options) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, spans[, kept]) of every row.

    ``spans`` lists the removed runs as (low, high) byte offsets, ``kept`` the bytes that remain, which may
    cut a character in two. Null and empty texts have no bytes; texts below ``width`` bytes lose none. Whole
    rows that repeat are occurrences of each other. An empty table gives an empty result.
    """
    rows, spans = repeats(docs, text, row_id, width, **options)
    lists = spans.groupBy("uid").agg(F.array_sort(F.collect_set(F.struct("low", "high"))).alias("entries"))
    lists = stored(lists, "span-lists")
    touched = lists.select("uid")
    few = touched.count() <= BROADCAST_IDS
    texts = rows.select("uid", "text").join(F.broadcast(touched) if few else touched, "uid").dropDuplicates(["uid"])

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"uid": batch["uid"].to_pylist(), "n_removed": [], "n_spans": [], "kept_sha256": [], "spans": []}
            body = []
            for value, entries in zip(batch["text"], batch["entries"]):
                data = value.as_buffer().to_pybytes()
                # Runs that touch or overlap are one run.
                low, high = (np.asarray(entries.values.field(i)) for i in (0, 1))
                top = np.maximum.accumulate(high)
                new = np.append(True, low[1:] > top[:-1])
                begin, end = low[new], top[np.append(np.flatnonzero(new)[1:] - 1, len(top) - 1)]
                rest = b"".join(data[x:y] for x, y in zip([0, *end.tolist()], [*begin.tolist(), len(data)]))
                out["n_removed"].append(int((end - begin).sum()))
                out["n_spans"].append(len(begin))
                out["kept_sha256"].append(hashlib.sha256(rest).hexdigest())
                out["spans"].append([{"low": a, "high": b} for a, b in zip(begin.tolist(), end.tolist())])
                body.append(rest)
            spans = pa.array(out.pop("spans"), pa.list_(pa.struct({"low": pa.int64(), "high": pa.int64()})))
            columns = [pa.array(v) for v in out.values()] + [spans] + [pa.array(body, pa.binary())] * with_bytes
            yield pa.RecordBatch.from_arrays(columns, names=[*out, "spans"] + ["kept"] * with_bytes)

    shape = "uid long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<low: long, high: long>>"
    done = texts.join(lists, "uid").mapInArrow(kept, shape + ", kept binary" * with_bytes)
    zero = F.lit(0).cast("long")
    none = F.array().cast("array<struct<low: long, high: long>>")
    mine = rows.select("id", "uid", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha"),
                       *([F.col("text").cast("binary").alias("body")] if with_bytes else []))
    out = mine.join(done, "uid", "left")
    return out.select(F.col("id").alias(row_id), "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"),
                      F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"),
                      F.coalesce("spans", none).alias("spans"), *([F.coalesce("kept", "body").alias("kept")] if with_bytes else []))


@query("op4_suffix_dedup")
def op4_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeats(table(spark, folder, "documents")).drop("spans")
