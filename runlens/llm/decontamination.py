"""Benchmark passages inside documents, by SimHash of item-sized windows. DataFrame functions only.

An item of L words is compared with windows of L words. Similarity is the weighted Jaccard
similarity of the two multisets of five-word shingles, words being runs of letters and digits in
lower case.

1. A window that reaches the threshold t shares all but (1 - t) of the item's shingles, so it holds
   at least one of any ``probe_count`` of them. Each item names that many probes (those of the longest
   words, which are rare). Documents that hold the two longest words of a probe are looked through for
   the probe itself, and the windows that cover one are kept.
2. Each such window and each item gets a 64-bit SimHash of its shingles.
3. The fingerprints are cut into ``BLOCKS`` blocks. Two fingerprints within ``RADIUS`` bits differ in at
   most ``FLIPS`` bits of some block, so items are entered under every value within that distance of each
   of their blocks, and an equi-join on (words, block, value) finds all pairs within the radius.
4. The pairs are verified by their exact similarity.

Probes and items have the size of the benchmark; Spark broadcasts them when that is small and shuffles
otherwise. Per document only shingle positions move, and only those that hit a probe.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.llm.registry import discard, query, release, stored, table

WORDS = 5
THRESHOLD = 0.8
BLOCKS, BLOCK_BITS, FLIPS = 8, 8, 2
RADIUS = BLOCKS * (FLIPS + 1) - 1
_ALL = 2_000_000_000
# Words are runs of ASCII letters and digits and of characters beyond ASCII.
BETWEEN = r"[\x00-/:-@\[-`{-\x7f]+"


def words_of(text: Column) -> Column:
    """Words in lower case; a text that begins or ends with another mark has an empty word there."""
    return F.split(F.lower(F.coalesce(text, F.lit(""))), BETWEEN)


def filled_words_of(text: Column) -> Column:
    return F.filter(words_of(text), lambda x: x != "")


def with_shingles(rows: DataFrame) -> DataFrame:
    """Adds ``h``, the digest of the five words of ``w`` from each position on."""
    rows = rows.withColumn("w1", F.transform("w", lambda x: F.xxhash64(x)))
    rows = rows.withColumn("w2", F.zip_with("w1", F.slice("w1", 2, _ALL), lambda a, b: F.xxhash64(a, b)))
    rows = rows.withColumn("w4", F.zip_with("w2", F.slice("w2", 3, _ALL), lambda a, b: F.xxhash64(a, b)))
    full = F.zip_with("w4", F.slice("w1", 5, _ALL), lambda a, b: F.xxhash64(a, b))
    return rows.withColumn("h", F.slice(full, 1, F.greatest(F.size("w1") - (WORDS - 1), F.lit(0)))).drop("w1", "w2", "w4")


def _items(benchmark: DataFrame, text: str, row_id: str) -> DataFrame:
    """(item, words, h) of the items with at least five words."""
    rows = with_shingles(benchmark.select(F.col(row_id).alias("item"), filled_words_of(F.col(text)).alias("w")))
    return rows.select("item", "w", "h", F.size("w").alias("words")).where(F.size("h") > 0)


def probe_count(shingles: Column, threshold: float = THRESHOLD) -> Column:
    """One more than the shingles of an item that a similar window may lack."""
    return (F.floor(shingles * F.lit(1 - threshold) + F.lit(1e-9)) + 1).cast("int")


def _probes(items: DataFrame, threshold: float) -> DataFrame:
    """(probe, words, first, second): shingles to look for, their window sizes, digests of their two longest words."""
    piece = lambda i: F.slice("w", i + 1, WORDS)
    length = lambda i: F.char_length(F.array_join(piece(i), ""))
    longest = lambda i: F.slice(F.reverse(F.array_sort(F.transform(
        piece(i), lambda x: F.struct(F.char_length(x).alias("n"), x.alias("x"))))), 1, 2)
    ranked = F.array_sort(F.transform("h", lambda h, i: F.struct((-length(i)).alias("rank"), i.alias("i"), h.alias("h"))))
    picked = items.select("words", "w", F.explode(F.slice(ranked, F.lit(1), probe_count(F.size("h"), threshold))).alias("p"))
    return (picked.select(F.col("p.h").alias("probe"), "words", longest(F.col("p.i")).alias("two"))
            .select("probe", "words", F.xxhash64(F.col("two")[0]["x"]).alias("first"),
                    F.xxhash64(F.col("two")[1]["x"]).alias("second")).distinct())


def _candidates(rows: DataFrame, probes: DataFrame) -> DataFrame:
    """(doc): ids of documents that hold the two longest words of some probe."""
    pairs = probes.select("probe", "first", "second").distinct()
    sought = (pairs.select("probe", F.col("first").alias("word"), F.lit(1).alias("mark"))
              .union(pairs.select("probe", "second", F.lit(2))))
    met = rows.select("doc", F.explode(words_of(F.col("text"))).alias("x")).select("doc", F.xxhash64("x").alias("word"))
    return (met.join(sought, "word").groupBy("doc", "probe").agg(F.bit_or("mark").alias("marks"))
            .where(F.col("marks") == 3).select("doc").distinct())


def fingerprint(sums: list[Column], n: Column) -> Column:
    """SimHash from lane sums: lane j of sum i counts the ones of bit 16 j + i."""
    out = F.lit(0).cast("long")
    for i, total in enumerate(sums):
        for j in range(4):
            lane = F.shiftrightunsigned(total, 16 * j).bitwiseAND(F.lit(0xFFFF))
            out = out.bitwiseOR(F.when(lane * 2 > n, F.lit(1 << (16 * j + i) if 16 * j + i < 63 else -(1 << 63))).otherwise(F.lit(0)).cast("long"))
    return out


def _lane_sums(h: str) -> list[Column]:
    lanes = F.lit(0x0001000100010001)
    return [F.sum(F.shiftrightunsigned(F.col(h), i).bitwiseAND(lanes)).alias(f"s{i}") for i in range(16)]


def with_fingerprint(rows: DataFrame, keys: list[str]) -> DataFrame:
    """SimHash of the array ``h`` per key; ``h`` itself is kept."""
    summed = (rows.select(*keys, F.explode("h").alias("x")).groupBy(*keys)
              .agg(F.count("*").alias("n"), *_lane_sums("x")))
    marks = summed.select(*keys, fingerprint([F.col(f"s{i}") for i in range(16)], F.col("n")).alias("fp"))
    return rows.join(marks, keys)


def _block(fp: Column, k: int) -> Column:
    return F.shiftrightunsigned(fp, BLOCK_BITS * k).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))


def _flip_masks() -> list[int]:
    return [sum(1 << b for b in bits) for r in range(FLIPS + 1) for bits in combinations(range(BLOCK_BITS), r)]


def within_radius(windows: DataFrame, items: DataFrame) -> DataFrame:
    """Pairs of equal size whose fingerprints differ in at most ``RADIUS`` bits, each once."""
    at = lambda fp: F.array(*[F.struct(F.lit(k).alias("block"), _block(fp, k).alias("value")) for k in range(BLOCKS)])
    entries = (items.select("item", "words", F.col("fp").alias("item_fp"), F.explode(at(F.col("fp"))).alias("b"))
               .select("item", "words", "item_fp", "b.block", F.explode(F.array(*[F.lit(m) for m in _flip_masks()])).alias("mask"), "b.value")
               .select("item", "words", "item_fp", "block", F.col("value").bitwiseXOR(F.col("mask")).alias("value")))
    looked = windows.select("doc", "start", "words", "fp", F.explode(at(F.col("fp"))).alias("b")) \
        .select("doc", "start", "words", "fp", "b.block", "b.value")
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS
    return looked.join(entries, ["words", "block", "value"]).where(near).select("doc", "start", "words", "item").distinct()


def _numbered(h: Column) -> Column:
    """Each value with how often it came before, so that a set intersection is one of multisets."""
    return F.transform(h, lambda x, i: F.struct(x.alias("x"), F.size(F.filter(F.slice(h, F.lit(1), i), lambda y: y == x)).alias("nth")))


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity of two arrays taken as multisets."""
    plain = (F.size(F.array_distinct(a)) == F.size(a)) & (F.size(F.array_distinct(b)) == F.size(b))
    shared = F.when(plain, F.size(F.array_intersect(a, b))).otherwise(F.size(F.array_intersect(_numbered(a), _numbered(b))))
    return shared / (F.size(a) + F.size(b) - shared)


def leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", row_id: str = "doc_id", item_text: str = "text",
          item_id: str = "item_id", threshold: float = THRESHOLD) -> DataFrame:
    """(id, item_id, similarity, start_word, n_words): the best window of each document and item at the threshold.

    The first of equally similar windows counts. Rows that share an id are one document with several
    texts. A document shorter than the item is one window. Null and empty texts have no shingles, nor have
    texts and items under five words: they match nothing. A null id is an id like any other.
    """
    items = _items(benchmark, item_text, item_id)
    probes = _probes(items, threshold)
    # An item listed twice is one item; the digest tells apart items that share an id.
    marked = items.select("item", "words", "h", F.xxhash64("item", "h").alias("key")).dropDuplicates(["key"])
    entered = with_fingerprint(marked, ["key"])
    rows = docs.select(F.col(row_id).alias("doc"), F.col(text).alias("text"))
    near = stored(_candidates(rows, probes), "leak-candidates")
    read = rows.join(near.withColumnRenamed("doc", "of"), F.col("doc").eqNullSafe(F.col("of"))).select("doc", filled_words_of(F.col("text")).alias("w"))
    read = stored(with_shingles(read).select("doc", "h", F.monotonically_increasing_id().alias("row")), "leak-shingles")
    hits = read.select("row", F.posexplode("h").alias("pos", "probe")).join(probes.select("probe", "words").distinct(), "probe")
    about = hits.groupBy("row").agg(F.collect_set(F.struct("pos", "words")).alias("hits"))
    found = read.join(about, "row")
    # Every start from which a window of that size still covers the hit.
    starts = F.explode(F.array_distinct(F.flatten(F.transform("hits", lambda x: F.transform(
        F.sequence(F.greatest(x["pos"] - (x["words"] - WORDS), F.lit(0)), x["pos"]),
        lambda s: F.struct(s.alias("start"), x["words"].alias("words")))))))
    windows = (found.select("doc", "h", starts.alias("at"))
               .select("doc", "at.start", "at.words", F.slice("h", F.col("at.start") + 1, F.col("at.words") - (WORDS - 1)).alias("h"))
               .withColumn("key", F.xxhash64("doc", "start", "words", "h")).where(F.size("h") > 0))
    plain = stored(windows, "leak-windows")
    discard(near, read)
    windows = stored(with_fingerprint(plain.dropDuplicates(["key"]), ["key"]), "leak-marked")
    discard(plain)
    release(docs.sparkSession)
    pairs = within_radius(windows.select(F.col("key").alias("doc"), "start", "words", "fp"),
                          entered.select(F.col("key").alias("item"), "words", "fp"))
    checked = (pairs.select(F.col("doc").alias("key"), F.col("item").alias("item_key"))
               .join(windows.select("key", "doc", "start", "words", "h"), "key")
               .join(entered.select(F.col("key").alias("item_key"), "item", F.col("h").alias("item_h")), "item_key")
               .withColumn("similarity", similarity(F.col("h"), F.col("item_h"))).where(F.col("similarity") >= threshold))
    best = F.max(F.struct("similarity", (-F.col("start")).alias("back"), F.col("words").alias("n_words"))).alias("best")
    return checked.groupBy("doc", "item").agg(best).select(
        F.col("doc").alias(row_id), F.col("item").alias(item_id), "best.similarity",
        (-F.col("best.back")).alias("start_word"), "best.n_words")


def clean(docs: DataFrame, benchmark: DataFrame, row_id: str = "doc_id", **options) -> DataFrame:
    """The documents in which no item leaked; their columns are untouched."""
    bad = leaks(docs, benchmark, row_id=row_id, **options).select(F.col(row_id).alias("_bad")).distinct()
    return docs.join(bad, F.col(row_id).eqNullSafe(F.col("_bad")), "left_anti")


@query("op7_decontamination")
def op7_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
