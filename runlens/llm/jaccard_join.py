"""Join of near-equal documents: Jaccard similarity of word n-gram sets as a blocked sparse product.

The product of the document by n-gram matrix with its transpose has the overlap of every two
documents. It is never formed whole. The n-grams have one order, frequent ones last, and a document
keeps in the first block of columns only as many of its first n-grams as a pair at the threshold cannot
do without (``prefix_length``). Products inside this block are summed per pair; a pair whose sum and
sizes rule the threshold out is discarded, and only the others get the product of the remaining columns,
as an intersection of their whole sets.

Documents with one and the same set are one row of the matrix. Rows that meet in columns with many rows are
grouped around pivot rows and written as differences: with d the symmetric difference of a row and its pivot,
two rows x, y of one pivot differ by |d(x)| + |d(y)| - 2 |d(x) d(y)| elements. Columns that a whole family shares are
in no difference, so the product of the differences has few terms, while that of the rows has one per pair of
the family. Pairs whose differences are so small that they link without a common element both link with the
pivot, so that their component is known; all others need a common element among the first ones of both differences, those
that are not in the pivot coming first. Pairs of rows that have no pivot in common get the product of the rows.

The order of n-grams takes the ``MAX_HOT`` most frequent ones of a part of the documents; it and the choice of
pivots decide how many pairs are looked at, never which are found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.llm import bytes as B
from runlens.llm.components import components
from runlens.llm.registry import discard, query, release, stored, table

WORDS = 3
PERCENT = 90
MAX_HOT = 65_536
PART = 32
LONG_COLUMN = 32
FAMILY = 8
BROADCAST_IDS = 1_000_000
_HOT = 1 << 62


def prefix_length(n, percent: int = PERCENT):
    """A set of n shares one of its first so many elements with any set at the threshold."""
    return n - (n * percent + 99) // 100 + 1


def needed(na: Column, nb: Column, percent: int = PERCENT) -> Column:
    """The smallest overlap of two sets of these sizes at the threshold, from 100 i >= percent (na + nb - i)."""
    return F.ceil((na + nb) * percent / (100 + percent))


def _sets(run: B.Run, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, digest) of the distinct shingles, sorted by both."""
    doc, h = B.shingles(B.words(run, lower=True), n)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    return doc[new], h[new]


def frequent(docs: DataFrame, words: int, part: int = PART, limit: int = MAX_HOT) -> tuple[np.ndarray, np.ndarray]:
    """Digests of the most frequent shingles of one ``part``-th of the documents, sorted, and their ranks."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in B.slices(batch["text"]):
                yield pa.RecordBatch.from_pydict({"h": B.signed(_sets(run, words)[1])})

    some = docs.where(F.pmod(F.xxhash64("id", F.lit(9)), F.lit(part)) == 0)
    got = (some.select("text").mapInArrow(emit, "h long").groupBy("h").agg(F.count("*").alias("n"))
           .where("n >= 2").orderBy(F.desc("n"), "h").limit(limit).toPandas())
    h = got.h.to_numpy(np.int64).view(B.U64)
    order = np.argsort(h)
    return h[order], (limit - 1 - np.arange(len(h)))[order].astype(B.U64)


def keys(h: np.ndarray, hot: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Shingles as numbers in the common order: 62 bits of the digest, or above them the rank of a frequent one."""
    out = h >> B.U64(2)
    if len(hot[0]):
        at = np.minimum(np.searchsorted(hot[0], h), len(hot[0]) - 1)
        found = hot[0][at] == h
        out[found] = B.U64(_HOT) + hot[1][at[found]]
    return out


def _signatures(doc: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """128 bits of each document's whole set, zero for an empty one; ``doc`` is sorted."""
    sums = np.zeros((n, 2), B.U64)
    count = np.bincount(doc, minlength=n)
    filled = count > 0
    if filled.any():
        first = (np.cumsum(count) - count)[filled]
        sums[filled, 0] = np.add.reduceat(B.mix(h), first)
        sums[filled, 1] = np.add.reduceat(B.mix(h ^ B.U64(0xA5A5A5A5A5A5A5A5)), first)
    return sums


def _matrix(docs: DataFrame, words: int, percent: int, hot) -> DataFrame:
    """(id, node, n, prefix): node is 128 bits of the whole set."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in B.slices(batch["text"]):
                doc, h = _sets(run, words)
                k = keys(h, hot)
                order = np.lexsort((k, doc))
                k = k[order]
                n = np.bincount(doc, minlength=run.n)
                first = np.cumsum(n) - n
                sums = _signatures(doc, h, run.n)
                length = np.where(n > 0, prefix_length(n, percent), 0)
                cuts = np.concatenate([[0], np.cumsum(length)])
                own = np.arange(cuts[-1]) - np.repeat(cuts[:-1], length) + np.repeat(first, length)
                yield pa.RecordBatch.from_arrays(
                    [batch["id"].slice(run.first, run.n),
                     pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), run.n, [None, pa.py_buffer(sums.tobytes())])
                     .cast(pa.binary()), pa.array(n),
                     pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(B.signed(k[own])))],
                    names=["id", "node", "n", "prefix"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(emit, f"id {kind}, node binary, n long, prefix array<long>")


def _whole_sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(nid, whole): the sets of the nodes in ``ids`` (id, nid, node), read from a row with that id and set."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in B.slices(batch["text"]):
                doc, h = _sets(run, words)
                cut = np.searchsorted(doc, np.arange(run.n + 1))
                own = [s.tobytes() for s in _signatures(doc, h, run.n)]
                wanted = batch["node"].slice(run.first, run.n).to_pylist()
                keep = pa.array([x == y for x, y in zip(own, wanted)], pa.bool_())  # ids may repeat with another text
                yield pa.RecordBatch.from_arrays(
                    [batch["nid"].slice(run.first, run.n),
                     pa.array([h[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary())],
                    names=["nid", "whole"]).filter(keep)

    few = ids.count() <= BROADCAST_IDS
    ids = ids.withColumnRenamed("id", "of")
    rows = docs.join(F.broadcast(ids) if few else ids, F.col("id").eqNullSafe(F.col("of")))
    return rows.select("nid", "node", "text").mapInArrow(emit, "nid long, whole binary")


def _differences(docs: DataFrame, nodes: DataFrame, star: DataFrame, words: int, percent: int) -> DataFrame:
    """(nid, pivot, n, np, d, prefix): each row's first elements of the symmetric difference with its pivot, and its size.

    Elements that are not in the pivot come first. Rows that differ by more than half their size are left out.
    """
    named = star.select(F.col("pivot").alias("nid")).distinct()
    pivots = _whole_sets(docs, stored(nodes.join(named, "nid").select("id", "nid", "node"), "jaccard-pivot-ids"), words)
    pivots = stored(pivots.dropDuplicates(["nid"]).select(F.col("nid").alias("pivot"), F.col("whole")), "jaccard-pivots")
    ids = stored(nodes.join(star, "nid").select("id", "nid", "node", "pivot"), "jaccard-star")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in B.slices(batch["text"]):
                doc, h = _sets(run, words)
                cut = np.searchsorted(doc, np.arange(run.n + 1))
                own = [s.tobytes() for s in _signatures(doc, h, run.n)]
                of = batch.slice(run.first, run.n)
                out = []
                for i, (nid, node, pivot) in enumerate(zip(of["nid"].to_pylist(), of["node"].to_pylist(), of["pivot"].to_pylist())):
                    if own[i] != node:  # ids may repeat with another text
                        continue
                    x, y = h[cut[i]:cut[i + 1]], np.frombuffer(of["whole"][i].as_buffer(), B.U64)
                    added, gone = np.setdiff1d(x, y, assume_unique=True), np.setdiff1d(y, x, assume_unique=True)
                    d = len(added) + len(gone)
                    if 2 * d <= len(x):
                        first = np.concatenate([added, gone])[:len(x) * (100 - percent) // percent + 1]
                        out.append((nid, pivot, len(x), len(y), d, B.signed(first)))
                nid, pivot, n, np_, d, prefix = zip(*out) if out else ((),) * 6
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(c, pa.int64()) for c in (nid, pivot, n, np_, d)), pa.array(prefix, pa.list_(pa.int64()))],
                    names=["nid", "pivot", "n", "np", "d", "prefix"])

    few = ids.count() <= BROADCAST_IDS
    wanted = ids.withColumnRenamed("id", "of")
    rows = docs.join(F.broadcast(wanted) if few else wanted, F.col("id").eqNullSafe(F.col("of"))).join(pivots, "pivot")
    out = rows.select("nid", "node", "pivot", "whole", "text").mapInArrow(
        emit, "nid long, pivot long, n long, np long, d long, prefix array<long>")
    out = stored(out.dropDuplicates(["nid"]), "jaccard-differences")
    discard(pivots, ids)
    return out


def _families(block: DataFrame, percent: int) -> DataFrame:
    """(nid, pivot) for rows in long columns: of the pivots of its columns the one it shares most of them with.

    The pivot of a column, among rows of about one size, is the one with the most long columns, which
    has the fewest elements of its own. A row that shares less than a tenth of its first block with its pivot has
    met it by chance, in a frequent n-gram: it is left out, and so are pivots with fewer than ``FAMILY`` other rows.
    """
    long = block.where(F.col("rows") >= LONG_COLUMN).withColumn(
        "band", F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent))))
    long = long.join(long.groupBy("nid").agg(F.count("*").alias("columns")), "nid")
    best = F.max_by(F.struct("nid", "columns"), F.struct("columns", F.xxhash64("nid"), "nid")).alias("best")
    pivots = long.groupBy("k", "band").agg(best)
    met = long.join(pivots, ["k", "band"]).groupBy("nid", F.col("best.nid").alias("pivot")).agg(
        F.count("*").alias("shared"), F.first("best.columns").alias("columns"), F.first("p").alias("p"))
    star = met.groupBy("nid").agg(F.max_by(F.struct("pivot", "shared", "p"), F.struct(
        "shared", "columns", F.xxhash64("pivot"), "pivot")).alias("best")).select("nid", "best.*")
    star = star.where((F.col("nid") == F.col("pivot")) | (F.col("shared") * 10 >= F.col("p")))
    large = star.where("nid <> pivot").groupBy("pivot").agg(F.count("*").alias("others")).where(F.col("others") >= FAMILY)
    return star.join(large, "pivot", "left_semi").select("nid", "pivot")


def _family_pairs(near: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """(a, b) of one pivot that are not connected yet and have a common element where their differences need one.

    Rows a, b link if d(a) + d(b) - 2 common <= r (n(a) + n(b)), r = (100 - percent) / (100 + percent). So the first
    common element stands at a place of at most half of d(a) - d(b) + r (n(a) + n(b)) in a, and the other way round in b.
    ``small`` marks the places a row needs as the one with the smaller difference: half of r (n(a) + n(b)) at most, and
    if it links with the pivot less, since the partner then does not and has the larger difference for it.
    """
    up, down = 100 + percent, 100 - percent
    most = F.col("n") * (down / percent)
    linked = F.col("d") * up <= (F.col("n") + F.col("np")) * down
    least = F.when(linked, F.greatest(F.col("d"), (F.col("n") * (percent / 100) + F.col("np")) * (down / up))).otherwise(F.col("d"))
    rows = (near.join(roots.withColumnRenamed("node", "nid"), "nid", "left")
            .select("nid", "pivot", "n", "d", F.coalesce("root", "nid").alias("root"),
                    ((F.col("d") - least + most) / 2 + 0.001).alias("reach"), F.posexplode("prefix").alias("pos", "e")))
    small = rows.where(F.col("pos") <= F.col("reach")).drop("reach").toDF("nid_b", "pivot", "n_b", "d_b", "root_b", "pos_b", "e")
    larger = F.struct("d", "nid") > F.struct(F.col("d_b").alias("d"), F.col("nid_b").alias("nid"))
    room = (F.col("n") + F.col("n_b")) * down
    apart = (F.col("d") - F.col("d_b")) * up
    return (rows.drop("reach").join(small, ["pivot", "e"])
            .where(larger & (F.col("root") != F.col("root_b")) & _fits(F.col("n"), F.col("n_b"), percent)
                   & (2 * up * F.col("pos") <= room + apart) & (2 * up * F.col("pos_b") <= room - apart))
            .select(F.least("nid", "nid_b").alias("a"), F.greatest("nid", "nid_b").alias("b")))


def _verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) of the stored table ``pairs`` whose whole sets reach the threshold, with their overlap."""
    named = pairs.select(F.col("a").alias("nid")).union(pairs.select(F.col("b").alias("nid"))).distinct()
    ids = stored(nodes.join(named, "nid").select("id", "nid", "node"), "jaccard-ids")
    sets = stored(_whole_sets(docs, ids, words).dropDuplicates(["nid"]), "jaccard-sets")

    def overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch["whole_a"], batch["whole_b"]
            x = [np.frombuffer(v.as_buffer(), B.U64) for v in a]
            y = [np.frombuffer(v.as_buffer(), B.U64) for v in b]
            shared = [len(np.intersect1d(u, v, assume_unique=True)) for u, v in zip(x, y)]
            keep = [100 * i >= percent * (len(u) + len(v) - i) for i, u, v in zip(shared, x, y)]
            yield pa.RecordBatch.from_pydict({"a": batch["a"], "b": batch["b"], "overlap": shared}).filter(pa.array(keep, pa.bool_()))

    both = (pairs.join(sets.select(F.col("nid").alias("a"), F.col("whole").alias("whole_a")), "a")
            .join(sets.select(F.col("nid").alias("b"), F.col("whole").alias("whole_b")), "b"))
    out = stored(both.mapInArrow(overlap, "a long, b long, overlap long"), "jaccard-links")
    discard(ids, sets)
    return out


def _fits(na: Column, nb: Column, percent: int) -> Column:
    """Sizes that can reach the threshold at all."""
    return (F.least(na, nb) * 100 >= F.greatest(na, nb) * percent)


def _possible(c: Column, a: str, b: str, percent: int) -> Column:
    """Whether sizes and the sum ``c`` over the first block leave the threshold within reach.

    In the set whose block ends first, what is not shared inside the block is not shared at all.
    """
    of = lambda name, side: F.col(f"{side}.{name}")
    missed = F.when(of("last", a) <= of("last", b), of("n", a) - (of("p", a) - c)).otherwise(of("n", b) - (of("p", b) - c))
    return missed >= needed(of("n", a), of("n", b), percent)


def join(docs: DataFrame, text: str = "text", row_id: str = "doc_id", words: int = WORDS,
         percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id) for every row.

    Two rows link when their sets reach the threshold. A text without words, or null, has an empty set and
    links with nothing, so its component is its own id. Rows with equal sets count as one node of the
    graph; links inside a component that is connected already are not looked for, so there is no count of
    links. Fewer than ``words`` words are one shingle.
    Rows without an id take part, but a component is named by its smallest id that is not null.
    """
    rows = docs.select(F.col(row_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    hot = frequent(rows, words)
    matrix = stored(_matrix(rows, words, percent, hot), "jaccard-matrix")
    nodes = stored(matrix.where("n > 0").groupBy("node").agg(
        F.min("id").alias("id"), F.first("n").alias("n"), F.first("prefix").alias("prefix"))
        .withColumn("nid", F.monotonically_increasing_id()), "jaccard-nodes")
    # From here on the first blocks are read from the nodes alone, and once the columns are written from these.
    whole, matrix = matrix, stored(matrix.select("id", "node", "n"), "jaccard-rows")
    discard(whole)
    block = nodes.select("nid", "n", F.size("prefix").alias("p"), F.element_at("prefix", -1).alias("last"),
                         F.explode("prefix").alias("k"))
    shared = block.groupBy("k").agg(F.count("*").alias("rows")).where("rows > 1")
    block = stored(block.join(shared, "k"), "jaccard-block")
    whole, nodes = nodes, stored(nodes.select("nid", "id", "node"), "jaccard-node-ids")
    discard(whole)

    release(docs.sparkSession)
    star = stored(_families(block, percent), "jaccard-families")
    near = _differences(rows, nodes, star, words, percent)
    first = near.where((F.col("nid") != F.col("pivot")) & (F.col("d") * (100 + percent) <= (F.col("n") + F.col("np")) * (100 - percent))) \
        .select(F.col("nid").alias("a"), F.col("pivot").alias("b"))
    first = stored(first, "jaccard-pivot-links")
    roots = components(first)

    # Products of the block between rows that are not connected yet and have no pivot in common. In each column, rows
    # of its largest family are only met by the others.
    known = (block.drop("rows").join(roots.withColumnRenamed("node", "nid"), "nid", "left").withColumn("root", F.coalesce("root", "nid"))
             .join(near.select("nid", "pivot"), "nid", "left").withColumn("family", F.coalesce("pivot", F.lit(-1).cast("long"))).drop("pivot"))
    known = stored(known, "jaccard-rooted")
    discard(block)
    main = (known.where("family >= 0").groupBy("k", "family").agg(F.count("*").alias("c"))
            .groupBy("k").agg(F.max_by("family", F.struct("c", "family")).alias("main")))
    side = (F.col("family") < 0) | (F.col("family") != F.coalesce("main", F.lit(-1).cast("long")))
    rooted, known = known, stored(known.join(main, "k", "left").withColumn("side", side).drop("main"), "jaccard-sides")
    discard(rooted)
    release(docs.sparkSession)
    other = known.select("k", *[F.col(c).alias(f"{c}_b") for c in ("nid", "n", "p", "last", "root", "family", "side")])
    products = (known.where("side").join(other, "k")
                .where((~F.col("side_b") | (F.col("nid") < F.col("nid_b"))) & (F.col("root") != F.col("root_b")))
                .where((F.col("family") < 0) | (F.col("family") != F.col("family_b")))
                .where(_fits(F.col("n"), F.col("n_b"), percent)))
    ordered = F.col("nid") < F.col("nid_b")
    mine, theirs = F.struct("n", "p", "last"), F.struct(*(F.col(f"{c}_b").alias(c) for c in ("n", "p", "last")))
    products = products.select(F.least("nid", "nid_b").alias("nid"), F.greatest("nid", "nid_b").alias("nid_b"),
                               F.when(ordered, mine).otherwise(theirs).alias("x"), F.when(ordered, theirs).otherwise(mine).alias("y"))
    sums = products.groupBy("nid", "nid_b").agg(F.count("*").alias("c"), F.first("x").alias("x"), F.first("y").alias("y"))
    left = sums.where(_possible(F.col("c"), "x", "y", percent)) \
        .select(F.col("nid").alias("a"), F.col("nid_b").alias("b"))
    left = stored(left.union(_family_pairs(near, roots, percent)).distinct(), "jaccard-pairs")
    discard(star, near, known)
    release(docs.sparkSession)
    second = _verified(rows, nodes, left, words, percent)
    links = stored(first.union(second.select("a", "b")), "jaccard-all-links")
    discard(left, first, second)

    roots = components(links)
    placed = (nodes.select("node", "nid", "id")
              .join(roots.withColumnRenamed("node", "nid"), "nid", "left")
              .withColumn("root", F.coalesce("root", "nid")))
    named = placed.groupBy("root").agg(F.min("id").alias("component_id"))
    placed = placed.join(named, "root").select("node", "component_id")
    filled = F.when(F.col("n") > 0, F.col("node"))
    out = matrix.select("id", "n", filled.alias("node")).join(placed, "node", "left")
    return out.select(F.col("id").alias(row_id), F.col("n").alias("n_shingles"),
                      F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


SQL = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM worded WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common_counts AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id <> y.doc_id
  GROUP BY x.doc_id, y.doc_id),
links AS (
  SELECT a, b FROM common_counts JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
  WHERE 100 * c >= 90 * (p.n + q.n - c)),
reach (doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT d.doc_id, CAST(coalesce(any_value(z.n), 0) AS BIGINT) AS n_shingles, min(r.other) AS component_id
FROM documents d JOIN reach r ON r.doc_id = d.doc_id LEFT JOIN sizes z ON z.doc_id = d.doc_id
GROUP BY d.doc_id
"""


@query("op10_jaccard_join", SQL)
def op10_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return join(table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id")
