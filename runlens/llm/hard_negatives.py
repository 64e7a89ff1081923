"""Hard negatives of a stated set of anchors by spanning-tree bounds.

Anchors are sorted by the signs of a few fixed projections and cut into blocks of ``ANCHORS``, so that a
block holds anchors that lie near one another; all rows are packed into chunks of ``ROWS``. Every block
meets every chunk: the chunks are dealt to lanes and each block is sent to each lane, so that a task works
through the chunks of its lane block by block.

In a block the anchors form a minimum spanning tree. The root's scores with a chunk are exact. What is known
of a parent's score, plus and minus the length of the edge times the candidate's norm, bounds the child's
score; only candidates whose bounds reach the wanted window are scored for the child. Best rows found
so far narrow the windows from chunk to chunk. Two passes: the best rows of the anchor's own label, then the best rows of
other labels inside the windows those scores set.

Scores are exact integers: products in doubles where all sums stay below 2^53, in Python's integers otherwise
(scores beyond 64 bits come out as the nearest 64-bit number).

Defined results: rows take no part with a null id, label or vector, or with a component that is null or that is not
finite once scaled. Vectors of different lengths are compared over the components both have. Rows with a repeated id are rows of their
own; ties go to the smaller id. An anchor without rows of its label has no result. An empty table gives an empty result.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runlens.llm.registry import discard, query, setting, stored, table

ANCHORS, ROWS = 256, 4096
#: Components in one chunk at most, and chunks of one lane where there are many.
COMPONENTS, LANE, LANES = 1 << 20, 64, 64
#: Bytes of pairs, each a block and a chunk, that Spark hands to Python at a time; its default, 64 MB, is held several times by each task.
BATCH, PAIRS = "spark.sql.execution.arrow.maxBytesPerBatch", "8m"
_EXACT = 2.0 ** 53
_LAST = 2 ** 63 - 1
_PACKED = "ids binary, labels binary, rows binary, width int, vectors binary"


def _valid(rows: DataFrame, row_id: str, label: Column, vector: str, scale: float) -> DataFrame:
    scaled = F.transform(F.col(vector), lambda x: F.lit(float(scale)) * x.cast("double"))
    finite = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return (rows.select(F.col(row_id).cast("long").alias("id"), label.cast("long").alias("label"), scaled.alias("v"))
            .where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()).where(finite)
            .select(F.monotonically_increasing_id().alias("row"), "id", "label", "v"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Whole-number vectors, shorter ones filled with zeros."""
    n = column.value_lengths().to_numpy(zero_copy_only=False)
    values, width = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)), int(n.max(initial=0))
    if (n == width).all():
        return values.reshape(len(n), width)
    out = np.zeros((len(n), width))
    out[np.arange(width) < n[:, None]] = values
    return out


def _pack(limit: int) -> Callable:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(t: pa.Table) -> Iterator[pa.RecordBatch]:
            width = max(1, int(np.max(t["v"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False), initial=0)))
            step = max(1, min(limit, COMPONENTS // width))
            for part in (t.slice(i, step).combine_chunks() for i in range(0, len(t), step)):
                m = _matrix(part["v"].chunk(0))
                small = np.abs(m).max(initial=0) < 2 ** 31
                columns = [part[c].to_numpy().astype("<i8").tobytes() for c in ("id", "label", "row")]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array([c], pa.binary()) for c in columns), pa.array([m.shape[1] if small else -m.shape[1]], pa.int32()),
                     pa.array([m.astype("<i4" if small else "<f8").tobytes()], pa.binary())], names=["ids", "labels", "rows", "width", "vectors"])

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= limit:
                yield from flush(pa.Table.from_batches(held))
                held = []
        if held and sum(b.num_rows for b in held):
            yield from flush(pa.Table.from_batches(held))

    return pack


class Packed:
    """Rows of one chunk or block as arrays."""

    def __init__(self, ids, labels, rows, width, vectors):
        self.ids, self.labels, self.rows = (np.frombuffer(x.as_buffer(), "<i8") for x in (ids, labels, rows))
        width, kind = width.as_py(), "<i4" if width.as_py() >= 0 else "<f8"
        self.v = np.frombuffer(vectors.as_buffer(), kind).astype(np.float64).reshape(len(self.ids), abs(width))
        self.largest = float(np.abs(self.v).max(initial=0))
        self.norm = np.sqrt((self.v * self.v).sum(1)) if self.largest < 1e150 else np.full(len(self.v), np.inf)


def tree(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimum spanning tree: the order in which rows join it, their parents (-1: root) and the lengths of the edges."""
    n = len(v)
    near, parent = np.full(n, np.inf), np.full(n, -1)
    order, length, out = np.zeros(n, np.int64), np.zeros(n), np.zeros(n, bool)
    at = 0
    for k in range(n):
        order[k], length[at], out[at] = at, (0.0 if k == 0 else near[at]), True
        d = np.sqrt(((v - v[at]) ** 2).sum(1))
        closer = (d < near) & ~out
        near[closer], parent[closer] = d[closer], at
        at = int(np.where(out, np.inf, near).argmin())
    return order, parent, length


class Block:
    """Anchors with their tree, and what each of their windows has found so far."""

    def __init__(self, packed: Packed, windows: list[list[tuple]], keep: int, same: bool):
        self.a, self.windows, self.keep, self.same = packed, windows, keep, same
        self.exact = packed.largest < 1e150
        self.order, self.parent, self.length = tree(packed.v) if self.exact else (np.arange(len(packed.ids)), None, None)
        self.found: list[list[tuple]] = [[(np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(w) for w in windows]

    def meet(self, c: Packed) -> None:
        width = min(self.a.v.shape[1], c.v.shape[1])
        a, v = self.a.v[:, :width], c.v[:, :width]
        exact = self.exact and self.a.largest * c.largest * max(width, 1) < _EXACT
        if not exact:
            a, v = (np.array([[int(x) for x in r] for r in m], object).reshape(m.shape) for m in (a, v))
        bounds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for i in self.order.tolist():
            wanted = c.labels == self.a.labels[i] if self.same else c.labels != self.a.labels[i]
            if self.same:
                wanted &= c.rows != self.a.rows[i]
            if not exact or self.parent[i] < 0:
                low = high = v @ a[i] if width else np.zeros(len(v))
            else:
                low, high = bounds[self.parent[i]]
                # One more than the bound, for the rounding of root and product.
                slack = self.length[i] * c.norm * (1 + 1e-9) + 1
                low, high = low - slack, high + slack
                reach = np.zeros(len(v), bool)
                for (least, most), best in zip(self.windows[i], self.found[i]):
                    floor = best[0][-1] if len(best[0]) == self.keep else least
                    reach |= (high >= max(floor, least)) & (low <= most)
                wanted &= reach
                at = np.flatnonzero(wanted)
                low[at] = high[at] = v[at] @ a[i]
            bounds[i] = low, high
            at = np.flatnonzero(wanted)
            score, ids, rows = low[at], c.ids[at], c.rows[at]
            for w, (least, most) in enumerate(self.windows[i]):
                fits = np.flatnonzero((score >= least) & (score <= most))
                if len(fits):
                    best = self.found[i][w]
                    s, d, r = (np.concatenate(x) for x in zip(best, (score[fits], ids[fits], rows[fits])))
                    order = sorted(range(len(s)), key=lambda k: (-s[k], d[k], r[k])) if s.dtype == object else np.lexsort((r, d, -s))
                    self.found[i][w] = s[order[:self.keep]], d[order[:self.keep]], r[order[:self.keep]]


_INF = float("inf")
_BEST = "block long, anchor int, anchor_id long, anchor_row long, window int, score long, id long, row long"


def _best(blocks: DataFrame, chunks: DataFrame, keep: int, same: bool) -> DataFrame:
    """The best ``keep`` rows of every window of every anchor in each lane."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Block] = {}

        def out(number: int, b: Block) -> pa.RecordBatch:
            rows = [(number, i, int(b.a.ids[i]), int(b.a.rows[i]), w, min(max(int(s), -_LAST), _LAST), int(d), int(r))
                    for i, f in enumerate(b.found) for w, found in enumerate(f) for s, d, r in zip(*found)]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [[]] * 8, kinds)],
                                              names=[x.split()[0] for x in _BEST.split(", ")])

        for batch in batches:
            for number, windows, *packed in zip(*batch.columns):
                number = number.as_py()
                if number not in held:
                    if len(held) == 16:  # a block whose chunks come apart is only written more than once
                        yield out(first := next(iter(held)), held.pop(first))
                    a = Packed(*packed[:5])
                    shaped: list[list[tuple]] = [[(-_INF, _INF)] if same else [] for _ in a.ids]
                    for x in windows.as_py() or []:
                        shaped[x["anchor"]].append((x["least"], x["most"]))
                    held[number] = Block(a, shaped, keep, same)
                held[number].meet(Packed(*packed[5:]))
        for number, b in held.items():
            yield out(number, b)

    names = [x.split()[0] for x in _PACKED.split(", ")]
    lanes = chunks.agg(F.max("lane")).first()[0]
    spread = blocks.select("block", "windows", *names, F.explode(F.sequence(F.lit(0), F.lit(lanes or 0))).alias("lane"))
    # Spark's estimate of ``spread`` is that of ``blocks``, without the copies for the lanes, and would send all of them through the driver.
    paired = spread.hint("merge").join(chunks.select("lane", *(F.col(c).alias(f"c_{c}") for c in names)), "lane")
    return paired.select("block", "windows", *names, *(f"c_{c}" for c in names)).mapInArrow(meet, _BEST)


def _first(best: DataFrame, keep: int) -> DataFrame:
    order = Window.partitionBy("block", "anchor", "window").orderBy(F.desc("score"), "id", "row")
    return best.select("*", F.row_number().over(order).alias("rank")).where(F.col("rank") <= keep)


def _near(dim_seed: int = 17, bits: int = 16) -> Callable:
    def signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch["v"])
            plane = np.random.default_rng(dim_seed).standard_normal((bits, v.shape[1])).T
            code = ((np.clip(v, -1e100, 1e100) @ plane) > 0) @ (1 << np.arange(bits)[::-1]) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code.astype(np.int64))], names=[*batch.schema.names, "near"])

    return signs


def mine(rows: DataFrame, is_anchor: Column, *, row_id: str = "vec_id", label: Column | None = None, vector: str = "embedding",
         scale: float = 256.0, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95) -> DataFrame:
    """(anchor_id, anchor_row, positive_id, positive_rank, rank, negative_id, positive_score, negative_score).

    ``is_anchor`` is a condition on ``id``. The negatives of a positive with score p are the best rows of other labels
    with ``least``/100 p <= score <= ``most``/100 p.
    """
    valid = stored(_valid(rows, row_id, F.col("label") if label is None else label, vector, scale), "mine-rows")
    chunks = stored(valid.mapInArrow(_pack(ROWS), _PACKED).select(F.monotonically_increasing_id().alias("chunk"), "*"), "mine-chunks")
    n = chunks.count()
    lanes = max(1, min(n, max(LANES, n // LANE)))
    chunks = chunks.withColumn("lane", F.pmod(F.xxhash64("chunk"), F.lit(lanes)).cast("int"))
    near = (valid.where(is_anchor).select("row", "id", "label", "v").mapInArrow(_near(), "row long, id long, label long, v array<double>, near long"))
    sort = near.repartitionByRange(F.col("near"), F.col("row")).sortWithinPartitions("near", "row").drop("near")
    blocks = stored(sort.mapInArrow(_pack(ANCHORS), _PACKED).select(F.monotonically_increasing_id().alias("block"), "*"), "mine-anchors")
    discard(valid)
    no_windows = F.lit(None).cast("array<struct<anchor: int, least: long, most: long>>")
    with setting(rows.sparkSession, BATCH, PAIRS):
        best = stored(_first(_best(blocks.withColumn("windows", no_windows), chunks, positives, True), positives)
                      .select("block", "anchor", "anchor_id", "anchor_row", F.col("rank").alias("positive_rank"), F.col("id").alias("positive_id"),
                              F.col("score").alias("positive_score"), F.col("row").alias("positive_row")), "mine-positives")
    # In whole numbers of any size: 100 s >= least p and 100 s <= most p.
    p = F.col("positive_score").cast("decimal(24,0)")
    bound = F.greatest(F.lit(-_LAST), F.ceil(p * least / 100)).cast("long"), F.least(F.lit(_LAST), F.floor(p * most / 100)).cast("long")
    windows = best.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("anchor", "positive_rank", bound[0].alias("least"), bound[1].alias("most")))).alias("w"))
    asked = blocks.join(windows.select("block", F.transform("w", lambda x: F.struct(x.anchor.alias("anchor"), x.least.alias("least"), x.most.alias("most"))).alias("windows")), "block")
    with setting(rows.sparkSession, BATCH, PAIRS):
        found = stored(_first(_best(asked, chunks, negatives, False), negatives).select(
            "block", "anchor", (F.col("window") + 1).alias("positive_rank"), "rank", F.col("id").alias("negative_id"),
            F.col("score").alias("negative_score")), "mine-negatives")
    return found.join(best, ["block", "anchor", "positive_rank"]).select(
        "anchor_id", "anchor_row", "positive_id", "positive_rank", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


@query("op11_hard_negatives", """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
           FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT a.vec_id AS anchor_id, a.label AS anchor_label, b.vec_id, b.label, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
           FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
     p AS (SELECT anchor_id, vec_id, score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r
           FROM s WHERE label = anchor_label),
     n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
                  CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS INT) AS rank
           FROM p JOIN s ON p.anchor_id = s.anchor_id
           WHERE p.r <= 5 AND s.label <> s.anchor_label AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
""")
def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, folder, "embeddings"), F.col("id") % 50 == 0, label=label).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
