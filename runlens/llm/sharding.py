"""Shards of near-equal bytes by sampled splitters.

Rows are laid out in the order of (digest of the text, id). Rows are drawn with a
probability in proportion to their size, so that the quantiles of the drawn keys
cut the order into ranges of about equal bytes. Each range is then measured
exactly, ranges that came out too large are cut again from a denser draw, and the
shards are filled from the measured ranges. All work per row happens inside one
range, whose bytes are bounded; the driver holds only splitters and range sizes.

Equal texts share a shard unless they are larger than a shard together. A text
whose copies span several ranges, or one as large as a range, is hot. Hot texts
are placed first, largest first, where most room is left, and the others fill the
shards up. Ranges end inside the copies of a hot text, and these pieces are placed
one by one when the whole group fits nowhere.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens.llm.registry import query, table

N_SHARDS = 40
RANGES_PER_SHARD = 32
DRAWS_PER_RANGE = 16
ROWS_PER_RANGE = 1_000_000
ROW_BYTES = 16
OVERFULL = 2.0


@dataclass
class Splitters:
    """Sorted (digest, id) pairs. A digest that stands alone starts at its first row."""

    digest: np.ndarray
    row_id: np.ndarray

    def __post_init__(self):
        order = np.lexsort((self.row_id, self.digest))
        pairs = np.stack([self.digest[order], self.row_id[order]], 1) if len(order) else np.zeros((0, 2), np.int64)
        pairs = np.unique(pairs, axis=0) if len(pairs) else pairs
        self.digest, self.row_id = pairs[:, 0].copy(), pairs[:, 1].copy()

    @property
    def hot(self) -> np.ndarray:
        """Digests with more than one splitter: their group spans ranges."""
        values, counts = np.unique(self.digest, return_counts=True)
        return values[counts > 1]

    def locate(self, digest: np.ndarray, row_id: np.ndarray) -> np.ndarray:
        low = np.searchsorted(self.digest, digest, "left")
        high = np.searchsorted(self.digest, digest, "right")
        out = high.copy()
        for value in np.unique(digest[high - low > 1]):
            rows = digest == value
            a, b = np.searchsorted(self.digest, [value, value + 1] if value < np.iinfo(np.int64).max
                                   else [value, value], "left")
            b = b if value < np.iinfo(np.int64).max else len(self.digest)
            out[rows] = a + 1 + np.searchsorted(self.row_id[a + 1:b], row_id[rows], "right")
        return out


def _drawn(rows: DataFrame, rate: Column, seed: int) -> np.ndarray:
    """(digest, id, size) of rows drawn with probability ``rate``."""
    uniform = F.pmod(F.xxhash64("_digest", "_id", F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    got = rows.where(uniform < rate).select("_digest", "_id", "_size").toPandas()
    return got[["_digest", "_id", "_size"]].to_numpy(np.int64)


def _quantiles(keys: np.ndarray, parts: int) -> np.ndarray:
    """The keys at the inner boundaries of ``parts`` equal runs of the sorted keys."""
    if parts < 2 or not len(keys):
        return keys[:0, :2]
    keys = keys[np.lexsort((keys[:, 1], keys[:, 0]))]
    return keys[(np.arange(1, parts) * len(keys)) // parts, :2]


def _ranged(rows: DataFrame, cuts: Splitters, large: set[int]) -> DataFrame:
    @F.pandas_udf(T.LongType())
    def locate(digest: pd.Series, row_id: pd.Series) -> pd.Series:
        return pd.Series(cuts.locate(digest.to_numpy(np.int64), row_id.to_numpy(np.int64)))

    hot = set(cuts.hot.tolist()) | large

    @F.pandas_udf(T.BooleanType())
    def is_hot(digest: pd.Series) -> pd.Series:
        return digest.isin(hot)

    return rows.withColumns({"_range": locate("_digest", "_id"), "_hot": is_hot("_digest")})


def _measured(ranged: DataFrame) -> pd.DataFrame:
    """Bytes and rows of each range's ordinary rows, and of each hot digest in it."""
    key = F.when(F.col("_hot"), F.col("_digest").cast("string"))  # text: pandas would round a nullable long
    return (ranged.groupBy("_range", key.alias("_group"))
            .agg(F.sum("_size").alias("bytes"), F.count("*").alias("rows")).toPandas())


def _layout(sizes: pd.DataFrame, n_shards: int):
    """Shard of each hot piece, and the fill level at which each shard's ordinary rows end."""
    share = sizes.bytes.sum() / n_shards
    free = np.full(n_shards, float(share))
    placed: dict[tuple[int, int], int] = {}
    hot = sizes[sizes._group.notna()]
    groups = sorted(((g.bytes.sum(), key, g) for key, g in hot.groupby("_group")), key=lambda x: (-x[0], x[1]))
    for size, key, g in groups:
        at = int(np.argmax(free))
        whole = free[at] >= size
        for piece in g.rename(columns={"_range": "at"}).sort_values("at").itertuples():
            if not whole and free[at] < piece.bytes:
                at = int(np.argmax(free))
            free[at] -= piece.bytes
            placed[(int(piece.at), int(key))] = at
    free = np.maximum(free, 0)
    return placed, np.cumsum(free)


def shard(df: DataFrame, text: str = "text", row_id: str = "doc_id", n_shards: int = N_SHARDS,
          row_bytes: int = ROW_BYTES) -> DataFrame:
    """``df`` with ``shard`` and ``slot``: shards of near-equal bytes, slots gapless from 0 in each.

    A row counts the bytes of its text plus ``row_bytes``; a null text has no bytes and is
    equal to an empty one, a null id sorts first, repeated rows all stay and get slots of
    their own. An empty table gives an empty result. Columns already named ``shard`` or
    ``slot`` are replaced; names that begin with ``_`` are reserved.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = df.drop("shard", "slot").withColumns({
        "_size": F.octet_length(body).cast("long") + row_bytes, "_digest": F.xxhash64(body),
        "_id": F.coalesce(F.col(row_id).cast("long"), F.lit(-(1 << 63)))})
    total, count = rows.agg(F.coalesce(F.sum("_size"), F.lit(0)), F.count("*")).first()
    ranges = max(n_shards * RANGES_PER_SHARD, count // ROWS_PER_RANGE)
    mean = max(total / ranges, 1.0)
    drawn = _drawn(rows, F.col("_size") * (DRAWS_PER_RANGE / mean), 1)
    large = set(drawn[drawn[:, 2] >= mean, 0].tolist())  # each such row is drawn: at most one for each range
    cuts = Splitters(*_quantiles(drawn, min(ranges, len(drawn))).T.copy())
    sizes = None
    for attempt in (2, 3):
        sizes = _measured(_ranged(rows, cuts, large))
        full = sizes.groupby("_range").bytes.sum()
        full = full[full > OVERFULL * mean]
        if full.empty:
            break
        inside = _ranged(rows, cuts, large).where(F.col("_range").isin([int(x) for x in full.index]))
        drawn = _drawn(inside, F.col("_size") * (4 * DRAWS_PER_RANGE / mean), attempt)
        where = cuts.locate(drawn[:, 0].copy(), drawn[:, 1].copy())
        more = [_quantiles(drawn[where == r], int(np.ceil(b / mean))) for r, b in full.items()]
        more = np.concatenate(more)
        cuts = Splitters(np.append(cuts.digest, more[:, 0]), np.append(cuts.row_id, more[:, 1]))
        sizes = None
    if sizes is None:
        sizes = _measured(_ranged(rows, cuts, large))
    placed, levels = _layout(sizes, n_shards)
    cool = sizes[sizes._group.isna()].sort_values("_range")
    before = dict(zip(cool._range.astype(int), np.concatenate([[0], np.cumsum(cool.bytes)[:-1]]).astype(float))) \
        if len(cool) else {}

    @F.pandas_udf(T.IntegerType())
    def to_shard(at: pd.Series, digest: pd.Series, hot: pd.Series, middle: pd.Series) -> pd.Series:
        level = at.map(before).fillna(0).to_numpy() + middle.to_numpy()
        out = np.minimum(np.searchsorted(levels, level, "right"), n_shards - 1)
        for i in np.flatnonzero(hot.to_numpy()):
            out[i] = placed[(int(at.iat[i]), int(digest.iat[i]))]
        return pd.Series(out.astype(np.int32))

    in_range = Window.partitionBy("_range", "_hot").orderBy("_digest")
    peers = in_range.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    group = Window.partitionBy("_range", "_hot", "_digest")
    assigned = (_ranged(rows, cuts, large)
                .withColumn("_middle", F.sum("_size").over(peers) - F.sum("_size").over(group) / 2)
                .withColumn("shard", to_shard("_range", "_digest", "_hot", "_middle")))
    parts = assigned.groupBy("shard", "_range", "_hot").agg(F.count("*").alias("n")).toPandas()
    parts = parts.sort_values(["shard", "_range", "_hot"])
    parts["before"] = parts.groupby("shard").n.cumsum() - parts.n
    offsets = {(s, r, h): b for s, r, h, b in zip(
        parts.shard.tolist(), parts._range.tolist(), parts._hot.tolist(), parts.before.tolist())}

    @F.pandas_udf(T.LongType())
    def to_slot(at: pd.Series, rng: pd.Series, hot: pd.Series, rank: pd.Series) -> pd.Series:
        start = [offsets[key] for key in zip(at.tolist(), rng.tolist(), hot.tolist())]
        return pd.Series(np.asarray(start, np.int64) + rank.to_numpy(np.int64) - 1)

    rank = F.row_number().over(Window.partitionBy("_range", "_hot", "shard").orderBy("_digest", "_id"))
    placed_rows = assigned.withColumn("_rank", rank).withColumn("slot", to_slot("shard", "_range", "_hot", "_rank"))
    return placed_rows.select(*[c for c in df.columns if c not in ("shard", "slot")], "shard", "slot")


def write_shards(df: DataFrame, path: str, **options) -> None:
    """One folder per shard, rows in slot order; ``df`` is the result of ``shard``."""
    shard(df, **options).repartition("shard").sortWithinPartitions("shard", "slot") \
        .write.partitionBy("shard").parquet(path)


@query("op2_sharding")
def op2_sharding(spark: SparkSession, folder: str) -> DataFrame:
    body = F.coalesce(F.col("text"), F.lit(""))
    rows = table(spark, folder, "documents").select("doc_id", "text")
    return shard(rows.withColumns({"size": F.octet_length(body).cast("long") + ROW_BYTES,
                                   "text_crc32": F.crc32(body)})).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
