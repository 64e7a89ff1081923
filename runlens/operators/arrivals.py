"""Which ids have arrived, as bitmaps over blocks of ids.

Ids are handed out in order but rows are committed in any order, so an id below the high-water mark may still
come. A block is a range of ids inside one bitmap of ``BLOCK`` bits, with a bit for each id that has arrived. Blocks
that are complete are forgotten; the others are asked for again, and only they. A block in which nothing has come for
long holds ids the source has skipped for good: it is asked for in audits alone, so that nothing is ever given up.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.functions.timegrid import ts

BLOCK = 32_768
#: Ranges of ids that a source is asked for by name; of more only the outer bounds.
RANGES = 200


def blocks(spark: SparkSession, low: int, high: int) -> DataFrame:
    """Blocks over the ids low..high, of which none has arrived. Ids begin with 1."""
    low = max(low, 1)
    first, last = (low - 1) // BLOCK + 1, (high - 1) // BLOCK + 1
    numbers = spark.range(first, last + 1 if high >= low else first).withColumnRenamed("id", "bucket")
    return numbers.select(
        "bucket", F.greatest((F.col("bucket") - 1) * BLOCK + 1, F.lit(low)).cast("bigint").alias("low"),
        F.least(F.col("bucket") * BLOCK, F.lit(high)).cast("bigint").alias("high"),
        F.lit(b"").alias("bits"), F.lit(None).cast("timestamp").alias("quiet_since"))


def arrived(blocks: DataFrame, ids: DataFrame, as_of: dt.datetime) -> DataFrame:
    """The blocks once ``ids`` have arrived, without those that are complete by then."""
    come = (ids.select("id", F.bitmap_bucket_number("id").alias("bucket")).join(blocks.select("bucket", "low", "high"), "bucket")
            .where(F.col("id").between(F.col("low"), F.col("high"))).groupBy("bucket", "low", "high").agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits"))
            .withColumn("quiet_since", ts(as_of)))
    known = blocks.withColumn("quiet_since", F.coalesce("quiet_since", ts(as_of)))
    merged = known.unionByName(come).groupBy("bucket", "low", "high").agg(
        F.bitmap_or_agg("bits").alias("bits"), F.max("quiet_since").alias("quiet_since"))
    return merged.where(F.bitmap_count("bits") < F.col("high") - F.col("low") + 1)


def asked(blocks: DataFrame, as_of: dt.datetime, patience: dt.timedelta | None, audit: bool = False) -> DataFrame:
    """Blocks worth asking for: those in which something has come of late, in an audit all."""
    return blocks if audit or patience is None else blocks.where(F.coalesce("quiet_since", ts(as_of)) > ts(as_of - patience))


def late_rows(source: DataFrame, blocks: DataFrame) -> DataFrame:
    """Source rows whose ids lie in the blocks and have not arrived.

    The ranges of the blocks go to the source as plain bounds on the id; without blocks nothing is read.
    """
    bounds = blocks.agg(F.min("low").alias("low"), F.max("high").alias("high"), F.count("*").alias("n")).first()
    if not bounds["n"]:
        return source.limit(0)
    ranges = [bounds] if bounds["n"] > RANGES else blocks.select("low", "high").orderBy("low").collect()
    within = F.lit(False)
    for low, high in _runs([(r["low"], r["high"]) for r in ranges]):
        within |= F.col("id").between(low, high)
    rows = source.where(within)
    known = blocks.select(*[F.col(c).alias(f"_block_{c}") for c in ("bucket", "low", "high", "bits")])
    place = "bitmap_bit_position(id)"
    byte = f"cast(conv(hex(substring(_block_bits, cast({place} div 8 as int) + 1, 1)), 16, 10) as int)"
    has_come = F.expr(f"coalesce((shiftright({byte}, cast({place} % 8 as int)) & 1) = 1, false)")
    inside = F.expr("bitmap_bucket_number(id) = _block_bucket and id between _block_low and _block_high")
    return rows.join(known, inside & ~has_come, "left_semi")


def _runs(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for low, high in ranges:
        if out and low <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out
