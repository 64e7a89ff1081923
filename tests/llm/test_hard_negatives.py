"""Hard negatives against scoring everything in Python's integers."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from runlens.llm import hard_negatives

SHAPE = "vec_id long, label int, embedding array<double>"


def expected(rows, every, positives=5, negatives=3, least=50, most=95, scale=256.0):
    ok = [(i, l, [math.floor(scale * x) for x in v], k) for k, (i, l, v) in enumerate(rows)
          if None not in (i, l, v) and all(x is not None and math.isfinite(scale * x) for x in v)]
    out = []
    for i, l, v, k in ok:
        if i % every:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(v, w)), j, m, n) for j, m, w, n in ok if n != k), key=lambda x: (x[0], x[1]))
        for s, j, _, _ in [x for x in scored if x[2] == l][:positives]:
            fits = [x for x in scored if x[2] != l and least * -s <= 100 * -x[0] <= most * -s][:negatives]
            out += [(i, j, r + 1, x[1], -s, -x[0]) for r, x in enumerate(fits)]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def vectors(n, dim, seed, spread=0.4):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, dim))
    return [(i, int(rng.integers(4)), (centres[rng.integers(6)] + spread * rng.standard_normal(dim)).tolist()) for i in range(n)]


@pytest.mark.parametrize("anchors,rows", [(256, 4096), (8, 16), (1, 3)])
def test_all_scores(spark, monkeypatch, anchors, rows):
    monkeypatch.setattr(hard_negatives, "ANCHORS", anchors)
    monkeypatch.setattr(hard_negatives, "ROWS", rows)
    data = vectors(240, 6, 1)
    df = spark.createDataFrame([(*r, 9, "x", 1) for r in data], SHAPE + ", row long, id string, score long").repartition(3)
    assert got(hard_negatives.mine(df, F.col("id") % 10 == 0)) == expected(data, 10)


def test_odd_rows(spark):
    data = vectors(80, 3, 2)
    data += [(100, 1, None), (110, None, [1.0, 2.0, 3.0]), (None, 1, [1.0, 2.0, 3.0]), (120, 1, [1.0, None, 2.0]), (130, 1, [float("nan"), 1.0, 1.0]),
             (140, 2, [float("inf"), 0.0, 0.0]), (150, 2, []), (160, 2, [1.0]), (170, 2, [1.0, 1.0, 1.0, 5.0]), (180, 77, [1.0, 1.0, 1.0]),
             (190, 3, [0.0, 0.0, 0.0]), (200, 3, [-1.0, -1.0, -1.0])] + [(300 + i, i % 2, [1.0, 0.5, 0.25]) for i in range(20)]
    random.Random(3).shuffle(data)
    assert got(hard_negatives.mine(spark.createDataFrame(data, SHAPE), F.col("id") % 10 == 0)) == expected(data, 10)


def test_repeated_ids(spark):
    data = [(10, 1, [1.0, 0.0]), (10, 1, [1.0, 0.0]), (11, 2, [0.8, 0.0]), (11, 2, [0.8, 0.0])]
    want = [(10, 10, 1, 11, 65536, 52224), (10, 10, 2, 11, 65536, 52224)]
    assert got(hard_negatives.mine(spark.createDataFrame(data, SHAPE), F.col("id") % 10 == 0)) == sorted(want * 2)


def test_large_numbers_stay_exact(spark):
    data = [(0, 1, [3e6, 1.0]), (1, 1, [3e6, 2.0]), (2, 2, [2.4e6, 1.0]), (3, 2, [2.4e6, 1.5]), (4, 3, [2.4e6, 1.25])]
    assert got(hard_negatives.mine(spark.createDataFrame(data, SHAPE), F.col("id") == 0)) == [
        r for r in expected(data, 5) if r[0] == 0]


def test_no_rows(spark):
    assert got(hard_negatives.mine(spark.createDataFrame([], SHAPE), F.col("id") % 10 == 0)) == []


def test_blocks_reach_lanes_without_the_driver(spark):
    """However small the table of blocks: the driver never holds its copies for the lanes."""
    data = vectors(60, 4, 6)
    rows = spark.createDataFrame([(k, i, l, [float(math.floor(256 * x)) for x in v]) for k, (i, l, v) in enumerate(data)],
                                 "row long, id long, label long, v array<double>").coalesce(1)
    packed = [hard_negatives.stored(rows.mapInArrow(hard_negatives._pack(n), hard_negatives._PACKED), "test-packed") for n in (20, 10)]
    blocks = packed[0].select(F.monotonically_increasing_id().alias("block"), F.lit(None).cast("array<struct<anchor: int, least: long, most: long>>").alias("windows"), "*")
    chunks = packed[1].select("*", (F.monotonically_increasing_id() % 3).cast("int").alias("lane"))
    best = hard_negatives._best(blocks, chunks, 1, True)
    found = {}
    for r in best.collect():
        found[r.anchor_row] = max(found.get(r.anchor_row, r.score), r.score)
    scored = rows.select("row", "label", "v").collect()
    assert found == {a.row: max(sum(int(x * y) for x, y in zip(a.v, b.v)) for b in scored if b.label == a.label and b.row != a.row) for a in scored}
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_bounds_leave_rows_unscored():
    """Near anchors: children of the tree score far fewer rows than the root."""
    rng = np.random.default_rng(4)
    import pyarrow as pa

    def packed(v, labels):
        ids = np.arange(len(v))
        b = [pa.scalar(x.astype("<i8").tobytes(), pa.binary()) for x in (ids, labels, ids + 10_000 * (len(v) < 50))]
        return hard_negatives.Packed(*b, pa.scalar(v.shape[1], pa.int32()), pa.scalar(np.floor(v * 256).astype("<i4").tobytes(), pa.binary()))

    centre = rng.standard_normal(8)
    anchors = packed(centre + 0.01 * rng.standard_normal((20, 8)), np.zeros(20))
    chunk = packed(rng.standard_normal((2000, 8)), np.zeros(2000))
    block = hard_negatives.Block(anchors, [[(-np.inf, np.inf)]] * 20, 5, True)
    counted = []

    class Counted(np.ndarray):
        def __matmul__(self, other):
            counted.append(len(self))
            return np.asarray(self) @ np.asarray(other)

    block.meet(chunk)
    chunk.v = chunk.v.view(Counted)
    block.meet(chunk)
    assert counted[0] == 2000 and sum(counted[1:]) < 19 * 400
