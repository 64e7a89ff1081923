"""Fixed windows against a plain fold, severity, redaction, keys."""

from __future__ import annotations

import datetime as dt
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from fixed import rows
from runlens.functions import text
from runlens.operators import accesslog
from runlens.streaming import stateful

ZERO = dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc)


def fold(hits, size):
    """The counter as the service keeps it: one hit after the other."""
    out = {}
    for key in {k for k, _ in hits}:
        expires, start = None, None
        for ms in sorted(m for k, m in hits if k == key):
            if expires is None or ms >= expires:
                start, expires = ms, ms + size
            out[key, start] = out.get((key, start), 0) + 1
    return out


@pytest.mark.parametrize("seed, spread", [(1, 40_000), (2, 400_000), (3, 4_000_000), (4, 100_000)])
def test_fixed_windows_equal_the_fold(spark, seed, spread):
    rng = random.Random(seed)
    size = 60_000
    # One key has most of the hits, bursts share a millisecond, edges are exact.
    hits = [("hot", rng.randrange(spread)) for _ in range(300)] + [("cold", rng.randrange(spread)) for _ in range(20)]
    hits += [("edge", k * size) for k in range(5)] + [("edge", 5 * size - 1)] * 3 + [("late", 10 * size)]
    log = spark.createDataFrame([(k, ZERO + dt.timedelta(milliseconds=m)) for k, m in hits], "k string, at timestamp")
    got = accesslog.fixed_windows(spark, log, "k", "at", dt.timedelta(milliseconds=size), 2)
    base = int(ZERO.timestamp() * 1000)
    actual = {(r.key, round(r.window_start.timestamp() * 1000) - base): r.hits for r in got.collect()}
    assert actual == fold(hits, size)
    assert got.filter("blocked <> greatest(hits - 2, 0)").count() == 0
    assert got.filter("expires_at <> window_start + interval 1 minute").count() == 0


def test_hit_counter_keeps_its_window_between_batches(spark, tmp_path):
    rng = random.Random(7)
    hits = sorted(("k", rng.randrange(600_000)) for _ in range(60))
    src, out = tmp_path / "in", str(tmp_path / "out")
    for n, part in enumerate((hits[:25], hits[25:40], hits[40:])):
        spark.createDataFrame([(k, ZERO + dt.timedelta(milliseconds=m)) for k, m in part], "k string, at timestamp") \
            .coalesce(1).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema("k string, at timestamp").parquet(str(src))
        windows = stateful.hit_windows(stream, "k", "at", dt.timedelta(minutes=1))
        with stateful.rocksdb_state(spark):
            windows.writeStream.outputMode("update").foreachBatch(
                lambda df, i: df.withColumn("batch", F.lit(i)).write.mode("append").parquet(out)) \
                .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    final = spark.read.parquet(out).groupBy("key", "start_ms").agg(F.max_by("hits", "batch").alias("hits"))
    base = int(ZERO.timestamp() * 1000)
    assert {(r.key, r.start_ms - base): r.hits for r in final.collect()} == fold(hits, 60_000)


def test_severity(spark):
    data = [(503, False, 1), (200, True, 1), (404, False, 9000), (200, False, 2000), (200, False, 1999)]
    df = spark.createDataFrame(data, "s int, a boolean, ms int").coalesce(1)
    got = [r[0] for r in df.select(accesslog.severity(F.col("s"), F.col("a"), F.col("ms"))).collect()]
    assert got == ["error", "error", "warn", "warn", "info"]


def test_redaction(spark):
    cases = [
        ('{"password":"hunter2","n":1}', '{"password":"[redacted]","n":1}'),
        ('{"Set-Cookie":"a\\"b,c","keep":"visible"}', '{"Set-Cookie":"[redacted]","keep":"visible"}'),
        ('{"token":12.5,"x":null}', '{"token":"[redacted]","x":null}'),
        ('{"nested":{"apiKey":"sk","keep":"visible"}}', '{"nested":{"apiKey":"[redacted]","keep":"visible"}}'),
        ('[{"jwt":{"a":1}},{"b":2}]', '[{"jwt":"[redacted]"},{"b":2}]'),
        ('{"a":{"b":{"c":{"d":{"e":{"secret":1}}}}}}', '{"a":{"b":{"c":{"d":{"e":{"secret":"[redacted]"}}}}}}'),
        ('{"token":"' + "a" * 100_000 + '","x":1.50}', '{"token":"[redacted]","x":1.5}'),
        ('{"pass\\u0077ord":"p"}', '{"password":"[redacted]"}'),
        ('{"a":{"token":"x"},', "[redacted]"),
        ("[" * 200_000, "[redacted]"),
        ('{"x":1.50}', '{"x":1.50}'),
        ('{"passwords":"kept"}', '{"passwords":"kept"}'),
        ('{"secret": broken [', "[redacted]"),
        (None, None),
    ]
    df = spark.createDataFrame([(c[0],) for c in cases], "line string").coalesce(1)
    got = [r[0] for r in df.select(text.redact_json(F.col("line"))).collect()]
    assert got == [c[1] for c in cases]


def test_keys_and_times(spark):
    df = spark.createDataFrame([("1.2.3.4", "  Bob@X.org ", "2026-01-01T10:00:00"), ("1.2.3.4", None, "2026-01-01T10:00:00+02:00")],
                               "ip string, mail string, at string").coalesce(1)
    who = hashlib.sha256(b"bob@x.org").hexdigest()[:16]
    key = text.account_key(F.col("ip"), F.col("mail"))
    first, second = df.select(key.alias("k"), text.hashed_key("login-account", key).alias("h"),
                              text.render_time_text(F.col("at"), "Europe/Athens").alias("t")).collect()
    assert first.k == f"1.2.3.4|{who}"
    assert first.h == hashlib.sha256(f"login-account:{first.k}".encode()).hexdigest()[:32]
    assert (first.t, second.t) == ("1/1/2026, 12:00:00", "1/1/2026, 10:00:00")
    bad = spark.createDataFrame([("nonsense",)], "at string")
    assert bad.select(text.render_time_text(F.col("at"), "UTC")).first()[0] == "N/A"


def test_trim_covers_odd_spaces(spark):
    df = spark.createDataFrame([(chr(0xA0) + chr(0xFEFF) + " a b " + chr(0x2028) + "\n\t",)], "s string")
    assert rows(df.select(text.trim_all(F.col("s")))) == [("a b",)]
