"""Work queue of error extraction, kept as columns of the execution table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions.timegrid import ts

# --- fixed values -----------------------------------------------------------
MAX_ATTEMPTS = 5
BACKOFF_CAP_MINUTES = 360
# ----------------------------------------------------------------------------

# Outcomes of one extraction attempt.
DONE, RETRY, VANISHED, OVERSIZED = "done", "retry", "vanished", "oversized"


def next_attempt(attempts: Column, as_of: dt.datetime) -> Column:
    """Exponential back-off: 2^attempts minutes, at most six hours."""
    minutes = F.least(F.pow(F.lit(2.0), attempts), F.lit(float(BACKOFF_CAP_MINUTES)))
    return ts(as_of) + F.make_dt_interval(mins=minutes.cast("int"))


def is_due(as_of: dt.datetime) -> Column:
    return (F.col("analytics_status") == "pending") & (
        F.col("analytics_next_attempt").isNull() | (F.col("analytics_next_attempt") <= ts(as_of)))


def due(executions: DataFrame, as_of: dt.datetime, limit: int | None = None) -> DataFrame:
    """All due ids, or the oldest ``limit`` of them: new failures never keep old ones waiting."""
    ids = executions.filter(is_due(as_of)).select("id")
    return ids if limit is None else ids.orderBy("id").limit(limit)


def enqueue(executions: DataFrame, ids: DataFrame) -> DataFrame:
    """Mark ids pending and forget earlier attempts."""
    wanted = ids.select("id").distinct().withColumn("_wanted", F.lit(True))
    hit = F.col("_wanted").isNotNull()
    return executions.join(wanted, "id", "left").withColumns({
        "analytics_status": F.when(hit, "pending").otherwise(F.col("analytics_status")),
        "analytics_attempts": F.when(hit, F.lit(0)).otherwise(F.col("analytics_attempts")).cast("bigint"),
        "analytics_next_attempt": F.when(~hit, F.col("analytics_next_attempt")),
    }).select(*executions.columns)


def outcomes(requested: DataFrame, payloads: DataFrame, extracted: DataFrame) -> DataFrame:
    """Outcome per requested id.

    ``payloads`` has ``execution_id``, ``data`` (capped) and ``data_bytes``.
    No payload row: vanished. Cut off by the cap: oversized. Empty: done. A
    payload that could not be decoded, and so was not extracted: retry.
    """
    read = payloads.select(F.col("execution_id").alias("id"),
                           F.col("data").isNull().alias("_no_text"),
                           (F.coalesce(F.col("data"), F.lit("")) == "").alias("_empty"),
                           F.coalesce("data_bytes", F.lit(0)).alias("_bytes"),
                           F.lit(True).alias("_read"))
    got = extracted.select("id", F.lit(True).alias("_extracted"))
    return (requested.select("id").join(read, "id", "left").join(got, "id", "left")
            .select("id",
                    F.when(F.col("_read").isNull(), VANISHED)
                    .when(F.col("_no_text") & (F.col("_bytes") > 0), OVERSIZED)
                    .when(F.col("_empty") | F.col("_extracted").isNotNull(), DONE)
                    .otherwise(RETRY).alias("outcome")))


def settle(executions: DataFrame, results: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Apply outcomes: done, failed at once, or one attempt more with back-off,
    failed for good at the fifth."""
    joined = executions.join(results.select("id", "outcome"), "id", "left")
    outcome = F.col("outcome")
    tried = F.coalesce("analytics_attempts", F.lit(0)) + F.when(outcome == RETRY, 1).otherwise(0)
    exhausted = (outcome == RETRY) & (tried >= MAX_ATTEMPTS)
    return joined.withColumns({
        "analytics_status": F.when(outcome == DONE, "done")
        .when(outcome.isin(VANISHED, OVERSIZED) | exhausted, "failed")
        .otherwise(F.col("analytics_status")),
        "analytics_attempts": F.when(outcome == RETRY, tried)
        .otherwise(F.col("analytics_attempts")).cast("bigint"),
        "analytics_next_attempt": F.when(outcome == DONE, F.lit(None).cast("timestamp"))
        .when((outcome == RETRY) & ~exhausted, next_attempt(tried, as_of))
        .otherwise(F.col("analytics_next_attempt")),
    }).select(*executions.columns)
