"""Steps of the incremental sync as table transformations."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.functions.timegrid import ts
from runlens.operators.arrivals import late_rows
from runlens.operators.filters import not_deleted
from runlens.schemas import FAILED_STATUSES, OPEN_STATUSES

# --- fixed values -----------------------------------------------------------
MISSING_GRACE = dt.timedelta(hours=1)
# ----------------------------------------------------------------------------


def initial_load(source: DataFrame, since: dt.datetime | None = None) -> DataFrame:
    """First sync: all live rows, or those started after ``since``."""
    return not_deleted(source if since is None else source.filter(F.col("started_at") > ts(since)))


def high_water(local: DataFrame, source: DataFrame) -> DataFrame:
    """One row with the greatest known id, never above the source's own maximum.

    A stray id beyond the source would otherwise park the sync for good.
    """
    local_max = local.agg(F.max("id")).scalar()
    return source.agg(F.max("id").alias("source_max")).select(
        local_max.alias("local_max"), "source_max",
        F.when(local_max.isNotNull(), F.least(local_max, F.col("source_max"))).alias("high_water"))


def incremental(source: DataFrame, high_water_id: int, blocks: DataFrame | None = None) -> DataFrame:
    """Live rows above the high-water id, and below it those of ``blocks`` whose ids have never arrived."""
    rows = source.filter(F.col("id") > F.lit(high_water_id))
    if blocks is not None:
        rows = rows.unionByName(late_rows(source.filter(F.col("id") <= F.lit(high_water_id)), blocks))
    return not_deleted(rows)


def lookup(source: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Source rows of a set of ids given as a table."""
    return source.join(ids.select(key), key, "left_semi")


def vanished(ids: DataFrame, source: DataFrame, key: str = "id") -> DataFrame:
    """Requested ids the source no longer has."""
    return ids.select(key).distinct().join(source.select(key), key, "left_anti")


def open_rows(executions: DataFrame) -> DataFrame:
    return executions.filter(F.col("status").isin(OPEN_STATUSES))


def refresh_open(executions: DataFrame, source: DataFrame, as_of: dt.datetime,
                 optional: list[str] | None = None,
                 grace: dt.timedelta = MISSING_GRACE) -> DataFrame:
    """Open executions brought up to date from the source.

    Found rows take the source's status and stop and keep their own start. A row
    the source lacks is marked missing first, and after the grace period its
    status is unknowable.
    """
    optional = optional if optional is not None else [
        c for c in source.columns if c in executions.columns
        and c not in ("id", "workflow_id", "status", "started_at", "stopped_at")]
    still_open = open_rows(executions)
    found = source.select("id", F.lit(True).alias("_found"), *[
        F.col(c).alias(f"_src_{c}") for c in ["status", "started_at", "stopped_at", *optional]])
    joined = still_open.join(found, "id", "left")
    is_found = F.col("_found").isNotNull()
    overdue = F.col("missing_since") <= ts(as_of - grace)
    updates = {
        "status": F.when(is_found, F.col("_src_status"))
        .when(overdue, F.lit("unknown")).otherwise(F.col("status")),
        "started_at": F.coalesce("started_at", "_src_started_at"),
        "stopped_at": F.when(is_found, F.col("_src_stopped_at")).otherwise(F.col("stopped_at")),
        "missing_since": F.when(~is_found, F.coalesce("missing_since", ts(as_of))),
        **{c: F.when(is_found, F.col(f"_src_{c}")).otherwise(F.col(c)) for c in optional},
    }
    return joined.withColumns(updates).select(*executions.columns)


def detect_changes(fetched: DataFrame, known: DataFrame) -> DataFrame:
    """Fetched rows with ``is_new``, ``is_changed`` and ``needs_analytics``."""
    before = known.select("id", F.col("status").alias("_before"), F.lit(True).alias("_known"))
    joined = fetched.join(before, "id", "left")
    is_new = F.col("_known").isNull()
    changed = is_new | ~F.col("status").eqNullSafe(F.col("_before"))
    return joined.withColumns({
        "is_new": is_new, "is_changed": changed,
        "needs_analytics": changed & F.coalesce(F.col("status").isin(FAILED_STATUSES), F.lit(False)),
    }).drop("_before", "_known")


def failed_ids(*tables: DataFrame) -> DataFrame:
    """Ids found failed by any of the phases, each once."""
    ids = tables[0].select("id")
    for table in tables[1:]:
        ids = ids.union(table.select("id"))
    return ids.distinct()


def backfill(executions: DataFrame, source: DataFrame, columns: list[str],
             sentinel: str = "mode") -> DataFrame:
    """Fill columns added later on every row that predates them and that the
    source still has. One join over all of them."""
    filled = source.select("id", F.lit(True).alias("_found"),
                           *[F.col(c).alias(f"_src_{c}") for c in columns])
    pending = F.col(sentinel).isNull() & F.col("_found").isNotNull()
    joined = executions.join(filled, "id", "left").withColumn("_fill", pending)
    return joined.withColumns({
        c: F.when(F.col("_fill"), F.col(f"_src_{c}")).otherwise(F.col(c)) for c in columns
    }).select(*executions.columns)


def backfill_chunk(executions: DataFrame, cursor: int, chunk: int | None = None,
                   sentinel: str = "mode") -> DataFrame:
    """Ids still to fill after ``cursor``, or the next ``chunk`` of them, for a walk that can be interrupted."""
    pending = executions.filter((F.col("id") > cursor) & F.col(sentinel).isNull())
    ids = pending.select("id").orderBy("id")
    return ids if chunk is None else ids.limit(chunk)


def seed_queue(executions: DataFrame, errors: DataFrame) -> DataFrame:
    """Queue state of executions that predate the queue.

    Failed rows already analysed are done, the other failed rows are pending;
    rows with a queue state keep it.
    """
    analysed = errors.select("id").distinct().withColumn("_done", F.lit(True))
    joined = executions.join(analysed, "id", "left")
    failed = F.col("status").isin(FAILED_STATUSES) & F.col("analytics_status").isNull()
    return joined.withColumn(
        "analytics_status",
        F.when(failed & F.col("_done").isNotNull(), "done")
        .when(failed, "pending").otherwise(F.col("analytics_status"))
    ).select(*executions.columns)
