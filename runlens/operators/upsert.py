"""Keyed merge of two tables with a rule per column."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rule = Callable[[Column, Column], Column]


def take_new(old: Column, new: Column) -> Column:
    return new


def keep_old(old: Column, new: Column) -> Column:
    return old


def prefer_new(old: Column, new: Column) -> Column:
    return F.coalesce(new, old)


def prefer_old(old: Column, new: Column) -> Column:
    return F.coalesce(old, new)


def reset(old: Column, new: Column) -> Column:
    return F.lit(None)


EXECUTION_RULES: Mapping[str, Rule] = {
    # The key of the workflow is set once; a repaired start survives a source NULL.
    "workflow_id": keep_old, "started_at": prefer_new, "missing_since": reset,
    "analytics_status": keep_old, "analytics_attempts": keep_old,
    "analytics_next_attempt": keep_old,
}
ERROR_RULES: Mapping[str, Rule] = {
    "workflow_id": keep_old, "timestamp": keep_old, "http_code": prefer_new,
}


def upsert(existing: DataFrame, incoming: DataFrame, key: str | list[str],
           rules: Mapping[str, Rule] | None = None) -> DataFrame:
    """``existing`` with the rows of ``incoming`` merged in by key.

    A matched row takes the incoming value of every incoming column unless a rule
    says otherwise; columns the incoming side lacks keep their value. One
    full-outer equi-join, and both sides are unique by key, so no key is hot.
    ``incoming`` must hold each key once (see :func:`latest_by_key`).
    """
    keys = [key] if isinstance(key, str) else list(key)
    rules = rules or {}
    old = existing.select(*[F.col(c).alias(f"old_{c}") for c in existing.columns],
                          F.lit(True).alias("in_old"))
    new = incoming.select(*[F.col(c).alias(f"new_{c}") for c in incoming.columns],
                          F.lit(True).alias("in_new"))
    condition = [F.col(f"old_{k}") == F.col(f"new_{k}") for k in keys]
    merged = old.join(new, condition, "full_outer")
    incoming_columns = set(incoming.columns)

    def value(field) -> Column:
        name = field.name
        before, after = F.col(f"old_{name}"), F.col(f"new_{name}")
        if name in keys:
            return F.coalesce(before, after).alias(name)
        if name not in incoming_columns:
            after = F.lit(None).cast(field.dataType)
            rule = rules.get(name, keep_old)
        else:
            rule = rules.get(name, take_new)
        result = (F.when(F.col("in_new").isNull(), before)
                  .when(F.col("in_old").isNull(), after)
                  .otherwise(rule(before, after)))
        return result.cast(field.dataType).alias(name)

    return merged.select(*[value(f) for f in existing.schema.fields])


def latest_by_key(df: DataFrame, key: str | list[str], order: list[str]) -> DataFrame:
    """One row per key: the one with the greatest ``order`` tuple.

    ``max_by`` is a mergeable aggregate, so a key that is delivered again and
    again is folded on the map side.
    """
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in keys]
    winner = F.max_by(F.struct(*rest), F.struct(*order))
    return (df.groupBy(*keys).agg(winner.alias("_row"))
            .select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])
            .select(*df.columns))


def changed_rows(old: DataFrame, new: DataFrame, key: str, compare: list[str]) -> DataFrame:
    """Rows of ``new`` that are absent from ``old`` or differ in ``compare``, null-safe."""
    before = old.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_old_{c}") for c in compare],
                        F.lit(True).alias("_known"))
    joined = new.join(before, new[key] == before["_key"], "left")
    same = F.coalesce("_known", F.lit(False))
    for c in compare:
        same &= F.col(c).eqNullSafe(F.col(f"_old_{c}"))
    return joined.filter(~same).select(*[new[c] for c in new.columns])


def different_rows(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``new`` that ``old`` has not got in the same form, null-safe over all columns."""
    return changed_rows(old, new, key, [c for c in new.columns if c != key])


def insert_missing(primary: DataFrame, fallback: DataFrame, key: str) -> DataFrame:
    """Rows of ``primary`` plus those rows of ``fallback`` whose key is not in it."""
    return primary.unionByName(
        fallback.join(primary.select(key), key, "left_anti").select(*primary.columns))
