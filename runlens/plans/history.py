"""Sync history, conversations and guarded ad-hoc queries."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from runlens.operators.scope import EVERYTHING, Scope
from runlens.params import BadRequest

# --- fixed values -----------------------------------------------------------------
CONTEXT_ROWS, HISTORY_ROWS, RUN_ROWS = 10, 50, 20
CODE_FUNCTIONS = {"reflect", "java_method", "try_reflect"}
# Parts of a parsed statement that only read what stands below them.
READING = {
    "Project", "Filter", "Aggregate", "Join", "LateralJoin", "Sort", "GlobalLimit", "LocalLimit", "LimitAll", "Offset", "Distinct",
    "Deduplicate", "Union", "Except", "Intersect", "SubqueryAlias", "UnresolvedSubqueryColumnAliases", "UnresolvedHaving",
    "UnresolvedQualify", "WithWindowDefinition", "UnresolvedInlineTable", "LocalRelation", "OneRowRelation", "OneRowRelation$", "Generate", "Pivot", "Unpivot",
    "UnresolvedWith", "UnresolvedRelation", "Sample", "UnresolvedOrdinal",
}
# ----------------------------------------------------------------------------------


def _ranked(chat: DataFrame, user: str, order: list) -> DataFrame:
    return chat.withColumn("rank", F.row_number().over(W.partitionBy(user).orderBy(*order)))


def recent_context(chat: DataFrame, user: str = "user_id", order: str = "created_at",
                   n: int = CONTEXT_ROWS) -> DataFrame:
    """The last ten messages of every user; ``position`` counts them oldest first."""
    newest = _ranked(chat, user, [F.desc(order)]).filter(F.col("rank") <= n)
    return newest.withColumn(
        "position", F.row_number().over(W.partitionBy(user).orderBy(F.asc(order)))).drop("rank")


def conversation_history(chat: DataFrame, user: str = "user_id", order: str = "created_at",
                         n: int = HISTORY_ROWS) -> DataFrame:
    """The fifty oldest messages of every user."""
    return (_ranked(chat, user, [F.asc(order)]).filter(F.col("rank") <= n)
            .withColumnRenamed("rank", "position"))


def sync_history(runs: DataFrame, n: int = RUN_ROWS) -> DataFrame:
    """The newest sync runs with the size of the copy in megabytes."""
    return (runs.withColumn("replica_mb", F.floor(
        F.col("replica_bytes") / F.lit(1048576.0) * 10 + F.lit(0.5)) / F.lit(10.0))
        .orderBy(F.desc("id")).limit(n))


def check_select(text: str) -> str:
    """The statement, if it begins like a query; :func:`check_plan` decides what it does."""
    if not re.match(r"(SELECT|WITH)\b", text.strip(), re.IGNORECASE):
        raise BadRequest("a query has to begin with SELECT or WITH")
    return text.strip()


def _seq(scala) -> list:
    return [scala.apply(i) for i in range(scala.size())]


def _kind(node) -> str:
    return node.getClass().getSimpleName()


def check_plan(spark: SparkSession, text: str, names: set[str]) -> None:
    """Refuse a statement that does anything but read ``names``, or that runs code of the JVM.

    Spark's own parser says what the statement is; its nodes are walked, those inside expressions too, each with
    the common table expressions that can be seen from where it stands. What a text literal says plays no part.
    """
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except Exception as error:
        raise BadRequest(f"the query cannot be parsed: {error}") from error
    given = {name.lower() for name in names}
    plans: list[tuple] = [(plan, frozenset())]
    while plans:
        node, own = plans.pop()
        kind = _kind(node)
        if kind in ("UnresolvedTableValuedFunction", "UnresolvedTVFAliases"):
            raise BadRequest("the query must not call table functions")
        if kind not in READING:
            raise BadRequest(f"the query must only read, and may not use {kind}")
        if kind == "UnresolvedRelation":
            parts = _seq(node.multipartIdentifier())
            if len(parts) != 1 or parts[0].lower() not in own | given:
                raise BadRequest(f"the query reads what it may not: {'.'.join(parts)}")
        inside = own
        if kind == "UnresolvedWith":
            for relation in _seq(node.cteRelations()):
                name = relation._1().lower()
                # A name is seen by what follows it, by itself only where recursion is allowed.
                plans.append((relation._2(), inside | {name} if node.allowRecursion() else inside))
                inside = inside | {name}
        plans += [(child, inside) for child in _seq(node.children())]
        expressions = _seq(node.expressions())
        while expressions:
            e = expressions.pop()
            kind = _kind(e)
            if kind.startswith(("ExpressionWithUnresolvedIdentifier", "PlanWithUnresolvedIdentifier")):
                raise BadRequest("the query must not compute names")
            if kind == "UnresolvedFunction":
                called = _seq(e.nameParts())[-1].lower()
                if called in CODE_FUNCTIONS:
                    raise BadRequest(f"the query must not call {called}")
            if _holds_query(e):
                plans.append((e.plan(), inside))
            expressions += _seq(e.children())


def _holds_query(expression) -> bool:
    """Whether an expression holds a query."""
    jvm_class = expression.getClass()
    while jvm_class is not None:
        if jvm_class.getSimpleName() == "PlanExpression":
            return True
        jvm_class = jvm_class.getSuperclass()
    return False


def guarded_select(spark: SparkSession, text: str, tables: dict[str, DataFrame], n: int | None = None,
                   scope: Scope = EVERYTHING) -> tuple[DataFrame, DataFrame]:
    """A caller's query over the given tables, and its row count; with ``n`` only the first rows.

    A user who may not see everything is refused, because a free query cannot be narrowed. The tables are
    views under names of this call alone, so callers of one session do not see each other's.
    """
    if scope.restricted:
        raise BadRequest("free queries are for users who may see every workflow")
    text = check_select(text)
    check_plan(spark, text, set(tables))
    views = {name: f"guarded_{uuid.uuid4().hex}" for name in tables}
    for name, view in views.items():
        tables[name].createOrReplaceTempView(view)
    try:
        given = ", ".join(f"`{name}` AS (SELECT * FROM {view})" for name, view in views.items())
        with_ = re.match(r"WITH\s+(RECURSIVE\b)?", text, re.IGNORECASE)
        rest = text[with_.end():] if with_ else ""
        result = spark.sql(f"WITH {with_[1] or ''} {given}, {rest}" if with_ else f"WITH {given} {text}")
    finally:
        for view in views.values():
            spark.catalog.dropTempView(view)
    return result if n is None else result.limit(n), result.agg(F.count("*").alias("total_rows"))
