"""Error rules, decoding and extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlens.catalog.registry import classify_sql, query
from runlens.functions import errors as rules
from runlens.functions import payload
from runlens.functions.timegrid import ts
from runlens.operators import care
from runlens.sources.readers import payloads_for
from runlens.sources.sample import AS_OF


def _read(t):
    return payloads_for(t.payloads, t.executions, t.executions.filter("status = 'error'"))


@query("e1_decode_payload", """
SELECT id AS execution_id, 22 + 0 * id AS n_items, id % 10 IN (2, 5) AS listed, 's' || error_message AS message,
  '{"row":' || CAST(id AS VARCHAR) || '}' AS input_data
FROM error_candidates WHERE id % 10 <> 7""")
def _(t):
    decoded = payload.decode(_read(t), subtrees=True)
    root, first = ("resultData", "error", "message"), (0, "resultData", "error", "message")
    return decoded.select(
        "execution_id", F.col("n_items").cast("bigint").alias("n_items"), F.expr(f"{payload.leaf(0)} is not null").alias("listed"),
        F.expr(f"coalesce({payload.leaf(*root)}, {payload.leaf(*first)})").alias("message"),
        F.expr("greatest(subtrees[0], subtrees[2])").alias("input_data"))


@query("e2_extract_errors", """
SELECT id, workflow_id, '' AS node_id, node_name, node_type, error_type, error_message, error_stack,
  CASE WHEN id % 10 IN (2, 5) THEN '' ELSE source_node END AS source_node,
  CASE WHEN id % 10 NOT IN (2, 5) THEN source_output_index END AS source_output_index,
  '{"row":' || CAST(id AS VARCHAR) || '}' AS input_data, '{"retries":2}' AS metadata, '' AS execution_source,
  error_category, http_code, "timestamp"
FROM errors WHERE id % 10 <> 7""")
def _(t):
    return payload.extract_errors(_read(t), ts(AS_OF))


@query("e4_http_status", "SELECT id, http_code FROM error_candidates WHERE id % 10 <> 7")
def _(t):
    return payload.extract(_read(t), with_subtrees=False).select("id", "http_code")


@query("e5_stack_header", "SELECT id, head_type, head_message FROM headers")
def _(t):
    kind, message = rules.stack_header(F.col("error_stack"))
    return t.error_candidates.select("id", kind.alias("head_type"), message.alias("head_message"))


@query("e6_reconcile", "SELECT id, error_type, error_message FROM reconciled")
def _(t):
    kind, message = rules.reconcile(F.col("error_message"), F.col("error_type"), F.col("error_stack"))
    return t.error_candidates.select("id", kind.alias("error_type"), message.alias("error_message"))


@query("e7_classify_texts", f"""
SELECT doc_id, {classify_sql("lower(text)", "''", "lower(source)", "CAST(NULL AS BIGINT)")} AS error_category
FROM documents""")
def _(t):
    """Whole documents as messages: the rules over long free text."""
    lowered = t.raw("documents").select("doc_id", F.inline(F.array(F.struct(
        F.lower("text").alias("msg"), F.lower("source").alias("node")))))
    category = rules.classify("msg", "''", "node", "cast(null as bigint)")
    return lowered.select("doc_id", category.alias("error_category"))


@query("e8_resolve", "SELECT id, error_type, error_message, error_category FROM errors")
def _(t):
    return t.errors.select("id", "error_type", "error_message", "error_category")


_CHANGES = """changes AS (
  SELECT id, old_type, old_message, error_type, error_message, error_category,
    CASE WHEN length(old_message) % 2 = 0 THEN 'data' ELSE 'unknown' END AS old_category,
    CASE WHEN old_message IS NOT DISTINCT FROM error_message THEN
           CASE WHEN error_type <> old_type THEN 'type' ELSE 'category' END
         WHEN trim(old_message, ' ' || chr(10)) = error_message THEN 'trimmed'
         WHEN trim(old_message, ' ' || chr(10)) = '' AND TRUE THEN 'filled'
         WHEN error_message IS NULL THEN 'lost'
         WHEN starts_with(error_message, trim(old_message, ' ' || chr(10))) THEN 'extended'
         WHEN trim(old_message, ' ' || chr(10)) = error_type THEN 'unmasked'
         ELSE 'other' END AS change_kind
  FROM resolved
  WHERE old_message IS DISTINCT FROM error_message OR old_type <> error_type
    OR error_category <> CASE WHEN length(old_message) % 2 = 0 THEN 'data' ELSE 'unknown' END)"""


@query("e9_rederived_changes", f"""
, {_CHANGES} SELECT id, error_type, error_message, error_category, old_category FROM changes""")
def _(t):
    return care.reclassify(t.stale_errors, 1, rules.RULES_VERSION).select(
        "id", "error_type", "error_message", "error_category", "old_category")


@query("e10_change_kinds", f', {_CHANGES} SELECT change_kind, count(*) AS "rows" FROM changes GROUP BY 1')
def _(t):
    return care.change_histogram(care.rederived_changes(t.stale_errors))


@query("a15_category_moves", f"""
, {_CHANGES} SELECT old_category, error_category AS new_category, count(*) AS "rows"
FROM changes WHERE old_category <> error_category GROUP BY 1, 2""")
def _(t):
    return care.category_moves(care.rederived_changes(t.stale_errors))


@query("w5_examples_per_kind", f"""
, {_CHANGES} SELECT change_kind, id, error_message FROM changes
QUALIFY row_number() OVER (PARTITION BY change_kind ORDER BY id) <= 1""")
def _(t):
    changes = care.rederived_changes(t.stale_errors)
    return care.first_examples(changes, ["change_kind"], 1).select("change_kind", "id", "error_message")


@query("w5_examples_per_move", f"""
, {_CHANGES} SELECT old_category, error_category, id FROM changes WHERE old_category <> error_category
QUALIFY row_number() OVER (PARTITION BY old_category, error_category ORDER BY id) <= 3""")
def _(t):
    moved = care.rederived_changes(t.stale_errors).filter("old_category <> error_category")
    return care.first_examples(moved, ["old_category", "error_category"], 3).select(
        "old_category", "error_category", "id")
