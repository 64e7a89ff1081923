"""Registration of a query together with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens.functions import errors as rules
from runlens.sources.sample import MESSAGES, SampleTables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def plain_types(df: DataFrame) -> DataFrame:
    """Timestamps without a zone, as the SQL side has them."""
    return df.select(*[
        F.col(f.name).cast("timestamp_ntz").alias(f.name) if isinstance(f.dataType, T.TimestampType)
        else F.col(f.name) for f in df.schema.fields])


def query(name: str, sql: str | None = None):
    """Register a function of the sample tables under ``name``."""

    def register(build: Callable[[SampleTables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plain_types(build(SampleTables(spark, sf_dir)))

        QUERIES[name] = run
        if sql is not None:
            ORACLE_SQL[name] = f"{PRELUDE}\n{sql.strip()}"
        return build

    return register


def _text(value: str) -> str:
    """SQL literal; a line feed cannot stand inside it."""
    parts = ["'" + p.replace("'", "''") + "'" for p in value.split("\n")]
    return " || chr(10) || ".join(parts)


def _any_word(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, {_text(w)})" for w in words) + ")"


def _any_pattern(column: str, patterns: list[str]) -> str:
    return "(" + " OR ".join(f"regexp_matches({column}, {_text(p)})" for p in patterns) + ")"


def classify_sql(msg: str, kind: str, node: str, http: str) -> str:
    """The category rules in SQL, over lowered text columns."""
    pair = " AND ".join(f"contains({msg}, {_text(w)})" for w in rules.CONFIG_WORD_PAIR)
    return f"""CASE
      WHEN {http} = 429 THEN 'rate_limit'
      WHEN {http} IN (401, 403) THEN 'auth'
      WHEN {http} >= 500 THEN 'upstream'
      WHEN {http} = 408 THEN 'network'
      WHEN {http} >= 400 THEN 'data'
      WHEN {_any_word(msg, rules.RATE_LIMIT_WORDS)} THEN 'rate_limit'
      WHEN {_any_word(msg, rules.AUTH_WORDS)} OR {_any_pattern(msg, rules.AUTH_PATTERNS)} THEN 'auth'
      WHEN {_any_word(msg, rules.NETWORK_WORDS)} THEN 'network'
      WHEN {_any_word(msg, rules.UPSTREAM_WORDS)} OR {_any_pattern(msg, rules.UPSTREAM_PATTERNS)}
        THEN 'upstream'
      WHEN {kind} = '{rules.CONFIG_TYPE}' OR {_any_word(msg, rules.CONFIG_WORDS)} OR ({pair})
        OR {_any_pattern(msg, rules.CONFIG_PATTERNS)} THEN 'config'
      WHEN {_any_pattern(msg, rules.DATA_PATTERNS)} THEN 'data'
      WHEN {kind} = '{rules.LOGIC_TYPE}' THEN 'logic'
      WHEN {_any_word(node, rules.LOGIC_NODE_WORDS)} OR ends_with({node}, '{rules.LOGIC_NODE_SUFFIX}')
        THEN 'logic'
      ELSE 'unknown' END"""


_MESSAGE_ROWS = ",\n".join(
    "(" + ", ".join([str(m[0]), *[_text(v) for v in m[1:5]],
                     "CAST(NULL AS BIGINT)" if m[5] is None else f"CAST({m[5]} AS BIGINT)"]) + ")"
    for m in MESSAGES)

_HEADER = r"^((?:[A-Za-z_$][A-Za-z0-9_$]*)?(?:Error|Exception))(?::[ \t]*(.*))?$"

# The sample tables as the model's tables. ``resolved`` follows the error rules
# step by step: first stack line, header, reconciled text, category.
PRELUDE = f"""
WITH workflow_entity AS (
  SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, c_acctbal >= 0 AS active FROM customer),
execution_entity AS (
  SELECT event_id AS id, CAST(user_id AS VARCHAR) AS workflow_id,
    CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'running' ELSE 'success' END AS status,
    ts AS started_at,
    CASE WHEN event_type <> 'signup'
      THEN ts + to_microseconds(CAST(round(value * 1000000) AS BIGINT)) END AS stopped_at,
    event_type AS mode
  FROM events),
project AS (
  SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name, 'team' AS type FROM nation),
project_relation AS (
  SELECT CAST(s_nationkey AS VARCHAR) AS project_id, CAST(s_suppkey AS VARCHAR) AS user_id,
    'project:editor' AS role FROM supplier),
shared_workflow AS (
  SELECT CAST(c_custkey AS VARCHAR) AS workflow_id, CAST(c_nationkey AS VARCHAR) AS project_id,
    'workflow:owner' AS role FROM customer),
visible AS (
  SELECT DISTINCT workflow_id FROM shared_workflow
  WHERE project_id IN (SELECT project_id FROM project_relation WHERE user_id = '7')),
workflow_settings AS (
  SELECT CAST(c_custkey AS VARCHAR) AS workflow_id,
    CAST((c_custkey % 10) * 60 AS BIGINT) AS saved_time_seconds,
    CAST(c_custkey % 7 AS DOUBLE) * 12.5 AS hourly_rate
  FROM customer WHERE c_custkey % 3 <> 0),
messages (m_id, node_type, error_type, error_message, error_stack, http_code) AS (VALUES
{_MESSAGE_ROWS}),
error_candidates AS (
  SELECT e.event_id AS id, CAST(e.user_id AS VARCHAR) AS workflow_id,
    'node_' || CAST(e.k % 7 AS VARCHAR) AS node_name, m.node_type, m.error_type, m.error_message,
    m.error_stack, m.http_code,
    CASE WHEN e.k % 5 = 0 THEN '' ELSE 'src_' || CAST(e.k % 5 AS VARCHAR) END AS source_node,
    CAST(e.k % 2 AS BIGINT) AS source_output_index, e.ts AS "timestamp"
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
        FROM events WHERE event_type = 'error') e
  JOIN messages m ON m.m_id = e.k % {len(MESSAGES)}),
stack_lines AS (
  SELECT *, trim(string_split(error_stack, chr(10))[1]) AS line,
    trim(error_message, ' ' || chr(10) || chr(9)) AS given, trim(error_type) AS given_type
  FROM error_candidates),
headers AS (
  SELECT *,
    CASE WHEN regexp_matches(line, '{_HEADER}') THEN regexp_extract(line, '{_HEADER}', 1) END AS head_type,
    CASE WHEN regexp_matches(line, '{_HEADER}') THEN trim(regexp_extract(line, '{_HEADER}', 2)) END AS head_message
  FROM stack_lines),
reconciled AS (
  SELECT id, workflow_id, node_name, node_type, http_code, error_stack, source_node,
    source_output_index, "timestamp", error_type AS old_type, error_message AS old_message,
    CASE WHEN given_type <> '' THEN given_type ELSE coalesce(head_type, '') END AS error_type,
    CASE WHEN coalesce(head_message, '') <> ''
           AND (given = '' OR given = head_type OR starts_with(head_message, given)) THEN head_message
         WHEN given = '' THEN NULL ELSE given END AS error_message
  FROM headers),
resolved AS (
  SELECT *, CASE WHEN error_message IS NULL THEN 'unparsed' ELSE
    {classify_sql('lower(error_message)', 'lower(error_type)', 'lower(node_type)', 'http_code')}
    END AS error_category
  FROM reconciled),
errors AS (
  SELECT id, workflow_id, node_name, node_type, error_type, error_message, error_stack, http_code,
    source_node, source_output_index, "timestamp", error_category FROM resolved),
replica AS (
  SELECT id, workflow_id, CASE WHEN id % 11 = 0 THEN 'running' ELSE status END AS status,
    CASE WHEN id % 13 <> 0 THEN started_at END AS started_at,
    CASE WHEN id % 11 <> 0 THEN stopped_at END AS stopped_at,
    CASE WHEN id % 2 = 0 THEN mode END AS mode,
    CASE WHEN id % 22 = 0 THEN TIMESTAMP '2024-01-30 22:00:00'
         WHEN id % 33 = 0 THEN TIMESTAMP '2024-01-30 23:30:00' END AS missing_since,
    CASE WHEN status = 'error' THEN CASE WHEN id % 3 = 0 THEN 'pending' ELSE 'done' END END AS analytics_status,
    CAST(id % 5 AS BIGINT) AS analytics_attempts,
    CASE WHEN id % 4 = 0 THEN TIMESTAMP '2024-01-31 00:10:00' END AS analytics_next_attempt
  FROM execution_entity WHERE id % 17 <> 3),
source AS (
  SELECT * FROM execution_entity WHERE id % 19 <> 5)"""
