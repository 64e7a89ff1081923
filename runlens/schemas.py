"""Declared table schemas and the optional columns probed at the source.

Field names follow the stored tables in snake_case. Timestamps are UTC instants.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: status and category domains ------------------------------
OPEN_STATUSES = ["new", "running", "waiting"]
LISTING_STATUSES = ["success", "error", "canceled", "crashed", "running"]
FAILED_STATUSES = ["error", "crashed"]
TRANSIENT_CATEGORIES = ["rate_limit", "network", "upstream"]
STRUCTURAL_CATEGORIES = ["auth", "config", "data", "logic"]
ALL_CATEGORIES = TRANSIENT_CATEGORIES + STRUCTURAL_CATEGORIES + ["unknown", "unparsed"]
# ----------------------------------------------------------------------------

_S, _L, _D, _B, _TS = (
    T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampType(),
)


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields])


EXECUTION_BASE = _schema(
    ("id", _L), ("workflow_id", _S), ("status", _S), ("started_at", _TS), ("stopped_at", _TS),
)

# Copied only where the source has them.
EXECUTION_OPTIONAL = _schema(
    ("mode", _S), ("created_at", _TS), ("wait_till", _TS), ("finished", _B), ("retry_of", _S),
    ("retry_success_id", _S), ("json_size_bytes", _L), ("binary_data_size_bytes", _L),
    ("workflow_version_id", _S),
)

# Written by the sync itself, never read from the source.
EXECUTION_LOCAL = _schema(
    ("missing_since", _TS), ("analytics_status", _S), ("analytics_attempts", _L),
    ("analytics_next_attempt", _TS),
)

EXECUTION = T.StructType(
    EXECUTION_BASE.fields + EXECUTION_OPTIONAL.fields + EXECUTION_LOCAL.fields
)

WORKFLOW_BASE = _schema(("id", _S), ("name", _S), ("active", _B))
WORKFLOW_OPTIONAL = _schema(
    ("is_archived", _B), ("parent_folder_id", _S), ("created_at", _TS), ("updated_at", _TS),
    ("trigger_count", _L), ("description", _S),
)
WORKFLOW = T.StructType(WORKFLOW_BASE.fields + WORKFLOW_OPTIONAL.fields)

ERROR = _schema(
    ("id", _L), ("workflow_id", _S), ("node_id", _S), ("node_name", _S), ("node_type", _S),
    ("error_type", _S), ("error_message", _S), ("error_stack", _S), ("source_node", _S),
    ("source_output_index", _L), ("input_data", _S), ("metadata", _S), ("execution_source", _S),
    ("error_category", _S), ("http_code", _L), ("timestamp", _TS),
)

WORKFLOW_SETTINGS = _schema(("workflow_id", _S), ("saved_time_seconds", _D), ("hourly_rate", _D))
VOLUME = _schema(("timestamp", _TS), ("started_count", _L))
PROJECT = _schema(("id", _S), ("name", _S), ("type", _S))
PROJECT_RELATION = _schema(("project_id", _S), ("user_id", _S), ("role", _S))
SHARED_WORKFLOW = _schema(("workflow_id", _S), ("project_id", _S), ("role", _S))
SETTINGS = _schema(("key", _S), ("value", _S))
OPEN_BLOCK = _schema(("bucket", _L), ("low", _L), ("high", _L), ("bits", T.BinaryType()), ("quiet_since", _TS))
ACTIVE = _schema(("id", _L))
CHAT = _schema(("id", _L), ("user_id", _S), ("role", _S), ("content", _S), ("sql_used", _S),
               ("created_at", _TS))
SYNC_RUN = _schema(
    ("id", _L), ("started_at", _TS), ("finished_at", _TS), ("duration_ms", _L), ("status", _S),
    ("workflows", _L), ("executions", _L), ("rows_read", _L), ("errors", _L),
    ("analytics_done", _L), ("analytics_failed", _L), ("analytics_queued", _L),
    ("reclassified", _L), ("purged_input", _L), ("purged_stack", _L), ("replica_bytes", _L),
    ("error_message", _S),
)
PAYLOAD = _schema(("execution_id", _L), ("data", _S))


def coerce(column: Column, source: T.DataType, target: T.DataType) -> Column:
    """Stored form of one source value.

    A bigint delivered as text becomes a number only if it is digits with an
    optional minus sign; any other text in a numeric column becomes NULL rather
    than text.
    """
    if isinstance(source, T.StringType) and isinstance(target, T.LongType):
        return F.when(column.rlike("^-?[0-9]+$"), column.try_cast(target))
    if source == target:
        return column
    return column.try_cast(target)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project ``df`` to ``schema``: copy the columns it has, type-null the rest."""
    have = {f.name: f.dataType for f in df.schema.fields}
    return df.select(*[
        (coerce(F.col(f.name), have[f.name], f.dataType) if f.name in have
         else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in schema.fields
    ])


def present_columns(df: DataFrame, spec: T.StructType) -> list[str]:
    """Optional columns of ``spec`` that this source really has."""
    have = set(df.columns)
    return [f.name for f in spec.fields if f.name in have]
