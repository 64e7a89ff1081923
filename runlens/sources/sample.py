"""The execution model over the sample tables.

Workflows come from customers, executions from events, projects from nations and
members from suppliers. Everything is a projection of those tables, so its size
follows theirs.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.functions.errors import resolve
from runlens.functions.timegrid import ts
from runlens.session import use_utc

AS_OF = dt.datetime(2024, 1, 31, tzinfo=dt.timezone.utc)

# Fixed values: (number, node type, class, message, stack, HTTP status).
MESSAGES: list[tuple[int, str, str, str, str, int | None]] = [
    (0, "core.code", "", "TypeError", "TypeError: Cannot read properties of undefined\n at x", None),
    (1, "core.http", "NodeApiError", "Too Many Requests - rate limit reached", "", 429),
    (2, "core.http", "NodeApiError", "Not authenticated", "", None),
    (3, "core.pg", "", "connect ECONNREFUSED 10.0.0.1:5436", "", None),
    (4, "core.http", "NodeApiError", "The service is currently unavailable.", "", None),
    (5, "core.set", "", "", "", None),
    (6, "core.set", "", "something odd", "", None),
    (7, "core.http", "NodeApiError", "something went wrong", "", 403),
    (8, "core.http", "NodeApiError", "something went wrong", "", 502),
    (9, "core.http", "NodeApiError", "order 429 could not be found", "", 404),
    (10, "core.http", "NodeApiError", "slow answer", "", 408),
    (11, "core.set", "", "call_center", "Error: call_center: 18 names, 21 values\n at y", None),
    (12, "core.set", "NodeApiError", "refresh_token was rejected", "", None),
    (13, "core.set", "", "Unexpected token < in JSON at position 0", "", None),
    (14, "core.set", "", "  upstream said 503 again \n", "", None),
    (15, "core.set", "", "code 15030 is no status", "", None),
    (16, "core.shell", "", "Failed to launch the browser process: Code: null", "", None),
    (17, "core.set", "WorkflowHasIssuesError", "check the nodes", "", None),
    (18, "core.set", "", "Parameter \"url\" is required", "", None),
    (19, "core.set", "", "expected a list but got a number", "", None),
    (20, "core.set", "NodeOperationError", "stopped on purpose", "", None),
    (21, "core.executeCommand", "", "exit status 3", "", None),
    (22, "core.function", "", "script blew up", "", None),
    (23, "core.set", "", "", "RangeError: Invalid array length\n at z", None),
]


# Declared, so that opening a table does not start a job to read its footer.
SCHEMAS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def executions_of(events: DataFrame) -> DataFrame:
    """Events, batch or stream, as executions."""
    kind, started = F.col("event_type"), F.col("ts").cast("timestamp")
    length = F.make_dt_interval(secs=F.col("value").cast("decimal(18,6)"))
    return events.select(
        F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("workflow_id"),
        F.when(kind == "error", "error").when(kind == "signup", "running")
        .otherwise("success").alias("status"),
        started.alias("started_at"),
        F.when(kind != "signup", started + length).alias("stopped_at"),
        kind.alias("mode"))


@dataclass
class SampleTables:
    """Lazily built tables of one sample folder."""

    spark: SparkSession
    path: str

    def __post_init__(self) -> None:
        use_utc(self.spark)

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.path}/{name}.parquet")

    @cached_property
    def workflows(self) -> DataFrame:
        return self.raw("customer").select(
            F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"),
            (F.col("c_acctbal") >= 0).alias("active"))

    @cached_property
    def executions(self) -> DataFrame:
        return executions_of(self.raw("events"))

    @cached_property
    def error_events(self) -> DataFrame:
        """Error events with their payload number ``k``."""
        return (self.raw("events").filter(F.col("event_type") == "error")
                .withColumn("k", F.get_json_object("props", "$.k").cast("int")))

    @cached_property
    def error_candidates(self) -> DataFrame:
        """Fields of failed executions as a trace would carry them, not resolved.

        The message is picked by position from a short fixed list, an array
        literal, so no join is needed.
        """
        def literal(value: str | int | None) -> str:
            if value is None or isinstance(value, int):
                return "null" if value is None else f"{value}L"
            return "'" + value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"

        names = ("node_type", "error_type", "error_message", "error_stack", "http_code")
        entries = ", ".join(
            "named_struct(" + ", ".join(f"'{n}', {literal(v)}" for n, v in zip(names, m[1:])) + ")"
            for m in MESSAGES)
        k = F.col("k")
        chosen = F.expr(f"get(array({entries}), pmod(k, {len(MESSAGES)}))")
        return self.error_events.withColumn("m", chosen).select(
            F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("workflow_id"),
            F.concat(F.lit("node_"), (k % 7).cast("string")).alias("node_name"),
            F.col("m.node_type").alias("node_type"), F.col("m.error_type").alias("error_type"),
            F.col("m.error_message").alias("error_message"),
            F.col("m.error_stack").alias("error_stack"), F.col("m.http_code").alias("http_code"),
            F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("src_"), (k % 5).cast("string")))
            .alias("source_node"),
            (k % 2).cast("bigint").alias("source_output_index"),
            F.col("ts").cast("timestamp").alias("timestamp"))

    @cached_property
    def errors(self) -> DataFrame:
        return resolve(self.error_candidates)

    @cached_property
    def stale_errors(self) -> DataFrame:
        """The error table as older rules might have left it: class, message and
        category not reconciled, everything filed under 'data' or 'unknown'."""
        return self.error_candidates.withColumn(
            "error_category", F.when(F.length("error_message") % 2 == 0, "data").otherwise("unknown"))

    @cached_property
    def project(self) -> DataFrame:
        return self.raw("nation").select(
            F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"),
            F.lit("team").alias("type"))

    @cached_property
    def project_relation(self) -> DataFrame:
        return self.raw("supplier").select(
            F.col("s_nationkey").cast("string").alias("project_id"),
            F.col("s_suppkey").cast("string").alias("user_id"),
            F.lit("project:editor").alias("role"))

    @cached_property
    def shared_workflow(self) -> DataFrame:
        return self.raw("customer").select(
            F.col("c_custkey").cast("string").alias("workflow_id"),
            F.col("c_nationkey").cast("string").alias("project_id"),
            F.lit("workflow:owner").alias("role"))

    @cached_property
    def settings(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.raw("customer").filter(key % 3 != 0).select(
            key.cast("string").alias("workflow_id"),
            ((key % 10) * 60).cast("bigint").alias("saved_time_seconds"),
            ((key % 7).cast("double") * 12.5).alias("hourly_rate"))

    @cached_property
    def replica(self) -> DataFrame:
        """An earlier copy of the executions. Every seventeenth id has not arrived yet, so that there is something
        to fetch; some rows are still open in it, and some lack their start."""
        i = F.col("id")
        return (self.executions.filter(i % 17 != 3).select(
            "id", "workflow_id",
            F.when(i % 11 == 0, "running").otherwise(F.col("status")).alias("status"),
            F.when(i % 13 != 0, F.col("started_at")).alias("started_at"),
            F.when(i % 11 != 0, F.col("stopped_at")).alias("stopped_at"),
            F.when(i % 2 == 0, F.col("mode")).alias("mode"),
            F.when(i % 22 == 0, ts(AS_OF - dt.timedelta(hours=2)))
            .when(i % 33 == 0, ts(AS_OF - dt.timedelta(minutes=30))).alias("missing_since"),
            F.when(F.col("status") == "error",
                   F.when(i % 3 == 0, "pending").otherwise("done")).alias("analytics_status"),
            (i % 5).alias("analytics_attempts"),
            F.when(i % 4 == 0, ts(AS_OF + dt.timedelta(minutes=10))).alias("analytics_next_attempt")))

    @cached_property
    def source(self) -> DataFrame:
        """The executions as the source shows them later. Every nineteenth id is gone, so that there is
        something to miss."""
        return self.executions.filter(F.col("id") % 19 != 5)

    @cached_property
    def payloads(self) -> DataFrame:
        """Flattened traces of the failed executions, written by Spark from
        :attr:`error_candidates` in the shapes that occur: plain, list-like,
        doubly encoded, broken, and with the status in one of three places."""
        c = self.error_candidates

        def quoted(column: str | Column) -> Column:
            text = F.col(column) if isinstance(column, str) else column
            return F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(F.regexp_replace(
                text, r"\\", r"\\\\"), '"', r'\\"'), "\n", r"\\n"), F.lit('"'))

        status = F.coalesce(
            F.when(F.col("id") % 3 == 0, F.lit(',"httpCode":"12"'))
            .when(F.col("id") % 3 == 1, F.concat(F.lit(',"status":'), F.col("http_code")))
            .otherwise(F.lit(',"context":"13"')), F.lit(""))
        code = F.coalesce(F.col("http_code").cast("string"), F.lit("none"))
        error = F.concat(F.lit('{"message":"5","name":"6","stack":"7","node":"8"'), status, F.lit("}"))
        # 4 is the error object, 5.. its texts, 8 the node, 10.. the frame.
        tail = F.concat_ws(
            ",", error, quoted("error_message"), quoted("error_type"), quoted("error_stack"),
            F.lit('{"name":"9","type":"10"}'), quoted("node_name"), quoted("node_type"),
            F.lit('{"nodeExecutionStack":"14","metadata":"19"}'),
            quoted(code), F.concat(F.lit('{"httpCode":'), F.coalesce(F.col("http_code").cast("string"), F.lit("0")), F.lit("}")),
            F.lit('["15"]'), F.lit('{"source":"16","data":"20"}'), F.lit('{"main":"17"}'), F.lit('["18"]'),
            F.concat(F.lit('{"previousNode":"21","previousNodeOutput":'),
                     F.col("source_output_index").cast("string"), F.lit("}")),
            F.lit('{"retries":2}'), F.concat(F.lit('{"row":'), F.col("id").cast("string"), F.lit("}")),
            quoted("source_node"))
        result = F.lit('{"error":"4"}')
        plain = F.concat(F.lit('[{"resultData":"1","executionData":"11"},'), result,
                         F.lit(',null,null,'), tail, F.lit("]"))
        listed = F.concat(F.lit('[["2"],'), result, F.lit(',{"resultData":"1","executionData":"11"},null,'),
                          tail, F.lit("]"))
        nested = F.concat(F.lit('[{"data":"1"},'), quoted(plain), F.lit("]"))
        shape = F.col("id") % 10
        return c.select(
            F.col("id").alias("execution_id"),
            F.when(shape == 7, "not json").when(shape == 8, nested)
            .when(shape.isin(2, 5), listed).otherwise(plain).alias("data"))
