"""Error rules, each list of cases through one DataFrame."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlens.functions import errors as rules
from runlens.functions import payload

UNDEFINED = "Cannot read properties of undefined (reading 'id')"

HEADERS = [
    (f"TypeError: {UNDEFINED}\n    at VmCodeWrapper", "TypeError", UNDEFINED),
    ("Error: call_center: 18 names, 21 values\n    at foo", "Error", "call_center: 18 names, 21 values"),
    ("Error", "Error", ""),
    ("at Object.foo (file:1:2)", None, None),
    ("Warning: something happened", None, None),
    ("", None, None),
    (None, None, None),
]

RECONCILED = [
    ("TypeError", "", f"TypeError: {UNDEFINED}\n at x", "TypeError", UNDEFINED),
    ("call_center", "", "Error: call_center: 18 names, 21 values\n at x", "Error",
     "call_center: 18 names, 21 values"),
    ("The service is currently unavailable.", "NodeApiError",
     "NodeApiError: The service was not able to process your request\n at x", "NodeApiError",
     "The service is currently unavailable."),
    ("", "", "", "", None),
    ("   \n ", "", "", "", None),
    (None, None, None, "", None),
    (" kept ", " Own ", "TypeError: other", "Own", "kept"),
]

# message, class, node type, HTTP status, category
CATEGORIES = [
    ("something went wrong", "", "", 429, "rate_limit"),
    ("something went wrong", "", "", 401, "auth"),
    ("something went wrong", "", "", 502, "upstream"),
    ("something went wrong", "", "", 400, "data"),
    ("something went wrong", "", "", 408, "network"),
    ("something went wrong", "", "", 302, "unknown"),
    ("order 429 could not be found", "", "", 404, "data"),
    (UNDEFINED.lower(), "TypeError", "", None, "data"),
    ("connect ECONNREFUSED 46.225.80.80:5436", "", "", None, "network"),
    ("Too Many Requests - rate limit reached", "NodeApiError", "", None, "rate_limit"),
    ("Unauthorized - please check your credentials", "NodeApiError", "", None, "auth"),
    ("The service is currently unavailable.", "NodeApiError", "", None, "upstream"),
    ("the customer record was null in the source system", "", "", None, "unknown"),
    ("report missing for yesterday", "", "", None, "unknown"),
    ("Unexpected token < in JSON at position 0", "SyntaxError", "", None, "data"),
    ('required property "email" not supplied', "", "", None, "data"),
    ("script blew up", "Error", "base.code", None, "logic"),
    ("something odd", "", "", None, "unknown"),
    ("something odd", "NodeOperationError", "base.httpRequest", None, "logic"),
    ("Not Found", "NodeApiError", "base.httpRequest", None, "unknown"),
    ("Not authenticated", "NodeApiError", "base.httpRequest", None, "auth"),
    ("Failed to launch the browser process: Code: null stderr: /usr/bin/chromium: "
     "fork failed: Resource temporarily unavailable", "NodeApiError", "", None, "config"),
    ("The first argument must be of type string or an instance of Buffer", "NodeOperationError", "",
     None, "data"),
    ('Invalid URL: as. URL must start with "http" or "https".', "NodeOperationError", "", None, "data"),
    ("Failing row contains (null, New, 46131.63, DSLAM)", "NodeOperationError", "", None, "data"),
    ("The connection to the server was closed unexpectedly, perhaps it is offline", "NodeApiError", "",
     None, "network"),
    # Word edges are those of ASCII text.
    ("é503", "", "", None, "upstream"),
    ("code 15030", "", "", None, "unknown"),
    ("your refresh_token is gone", "", "", None, "auth"),
    ("tokens expired", "", "", None, "unknown"),
    ("token has expired", "", "", None, "auth"),
    ("services unavailable", "", "", None, "unknown"),
    ("value of null", "", "", None, "data"),
    ("parameter is required", "", "", None, "config"),
    ("x", "WorkflowHasIssuesError", "", None, "config"),
    ("exit 1", "", "base.executeCommand", None, "logic"),
    ("exit 1", "", "base.executeCommandTool", None, "unknown"),
]


def test_stack_header(spark):
    df = spark.createDataFrame([(h[0],) for h in HEADERS], "stack string").coalesce(1)
    kind, message = rules.stack_header(F.col("stack"))
    assert [tuple(r) for r in df.select(kind, message).collect()] == [h[1:] for h in HEADERS]


def test_reconcile(spark):
    df = spark.createDataFrame([r[:3] for r in RECONCILED], "m string, t string, s string").coalesce(1)
    kind, message = rules.reconcile(F.col("m"), F.col("t"), F.col("s"))
    assert [tuple(r) for r in df.select(kind, message).collect()] == [r[3:] for r in RECONCILED]


def test_categories(spark):
    rows = [(c[0], c[1], "", c[2], c[3]) for c in CATEGORIES]
    df = spark.createDataFrame(
        rows, "error_message string, error_type string, error_stack string, node_type string, http_code long")
    got = [r["error_category"] for r in rules.resolve(df.coalesce(1)).collect()]
    wrong = [(c[0], g, c[4]) for c, g in zip(CATEGORIES, got) if g != c[4]]
    assert wrong == []


def test_resolve_end_to_end(spark):
    df = spark.createDataFrame(
        [("", "", "", "base.code", None), ("TypeError", "", f"TypeError: {UNDEFINED}\n at x", "Unknown Type", None)],
        "error_message string, error_type string, error_stack string, node_type string, http_code long")
    got = [(r.error_type, r.error_message, r.error_category) for r in rules.resolve(df.coalesce(1)).collect()]
    assert got == [("", None, "unparsed"), ("TypeError", UNDEFINED, "data")]


def test_change_kinds(spark):
    cases = [
        ("same", "A", "same", "A", "category"),
        ("same", None, "same", "A", "type"),
        (" x ", "", "x", "", "trimmed"),
        (None, "", "x", "", "filled"),
        (" ", "", "x", "", "filled"),
        ("x", "", None, "", "lost"),
        ("ab", "", "abc", "", "extended"),
        ("TypeError", "", "real", "TypeError", "unmasked"),
        ("q", "", "real", "", "other"),
    ]
    df = spark.createDataFrame([c[:4] for c in cases], "om string, ot string, nm string, nt string").coalesce(1)
    kind = rules.change_kind(F.col("om"), F.col("ot"), F.col("nm"), F.col("nt"))
    assert [r[0] for r in df.select(kind).collect()] == [c[4] for c in cases]


def test_http_status(spark):
    cases = [
        ('{"httpCode":429}', 429), ('{"httpCode":"1"}', 503), ('{"context":"2"}', 401),
        ('{"response":"3"}', 404), ('{"message":"4"}', None), ('{"statusCode":99999}', None),
        ('{"httpCode":"5","status":404}', 404), ('{"cause":"6"}', None), ('{"status":404.0}', 404),
        ('{"status":404.5}', None), ('{"status":true}', None), ('{"httpCode":"7"}', 502),
    ]
    tail = '"503",{"httpCode":401},{"status":404},"boom","none",{"httpCode":7,"statusCode":500}," 502 x"'
    texts = [('[{"resultData":{"error":%s}},%s]' % (error, tail),) for error, _ in cases]
    decoded = payload.decode(spark.createDataFrame(texts, "data string").coalesce(1))
    got = [r[0] for r in decoded.select(F.expr(payload.http_status("resultData", "error"))).collect()]
    assert got == [code for _, code in cases]
