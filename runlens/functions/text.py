"""Text helpers: trimming, keys, dates, time zones, redaction."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Field names whose content must never be shown.
REDACTED_KEYS = [
    "password", "passwd", "pass", "token", "authorization", "auth", "secret", "apikey",
    "api_key", "jwt", "cookie", "set-cookie", "dashboard_db_pass", "openai_api_key",
    "dashboard_jwt_secret",
]
REDACTED = "[redacted]"

# White space as the web platform trims it, including no-break space and BOM.
_SPACE = r"[\s\p{Z}\x{FEFF}]"


def trim_all(column: Column) -> Column:
    return F.regexp_replace(column, rf"^{_SPACE}+|{_SPACE}+$", "")


def blank_to_null(column: Column) -> Column:
    return F.nullif(column, F.lit(""))


def error_summary(message: Column) -> Column:
    """Grouping key of a message: all of it. Errors that only begin alike stay apart."""
    return message


def safe_timestamp(text: Column) -> Column:
    """Timestamp of an ISO text, NULL when unreadable or outside 2000..2100."""
    parsed = trim_all(text).try_cast("timestamp")
    return F.when(F.year(parsed).between(2000, 2100), parsed)


def hashed_key(prefix: Column | str, key: Column, length: int = 32) -> Column:
    """First ``length`` hex digits of SHA-256 over ``prefix:key``."""
    head = F.lit(prefix) if isinstance(prefix, str) else prefix
    return F.substring(F.sha2(F.concat(head, F.lit(":"), key), 256), 1, length)


def account_key(address: Column, email: Column) -> Column:
    """Login-attempt key: source address and a digest of the normalised e-mail."""
    who = F.substring(F.sha2(F.lower(trim_all(F.coalesce(email, F.lit("")))), 256), 1, 16)
    return F.concat(address, F.lit("|"), who)


def render_time(moment: Column, tz: Column | str, pattern: str = "M/d/yyyy, HH:mm:ss") -> Column:
    """A stored UTC instant shown in another zone, on a 24-hour clock."""
    zone = F.lit(tz) if isinstance(tz, str) else tz
    local = F.convert_timezone(F.lit("UTC"), zone, moment.cast("timestamp_ntz"))
    return F.coalesce(F.date_format(local, pattern), F.lit("N/A"))


def render_time_text(text: Column, tz: Column | str, pattern: str = "M/d/yyyy, HH:mm:ss") -> Column:
    """As :func:`render_time` for text; a value without an offset is UTC."""
    has_zone = text.rlike(r"(Z|[+-]\d\d:?\d\d)$")
    moment = F.when(has_zone, text).otherwise(F.concat(text, F.lit("Z"))).try_cast("timestamp")
    return render_time(moment, tz, pattern)


def _without_secrets(document: object, keys: frozenset[str]) -> tuple[object, bool]:
    """The document with the values of secret keys replaced, and whether there were any; no recursion."""
    found, todo = False, [document]
    while todo:
        node = todo.pop()
        if isinstance(node, dict):
            for key in node:
                if key.lower() in keys:
                    node[key], found = REDACTED, True
        if isinstance(node, (dict, list)):
            todo.extend(node.values() if isinstance(node, dict) else node)
    return document, found


@F.pandas_udf(StringType())
def _redacted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    keys = frozenset(REDACTED_KEYS)

    def one(text: object) -> object:
        if not isinstance(text, str):
            return None
        try:
            document, found = _without_secrets(json.loads(text), keys)
            return json.dumps(document, ensure_ascii=False, separators=(",", ":")) if found else text
        except (ValueError, RecursionError):
            return REDACTED

    for batch in batches:
        yield batch.map(one)


def redact_json(column: Column) -> Column:
    """Replace the values of secret-looking keys in a JSON column, at every depth.

    One rule for every row: the text is parsed, so escaped key names count too. What has no such key
    passes as it is; what cannot be parsed, or is nested too deep to be, is hidden whole, since nobody
    can tell what it holds. NULL stays NULL.
    """
    return _redacted(column)
