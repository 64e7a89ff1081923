"""Driver-side parameters: dates, ranges, look-backs, clamps. No Spark here."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass
from zoneinfo import ZoneInfo, available_timezones

UTC = dt.timezone.utc

# --- fixed values -----------------------------------------------------------
MIN_YEAR, MAX_YEAR = 2000, 2100
DEFAULT_RANGE = dt.timedelta(days=7)
DAY_GRID_ABOVE = dt.timedelta(days=4)
LOOKBACK_HOURS = {"24h": 24, "48h": 48, "7d": 168, "30d": 720}
PICKER_LOOKBACK_HOURS = {"24h": 24, "48h": 48, "7d": 168, "14d": 336, "30d": 720}
MAX_SAVED_SECONDS = 86_400
MAX_HOURLY_RATE = 100_000
VOLUME_STEP = dt.timedelta(minutes=5)
VOLUME_BUCKETS = 288
# ----------------------------------------------------------------------------


class BadRequest(ValueError):
    """The caller's input is wrong; nothing was planned."""


def parse_iso_date(value: object) -> dt.datetime | None:
    """A UTC datetime, or None when the value is not a usable ISO date."""
    if isinstance(value, dt.datetime):
        parsed = value
    elif isinstance(value, str) and value.strip():
        try:
            parsed = dt.datetime.fromisoformat(value.strip())
        except ValueError:
            return None
    else:
        return None
    parsed = parsed.replace(tzinfo=UTC) if parsed.tzinfo is None else parsed.astimezone(UTC)
    return parsed if MIN_YEAR <= parsed.year <= MAX_YEAR else None


def parse_range(start: object, end: object) -> tuple[dt.datetime, dt.datetime] | None:
    """Both bounds, or None when neither is given; anything else is refused."""
    absent = (None, "")
    if start in absent and end in absent:
        return None
    if start in absent or end in absent:
        raise BadRequest("a range needs both its start and its end")
    lo, hi = parse_iso_date(start), parse_iso_date(end)
    if lo is None:
        raise BadRequest(f"cannot read the start of the range: {start}")
    if hi is None:
        raise BadRequest(f"cannot read the end of the range: {end}")
    if lo > hi:
        raise BadRequest("the range ends before it starts")
    return lo, hi


@dataclass(frozen=True)
class ReportRange:
    """Inclusive current period, the equally long period before it, and the grid."""

    start: dt.datetime
    end: dt.datetime
    prev_start: dt.datetime
    unit: str  # 'hour' or 'day'
    tz: str = "UTC"

    @property
    def step_seconds(self) -> int:
        return 86_400 if self.unit == "day" else 3_600

    @property
    def origin(self) -> dt.datetime:
        """First bucket: the start floored to its hour, or to midnight in ``tz``."""
        local = self.start.astimezone(ZoneInfo(self.tz))
        floored = local.replace(minute=0, second=0, microsecond=0)
        if self.unit == "day":
            floored = floored.replace(hour=0)
        return floored.astimezone(UTC)

    @property
    def bucket_count(self) -> int:
        """At most 98 hour buckets, because longer ranges have day buckets: some 37,000 in the years allowed."""
        span = (self.end - self.origin).total_seconds()
        return int(span // self.step_seconds) + 1


def metrics_range(start: object = None, end: object = None, *, as_of: dt.datetime,
                  tz: str = "UTC", longest: dt.timedelta | None = None) -> ReportRange:
    """KPI range: last seven days by default. A caller that wants to show no more than ``longest`` says so."""
    given = parse_range(start, end)
    if given is None:
        hi = parse_iso_date(as_of)
        lo = hi - DEFAULT_RANGE
        return ReportRange(lo, hi, lo - DEFAULT_RANGE, "day", tz)
    lo, hi = given
    lo = max(lo, hi - longest) if longest else lo
    length = hi - lo
    return ReportRange(lo, hi, lo - length, "day" if length > DAY_GRID_ABOVE else "hour", tz)


def error_range(start: object = None, end: object = None, *, as_of: dt.datetime) -> ReportRange:
    """Error-report range: same default, always a day grid."""
    given = parse_range(start, end)
    hi = given[1] if given else parse_iso_date(as_of)
    lo = given[0] if given else hi - DEFAULT_RANGE
    return ReportRange(lo, hi, lo - (hi - lo), "day")


def lookback_start(preset: str | None, *, as_of: dt.datetime,
                   presets: dict[str, int] = LOOKBACK_HOURS) -> dt.datetime | None:
    """Start of a look-back preset; absent or ``all`` means no bound, unknown 24 h."""
    if not preset or preset == "all":
        return None
    return parse_iso_date(as_of) - dt.timedelta(hours=presets.get(preset, 24))


def clamp_int(value: object, low: int, high: int | None, default: int) -> int:
    """Leading-digits integer with a default for unusable or zero input, clamped."""
    match = re.match(r"\s*([+-]?\d+)", str(value)) if value is not None else None
    number = (int(match.group(1)) if match else 0) or default
    number = max(number, low)
    return number if high is None else min(number, high)


def valid_time_zone(name: object) -> bool:
    return isinstance(name, str) and 0 < len(name) <= 64 and name in available_timezones()


def validate_setting(key: object, value: object) -> str | None:
    """None when the global setting may be stored, otherwise the reason it may not."""
    if not isinstance(key, str) or key == "":
        return "the setting has no key"
    if key != "timezone":
        return f"{key} cannot be set; only timezone can"
    if not valid_time_zone(value):
        return f"{key} needs the name of a time zone such as Asia/Tokyo"
    return None
