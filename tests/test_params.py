"""Driver-side parameters."""

from __future__ import annotations

import datetime as dt

import pytest

from runlens import params
from runlens.params import BadRequest
from runlens.plans.history import check_select, guarded_select
from runlens.operators.care import retention_cutoff

from fixed import AS_OF


@pytest.mark.parametrize("bad", ["foo", "", None, {}, [], "2026-13-45", "0202-01-01T00:00:00Z", "3000-01-01"])
def test_unusable_dates(bad):
    assert params.parse_iso_date(bad) is None


def test_usable_date():
    assert params.parse_iso_date("2026-08-18T10:30:00.000Z") == dt.datetime(2026, 8, 18, 10, 30, tzinfo=dt.timezone.utc)


def test_date_pairs():
    assert params.parse_range(None, "") is None
    for pair in (("2026-01-01", None), (None, "2026-01-01"), ("2026-08-20", "2026-08-10"), ("foo", "2026-01-01")):
        with pytest.raises(BadRequest):
            params.parse_range(*pair)
    lo, hi = params.parse_range("2026-08-10T00:00:00Z", "2026-08-20T00:00:00Z")
    assert lo < hi


def test_default_range_is_seven_days_by_day():
    r = params.metrics_range(as_of=AS_OF)
    assert (r.end - r.start, r.start - r.prev_start, r.unit) == (dt.timedelta(days=7), dt.timedelta(days=7), "day")
    assert r.bucket_count == 8


@pytest.mark.parametrize("length, unit", [
    (dt.timedelta(days=4), "hour"), (dt.timedelta(days=4, milliseconds=1), "day")])
def test_grid_changes_above_four_days(length, unit):
    end = dt.datetime(2026, 3, 20, tzinfo=dt.timezone.utc)
    assert params.metrics_range((end - length).isoformat(), end.isoformat(), as_of=AS_OF).unit == unit


def test_range_is_as_long_as_asked():
    r = params.metrics_range("2025-01-01", "2026-03-20", as_of=AS_OF)
    assert r.end - r.start == dt.timedelta(days=443) and r.bucket_count == 444
    assert params.metrics_range("2025-01-01", "2026-03-20", as_of=AS_OF, longest=dt.timedelta(days=60)).bucket_count == 61


def test_day_grid_in_another_zone():
    r = params.metrics_range("2026-03-01T00:00:00Z", "2026-03-10T00:00:00Z", as_of=AS_OF, tz="Europe/Athens")
    assert r.origin == dt.datetime(2026, 2, 28, 22, tzinfo=dt.timezone.utc)


def test_lookback():
    assert params.lookback_start("all", as_of=AS_OF) is None
    assert params.lookback_start(None, as_of=AS_OF) is None
    assert AS_OF - params.lookback_start("30d", as_of=AS_OF) == dt.timedelta(hours=720)
    assert AS_OF - params.lookback_start("nonsense", as_of=AS_OF) == dt.timedelta(hours=24)
    assert AS_OF - params.lookback_start("14d", as_of=AS_OF, presets=params.PICKER_LOOKBACK_HOURS) == dt.timedelta(days=14)


@pytest.mark.parametrize("value, expected", [(None, 20), ("abc", 20), ("0", 20), ("-4", 1), ("500", 100), ("7.9", 7)])
def test_clamp(value, expected):
    assert params.clamp_int(value, 1, 100, 20) == expected


def test_settings_allow_list():
    assert params.validate_setting("timezone", "Europe/Athens") is None
    assert params.validate_setting("timezone", "UTC") is None
    assert "timezone" in params.validate_setting("other", "x")
    for bad in ("Mars/Olympus_Mons", "", None):
        assert params.validate_setting("timezone", bad)


@pytest.mark.parametrize("days", [0, -1, "typo", None, float("nan"), float("inf")])
def test_retention_keeps_on_odd_input(days):
    assert retention_cutoff(days, AS_OF) is None


@pytest.mark.parametrize("text", ["DELETE FROM x", "WITH a AS (SELECT 1) INSERT INTO t SELECT 1", "select 1; drop table t",
                                  "PRAGMA x", ""])
def test_only_selects(spark, text):
    with pytest.raises(BadRequest):
        guarded_select(spark, text, {"t": spark.range(1), "x": spark.range(1)})


def test_select_may_mention_updated_columns():
    assert check_select(" select updated_at, created from t ") == "select updated_at, created from t"
