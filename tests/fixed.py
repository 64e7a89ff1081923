"""The moment all tests look from, and a comparable form of results."""

import datetime as dt

AS_OF = dt.datetime(2026, 8, 20, 12, 0, tzinfo=dt.timezone.utc)


def rows(df, *columns):
    picked = df.select(*columns) if columns else df
    return sorted([tuple(r) for r in picked.collect()], key=repr)
