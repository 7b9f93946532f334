"""As-of date arithmetic: look-back windows, season windows, horizons, the active set.

All bounds are computed once in Python from the ``as_of`` parameter and enter
the plan as literals, so Catalyst folds them and pushes the predicates into
the parquet scan (``PushedFilters``) instead of evaluating a date function per
row.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_date(d) -> dt.date:
    if isinstance(d, dt.datetime):
        return d.date()
    if isinstance(d, dt.date):
        return d
    return dt.date.fromisoformat(str(d))


def add_months(d: dt.date, k: int) -> dt.date:
    """Month arithmetic on a first-of-month date (no month-end clamping needed)."""
    m = d.month - 1 + k
    return dt.date(d.year + m // 12, m % 12 + 1, 1)


def month_start(d) -> dt.date:
    d = to_date(d)
    return dt.date(d.year, d.month, 1)


def year_month(d) -> str:
    d = to_date(d)
    return f"{d.year:04d}{d.month:02d}"


def lookback_bounds(as_of, months: int) -> tuple[dt.date, dt.date]:
    """``[first day of D's month - months, D - 1]``.

    The warehouse writes ``add_months(last_day(D), -(months+1)) + 1``; on the
    first of a month that is the same day, and the ``trunc`` form stays right
    for any D (Spark's ``add_months`` does not keep month ends).
    """
    d = to_date(as_of)
    return add_months(month_start(d), -months), d - dt.timedelta(days=1)


def season_bounds(as_of, years_back: int) -> dict[str, tuple[dt.date, dt.date]]:
    """Calendar windows of year ``year(D) - k``: turn-off Mar..Jun, turn-on Aug..Dec."""
    y = to_date(as_of).year - years_back
    return {
        "off": (dt.date(y, 3, 1), dt.date(y, 6, 30)),
        "on": (dt.date(y, 8, 1), dt.date(y, 12, 31)),
    }


def in_window(col: str | Column, bounds: tuple[dt.date, dt.date]) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return c.between(F.lit(bounds[0]), F.lit(bounds[1]))


def active_at(as_of, start: str = "sa_start_date", end: str = "sa_end_date") -> Column:
    """Active set: ``start_ym < ym(D) and end_ym >= ym(D)``.

    Written on the dates (``start < first-of-month(D) <= end``), which is the
    same predicate for date columns and can be pushed into a scan.
    """
    m = F.lit(month_start(as_of))
    return (F.col(start) < m) & (F.col(end) >= m)


def stopped_within(as_of, horizon: int, end: str = "sa_end_date") -> Column:
    """1 if the agreement ends in ``[D, D + horizon - 1]``, else 0."""
    d = to_date(as_of)
    return F.col(end).between(F.lit(d), F.lit(d + dt.timedelta(days=horizon - 1))).cast("int")


def horizon_labels(as_of, horizons=(7, 14, 21), end: str = "sa_end_date") -> list[Column]:
    return [stopped_within(as_of, h, end).alias(f"stop_{h}_days") for h in horizons]


def study_years(as_of, n: int = 7) -> list[int]:
    """The one-hot / pivot years: the ``n`` calendar years ending with D's year."""
    y = to_date(as_of).year
    return list(range(y - n + 1, y + 1))
