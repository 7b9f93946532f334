"""Column-level functions: sentinels, flags, one-hot years, encodings, math."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the study (sentinels for missing data).
OPEN_END = dt.date(2099, 12, 31)  # open agreement end date
NO_CREDIT = -1  # no credit rating
NO_WEATHER = -1  # no degree-day reading
NO_FLAG = "N"  # no DNP flag
NO_BUCKET = -1  # unknown usage bucket in the model matrix

# Cancelled, reactivated and pending-start agreements are removed before analysis.
DROPPED_STATUSES = ("70", "50", "10")

# Label codes of the model matrix for the test-table analogs: 21 cities
# (nation names NATION_0..NATION_20 -> 1..21) and the 5 customer classes; any
# other value encodes as 0.
CITY_CODES = {f"NATION_{i}": i + 1 for i in range(21)}
CLASS_CODES = {"AUTOMOBILE": 1, "BUILDING": 2, "FURNITURE": 3, "HOUSEHOLD": 4, "MACHINERY": 5}

# Customer segments used for the per-segment models and rates.
RESIDENTIAL = ("HOUSEHOLD",)
LANDLORD_BUILDER = ("BUILDING", "FURNITURE")


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def yn_flag(c: str | Column) -> Column:
    """'Y' when an outer-join match exists, else 'N'."""
    return F.when(col(c).isNotNull(), "Y").otherwise("N")


def yn_to_int(c: str | Column) -> Column:
    """'Y' -> 1, anything else (including NULL) -> 0."""
    return F.coalesce((col(c) == "Y").cast("int"), F.lit(0))


def present_flag(c: str | Column) -> Column:
    return col(c).isNotNull().cast("int")


def year_onehot(year_text: str | Column, years, prefix: str) -> list[Column]:
    return [(col(year_text) == F.lit(str(y))).cast("int").alias(f"{prefix}_{y}") for y in years]


def ym_text(c: str | Column) -> Column:
    return F.date_format(col(c), "yyyyMM")


def year_text(c: str | Column) -> Column:
    return F.date_format(col(c), "yyyy")


def postal5(c: str | Column) -> Column:
    # Oracle and Spark read start 0 as 1; write 1 so every engine agrees.
    return F.substring(col(c), 1, 5)


def days_between(later: str | Column, earlier: str | Column) -> Column:
    """Whole days ``later - earlier`` as BIGINT."""
    return F.datediff(F.to_date(col(later)), F.to_date(col(earlier))).cast("bigint")


def label_encode(c: str | Column, codes: dict[str, int], default: int = 0) -> Column:
    """Map literal lookup; values outside the map encode as ``default``."""
    pairs = []
    for k, v in codes.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.coalesce(F.create_map(*pairs)[col(c)], F.lit(default)).cast("int")


def round_half_even(c: str | Column, digits: int = 1) -> Column:
    """pandas/numpy ``round`` is half-to-even; Spark's ``round`` is half-up."""
    return F.bround(col(c), digits)
