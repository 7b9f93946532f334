"""Analysis-ready tables: cleaned extract, labelled rows, the active set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnscope.functions.asof import active_at, horizon_labels, to_date
from churnscope.functions.buckets import ARREARS_EDGES, USAGE_EDGES, cascade_bucket, decile_buckets
from churnscope.functions.scalar import DROPPED_STATUSES, present_flag, yn_to_int

YN_FLAGS = (
    "dnp_started_flag",
    "dnp_stopped_flag",
    "person_rcvd_18_mths_pledge",
    "seasonal_prior_1_yr_flag",
    "seasonal_prior_2_yr_flag",
    "seasonal_prior_3_yr_flag",
)


def status_filter() -> Column:
    """Drop cancelled/reactivated/pending-start agreements and rows missing codes.

    A missing status is kept (the notebook compares with ``!=``, which keeps it).
    """
    return (
        ~F.coalesce(F.col("sa_status_flag"), F.lit("")).isin(*DROPPED_STATUSES)
        & F.col("rate_class_code").isNotNull()
        & F.col("cis_division").isNotNull()
    )


def clean_feature_table(features: DataFrame) -> DataFrame:
    return features.filter(status_filter())


def labelled(clean: DataFrame, as_of, horizons=(7, 14, 21)) -> DataFrame:
    """Horizon labels and the four buckets (two quantile-based, two fixed)."""
    d = to_date(as_of)
    out = clean.select("*", *horizon_labels(d, horizons))
    out = decile_buckets(
        out,
        [
            ("arrears_payoff_amount", "arrears_payoff_bucket", None),
            # quantiles of the active rows only, assigned only to them
            ("active_diff_from_as_of", "current_days_active_bucket", active_at(d)),
        ],
    )
    out = out.withColumn("arrears_payoff_bucket_2", cascade_bucket("arrears_payoff_amount", ARREARS_EDGES))
    return out.withColumn("usage_past_18_bucket", cascade_bucket("usage_in_last_18_months", USAGE_EDGES))


def active_set(labelled_df: DataFrame, as_of) -> DataFrame:
    """Active rows with 0/1 twins of the Y/N flags and pledge-date presence flags."""
    d = to_date(as_of)
    y1, y2 = d.year - 2, d.year - 1
    out = labelled_df.filter(active_at(d)).select(
        "*",
        *[yn_to_int(c).alias(f"{c}_num" if c.endswith("pledge") or c.startswith("seasonal") else f"{c}_number")
          for c in YN_FLAGS],
        present_flag(f"pledge_date_{y1}").alias(f"pledge_date_{y1}_num"),
        present_flag(f"pledge_date_{y2}").alias(f"pledge_date_{y2}_num"),
    )
    drop = [f"pledge_date_{d.year - 6}", f"pledge_date_{d.year - 5}"] + [f"stop_{y}" for y in range(d.year - 6, d.year)]
    return out.drop(*drop)
