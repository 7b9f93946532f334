"""Per-key aggregates of the feature warehouse (aggregated before any join)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnscope.functions.asof import in_window, lookback_bounds, to_date

PAST = "1950-01-01"  # missing posting date counts as long past


def billing_counts(ft: DataFrame, as_of) -> DataFrame:
    """Payments/bills (and their segments) in 18 months, arrears and totals per SA.

    ``count(case when ... then id end)`` counts rows with a non-null id, not
    distinct ids.  Arrears sum the amounts whose arrears date is before D.
    """
    d = F.lit(to_date(as_of))
    w = in_window("post_date", lookback_bounds(as_of, 18))
    base = ft.filter((F.col("frozen_sw") == "Y") & (F.coalesce(F.col("post_date"), F.lit(PAST).cast("date")) < d))
    is_ps, is_bs = F.col("ft_type_flag") == "PS", F.col("ft_type_flag") == "BS"
    due = F.to_date("arrears_date") < d
    cur, pay = F.coalesce(F.col("current_amount"), F.lit(0.0)), F.coalesce(F.col("payoff_amount"), F.lit(0.0))
    return base.groupBy("sa_id").agg(
        F.count(F.when(is_ps & w, F.col("parent_id"))).alias("payments_in_last_18_months"),
        F.count(F.when(is_bs & w, F.col("parent_id"))).alias("bills_in_last_18_months"),
        F.count(F.when(is_ps & w, F.col("sibling_id"))).alias("pay_segs_in_last_18_months"),
        F.count(F.when(is_bs & w, F.col("sibling_id"))).alias("bill_segs_in_last_18_months"),
        F.sum(F.when(due, cur).otherwise(F.lit(0.0))).alias("arrears_current_amount"),
        F.sum(F.when(due, pay).otherwise(F.lit(0.0))).alias("arrears_payoff_amount"),
        F.sum(cur).alias("total_current_amount"),
        F.sum(pay).alias("total_payoff_amount"),
    )


def late_payment_counts(adj: DataFrame, as_of) -> DataFrame:
    return (
        adj.filter(
            (F.col("adjustment_type_code") == "LPC")
            & (F.col("adjustment_status_flag") == "50")
            & in_window("creation_date", lookback_bounds(as_of, 18))
        )
        .groupBy("sa_id")
        .agg(F.count(F.lit(1)).alias("late_payment_count"))
    )


def usage_18m(usage_fact: DataFrame, as_of) -> DataFrame:
    return (
        usage_fact.filter(in_window("last_day_of_period", lookback_bounds(as_of, 18)))
        .groupBy("sa_id")
        .agg(F.sum("billed_usage").alias("usage_in_last_18_months"))
    )


def pledge_by_year(pledge: DataFrame, years) -> DataFrame:
    """Per agreement (``c1sa``) and study year: latest pledge date and a 0/1 flag.

    A generated ``max(case ...)`` per year with the year list fixed up front:
    one aggregation, no extra job to discover pivot values.
    """
    yr = F.date_format("pledge_dt", "yyyy")
    aggs = []
    for y in years:
        hit = yr == F.lit(str(y))
        aggs.append(F.max(F.when(hit, F.to_date("pledge_dt"))).alias(f"pledge_date_{y}"))
        aggs.append(F.max(F.when(hit, F.lit(1)).otherwise(F.lit(0))).alias(f"pledge_flag_{y}"))
    return pledge.groupBy(F.col("c1sa").alias("sa_id")).agg(*aggs)


def history_min_max(sa: DataFrame, key: str, as_of, prefix: str) -> DataFrame:
    """Earliest/latest start and end before D per person or premise, cancelled excluded.

    ``status <> '70'`` also drops a NULL status, as in SQL.
    """
    d = F.lit(to_date(as_of))
    s, e = F.to_date("sa_start_date"), F.to_date("sa_end_date")
    return (
        sa.filter(F.col("sa_status_flag") != "70")
        .groupBy(key)
        .agg(
            F.max(F.when(s < d, s)).alias(f"{prefix}_max_sa_start_date"),
            F.min(F.when(s < d, s)).alias(f"{prefix}_min_sa_start_date"),
            F.max(F.when(e < d, e)).alias(f"{prefix}_max_sa_end_date"),
            F.min(F.when(e < d, e)).alias(f"{prefix}_min_sa_end_date"),
        )
    )
