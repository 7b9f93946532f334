"""Segment tables of the data story: stop counts and rates by city, class, bucket,
start year, cohort and DNP flag.  Every table is one grouped aggregation over
the labelled rows; the three horizons are computed in the same pass and, where
the study lists them one per horizon, unpivoted with ``stack``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnscope.functions.asof import active_at, study_years, to_date
from churnscope.functions.scalar import RESIDENTIAL

LABELS = ("stop_7_days", "stop_14_days", "stop_21_days")


def _stack_horizons(df: DataFrame, keys: list[str], prefix: str, value: str) -> DataFrame:
    """(keys, {prefix}7, {prefix}14, {prefix}21) -> (keys, horizon, value)."""
    pairs = ", ".join(f"{h}, `{prefix}{h}`" for h in (7, 14, 21))
    return df.selectExpr(*[f"`{k}`" for k in keys], f"stack(3, {pairs}) as (horizon, {value})")


def stops_total(lab: DataFrame) -> DataFrame:
    return lab.agg(*[F.sum(c).cast("bigint").alias(c) for c in LABELS])


def stops_by_start(lab: DataFrame, key: str, minimum: str) -> DataFrame:
    """Stops per start year (or year-month) from ``minimum`` on, per horizon; only
    groups that have stops (one filtered group-by per horizon in the study)."""
    grouped = lab.filter(F.col(key) >= minimum).groupBy(key).agg(
        *[F.sum(c).cast("bigint").alias(f"s{h}") for c, h in zip(LABELS, (7, 14, 21))]
    )
    return _stack_horizons(grouped, [key], "s", "stops").filter(F.col("stops") > 0)


def stop_rate_by(lab: DataFrame, as_of, key: str) -> DataFrame:
    return lab.filter(active_at(as_of)).groupBy(key).agg(
        *[F.avg(c).alias(f"rate_{h}") for c, h in zip(LABELS, (7, 14, 21))]
    )


def stop_count_by(lab: DataFrame, as_of, key: str) -> DataFrame:
    return lab.filter(active_at(as_of)).groupBy(key).agg(
        F.count(F.lit(1)).alias("active_agreements"),
        *[F.sum(c).cast("bigint").alias(f"stops_{h}") for c, h in zip(LABELS, (7, 14, 21))],
    )


def dnp_counts(lab: DataFrame, as_of, flags=("dnp_started_flag", "dnp_stopped_flag")) -> DataFrame:
    """Stopped agreements per horizon and DNP flag value, with the share of the horizon."""
    act = lab.filter(active_at(as_of))
    parts = []
    for flag in flags:
        g = act.groupBy(F.lit(flag).alias("flag_name"), F.col(flag).alias("flag_value")).agg(
            *[F.sum(c).cast("bigint").alias(f"s{h}") for c, h in zip(LABELS, (7, 14, 21))]
        )
        parts.append(g)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = _stack_horizons(out, ["flag_name", "flag_value"], "s", "stops").filter(F.col("stops") > 0)
    total = F.sum("stops").over(Window.partitionBy("flag_name", "horizon"))  # <= 2 x 3 x values rows
    return out.withColumn("share", F.col("stops") / total)


def stops_owing_counts(lab: DataFrame, as_of) -> DataFrame:
    s = lab.filter(active_at(as_of) & (F.col("stop_21_days") == 1))
    a, u, t = F.col("arrears_payoff_amount"), F.col("usage_in_last_18_months"), F.col("active_diff_from_as_of")
    return s.agg(
        F.count(F.lit(1)).alias("stopped"),
        F.count_if(a >= 1500).alias("owing_1500_plus"),
        F.count_if(a <= -100).alias("credit_100_plus"),
        F.count_if(a == 0).alias("owing_nothing"),
        F.count_if(u >= 5000).alias("usage_5000_plus"),
        F.count_if(u < 10).alias("usage_under_10"),
        F.count_if(u == 0).alias("usage_zero"),
        F.count_if(t >= 3650).alias("active_10y_plus"),
        F.count_if((t >= 1825) & (t < 3650)).alias("active_5_to_10y"),
    )


def stop_by_bucket(lab: DataFrame, as_of, bucket: str, classes=None, label: str = "stop_21_days") -> DataFrame:
    """Active agreements per bucket: count, stops and stop rate; optionally one class set."""
    act = lab.filter(active_at(as_of))
    seg = "all"
    if classes is not None:
        act = act.filter(F.col("customer_class").isin(list(classes)))
        seg = "+".join(classes)
    return act.groupBy(F.lit(seg).alias("segment"), F.col(bucket).alias("bucket")).agg(
        F.count(F.lit(1)).alias("active_agreements"), F.sum(label).cast("bigint").alias("stops"), F.avg(label).alias("stop_rate")
    )


def bucket_min_boundaries(lab: DataFrame, as_of, bucket: str, value: str) -> DataFrame:
    return lab.filter(active_at(as_of)).groupBy(F.col(bucket).alias("bucket")).agg(
        F.min(value).alias("min_value"), F.count(F.lit(1)).alias("rows")
    )


def cohort_table(lab: DataFrame, as_of) -> DataFrame:
    """For each study year Y: agreements alive in Y (start year <= Y <= end year)
    started within [year(D)-9, year(D)+1]: stop-in-Y rate, sum and count by start
    year, and the share of all stops of Y (denominator without the cohort filter)."""
    d = to_date(as_of)
    years = study_years(d)
    lo, hi = str(d.year - 9), str(d.year + 1)
    base = lab.filter(F.col("sa_start_year").between(lo, hi))
    # one row per (agreement, year alive): at most len(years) copies, no join
    yr = F.explode(F.array(*[F.struct(F.lit(str(y)).alias("y"), F.col(f"stop_{y}").alias("s")) for y in years]))
    expanded = base.select("sa_start_year", "sa_end_year", yr.alias("ys")).select(
        "sa_start_year", "sa_end_year", F.col("ys.y").alias("stop_year"), F.col("ys.s").alias("stopped")
    )
    alive = expanded.filter((F.col("sa_start_year") <= F.col("stop_year")) & (F.col("sa_end_year") >= F.col("stop_year")))
    cohorts = alive.groupBy("stop_year", "sa_start_year").agg(
        F.avg("stopped").alias("stop_rate"), F.sum("stopped").cast("bigint").alias("stops"), F.count(F.lit(1)).alias("alive")
    )
    totals = lab.agg(*[F.sum(f"stop_{y}").cast("bigint").alias(str(y)) for y in years])
    pairs = ", ".join(f"'{y}', `{y}`" for y in years)
    totals = totals.selectExpr(f"stack({len(years)}, {pairs}) as (stop_year, year_stops)")  # one row per year
    return cohorts.join(F.broadcast(totals), "stop_year", "left").withColumn(
        "stop_share", F.try_divide(F.col("stops"), F.col("year_stops"))
    )


def per_year_counts(lab: DataFrame, as_of, which: str, classes=None) -> DataFrame:
    d = to_date(as_of)
    lo = str(d.year - 6)
    if which == "start":
        src, key = lab.filter(F.col("sa_start_year") >= lo), "sa_start_year"
    else:
        src, key = lab.filter(F.col("sa_end_year").between(lo, str(d.year))), "sa_end_year"
    seg = "all"
    if classes is not None:
        src = src.filter(F.col("customer_class").isin(list(classes)))
        seg = "+".join(classes)
    return src.groupBy(F.lit(seg).alias("segment"), F.col(key).alias("year")).agg(F.count(F.lit(1)).alias("agreements"))


def avg_inactive_by_division(lab: DataFrame, as_of) -> DataFrame:
    """Mean days inactive before start, by start year and division, three filters."""
    d = to_date(as_of)
    lo, hi = str(d.year - 9), str(d.year + 1)
    start_ok = F.col("sa_start_year").between(lo, hi)
    days = F.col("person_days_inactive_before")
    variants: dict[str, Column] = {
        "all": start_ok,
        "non_negative": start_ok & (days >= 0),
        "has_prior": (days >= 0)
        & F.col("person_prior_stop_date").isNotNull()
        & F.col("sa_end_year").between(str(d.year - 4), str(d.year + 1)),
    }
    # one pass: each row carries the variants it belongs to
    tagged = lab.select(
        "sa_start_year",
        "cis_division",
        days.alias("days"),
        F.explode(F.array(*[F.when(c, F.lit(n)) for n, c in variants.items()])).alias("variant"),
    ).filter(F.col("variant").isNotNull())
    return tagged.groupBy("variant", "cis_division", "sa_start_year").agg(F.avg("days").alias("avg_days_inactive"))


def share_of_total(df: DataFrame, key: str) -> DataFrame:
    """Rows per group and their share of all rows; the total is summed over the grouped rows (one per city, code or year)."""
    g = df.groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    return g.withColumn("share", F.col("rows") / F.sum("rows").over(Window.partitionBy()).cast("double"))


def residential(df: DataFrame) -> DataFrame:
    return df.filter(F.col("customer_class").isin(list(RESIDENTIAL)))
