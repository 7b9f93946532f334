"""Joins of the feature warehouse: lookups, existence flags, anti/semi joins, seasons.

Right sides are reduced to one row per join key before they meet the wide
agreement row (distinct keys, aggregates), so no left join fans out and no
``distinct`` over the wide row is needed.  Only the weather calendar is broadcast
by hint, after its rows are counted; AQE measures each other side at run time and
broadcasts only what is under the threshold, falling back to a sort-merge join
(split when skewed) otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnscope.functions.asof import in_window, lookback_bounds, season_bounds
from churnscope.functions.scalar import yn_flag
from churnscope.sources.csv_io import stage_table

CALENDAR_DAYS = 400_000  # days of a broadcast calendar at most: a thousand years, a few MB

def agreements_lookup(sa: DataFrame) -> DataFrame:
    """``sa_s``: agreement -> account (integration_id, account_id)."""
    return sa.select("sa_id", "account_id")


def turn_ons(recdet: DataFrame, sa: DataFrame) -> DataFrame:
    """Turn-on facts with the agreement's account (inner lookup), DNP flag NULL -> 'N'."""
    return (
        recdet.filter(F.col("started_flag") == "Y")
        .join(agreements_lookup(sa), "sa_id")
        .select(
            "month_start_date",
            "account_id",
            "sa_id",
            "premise_id",
            F.coalesce(F.col("dnp_started_flag"), F.lit("N")).alias("dnp_started_flag"),
        )
    )


def premise_dnp_12m(recdet: DataFrame, as_of) -> DataFrame:
    """Premises with a disconnect-for-non-payment stop in the last 12 months."""
    w = lookback_bounds(as_of, 12)
    return (
        recdet.filter((F.col("dnp_stopped_flag") == "Y") & in_window("month_start_date", w))
        .select("premise_id")
        .distinct()
    )


def account_dnp_12m(recdet: DataFrame, sa: DataFrame, as_of) -> DataFrame:
    w = lookback_bounds(as_of, 12)
    return (
        recdet.filter((F.col("dnp_stopped_flag") == "Y") & in_window("month_start_date", w))
        .join(agreements_lookup(sa), "sa_id")
        .select("account_id")
        .distinct()
    )


def pledge_persons_18m(pledge: DataFrame, as_of) -> DataFrame:
    w = lookback_bounds(as_of, 18)
    return pledge.filter(in_window("pledge_dt", w)).select("person_id").distinct()


def uncancelled_payments(ft: DataFrame) -> DataFrame:
    """Frozen payment rows without a cancellation row of the same sibling (anti join)."""
    pays = ft.filter((F.col("frozen_sw") == "Y") & (F.col("ft_type_flag") == "PS"))
    cancels = ft.filter(F.col("ft_type_flag") == "PX").select("sibling_id")
    return pays.join(cancels, "sibling_id", "left_anti")


def last_payment_date(ft, pay_seg, pay, pay_event, as_of) -> DataFrame:
    """Most recent (not cancelled) payment date per agreement before D."""
    from churnscope.functions.asof import to_date

    pe = pay_event.filter(F.col("payment_date") < F.lit(to_date(as_of)))
    chain = (
        uncancelled_payments(ft)
        .select("sa_id", "sibling_id")
        .join(pay_seg.withColumnRenamed("integration_id", "sibling_id"), "sibling_id")
        .join(pay.withColumnRenamed("integration_id", "payment_id"), "payment_id")
        .join(pe.withColumnRenamed("integration_id", "pay_event_id"), "pay_event_id")
    )
    return chain.groupBy("sa_id").agg(F.max("payment_date").alias("most_recent_payment_date"))


def _windows(as_of, years_back) -> tuple:
    """Conditions on ``month_start_date``: the last 12 months, the bounds of the seasons, any of these."""
    last = in_window("month_start_date", lookback_bounds(as_of, 12))
    seasons = {k: season_bounds(as_of, k) for k in years_back}
    used = last
    for b in seasons.values():
        used = used | in_window("month_start_date", b["on"]) | in_window("month_start_date", b["off"])
    return last, seasons, used


def known_facts(recdet: DataFrame, sa: DataFrame, as_of, years_back=(1, 2, 3)) -> DataFrame:
    """Turn-on/off facts of the windows with the account of their agreement, stored: premises and accounts both read them."""
    known = agreements_lookup(sa).distinct().withColumn("known", F.lit(True))
    rows = recdet.filter(_windows(as_of, years_back)[2]).join(known, "sa_id", "left")
    return stage_table(rows.drop("sa_id", "dnp_started_flag"), "known_facts")


def premise_facts(recdet: DataFrame, sa: DataFrame, as_of, years_back=(1, 2, 3), stored: DataFrame | None = None) -> DataFrame:
    """One row per premise with a turn-on or turn-off in any of the windows:
    ``dnp_12m`` (a stop for non-payment in the last 12 months) and ``season_k``
    (a turn-off in Mar..Jun and a turn-on in Aug..Dec of year(D)-k).

    The warehouse joins turn-ons to turn-offs on the premise, once per year and
    over all pairs, and de-duplicates; existence on both sides is the same, and
    every flag is a conditional maximum of one partially aggregated pass.
    Seasons count only facts of known agreements, non-payment counts all.
    ``stored``: rows of ``known_facts``, if there.
    """
    last, seasons, used = _windows(as_of, years_back)
    tests = {"dnp_12m": (F.col("dnp_stopped_flag") == "Y") & last}
    for k, b in seasons.items():
        tests[f"on_{k}"] = (F.col("started_flag") == "Y") & in_window("month_start_date", b["on"])
        tests[f"off_{k}"] = (F.col("stopped_flag") == "Y") & in_window("month_start_date", b["off"])
    if stored is None:
        known = agreements_lookup(sa).select("sa_id", F.lit(True).alias("known")).distinct()
        rows = recdet.filter(used & F.col("premise_id").isNotNull()).join(known, "sa_id", "left")
    else:
        rows = stored.filter(used & F.col("premise_id").isNotNull())
    hits = rows.groupBy("premise_id").agg(
        *[F.max(F.when(t & (F.lit(n == "dnp_12m") | F.col("known")), True)).alias(n) for n, t in tests.items()]
    )
    return hits.select(
        "premise_id",
        F.coalesce("dnp_12m", F.lit(False)).alias("dnp_12m"),
        *[F.coalesce(F.col(f"on_{k}") & F.col(f"off_{k}"), F.lit(False)).alias(f"season_{k}") for k in years_back],
    )


def account_facts(sa: DataFrame, credit: DataFrame, stored: DataFrame, as_of) -> DataFrame:
    """``sa_id, account_id`` and what is known of the account: its ratings and whether it has a
    stop for non-payment in the last 12 months, of ``known_facts``' rows.

    Accounts meet their facts in rows of two ids, which then go to their agreement:
    the wide row is never shuffled by account.
    """
    ratings = credit.select("account_id", "internal_credit_rating").distinct()
    last = in_window("month_start_date", lookback_bounds(as_of, 12))
    stops = stored.filter((F.col("dnp_stopped_flag") == "Y") & last & F.col("known")).select("account_id").distinct()
    found = agreements_lookup(sa).join(ratings, "account_id", "left")
    found = found.join(stops.withColumn("account_dnp_12m", F.lit(True)), "account_id", "left")
    # distinct needs no shuffle beyond this one, nor does a join by sa_id
    return found.select("sa_id", "account_id", "internal_credit_rating", "account_dnp_12m").repartition("sa_id").distinct()


def with_account_facts(row: DataFrame, facts: DataFrame) -> DataFrame:
    """``row`` with the rating (-1 if none) and the 12-month 'Y'/'N' flag of its account, of ``account_facts``' rows.

    The key is the agreement, by which both sides are partitioned; the accounts are
    compared as a range of one value, which is no key of a second shuffle.  Rows
    without an agreement find nothing.
    """
    own = facts.withColumnsRenamed({"sa_id": "_sa", "account_id": "_account"})
    same = (F.col("sa_id") == F.col("_sa")) & F.col("account_id").between(F.col("_account"), F.col("_account"))
    return row.join(own, same, "left").drop("_sa", "_account").withColumns(
        {
            "internal_credit_rating": F.coalesce("internal_credit_rating", F.lit(-1)),
            "account_level_12_mth_dnp_flag": F.when(F.col("account_dnp_12m"), "Y").otherwise("N"),
        }
    ).drop("account_dnp_12m")


def season_flags(df: DataFrame, facts: DataFrame, years_back=(1, 2, 3)) -> DataFrame:
    """``df`` with 'Y'/'N' columns of the seasons of its premise."""
    sides = [F.when(F.col(f"season_{k}"), "Y").otherwise("N").alias(f"seasonal_prior_{k}_yr_flag") for k in years_back]
    found = df.join(facts.select("premise_id", *[f"season_{k}" for k in years_back]), "premise_id", "left")
    return found.select(*df.columns, *sides)


def existence_flag(df: DataFrame, keys: DataFrame, key: str, name: str) -> DataFrame:
    """Left join on a distinct key set and turn the match into 'Y'/'N'."""
    marked = keys.select(F.col(key), F.lit(True).alias(f"_hit_{name}"))
    return df.join(marked, key, "left").withColumn(name, yn_flag(f"_hit_{name}")).drop(f"_hit_{name}")


def calendar(weather: DataFrame, area: str = "LGC") -> DataFrame:
    """Degree day and average temperature of one area, a row per day, for ``weather_at``.

    The rows are stored, and their number is held against the days they span: a
    table with one row per day is no larger than the calendar and is broadcast,
    so no date (least of all the open end date, which most agreements share)
    is a shuffle key.  A table with several rows per day is left to the planner.
    """
    days = weather.filter((F.col("trend_area_code") == area) & F.col("degree_day_date").isNotNull()).select(
        F.to_date("degree_day_date").alias("day"), "degree_day", "average_temperature"
    )
    days = stage_table(days, "weather")
    rows, first, last = days.agg(F.count(F.lit(1)), F.min("day"), F.max("day")).first()
    return F.broadcast(days) if rows <= min((last - first).days + 1 if rows else 0, CALENDAR_DAYS) else days


def weather_at(df: DataFrame, days: DataFrame, date_col: str, prefix: str) -> DataFrame:
    """Degree day and average temperature on ``date_col`` (-1 if none), of ``calendar``'s rows."""
    w = days.select(
        F.col("day").alias(f"_{prefix}_day"),
        F.col("degree_day").alias(f"_{prefix}_dd"),
        F.col("average_temperature").alias(f"_{prefix}_avg"),
    )
    out = df.join(w, F.to_date(F.col(date_col)) == F.col(f"_{prefix}_day"), "left")
    return out.select(
        *df.columns,
        F.coalesce(F.col(f"_{prefix}_dd"), F.lit(-1.0)).alias(f"{prefix}_degree_day"),
        F.coalesce(F.col(f"_{prefix}_avg"), F.lit(-1.0)).alias(f"{prefix}_avg_temp"),
    )
