"""The feature warehouse as one lazy plan: one wide row per service agreement.

Stage order follows the warehouse script, but the joins are grouped by key, every
right side is reduced first, and the facts of a premise, person or account are
joined to rows of keys and dates only.  The wide row is formed last, in joins by
agreement, and is never shuffled itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnscope.functions.asof import study_years, to_date
from churnscope.functions.scalar import OPEN_END, postal5, year_onehot, year_text, ym_text
from churnscope.operators import aggregates as agg
from churnscope.operators import joins as J
from churnscope.operators.ordered import ordered_lag
from churnscope.sources.csv_io import stage_table

# The published extract keeps only these cities (analog: 21 of the 25 nations).
EXPORT_CITIES = tuple(f"NATION_{i}" for i in range(21))


@dataclass
class Sources:
    sa: DataFrame
    recdet: DataFrame
    weather: DataFrame
    ft: DataFrame
    pay_seg: DataFrame
    pay: DataFrame
    pay_event: DataFrame
    credit: DataFrame
    pledge: DataFrame
    adj: DataFrame
    usage_fact: DataFrame

    @classmethod
    def from_fixtures(cls, fx) -> "Sources":
        return cls(**{k: getattr(fx, k) for k in cls.__dataclass_fields__})


def base_agreements(sa: DataFrame) -> DataFrame:
    """Stage 1: projection with derived year / year-month text, upper city, 5-char postal."""
    end = F.coalesce(F.col("sa_end_date"), F.lit(OPEN_END))
    return sa.select(
        "cis_division",
        "account_id",
        "customer_class",
        "person_id",
        "sa_id",
        "sa_start_date",
        year_text("sa_start_date").alias("sa_start_year"),
        ym_text("sa_start_date").alias("sa_start_year_month"),
        end.alias("sa_end_date"),
        year_text(end).alias("sa_end_year"),
        ym_text(end).alias("sa_end_year_month"),
        "sa_status_flag",
        "rate_class_code",
        "premise_id",
        F.upper("city").alias("city"),
        postal5("postal").alias("postal"),
    )


AGREEMENT_TEXTS = ("sa_start_year", "sa_start_year_month", "sa_end_year", "sa_end_year_month")


def texts_of(start: str, end: str) -> dict:
    """``AGREEMENT_TEXTS`` of two date columns: worked out after the joins, which carry the dates alone."""
    return dict(zip(AGREEMENT_TEXTS, (year_text(start), ym_text(start), year_text(end), ym_text(end))))


def agreement_rest(sa: DataFrame, known: list[str]) -> DataFrame:
    """Columns of ``base_agreements`` that are not yet ``known``, with the dates of the ``AGREEMENT_TEXTS`` instead of these."""
    base = base_agreements(sa).withColumns({"_start": F.col("sa_start_date"), "_end": F.col("sa_end_date")})
    return base.drop(*AGREEMENT_TEXTS, *[c for c in known if c != "sa_id"])


def with_flags_a(base: DataFrame, src: Sources, as_of) -> DataFrame:
    """Turn-on / turn-off DNP flags (NULL -> 'N'); one row per distinct flag pair.

    An agreement with turn-on rows of different flags keeps one row per
    flag pair, as the warehouse's ``select distinct`` does.  The flag sets are
    reduced to distinct (agreement, flag) before the join; joining them to the
    agreements already restricts them to known agreements, so the account
    lookup of the turn-on stage is not needed here.
    """
    ons = (
        src.recdet.filter(F.col("started_flag") == "Y")
        .select("sa_id", F.coalesce(F.col("dnp_started_flag"), F.lit("N")).alias("dnp_started_flag"))
        .distinct()
    )
    offs = (
        src.recdet.filter(F.col("stopped_flag") == "Y")
        .select("sa_id", F.coalesce(F.col("dnp_stopped_flag"), F.lit("N")).alias("dnp_stopped_flag"))
        .distinct()
    )
    return (
        base.join(ons, "sa_id", "left")
        .join(offs, "sa_id", "left")
        .withColumn("dnp_started_flag", F.coalesce(F.col("dnp_started_flag"), F.lit("N")))
        .withColumn("dnp_stopped_flag", F.coalesce(F.col("dnp_stopped_flag"), F.lit("N")))
    )


def with_history(row: DataFrame, as_of, skew_safe: bool = True) -> DataFrame:
    """Agreements started before D, with the previous agreement of the same
    premise and person (LAG of end and start date).

    Runs on the keys, dates and flags alone, which are stored: each history reads
    them a second time for the last rows of its segments.
    """
    d = to_date(as_of)
    row = row.select("sa_id", "premise_id", "person_id", "sa_start_date", "sa_end_date", "dnp_started_flag", "dnp_stopped_flag")
    row = stored = stage_table(row.filter(F.to_date("sa_start_date") < F.lit(d)), "agreement_flags")
    # sa_id (and the two fan-out flags of an agreement with several turn-on /
    # turn-off rows) break the ties the warehouse left undefined
    order = ["sa_start_date", "sa_id", "dnp_started_flag", "dnp_stopped_flag"]
    row = ordered_lag(
        row,
        "premise_id",
        order,
        {"sa_end_date": "premise_prior_stop_date", "sa_start_date": "premise_prior_start_date"},
        skew_safe=skew_safe,
        stored=stored,
    )
    return ordered_lag(
        row,
        "person_id",
        order,
        {"sa_end_date": "person_prior_stop_date", "sa_start_date": "person_prior_start_date"},
        skew_safe=skew_safe,
        stored=stored,
    )


def build_feature_table(src: Sources, as_of, skew_safe: bool = True, years=None) -> DataFrame:
    d = to_date(as_of)
    years = years or study_years(d)
    base = base_agreements(src.sa)
    row = with_history(with_flags_a(base, src, d), d, skew_safe)

    # -- keyed by premise and person: their facts meet the keys and dates, not the wide row --
    stored = J.known_facts(src.recdet, src.sa, d)
    facts = J.premise_facts(src.recdet, src.sa, d, stored=stored).join(
        agg.history_min_max(base.filter("premise_id is not null"), "premise_id", d, "premise"), "premise_id", "full"
    )
    pledged = J.pledge_persons_18m(src.pledge, d).filter("person_id is not null").withColumn("pledged", F.lit(True))
    persons = pledged.join(agg.history_min_max(base.filter("person_id is not null"), "person_id", d, "person"), "person_id", "full")
    row = row.join(persons, "person_id", "left").join(facts, "premise_id", "left")

    # -- keyed by agreement: every shuffle is by sa_id, and the last one of the wide row --
    begun = src.sa.filter(F.to_date("sa_start_date") < F.lit(d))  # the rows have no other
    row = row.join(agreement_rest(begun, row.columns), "sa_id")
    billing = agg.billing_counts(src.ft, d)
    row = row.join(billing, "sa_id", "left")
    row = row.join(J.last_payment_date(src.ft, src.pay_seg, src.pay, src.pay_event, d), "sa_id", "left")
    row = row.join(agg.late_payment_counts(src.adj, d), "sa_id", "left")
    row = row.join(agg.pledge_by_year(src.pledge, years), "sa_id", "left")
    row = row.join(agg.usage_18m(src.usage_fact, d), "sa_id", "left")
    row = J.with_account_facts(row, J.account_facts(begun, src.credit, stored, d))
    counts = [c for c in billing.columns if c.endswith("months")] + ["late_payment_count"]
    amounts = [c for c in billing.columns if c.endswith("amount")]
    row = row.fillna(0, subset=counts).fillna(0.0, subset=amounts)
    row = row.fillna(0, subset=[f"pledge_flag_{y}" for y in years])

    # -- columns worked out from the joined ones ---------------------------------------
    flags = {"premise_level_12_mth_dnp_flag": "dnp_12m", "person_rcvd_18_mths_pledge": "pledged"}
    flags |= {f"seasonal_prior_{k}_yr_flag": f"season_{k}" for k in (1, 2, 3)}
    row = row.withColumns({name: F.when(F.col(fact), "Y").otherwise("N") for name, fact in flags.items()})
    row = row.withColumns(texts_of("_start", "_end"))

    # -- weather at start and end (one row per day), year one-hots -------------------
    days = J.calendar(src.weather)
    row = J.weather_at(row, days, "sa_start_date", "sa_start")
    row = J.weather_at(row, days, "sa_end_date", "sa_end")
    row = row.select(
        "*", *year_onehot("sa_end_year", years, "stop"), *year_onehot("sa_start_year", years, "start")
    )
    return feature_view(row, d, years)


def _days(a: str, b: str):
    return F.coalesce(F.datediff(F.col(a), F.col(b)).cast("bigint"), F.lit(0).cast("bigint"))


def feature_view(row: DataFrame, as_of, years) -> DataFrame:
    """The published column list; prior stops later than D are blanked (NULL / 0)."""
    d = F.lit(to_date(as_of))
    out = []
    for who in ("premise", "person"):
        future = F.col(f"{who}_prior_stop_date") > d
        out += [
            F.when(~future | F.col(f"{who}_prior_stop_date").isNull(), F.col(f"{who}_prior_stop_date")).alias(
                f"{who}_prior_stop_date"
            ),
            F.when(future, F.lit(0).cast("bigint"))
            .otherwise(_days("sa_start_date", f"{who}_prior_stop_date"))
            .alias(f"{who}_days_inactive_before"),
            F.when(future, F.lit(0).cast("bigint"))
            .otherwise(_days(f"{who}_prior_stop_date", f"{who}_prior_start_date"))
            .alias(f"{who}_days_active_before"),
        ]
    active = (F.col("sa_start_date") < d) & (F.col("sa_end_date") >= d)
    out.append(F.when(active, F.datediff(d, F.col("sa_start_date")).cast("bigint")).alias("active_diff_from_as_of"))
    keep = [c for c in FEATURE_COLUMNS_HEAD]
    keep += [f"stop_{y}" for y in years] + [f"start_{y}" for y in years]
    for y in years:
        keep += [f"pledge_date_{y}", f"pledge_flag_{y}"]
    keep += FEATURE_COLUMNS_TAIL
    return row.select(*keep, *out)


# The column names of the published feature table.
FEATURE_COLUMNS_HEAD = [
    "cis_division",
    "account_id",
    "customer_class",
    "person_id",
    "sa_id",
    "sa_start_date",
    "sa_start_year",
    "sa_start_year_month",
    "sa_end_date",
    "sa_end_year",
    "sa_end_year_month",
    "sa_status_flag",
    "rate_class_code",
    "premise_id",
    "city",
    "postal",
    "dnp_started_flag",
    "dnp_stopped_flag",
    "internal_credit_rating",
    "premise_level_12_mth_dnp_flag",
    "account_level_12_mth_dnp_flag",
    "person_rcvd_18_mths_pledge",
    "payments_in_last_18_months",
    "bills_in_last_18_months",
    "pay_segs_in_last_18_months",
    "bill_segs_in_last_18_months",
    "arrears_current_amount",
    "arrears_payoff_amount",
    "total_current_amount",
    "total_payoff_amount",
    "most_recent_payment_date",
    "late_payment_count",
    "seasonal_prior_1_yr_flag",
    "seasonal_prior_2_yr_flag",
    "seasonal_prior_3_yr_flag",
    "sa_start_degree_day",
    "sa_start_avg_temp",
    "sa_end_degree_day",
    "sa_end_avg_temp",
]

FEATURE_COLUMNS_TAIL = [
    "usage_in_last_18_months",
    "person_max_sa_start_date",
    "person_min_sa_start_date",
    "person_max_sa_end_date",
    "person_min_sa_end_date",
    "premise_max_sa_start_date",
    "premise_min_sa_start_date",
    "premise_max_sa_end_date",
    "premise_min_sa_end_date",
]


def export_extract(features: DataFrame, cities=EXPORT_CITIES) -> DataFrame:
    """Rows of the published extract: only the listed cities (after the LAGs)."""
    return features.filter(F.col("city").isin(list(cities)))
