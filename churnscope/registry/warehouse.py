"""Keys of the feature warehouse: scans and sinks, scalar functions, buckets,
joins, per-key aggregates and history windows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from churnscope.functions import asof as A
from churnscope.functions import scalar as S
from churnscope.functions.hashing import mask_id
from churnscope.operators import aggregates as agg
from churnscope.operators import joins as J
from churnscope.operators.ordered import ordered_lag
from churnscope.plans import features as FT
from churnscope.registry import oracle, register
from churnscope.session import checkpoint_dir
from churnscope.sources import csv_io

D = "date '1998-03-01'"
L12 = "date '1997-03-01' and date '1998-02-28'"
L18 = "date '1996-09-01' and date '1998-02-28'"
YEARS = list(range(1992, 1999))
CITY_LIST = ", ".join(f"'{c}'" for c in FT.EXPORT_CITIES)


def _shared_path(c, name: str) -> str:
    return f"{checkpoint_dir(c.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- 2.1 sources
@register("scan_table", oracle("select o_orderkey, o_custkey, o_orderstatus, o_orderdate from orders"))
def scan_table(c):
    from churnscope.sources.tables import scan_table as scan

    return scan(c.spark, c.sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate"])


@register("scan_csv_typed", oracle("select * from sa"))
def scan_csv_typed(c):
    path = _shared_path(c, "sa-csv")
    csv_io.sink_csv(c.fx.sa, path)
    return csv_io.scan_csv_typed(c.spark, path, c.fx.sa.schema)


@register(
    "sink_csv",
    oracle(
        "select cast(sa_id as varchar) as sa_id, city, strftime(sa_start_date, '%Y-%m-%d') as sa_start_date, "
        "rate_class_code from sa"
    ),
)
def sink_csv(c):
    path = _shared_path(c, "sink-csv")
    csv_io.sink_csv(c.fx.sa.select("sa_id", "city", "sa_start_date", "rate_class_code"), path)
    return c.spark.read.option("header", True).csv(path)


@register("stage_ctas", oracle("select * from sa_money"))
def stage_ctas(c):
    return csv_io.materialize(agg.billing_counts(c.src.ft, c.d), _shared_path(c, "stage-billpay"))


@register("export_extract", oracle(f"select * from features where city in ({CITY_LIST})"))
def export_extract(c):
    return csv_io.checked_export(FT.export_extract(c.features), _shared_path(c, "extract"))


@register("feature_view", oracle("select * from features"))
def feature_view(c):
    """The published view, every column of it, read by its name."""
    name = "service_agreement_features_v"
    c.features.createOrReplaceTempView(name)
    return c.spark.table(name)


@register(
    "mask_ids",
    oracle(
        "select md5('mask:' || cast(account_id as varchar)) as account_id, md5('mask:' || cast(person_id as varchar)) as person_id, "
        "md5('mask:' || cast(sa_id as varchar)) as sa_id, md5('mask:' || cast(premise_id as varchar)) as premise_id, city from sa"
    ),
)
def mask_ids(c):
    sa = c.fx.sa
    return sa.select(*[mask_id(k).alias(k) for k in ("account_id", "person_id", "sa_id", "premise_id")], "city")


# ---------------------------------------------------- 2.2 projections/predicates
@register("project_rename", oracle("select * from agreement"))
def project_rename(c):
    return c.base


@register("filter_eq_in", oracle(f"select * from sa where sa_status_flag = '20' and city in ({CITY_LIST})"))
def filter_eq_in(c):
    sa = c.fx.sa
    return sa.filter((F.col("sa_status_flag") == "20") & F.col("city").isin(list(FT.EXPORT_CITIES)))


@register(
    "filter_status_notnull",
    oracle(
        "select * from agreement where coalesce(sa_status_flag, '') not in ('70', '50', '10') "
        "and rate_class_code is not null and cis_division is not null"
    ),
)
def filter_status_notnull(c):
    from churnscope.plans.chapters import status_filter

    return c.base.filter(status_filter())


@register(
    "filter_active_asof",
    oracle("select * from agreement where sa_start_year_month < '199803' and sa_end_year_month >= '199803'"),
)
def filter_active_asof(c):
    return c.base.filter(A.active_at(c.d))


@register(
    "nvl_defaults",
    oracle(
        "select sa_id, dnp_started_flag, dnp_stopped_flag, internal_credit_rating, sa_start_degree_day, sa_end_avg_temp, "
        "late_payment_count, arrears_payoff_amount, pledge_flag_1997, usage_in_last_18_months, most_recent_payment_date, "
        "premise_days_inactive_before from features"
    ),
)
def nvl_defaults(c):
    return c.features.select(
        "sa_id", "dnp_started_flag", "dnp_stopped_flag", "internal_credit_rating", "sa_start_degree_day",
        "sa_end_avg_temp", "late_payment_count", "arrears_payoff_amount", "pledge_flag_1997",
        "usage_in_last_18_months", "most_recent_payment_date", "premise_days_inactive_before",
    )


@register(
    "case_flag_yn",
    oracle(
        "select a.sa_id, a.premise_id, case when e.premise_id is not null then 'Y' else 'N' end as premise_level_12_mth_dnp_flag "
        "from agreement a left join cut_premise e on a.premise_id = e.premise_id"
    ),
)
def case_flag_yn(c):
    out = J.existence_flag(c.base.select("sa_id", "premise_id"), J.premise_dnp_12m(c.src.recdet, c.d), "premise_id",
                           "premise_level_12_mth_dnp_flag")
    return out


@register(
    "flag_yn_to_int",
    oracle(
        "select sa_id, started_flag, dnp_started_flag, case when dnp_started_flag = 'Y' then 1 else 0 end as dnp_started_flag_number "
        "from recdet"
    ),
)
def flag_yn_to_int(c):
    r = c.fx.recdet
    return r.select("sa_id", "started_flag", "dnp_started_flag", S.yn_to_int("dnp_started_flag").alias("dnp_started_flag_number"))


@register(
    "date_isnull_flag",
    oracle(
        "select sa_id, case when pledge_date_1996 is not null then 1 else 0 end as pledge_date_1996_num, "
        "case when pledge_date_1997 is not null then 1 else 0 end as pledge_date_1997_num from pledge_year"
    ),
)
def date_isnull_flag(c):
    p = agg.pledge_by_year(c.fx.pledge, YEARS)
    return p.select("sa_id", *[S.present_flag(f"pledge_date_{y}").alias(f"pledge_date_{y}_num") for y in (1996, 1997)])


_ONEHOT_SQL = ", ".join(
    [f"case when sa_end_year = '{y}' then 1 else 0 end as stop_{y}" for y in YEARS]
    + [f"case when sa_start_year = '{y}' then 1 else 0 end as start_{y}" for y in YEARS]
)


@register("year_onehot", oracle(f"select sa_id, {_ONEHOT_SQL} from agreement"))
def year_onehot(c):
    return c.base.select("sa_id", *S.year_onehot("sa_end_year", YEARS, "stop"), *S.year_onehot("sa_start_year", YEARS, "start"))


@register("string_upper_substr", oracle("select sa_id, upper(city) as city, substr(postal, 1, 5) as postal from sa"))
def string_upper_substr(c):
    sa = c.fx.sa
    return sa.select("sa_id", F.upper("city").alias("city"), S.postal5("postal").alias("postal"))


@register(
    "date_format_ym",
    oracle(
        "select sa_id, strftime(sa_start_date, '%Y') as sa_start_year, strftime(sa_start_date, '%Y%m') as sa_start_year_month, "
        "strftime(sa_end_date, '%Y') as sa_end_year, strftime(sa_end_date, '%Y%m') as sa_end_year_month from sa"
    ),
)
def date_format_ym(c):
    sa = c.fx.sa
    return sa.select(
        "sa_id",
        S.year_text("sa_start_date").alias("sa_start_year"),
        S.ym_text("sa_start_date").alias("sa_start_year_month"),
        S.year_text("sa_end_date").alias("sa_end_year"),
        S.ym_text("sa_end_date").alias("sa_end_year_month"),
    )


@register(
    "date_trunc_day",
    oracle(
        "select o_orderkey, cast(o_orderdate as date) as order_day, cast(date_trunc('month', o_orderdate) as date) as order_month "
        "from orders"
    ),
)
def date_trunc_day(c):
    o = c.tables.orders
    return o.select("o_orderkey", F.to_date("o_orderdate").alias("order_day"), F.trunc(F.to_date("o_orderdate"), "MM").alias("order_month"))


@register(
    "lookback_window",
    oracle(
        f"select 12 as months, month_start_date, count(*) as rows from recdet where month_start_date between {L12} group by month_start_date "
        f"union all select 18, pledge_dt, count(*) from pledge where pledge_dt between {L18} group by pledge_dt"
    ),
)
def lookback_window(c):
    r = c.fx.recdet.filter(A.in_window("month_start_date", A.lookback_bounds(c.d, 12)))
    p = c.fx.pledge.filter(A.in_window("pledge_dt", A.lookback_bounds(c.d, 18)))
    a = r.groupBy(F.lit(12).alias("months"), F.col("month_start_date")).agg(F.count(F.lit(1)).alias("rows"))
    b = p.groupBy(F.lit(18).alias("months"), F.col("pledge_dt").alias("month_start_date")).agg(F.count(F.lit(1)).alias("rows"))
    return a.unionByName(b)


def _season_sql() -> str:
    parts = []
    for k in (1, 2, 3):
        b = A.season_bounds(A.to_date("1998-03-01"), k)
        for side, flag in (("on", "started_flag"), ("off", "stopped_flag")):
            lo, hi = b[side]
            parts.append(
                f"select {k} as years_back, '{side}' as side, count(*) as rows from recdet "
                f"where {flag} = 'Y' and month_start_date between date '{lo}' and date '{hi}'"
            )
    return " union all ".join(parts)


@register("season_window", oracle(_season_sql()))
def season_window(c):
    r = c.fx.recdet
    tests = []
    for k in (1, 2, 3):
        b = A.season_bounds(c.d, k)
        for side, flag in (("on", "started_flag"), ("off", "stopped_flag")):
            tests.append((k, side, (F.col(flag) == "Y") & A.in_window("month_start_date", b[side])))
    counts = r.agg(*[F.count_if(t).alias(f"{side}_{k}") for k, side, t in tests])
    rows = ", ".join(f"{k}, '{side}', {side}_{k}" for k, side, _ in tests)
    return counts.selectExpr(f"stack({len(tests)}, {rows}) as (years_back, side, rows)")


@register(
    "date_diff_days",
    oracle(
        f"select sa_id, case when sa_end_date < date '2099-12-31' then sa_end_date - sa_start_date end as days_open, "
        f"case when sa_start_date < {D} and sa_end_date >= {D} then {D} - sa_start_date end as active_days from sa"
    ),
)
def date_diff_days(c):
    sa = c.fx.sa
    d = F.lit(c.d)
    return sa.select(
        "sa_id",
        F.when(F.col("sa_end_date") < F.lit(S.OPEN_END), S.days_between("sa_end_date", "sa_start_date")).alias("days_open"),
        F.when((F.col("sa_start_date") < d) & (F.col("sa_end_date") >= d), S.days_between(d, "sa_start_date")).alias("active_days"),
    )


@register(
    "horizon_labels",
    oracle(
        "select sa_id, case when sa_end_date between date '1998-03-01' and date '1998-03-07' then 1 else 0 end as stop_7_days, "
        "case when sa_end_date between date '1998-03-01' and date '1998-03-14' then 1 else 0 end as stop_14_days, "
        "case when sa_end_date between date '1998-03-01' and date '1998-03-21' then 1 else 0 end as stop_21_days from sa"
    ),
)
def horizon_labels(c):
    return c.fx.sa.select("sa_id", *A.horizon_labels(c.d, (7, 14, 21)))


@register(
    "cap_future",
    oracle(
        "select sa_id, premise_prior_stop_date, person_prior_stop_date, premise_days_inactive_before, person_days_active_before "
        "from features"
    ),
)
def cap_future(c):
    return c.features.select(
        "sa_id", "premise_prior_stop_date", "person_prior_stop_date", "premise_days_inactive_before", "person_days_active_before"
    )


def _map_sql(col: str, codes: dict) -> str:
    whens = " ".join(f"when '{k}' then {v}" for k, v in codes.items())
    return f"case {col} {whens} else 0 end"


@register(
    "label_encode_map",
    oracle(
        f"select sa_id, {_map_sql('city', S.CITY_CODES)} as city_num, "
        f"{_map_sql('customer_class', S.CLASS_CODES)} as customer_class_num from active"
    ),
)
def label_encode_map(c):
    return c.active.select(
        "sa_id",
        S.label_encode("city", S.CITY_CODES).alias("city_num"),
        S.label_encode("customer_class", S.CLASS_CODES).alias("customer_class_num"),
    )


@register("fill_bucket_unknown", oracle("select sa_id, coalesce(usage_past_18_bucket, -1) as usage_past_18_bucket from active"))
def fill_bucket_unknown(c):
    return c.active.select("sa_id", F.coalesce(F.col("usage_past_18_bucket"), F.lit(S.NO_BUCKET)).alias("usage_past_18_bucket"))


# ------------------------------------------------------------------- 2.3 buckets
@register("bucket_fixed_arrears", oracle("select sa_id, arrears_payoff_amount, arrears_payoff_bucket_2 from labelled"))
def bucket_fixed_arrears(c):
    return c.labelled.select("sa_id", "arrears_payoff_amount", "arrears_payoff_bucket_2")


@register("bucket_fixed_usage", oracle("select sa_id, usage_in_last_18_months, usage_past_18_bucket from labelled"))
def bucket_fixed_usage(c):
    return c.labelled.select("sa_id", "usage_in_last_18_months", "usage_past_18_bucket")


@register("bucket_decile_arrears", oracle("select sa_id, arrears_payoff_amount, arrears_payoff_bucket from labelled"))
def bucket_decile_arrears(c):
    return c.labelled.select("sa_id", "arrears_payoff_amount", "arrears_payoff_bucket")


@register("bucket_decile_active_days", oracle("select sa_id, active_diff_from_as_of, current_days_active_bucket from labelled"))
def bucket_decile_active_days(c):
    return c.labelled.select("sa_id", "active_diff_from_as_of", "current_days_active_bucket")


# --------------------------------------------------------------------- 2.4 joins
@register(
    "join_base_inner",
    oracle(
        "select o.o_orderkey, o.o_orderdate, c.c_mktsegment, n.n_name, r.r_name from orders o "
        "join customer c on o.o_custkey = c.c_custkey join nation n on c.c_nationkey = n.n_nationkey "
        "join region r on n.n_regionkey = r.r_regionkey"
    ),
)
def join_base_inner(c):
    t = c.tables
    return (
        t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select("o_orderkey", "o_orderdate", "c_mktsegment", "n_name", "r_name")
    )


@register("join_left_unused_dim", oracle("select a.* from agreement a left join (select distinct premise_id from recdet) g on a.premise_id = g.premise_id"))
def join_left_unused_dim(c):
    # the dimension contributes no column: de-duplicate its key so the left join
    # cannot multiply rows (Catalyst then keeps just the projection of the base)
    geo = c.fx.recdet.select("premise_id").distinct()
    return c.base.join(geo, "premise_id", "left").select(*c.base.columns)


@register("join_inner_lookup", oracle("select * from turn_on"))
def join_inner_lookup(c):
    return J.turn_ons(c.fx.recdet, c.fx.sa)


@register("semi_join_exists", oracle("select * from agreement where premise_id in (select premise_id from cut_premise)"))
def semi_join_exists(c):
    return c.base.join(J.premise_dnp_12m(c.fx.recdet, c.d), "premise_id", "left_semi")


@register(
    "anti_join_cancelled",
    oracle(
        "select f.* from ft f where f.frozen_sw = 'Y' and f.ft_type_flag = 'PS' "
        "and not exists (select 1 from ft x where x.ft_type_flag = 'PX' and x.sibling_id = f.sibling_id)"
    ),
)
def anti_join_cancelled(c):
    return J.uncancelled_payments(c.fx.ft)


@register("join_chain_last_payment", oracle("select * from last_paid"))
def join_chain_last_payment(c):
    fx = c.fx
    return J.last_payment_date(fx.ft, fx.pay_seg, fx.pay, fx.pay_event, c.d)


@register(
    "self_join_season",
    oracle(
        "select p.premise_id, case when s1.premise_id is null then 'N' else 'Y' end as seasonal_prior_1_yr_flag, "
        "case when s2.premise_id is null then 'N' else 'Y' end as seasonal_prior_2_yr_flag, "
        "case when s3.premise_id is null then 'N' else 'Y' end as seasonal_prior_3_yr_flag "
        "from (select premise_id from away_1 union select premise_id from away_2 union select premise_id from away_3) p "
        "left join away_1 s1 on p.premise_id = s1.premise_id left join away_2 s2 on p.premise_id = s2.premise_id "
        "left join away_3 s3 on p.premise_id = s3.premise_id"
    ),
)
def self_join_season(c):
    facts = J.premise_facts(c.fx.recdet, c.fx.sa, c.d).filter("season_1 or season_2 or season_3")
    flags = [F.when(F.col(f"season_{k}"), "Y").otherwise("N").alias(f"seasonal_prior_{k}_yr_flag") for k in (1, 2, 3)]
    return facts.select("premise_id", *flags)


def _first(names: list[str], *keys: str) -> list[str]:
    """``names`` with ``keys`` in front, as joins on these keys leave them."""
    return [*keys, *[n for n in names if n not in keys]]


def _account_premise_flags(c):
    """Agreements with the ratings and flags of their account and premise, without the texts of their dates.

    These joins shuffle the columns of the agreement alone; what is known per agreement
    is joined after them, so the wide row is formed last.
    """
    src, d = c.src, c.d
    row = c.base.drop(*FT.AGREEMENT_TEXTS)
    credit = src.credit.select("account_id", "internal_credit_rating").distinct()
    row = row.join(credit, "account_id", "left").withColumn(
        "internal_credit_rating", F.coalesce(F.col("internal_credit_rating"), F.lit(-1))
    )
    row = J.existence_flag(row, J.account_dnp_12m(src.recdet, src.sa, d), "account_id", "account_level_12_mth_dnp_flag")
    return J.existence_flag(row, J.premise_dnp_12m(src.recdet, d), "premise_id", "premise_level_12_mth_dnp_flag")


def _features_a(c) -> list[str]:
    flags = ["dnp_started_flag", "dnp_stopped_flag", "internal_credit_rating", "premise_level_12_mth_dnp_flag", "account_level_12_mth_dnp_flag"]
    return _first([*c.base.columns, *flags], "account_id", "premise_id", "sa_id")


@register("left_join_features_a", oracle("select * from flags_a"))
def left_join_features_a(c):
    row = FT.with_flags_a(_account_premise_flags(c), c.src, c.d)
    return row.withColumns(FT.texts_of("sa_start_date", "sa_end_date")).select(*_features_a(c))


@register("left_join_features_b", oracle("select * from flags_b"))
def left_join_features_b(c):
    src, d = c.src, c.d
    row = _account_premise_flags(c)
    row = J.season_flags(row, J.premise_facts(src.recdet, src.sa, d))
    row = J.existence_flag(row, J.pledge_persons_18m(src.pledge, d), "person_id", "person_rcvd_18_mths_pledge")
    row = FT.with_flags_a(row, src, d)
    billing = agg.billing_counts(src.ft, d)
    row = row.join(billing, "sa_id", "left")
    row = row.join(J.last_payment_date(src.ft, src.pay_seg, src.pay, src.pay_event, d), "sa_id", "left")
    row = row.join(agg.late_payment_counts(src.adj, d), "sa_id", "left")
    counts = [c_ for c_ in billing.columns if c_.endswith("months")] + ["late_payment_count"]
    amounts = [c_ for c_ in billing.columns if c_.endswith("amount")]
    row = row.fillna(0, subset=counts).fillna(0.0, subset=amounts)
    seasons = [f"seasonal_prior_{k}_yr_flag" for k in (1, 2, 3)]
    known = [*billing.columns[1:], "most_recent_payment_date", "late_payment_count", "person_rcvd_18_mths_pledge", *seasons]
    return row.withColumns(FT.texts_of("sa_start_date", "sa_end_date")).select(*_first([*_features_a(c), *known], "person_id", "sa_id"))


@register(
    "left_join_weather_dates",
    oracle(
        "select a.sa_id, a.sa_start_date, a.sa_end_date, coalesce(b.degree_day, -1) as sa_start_degree_day, "
        "coalesce(b.average_temperature, -1) as sa_start_avg_temp, coalesce(c.degree_day, -1) as sa_end_degree_day, "
        "coalesce(c.average_temperature, -1) as sa_end_avg_temp from agreement a "
        "left join weather b on b.trend_area_code = 'LGC' and a.sa_start_date = b.degree_day_date "
        "left join weather c on c.trend_area_code = 'LGC' and a.sa_end_date = c.degree_day_date"
    ),
)
def left_join_weather_dates(c):
    row = c.base.select("sa_id", "sa_start_date", "sa_end_date")
    days = J.calendar(c.fx.weather)
    return J.weather_at(J.weather_at(row, days, "sa_start_date", "sa_start"), days, "sa_end_date", "sa_end")


_PL_SQL = ", ".join(f"b.pledge_date_{y}, coalesce(b.pledge_flag_{y}, 0) as pledge_flag_{y}" for y in YEARS)


@register(
    "left_join_pledge_usage",
    oracle(
        f"select a.sa_id, {_PL_SQL}, u.usage_in_last_18_months from agreement a left join pledge_year b on a.sa_id = b.sa_id "
        "left join sa_usage u on a.sa_id = u.sa_id"
    ),
)
def left_join_pledge_usage(c):
    row = c.base.select("sa_id")
    row = row.join(agg.pledge_by_year(c.fx.pledge, YEARS), "sa_id", "left")
    row = row.join(agg.usage_18m(c.fx.usage_fact, c.d), "sa_id", "left")
    return row.fillna(0, subset=[f"pledge_flag_{y}" for y in YEARS])


@register(
    "left_join_minmax",
    oracle(
        "select a.sa_id, per.max_sa_start_date as person_max_sa_start_date, per.min_sa_end_date as person_min_sa_end_date, "
        "prem.max_sa_end_date as premise_max_sa_end_date, prem.min_sa_start_date as premise_min_sa_start_date "
        "from agreement a left join span_person per on a.person_id = per.person_id "
        "left join span_premise prem on a.premise_id = prem.premise_id"
    ),
)
def left_join_minmax(c):
    row = c.base.select("sa_id", "person_id", "premise_id")
    row = row.join(agg.history_min_max(c.base, "person_id", c.d, "person"), "person_id", "left")
    row = row.join(agg.history_min_max(c.base, "premise_id", c.d, "premise"), "premise_id", "left")
    return row.select("sa_id", "person_max_sa_start_date", "person_min_sa_end_date", "premise_max_sa_end_date",
                      "premise_min_sa_start_date")


# ------------------------------------------------------- 2.5 warehouse aggregates
@register(
    "cond_count_18m",
    oracle("select sa_id, payments_in_last_18_months, bills_in_last_18_months, pay_segs_in_last_18_months, "
           "bill_segs_in_last_18_months from sa_money"),
)
def cond_count_18m(c):
    return agg.billing_counts(c.fx.ft, c.d).select(
        "sa_id", "payments_in_last_18_months", "bills_in_last_18_months", "pay_segs_in_last_18_months",
        "bill_segs_in_last_18_months",
    )


@register(
    "cond_sum_arrears",
    oracle("select sa_id, arrears_current_amount, arrears_payoff_amount, total_current_amount, total_payoff_amount from sa_money"),
)
def cond_sum_arrears(c):
    return agg.billing_counts(c.fx.ft, c.d).select(
        "sa_id", "arrears_current_amount", "arrears_payoff_amount", "total_current_amount", "total_payoff_amount"
    )


@register(
    "max_payment_date",
    oracle("select b.account_id, max(p.most_recent_payment_date) as most_recent_payment_date from last_paid p "
           "join sa b on p.sa_id = b.sa_id group by b.account_id"),
)
def max_payment_date(c):
    fx = c.fx
    per_sa = J.last_payment_date(fx.ft, fx.pay_seg, fx.pay, fx.pay_event, c.d)
    return per_sa.join(J.agreements_lookup(fx.sa), "sa_id").groupBy("account_id").agg(
        F.max("most_recent_payment_date").alias("most_recent_payment_date")
    )


@register("count_lpc", oracle("select * from late_fee"))
def count_lpc(c):
    return agg.late_payment_counts(c.fx.adj, c.d)


@register("sum_usage_18m", oracle("select * from sa_usage"))
def sum_usage_18m(c):
    return agg.usage_18m(c.fx.usage_fact, c.d)


@register("distinct_keys", oracle("select * from cut_account"))
def distinct_keys(c):
    return J.account_dnp_12m(c.fx.recdet, c.fx.sa, c.d)


@register("pivot_year_pledge", oracle("select * from pledge_year"))
def pivot_year_pledge(c):
    return agg.pledge_by_year(c.fx.pledge, YEARS)


_MM = "max_sa_start_date, min_sa_start_date, max_sa_end_date, min_sa_end_date"


@register(
    "minmax_person",
    oracle(f"select person_id, {', '.join(x.strip() + ' as person_' + x.strip() for x in _MM.split(','))} from span_person"),
)
def minmax_person(c):
    return agg.history_min_max(c.base, "person_id", c.d, "person")


@register(
    "minmax_premise",
    oracle(f"select premise_id, {', '.join(x.strip() + ' as premise_' + x.strip() for x in _MM.split(','))} from span_premise"),
)
def minmax_premise(c):
    return agg.history_min_max(c.base, "premise_id", c.d, "premise")


# ------------------------------------------------------------------- 2.6 windows
def _lag_sql(key: str) -> str:
    return (
        f"select sa_id, {key}, lag(sa_end_date, 1) over (partition by {key} order by sa_start_date, sa_id) as prior_stop_date, "
        f"lag(sa_start_date, 1) over (partition by {key} order by sa_start_date, sa_id) as prior_start_date "
        f"from agreement where sa_start_date < {D}"
    )


def _lag(c, key: str):
    rows = c.base.select("sa_id", key, "sa_start_date", "sa_end_date").filter(F.col("sa_start_date") < F.lit(c.d))
    out = ordered_lag(rows, key, ["sa_start_date", "sa_id"],
                      {"sa_end_date": "prior_stop_date", "sa_start_date": "prior_start_date"}, skew_safe=c.skew_safe)
    return out.select("sa_id", key, "prior_stop_date", "prior_start_date")


@register("lag_premise", oracle(_lag_sql("premise_id")))
def lag_premise(c):
    return _lag(c, "premise_id")


@register("lag_person", oracle(_lag_sql("person_id")))
def lag_person(c):
    return _lag(c, "person_id")


@register(
    "days_inactive_active_before",
    oracle("select sa_id, premise_days_inactive_before, person_days_inactive_before, premise_days_active_before, "
           "person_days_active_before from features"),
)
def days_inactive_active_before(c):
    return c.features.select("sa_id", "premise_days_inactive_before", "person_days_inactive_before",
                             "premise_days_active_before", "person_days_active_before")


# ------------------------------------------------------------------ 2.13 plans
@register("build_feature_table", oracle("select * from features"))
def build_feature_table(c):
    return c.features


@register("clean_feature_table", oracle("select * from clean"))
def clean_feature_table(c):
    return c.clean


@register("labelled_active_set", oracle("select * from active"))
def labelled_active_set(c):
    return c.active
