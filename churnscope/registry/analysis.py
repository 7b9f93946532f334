"""Keys of the data story and the statistics: profiles, segment tables,
histograms, cohorts, sort/limit, set operations, splits, re-sampling,
bootstrap, correlation."""

from __future__ import annotations

from pyspark.sql import functions as F

from churnscope.functions import scalar as S
from churnscope.functions.asof import active_at
from churnscope.functions.hashing import sql_hash_bits, sql_unit_hash
from churnscope.operators import profile as P
from churnscope.operators import sampling as R
from churnscope.operators import segments as G
from churnscope.operators import stats as ST
from churnscope.plans.features import FEATURE_COLUMNS_HEAD, FEATURE_COLUMNS_TAIL
from churnscope.registry import oracle, register

ACTIVE = "(sa_start_year_month < '199803' and sa_end_year_month >= '199803')"
YEARS = list(range(1992, 1999))
HORIZONS = (7, 14, 21)



# The study's 21 continuous variables and stop flags.
PEARSON_COLS = [
    "internal_credit_rating", "payments_in_last_18_months", "bills_in_last_18_months", "pay_segs_in_last_18_months",
    "bill_segs_in_last_18_months", "arrears_current_amount", "arrears_payoff_amount", "total_current_amount",
    "total_payoff_amount", "late_payment_count", "sa_start_avg_temp", "sa_end_avg_temp", "usage_in_last_18_months",
    "premise_days_inactive_before", "person_days_inactive_before", "premise_days_active_before",
    "person_days_active_before", "active_diff_from_as_of", "stop_7_days", "stop_14_days", "stop_21_days",
]

#: Every numeric column of the active set; ids are text in the study.
NUMERIC_COLS = [
    *PEARSON_COLS[:11], "sa_start_degree_day", "sa_end_degree_day", *PEARSON_COLS[11:], "stop_1998",
    *[f"start_{y}" for y in YEARS], *[f"pledge_flag_{y}" for y in YEARS], "arrears_payoff_bucket",
    "current_days_active_bucket", "arrears_payoff_bucket_2", "usage_past_18_bucket", "dnp_started_flag_number",
    "dnp_stopped_flag_number", "person_rcvd_18_mths_pledge_num", *[f"seasonal_prior_{k}_yr_flag_num" for k in (1, 2, 3)],
    "pledge_date_1996_num", "pledge_date_1997_num",
]
#: Every numeric column of the labelled rows, which keep all stop years and have no 0/1 twins of the flags.
LABELLED_COLS = [x for x in NUMERIC_COLS if not x.endswith(("_num", "_number"))] + [f"stop_{y}" for y in YEARS[:-1]]


# --------------------------------------------------------------------- profiles
@register(
    "value_counts_topk",
    oracle("select sa_status_flag as value, count(*) as count from features where sa_status_flag is not null "
           "group by sa_status_flag order by count desc, value limit 10"),
)
def value_counts_topk(c):
    return P.value_counts_topk(c.features, "sa_status_flag", ascending=False, n=10)


@register(
    "minmax_values_topk",
    oracle(f"select active_diff_from_as_of as value, count(*) as count from labelled where {ACTIVE} "
           "and active_diff_from_as_of is not null group by active_diff_from_as_of order by value limit 25"),
)
def minmax_values_topk(c):
    return P.minmax_values_topk(c.labelled.filter(active_at(c.d)), "active_diff_from_as_of", which="min", n=25)


def _describe_sql() -> str:
    parts = []
    for col in NUMERIC_COLS:
        x = f"cast({col} as double)"
        parts.append(
            f"select '{col}' as column_name, count({x}) as count, avg({x}) as mean, stddev_samp({x}) as std, min({x}) as min, "
            f"quantile_cont({x}, 0.25) as q25, quantile_cont({x}, 0.5) as q50, quantile_cont({x}, 0.75) as q75, max({x}) as max "
            "from active"
        )
    return " union all ".join(parts)


@register("describe_profile", oracle(_describe_sql()))
def describe_profile(c):
    return P.describe_profile(c.active, NUMERIC_COLS)


@register(
    "describe_categorical_by_group",
    oracle(
        "select sa_end_year, cast(sum(freq) as bigint) as count, count(*) as n_unique, "
        "arg_min(sa_start_year, -freq * 100000 + cast(sa_start_year as integer)) as top, max(freq) as freq "
        "from (select sa_end_year, sa_start_year, count(*) as freq from labelled where sa_start_year is not null "
        "group by sa_end_year, sa_start_year) pv group by sa_end_year"
    ),
)
def describe_categorical_by_group(c):
    return P.describe_categorical_by_group(c.labelled, "sa_end_year", "sa_start_year").withColumnRenamed("unique", "n_unique")


def _feature_columns() -> list[str]:
    cols = list(FEATURE_COLUMNS_HEAD) + [f"stop_{y}" for y in YEARS] + [f"start_{y}" for y in YEARS]
    for y in YEARS:
        cols += [f"pledge_date_{y}", f"pledge_flag_{y}"]
    cols += FEATURE_COLUMNS_TAIL
    for who in ("premise", "person"):
        cols += [f"{who}_prior_stop_date", f"{who}_days_inactive_before", f"{who}_days_active_before"]
    return cols + ["active_diff_from_as_of"]


def _null_sql(by: str = "", where: str = "true") -> str:
    """Spark's names of the types; every other one is DuckDB's in lower case."""
    kind = "case typeof(any_value({x})) when 'VARCHAR' then 'string' when 'INTEGER' then 'int' else lower(typeof(any_value({x}))) end"
    group, listed = (f" group by {by}", f"{by}, ") if by else ("", "")
    columns = [x for x in _feature_columns() if x != by]
    return " union all ".join(f"select {listed}'{x}' as column_name, {kind.format(x=x)} as type, count({x}) as non_null from features where {where}{group}" for x in columns)


@register("null_profile", oracle(_null_sql()))
def null_profile(c):
    return P.null_profile(c.features, _feature_columns())


@register("null_profile_by_group", oracle(_null_sql("sa_end_year", "sa_start_year = '1996'")))
def null_profile_by_group(c):
    """Of the agreements of one start year (two before the as-of year), by end year."""
    rows = c.features.filter(F.col("sa_start_year") == "1996")
    return P.null_profile(rows, [x for x in _feature_columns() if x != "sa_end_year"], by="sa_end_year")


# ------------------------------------------------------------- segment tables
@register("stops_total", oracle("select " + ", ".join(f"cast(sum(stop_{h}_days) as bigint) as stop_{h}_days" for h in HORIZONS) + " from labelled"))
def stops_total(c):
    return G.stops_total(c.labelled)


def _stops_by_sql(key: str, minimum: str) -> str:
    body = " union all ".join(
        f"select {key}, {h} as horizon, cast(sum(stop_{h}_days) as bigint) as stops from labelled where {key} >= '{minimum}' group by {key}"
        for h in HORIZONS
    )
    return f"select * from ({body}) x where stops > 0"


@register("stops_by_start_year", oracle(_stops_by_sql("sa_start_year", "1994")))
def stops_by_start_year(c):
    return G.stops_by_start(c.labelled, "sa_start_year", str(c.d.year - 4))


@register("stops_by_start_month", oracle(_stops_by_sql("sa_start_year_month", "199701")))
def stops_by_start_month(c):
    return G.stops_by_start(c.labelled, "sa_start_year_month", f"{c.d.year - 1}01")


def _rate_sql(key: str) -> str:
    return (f"select {key}, " + ", ".join(f"avg(stop_{h}_days) as rate_{h}" for h in HORIZONS)
            + f" from labelled where {ACTIVE} group by {key}")


def _count_sql(key: str) -> str:
    return (f"select {key}, count(*) as active_agreements, "
            + ", ".join(f"cast(sum(stop_{h}_days) as bigint) as stops_{h}" for h in HORIZONS)
            + f" from labelled where {ACTIVE} group by {key}")


@register("stop_rate_by_city", oracle(_rate_sql("city")))
def stop_rate_by_city(c):
    return G.stop_rate_by(c.labelled, c.d, "city")


@register("stop_rate_by_class", oracle(_rate_sql("customer_class")))
def stop_rate_by_class(c):
    return G.stop_rate_by(c.labelled, c.d, "customer_class")


@register("stop_count_by_city", oracle(_count_sql("city")))
def stop_count_by_city(c):
    return G.stop_count_by(c.labelled, c.d, "city")


@register("stop_count_by_class", oracle(_count_sql("customer_class")))
def stop_count_by_class(c):
    return G.stop_count_by(c.labelled, c.d, "customer_class")


def _dnp_sql(flags, share: bool) -> str:
    sums = ", ".join(f"cast(sum(stop_{h}_days) as bigint) as s{h}" for h in HORIZONS)
    per_flag = " union all ".join(
        f"select '{f}' as flag_name, {f} as flag_value, {sums} from labelled where {ACTIVE} group by {f}" for f in flags
    )
    longs = " union all ".join(f"select flag_name, flag_value, {h} as horizon, s{h} as stops from s" for h in HORIZONS)
    tail = ", stops / sum(stops) over (partition by flag_name, horizon) as share" if share else ""
    return f"with s as ({per_flag}), l as ({longs}) select flag_name, flag_value, horizon, stops{tail} from l where stops > 0"


@register("dnp_share", oracle(_dnp_sql(["dnp_started_flag"], True)))
def dnp_share(c):
    return G.dnp_counts(c.labelled, c.d, flags=("dnp_started_flag",))


@register("dnp_count", oracle(_dnp_sql(["dnp_started_flag", "dnp_stopped_flag"], False)))
def dnp_count(c):
    return G.dnp_counts(c.labelled, c.d).drop("share")


@register(
    "stops_owing_counts",
    oracle(
        "select count(*) as stopped, count_if(arrears_payoff_amount >= 1500) as owing_1500_plus, "
        "count_if(arrears_payoff_amount <= -100) as credit_100_plus, count_if(arrears_payoff_amount = 0) as owing_nothing, "
        "count_if(usage_in_last_18_months >= 5000) as usage_5000_plus, count_if(usage_in_last_18_months < 10) as usage_under_10, "
        "count_if(usage_in_last_18_months = 0) as usage_zero, count_if(active_diff_from_as_of >= 3650) as active_10y_plus, "
        "count_if(active_diff_from_as_of >= 1825 and active_diff_from_as_of < 3650) as active_5_to_10y "
        f"from labelled where {ACTIVE} and stop_21_days = 1"
    ),
)
def stops_owing_counts(c):
    return G.stops_owing_counts(c.labelled, c.d)


def _bucket_sql(bucket: str, with_res: bool) -> str:
    sel = (f"{bucket} as bucket, count(*) as active_agreements, cast(sum(stop_21_days) as bigint) as stops, "
           "avg(stop_21_days) as stop_rate")
    out = f"select 'all' as segment, {sel} from labelled where {ACTIVE} group by {bucket}"
    if with_res:
        out += (f" union all select 'HOUSEHOLD' as segment, {sel} from labelled where {ACTIVE} "
                f"and customer_class in ('HOUSEHOLD') group by {bucket}")
    return out


@register("stop_by_arrears_bucket", oracle(_bucket_sql("arrears_payoff_bucket_2", True)))
def stop_by_arrears_bucket(c):
    lab = c.labelled
    return G.stop_by_bucket(lab, c.d, "arrears_payoff_bucket_2").unionByName(
        G.stop_by_bucket(lab, c.d, "arrears_payoff_bucket_2", classes=S.RESIDENTIAL)
    )


@register("stop_by_usage_bucket", oracle(_bucket_sql("usage_past_18_bucket", True)))
def stop_by_usage_bucket(c):
    lab = c.labelled
    return G.stop_by_bucket(lab, c.d, "usage_past_18_bucket").unionByName(
        G.stop_by_bucket(lab, c.d, "usage_past_18_bucket", classes=S.RESIDENTIAL)
    )


@register("stop_by_active_decile", oracle(_bucket_sql("current_days_active_bucket", False)))
def stop_by_active_decile(c):
    return G.stop_by_bucket(c.labelled, c.d, "current_days_active_bucket")


@register(
    "decile_min_boundaries",
    oracle(f"select arrears_payoff_bucket as bucket, min(arrears_payoff_amount) as min_value, count(*) as rows "
           f"from labelled where {ACTIVE} group by arrears_payoff_bucket"),
)
def decile_min_boundaries(c):
    return G.bucket_min_boundaries(c.labelled, c.d, "arrears_payoff_bucket", "arrears_payoff_amount")


def _hist_sql(name: str, col: str, cond: str, bins: int) -> str:
    return (
        f"select '{name}' as histogram, b.bin, lo + b.bin * (case when hi > lo then hi - lo else 1.0 end) / {bins} as lower, "
        f"lo + (b.bin + 1) * (case when hi > lo then hi - lo else 1.0 end) / {bins} as upper, "
        "b.count from (select cast(least(floor((x - lo) / (case when hi > lo then hi - lo else 1.0 end) * "
        f"{bins}), {bins - 1}) as integer) as bin, count(*) as count from "
        f"(select cast({col} as double) as x from labelled where {ACTIVE} and stop_21_days = 1 and {cond}) u, "
        f"(select min(cast({col} as double)) as lo, max(cast({col} as double)) as hi from labelled "
        f"where {ACTIVE} and stop_21_days = 1 and {cond}) m group by 1) b, "
        f"(select min(cast({col} as double)) as lo, max(cast({col} as double)) as hi from labelled "
        f"where {ACTIVE} and stop_21_days = 1 and {cond}) m2"
    )


@register(
    "hist_equal_width",
    oracle(
        _hist_sql("usage", "usage_in_last_18_months", "usage_in_last_18_months < 5000", 20)
        + " union all "
        + _hist_sql("arrears", "arrears_payoff_amount", "arrears_payoff_amount < 1500 and arrears_payoff_amount > -100", 10)
    ),
)
def hist_equal_width(c):
    s = c.labelled.filter(active_at(c.d) & (F.col("stop_21_days") == 1))
    usage = P.equal_width_histogram(s.filter(F.col("usage_in_last_18_months") < 5000), "usage_in_last_18_months", 20, "usage")
    arrears = P.equal_width_histogram(
        s.filter((F.col("arrears_payoff_amount") < 1500) & (F.col("arrears_payoff_amount") > -100)),
        "arrears_payoff_amount", 10, "arrears",
    )
    return usage.unionByName(arrears)


# The four sets of rows of which the study draws histograms.
HIST_ROWS = {"credit": f"{ACTIVE} and internal_credit_rating between -1000 and 1000"}
HIST_ROWS |= {f"stopped_{h}_days": f"stop_{h}_days = 1" for h in HORIZONS}


def _hist_all_sql() -> str:
    listed = ", ".join(f"cast({x} as double) as {x}" for x in LABELLED_COLS)
    rows = " union all ".join(f"select '{name}' as rows, {listed} from labelled where {where}" for name, where in HIST_ROWS.items())
    return (
        f"with l as (select rows, column_name, value from ({rows}) unpivot (value for column_name in ({', '.join(LABELLED_COLS)}))), "
        "r as (select rows, column_name, min(value) as lo, max(value) as hi from l group by rows, column_name) "
        "select l.rows as rows, l.column_name as column_name, "
        "cast(least(floor((value - lo) / (case when hi > lo then hi - lo else 1.0 end) * 10), 9) as integer) as bin, "
        "count(*) as count from l join r on l.column_name = r.column_name and l.rows = r.rows group by 1, 2, 3"
    )


@register("hist_all_numeric", oracle(_hist_all_sql()))
def hist_all_numeric(c):
    return P.histograms_all_numeric(c.labelled, LABELLED_COLS, bins=10, subsets={n: F.expr(w) for n, w in HIST_ROWS.items()})


def _cohort_sql(kind: str) -> str:
    expanded = " union all ".join(
        f"select sa_start_year, sa_end_year, '{y}' as stop_year, stop_{y} as stopped from labelled "
        "where sa_start_year between '1989' and '1999'" for y in YEARS
    )
    totals = " union all ".join(f"select '{y}' as stop_year, cast(sum(stop_{y}) as bigint) as year_stops from labelled" for y in YEARS)
    cohorts = (
        f"with x as ({expanded}), t as ({totals}), "
        "g as (select stop_year, sa_start_year, avg(stopped) as stop_rate, cast(sum(stopped) as bigint) as stops, count(*) as alive "
        "from x where sa_start_year <= stop_year and sa_end_year >= stop_year group by stop_year, sa_start_year) "
    )
    if kind == "rate":
        return cohorts + "select stop_year, sa_start_year, stop_rate, stops, alive from g"
    return cohorts + ("select g.stop_year, g.sa_start_year, g.stops, t.year_stops, g.stops / nullif(t.year_stops, 0) as stop_share "
                      "from g left join t on g.stop_year = t.stop_year")


@register("cohort_stop_rate", oracle(_cohort_sql("rate")))
def cohort_stop_rate(c):
    return G.cohort_table(c.labelled, c.d).select("stop_year", "sa_start_year", "stop_rate", "stops", "alive")


@register("cohort_stop_share", oracle(_cohort_sql("share")))
def cohort_stop_share(c):
    return G.cohort_table(c.labelled, c.d).select("stop_year", "sa_start_year", "stops", "year_stops", "stop_share")


def _per_year_sql(key: str, cond: str) -> str:
    return (
        f"select 'all' as segment, {key} as year, count(*) as agreements from labelled where {cond} group by {key} union all "
        f"select 'HOUSEHOLD' as segment, {key} as year, count(*) as agreements from labelled where {cond} "
        f"and customer_class in ('HOUSEHOLD') group by {key}"
    )


@register("started_per_year", oracle(_per_year_sql("sa_start_year", "sa_start_year >= '1992'")))
def started_per_year(c):
    lab = c.labelled
    return G.per_year_counts(lab, c.d, "start").unionByName(G.per_year_counts(lab, c.d, "start", S.RESIDENTIAL))


@register("stopped_per_year", oracle(_per_year_sql("sa_end_year", "sa_end_year between '1992' and '1998'")))
def stopped_per_year(c):
    lab = c.labelled
    return G.per_year_counts(lab, c.d, "stop").unionByName(G.per_year_counts(lab, c.d, "stop", S.RESIDENTIAL))


@register(
    "avg_inactive_by_division",
    oracle(
        "select 'all' as variant, cis_division, sa_start_year, avg(person_days_inactive_before) as avg_days_inactive from labelled "
        "where sa_start_year between '1989' and '1999' group by cis_division, sa_start_year union all "
        "select 'non_negative', cis_division, sa_start_year, avg(person_days_inactive_before) from labelled "
        "where sa_start_year between '1989' and '1999' and person_days_inactive_before >= 0 group by cis_division, sa_start_year "
        "union all select 'has_prior', cis_division, sa_start_year, avg(person_days_inactive_before) from labelled "
        "where person_days_inactive_before >= 0 and person_prior_stop_date is not null and sa_end_year between '1994' and '1999' "
        "group by cis_division, sa_start_year"
    ),
)
def avg_inactive_by_division(c):
    return G.avg_inactive_by_division(c.labelled, c.d)


@register(
    "share_of_total",
    oracle("select city, count(*) as rows, count(*) / (select count(*) from active)::double as share from active group by city"),
)
def share_of_total(c):
    return G.share_of_total(c.active, "city")


# ------------------------------------------------------- sort, limit, set ops
@register("head_preview", oracle("select * from features order by sa_id, dnp_started_flag, dnp_stopped_flag limit 5"))
def head_preview(c):
    return c.features.orderBy("sa_id", "dnp_started_flag", "dnp_stopped_flag").limit(5)


@register(
    "sort_topk",
    oracle("select sa_id, city, arrears_payoff_amount from active order by arrears_payoff_amount desc, sa_id limit 10"),
)
def sort_topk(c):
    return c.active.select("sa_id", "city", "arrears_payoff_amount").orderBy(
        F.col("arrears_payoff_amount").desc(), F.col("sa_id")
    ).limit(10)


@register(
    "union_all",
    oracle("select sa_id, label, 'stops' as part from scored where label = 1 union all "
           "select sa_id, label, 'non_stops' as part from scored where label = 0"),
)
def union_all(c):
    s = c.scored.select("sa_id", "label")
    return s.filter(F.col("label") == 1).withColumn("part", F.lit("stops")).unionByName(
        s.filter(F.col("label") == 0).withColumn("part", F.lit("non_stops"))
    )


SEGMENT_SQL = (
    "case when customer_class in ('HOUSEHOLD') then 'residential' "
    "when customer_class in ('BUILDING', 'FURNITURE') then 'landlord_builder' else 'other' end"
)


def segment_col():
    return (
        F.when(F.col("customer_class").isin(list(S.RESIDENTIAL)), "residential")
        .when(F.col("customer_class").isin(list(S.LANDLORD_BUILDER)), "landlord_builder")
        .otherwise("other")
    )


@register("partition_by_class", oracle(f"select sa_id, customer_class, {SEGMENT_SQL} as segment from active"))
def partition_by_class(c):
    return c.active.select("sa_id", "customer_class", segment_col().alias("segment"))


# ----------------------------------------------------- split and re-sampling
SPLIT_SQL = f"case when {sql_unit_hash('sa_id', 'split:')} < 0.4 then 1 else 0 end"
TRAIN_SQL = f"select sa_id, label, payments from scored where {sql_unit_hash('sa_id', 'split:')} >= 0.4"


@register("split_train_test", oracle(f"select sa_id, label, {SPLIT_SQL} as is_test from scored"))
def split_train_test(c):
    return R.hash_split(c.scored.select("sa_id", "label")).select("sa_id", "label", "is_test")


def train_rows(c):
    return R.hash_split(c.scored.select("sa_id", "label", "payments")).filter(F.col("is_test") == 0).drop("is_test")


def _draw_sql(src: str, n_expr: str, salt: str, alias: str) -> str:
    """Draws with replacement from CTE ``src`` (rows with idx) of size n_expr."""
    return (
        f"select d.range as draw, p.sa_id, p.label, p.payments from range({n_expr}) d "
        f"join {src} p on {sql_hash_bits('d.range', salt)} % (select count(*) from {src}) = p.idx"
    )


def _indexed(name: str, cond: str) -> str:
    return f"{name} as (select *, row_number() over (order by sa_id) - 1 as idx from tr where {cond})"


@register(
    "resample_up",
    oracle(
        f"with tr as ({TRAIN_SQL}), {_indexed('pos', 'label = 1')} "
        + _draw_sql("pos", "(select count(*) from tr where label = 0)", "up:1:", "u")
        + " union all select null as draw, sa_id, label, payments from tr where label = 0"
    ),
)
def resample_up(c):
    return R.upsample_minority(train_rows(c), "label")


@register(
    "resample_down_10k",
    oracle(
        f"with tr as ({TRAIN_SQL}), {_indexed('neg', 'label = 0')} "
        + _draw_sql("neg", "10000", "down:0:", "n")
        + " union all select null as draw, sa_id, label, payments from tr where label = 1"
    ),
)
def resample_down_10k(c):
    return R.downsample_majority(train_rows(c), "label", 10000)


@register(
    "resample_20k_40k",
    oracle(
        f"with tr as ({TRAIN_SQL}), {_indexed('pos', 'label = 1')}, {_indexed('neg', 'label = 0')} "
        + _draw_sql("pos", "20000", "rs:1:", "p")
        + " union all "
        + _draw_sql("neg", "40000", "rs:0:", "n")
    ),
)
def resample_20k_40k(c):
    return R.resample_classes(train_rows(c), "label", {1: 20000, 0: 40000})


SEGMENT_SIZES = {
    "residential": {1: 20000, 0: 40000},
    "landlord_builder": {1: 500, 0: 1000},
    "other": {1: 1000, 0: 5000},
}


def _segment_sql() -> str:
    tr = (f"select s.sa_id, s.label, s.payments, {SEGMENT_SQL} as segment from scored s join sa b on s.sa_id = b.sa_id "
          f"where {sql_unit_hash('s.sa_id', 'split:')} >= 0.4")
    ctes, parts = [f"tr as ({tr})"], []
    for seg, sizes in SEGMENT_SIZES.items():
        for label, n in sizes.items():
            name = f"{seg}_{label}"
            ctes.append(f"{name} as (select *, row_number() over (order by sa_id) - 1 as idx from tr "
                        f"where segment = '{seg}' and label = {label})")
            parts.append(
                f"select d.range as draw, p.sa_id, p.label, p.payments, p.segment from range({n}) d join {name} p "
                f"on {sql_hash_bits('d.range', f'seg:{seg}:{label}:')} % (select count(*) from {name}) = p.idx"
            )
    return "with " + ", ".join(ctes) + " " + " union all ".join(parts)


@register("resample_by_segment", oracle(_segment_sql()))
def resample_by_segment(c):
    seg = c.fx.sa.select("sa_id", segment_col().alias("segment"))
    tr = train_rows(c).join(seg, "sa_id")
    return R.resample_by_segment(tr, "label", "segment", SEGMENT_SIZES)


def _bootstrap_sql(reps: int = 200) -> str:
    u = sql_unit_hash("(cast(b.sa_id as varchar) || ':' || cast(r.range as varchar))", "boot:")
    w = " + ".join(f"cast({u} >= {t!r}::double as integer)" for t in R.poisson_thresholds())
    cols = [f"stop_{h}_days" for h in HORIZONS]
    sums = ", ".join(f"sum(w * {x}) as {x}" for x in cols)
    means = ", ".join(f"{x} / nullif(sw, 0) as {x}" for x in cols)
    parts = " union all ".join(
        f"select '{x}' as column_name, (select avg({x}) from b) as mean, quantile_cont({x}, 0.025) as ci_low, "
        f"quantile_cont({x}, 0.975) as ci_high from m" for x in cols
    )
    return (
        f"with b as (select sa_id, {', '.join(cols)} from active), "
        f"w as (select r.range as rep, {w} as w, b.* from b, range({reps}) r), "
        f"s as (select rep, sum(w) as sw, {sums} from w group by rep), m as (select rep, {means} from s) {parts}"
    )


@register("bootstrap_mean_ci", oracle(_bootstrap_sql()))
def bootstrap_mean_ci(c):
    # 200 replicates, which the SQL twin can draw too; the study's 10,000 are
    # the key bootstrap_mean_ci_10000
    return R.bootstrap_mean_ci(c.active, [f"stop_{h}_days" for h in HORIZONS], replicates=200)


@register("bootstrap_mean_ci_10000")
def bootstrap_mean_ci_10000(c):
    return R.bootstrap_mean_ci_grouped(c.active, [f"stop_{h}_days" for h in HORIZONS], replicates=10_000)


# ------------------------------------------------------------------ statistics
def _pairs_sql(cols: list[str], src: str) -> str:
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    rows = ", ".join(f"{{'column_a': '{a}', 'column_b': '{b}', 'r': {ST.corr_sql(a, b)}}}" for a, b in pairs)
    return f"select u.column_a as column_a, u.column_b as column_b, u.r as r from (select unnest([{rows}]) as u from {src}) rows"


@register("pearson_matrix", oracle(_pairs_sql(PEARSON_COLS, "active")))
def pearson_matrix(c):
    return ST.pearson_matrix(c.active, PEARSON_COLS)


def _spearman_sql() -> str:
    """Ranks of each pair on its complete rows; a row per pair of columns, whatever it holds."""
    listed = ", ".join(f"cast({x} as double) as {x}" for x in NUMERIC_COLS)
    names = ", ".join(f"('{x}', {i})" for i, x in enumerate(NUMERIC_COLS))
    return (
        f"with numbered as (select row_number() over () as rn, {listed} from active), "
        f"long as (select rn, name, v from numbered unpivot (v for name in ({', '.join(NUMERIC_COLS)}))), "
        f"cols(name, i) as (values {names}), "
        "both_rows as (select a.name as column_a, b.name as column_b, a.v as x, b.v as y from long a join cols ca on a.name = ca.name "
        "join long b on a.rn = b.rn join cols cb on b.name = cb.name where ca.i < cb.i), "
        "ranked as (select column_a, column_b, "
        "rank() over (partition by column_a, column_b order by x) + (count(*) over (partition by column_a, column_b, x) - 1) / 2.0 as x, "
        "rank() over (partition by column_a, column_b order by y) + (count(*) over (partition by column_a, column_b, y) - 1) / 2.0 as y from both_rows) "
        "select ca.name as column_a, cb.name as column_b, r from cols ca join cols cb on ca.i < cb.i left join "
        "(select column_a, column_b, covar_samp(x, y) / nullif(stddev_samp(x) * stddev_samp(y), 0) as r from ranked group by column_a, column_b) g "
        "on g.column_a = ca.name and g.column_b = cb.name"
    )


@register("spearman_matrix", oracle(_spearman_sql()))
def spearman_matrix(c):
    return ST.spearman_matrix(c.active, NUMERIC_COLS, key=["sa_id", "dnp_started_flag", "dnp_stopped_flag"])


# The pairs of which the study tests the correlation, on the active and on all rows.
CI_PAIRS = {
    "active": [
        ("late_payment_count", "stop_21_days"), ("payments_in_last_18_months", "bills_in_last_18_months"),
        ("total_payoff_amount", "late_payment_count"), ("active_diff_from_as_of", "stop_21_days"),
        ("active_diff_from_as_of", "stop_7_days"), ("active_diff_from_as_of", "stop_14_days"),
    ],
    "labelled": [
        ("late_payment_count", "stop_21_days"), ("payments_in_last_18_months", "bills_in_last_18_months"),
        ("total_payoff_amount", "late_payment_count"),
    ],
}


def _ci_sql() -> str:
    """p by the finite series of Student's t distribution for whole degrees of freedom."""
    pairs = " union all ".join(
        f"select '{rows}' as rows, '{a}' as column_a, '{b}' as column_b, {ST.corr_sql(a, b)} as r, "
        f"count(*) filter ({a} is not null and {b} is not null) as n from {rows}"
        for rows, each in CI_PAIRS.items() for a, b in each
    )
    return (
        f"with g as ({pairs}), "
        "steps as (select g.*, k, case when k = 0 then 0 when n % 2 = 0 then ln((2 * k - 1) / (2 * k) * (1 - r * r)) "
        "else ln(2 * k / (2 * k + 1) * (1 - r * r)) end as step from g, "
        "unnest(generate_series(0, case when n % 2 = 0 then n // 2 - 2 else (n - 5) // 2 end)) as s(k)), "
        "terms as (select *, exp(sum(step) over (partition by rows, column_a, column_b order by k)) as term from steps), "
        "sums as (select rows, column_a, column_b, any_value(r) as r, any_value(n) as n, sum(term) as t from terms group by all) "
        "select rows, column_a, column_b, r, n, "
        "round(1 - case when n % 2 = 0 then abs(r) * t else 2 / pi() * (asin(abs(r)) + abs(r) * sqrt(1 - r * r) * t) end, 9) + 0.0 as p_value, "
        f"tanh(atanh(r) - {ST.Z_975!r}::double * (1.0 / nullif(sqrt(n - 3), 0))) as ci_low, "
        f"tanh(atanh(r) + {ST.Z_975!r}::double * (1.0 / nullif(sqrt(n - 3), 0))) as ci_high, r * r as r_squared from sums"
    )


@register("pearson_ci", oracle(_ci_sql()))
def pearson_ci(c):
    """p-values to nine digits, as far as the twin's series carries."""
    frames = {"active": c.active, "labelled": c.labelled}
    out = None
    for rows, pairs in CI_PAIRS.items():
        part = ST.pearson_cis(frames[rows], pairs).withColumn("rows", F.lit(rows))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("p_value", F.round("p_value", 9) + F.lit(0.0))


# The study's 28 features of its linear models, its years moved to those of the test tables.
STD_COLS = [
    "dnp_started_flag_number", "dnp_stopped_flag_number", "internal_credit_rating", "person_rcvd_18_mths_pledge_num",
    "payments_in_last_18_months", "bills_in_last_18_months", "arrears_payoff_amount", "total_payoff_amount",
    "late_payment_count", "seasonal_prior_1_yr_flag_num", "seasonal_prior_2_yr_flag_num", "seasonal_prior_3_yr_flag_num",
    "sa_start_avg_temp", "sa_end_avg_temp", *[f"start_{y}" for y in YEARS], "pledge_date_1996_num", "pledge_date_1997_num",
    "premise_days_inactive_before", "person_days_inactive_before", "premise_days_active_before",
    "person_days_active_before", "active_diff_from_as_of",
]


@register(
    "standardize",
    oracle(
        f"with a as (select sa_id, {', '.join(STD_COLS)}, {SPLIT_SQL} as is_test from active), "
        "st as (select " + ", ".join(f"avg({x}) as m_{x}, stddev_pop({x}) as s_{x}" for x in STD_COLS)
        + " from a where is_test = 0) select sa_id, is_test, "
        + ", ".join(f"({x} - m_{x}) / coalesce(nullif(s_{x}, 0), 1) as {x}" for x in STD_COLS) + " from a, st"
    ),
)
def standardize(c):
    a = R.hash_split(c.active.select("sa_id", *STD_COLS))
    return ST.standardize(a.filter(F.col("is_test") == 0), a, STD_COLS).select("sa_id", "is_test", *STD_COLS)


@register(
    "math_scalar",
    oracle(
        "select city, r, atanh(r) as z, tanh(atanh(r)) as r_back, sqrt(n) as sqrt_n, round_even(r, 1) as r_1dp from "
        f"(select city, {ST.corr_sql('payments_in_last_18_months', 'bills_in_last_18_months')} as r, count(*) as n from active "
        "group by city having count(*) >= 3) g"
    ),
)
def math_scalar(c):
    g = c.active.groupBy("city").agg(
        ST.corr("payments_in_last_18_months", "bills_in_last_18_months").alias("r"), F.count(F.lit(1)).alias("n")
    ).filter(F.col("n") >= 3)
    return g.select(
        "city", "r", F.atanh("r").alias("z"), F.tanh(F.atanh("r")).alias("r_back"), F.sqrt("n").alias("sqrt_n"),
        S.round_half_even("r", 1).alias("r_1dp"),
    )


LEAKAGE = ["sa_end_date", "sa_end_year", "sa_end_year_month", "stop_1998", "stop_7_days", "stop_14_days",
           "most_recent_payment_date", "person_max_sa_end_date", "premise_max_sa_end_date"]


@register("drop_columns", oracle(f"select * exclude ({', '.join(LEAKAGE)}) from active"))
def drop_columns(c):
    return c.active.drop(*LEAKAGE)


@register(
    "align_on_index",
    oracle("select s.sa_id, b.city, b.customer_class, s.label, s.pred from scored s join sa b on s.sa_id = b.sa_id"),
)
def align_on_index(c):
    return c.scored.select("sa_id", "label", "pred").join(
        c.fx.sa.select("sa_id", "city", "customer_class"), "sa_id"
    )
