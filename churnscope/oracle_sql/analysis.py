"""DuckDB twins of the cleaned / labelled / active tables."""

from __future__ import annotations

import datetime as dt

from churnscope.functions.asof import month_start, to_date
from churnscope.functions.buckets import ARREARS_EDGES, DECILE_PROBS, USAGE_EDGES
from churnscope.oracle_sql.features import AS_OF, feature_ctes


def lit(d) -> str:
    return f"date '{d.isoformat()}'"


def active_sql(as_of: str = AS_OF, prefix: str = "") -> str:
    m = lit(month_start(as_of))
    return f"({prefix}sa_start_date < {m} and {prefix}sa_end_date >= {m})"


def cascade_sql(expr: str, edges: list[str]) -> str:
    whens = " ".join(f"when {expr} >= {e} then {i}" for i, e in reversed(list(enumerate(edges))))
    return f"case {whens} end"


def horizon_sql(as_of: str, h: int, end: str = "sa_end_date") -> str:
    d = to_date(as_of)
    return f"case when {end} between {lit(d)} and {lit(d + dt.timedelta(days=h - 1))} then 1 else 0 end"


def analysis_ctes(as_of: str = AS_OF) -> dict[str, str]:
    d = to_date(as_of)
    ctes = feature_ctes(as_of)
    probs = ", ".join(str(p) for p in DECILE_PROBS)
    ctes["clean"] = """
select * from features
where coalesce(sa_status_flag, '') not in ('70', '50', '10') and rate_class_code is not null and cis_division is not null"""
    ctes["lab_qa"] = f"select quantile_cont(arrears_payoff_amount, [{probs}]) as qa from clean"
    ctes["lab_qd"] = f"select quantile_cont(active_diff_from_as_of, [{probs}]) as qd from clean where {active_sql(as_of)}"
    qa = ["-100"] + [f"qa[{i}]" for i in range(1, 10)]
    qd = ["-100"] + [f"qd[{i}]" for i in range(1, 10)]
    ctes["labelled"] = f"""
select c.*, {horizon_sql(as_of, 7)} as stop_7_days, {horizon_sql(as_of, 14)} as stop_14_days,
       {horizon_sql(as_of, 21)} as stop_21_days,
       {cascade_sql('arrears_payoff_amount', qa)} as arrears_payoff_bucket,
       {cascade_sql('arrears_payoff_amount', [str(e) for e in ARREARS_EDGES])} as arrears_payoff_bucket_2,
       {cascade_sql('usage_in_last_18_months', [str(e) for e in USAGE_EDGES])} as usage_past_18_bucket,
       case when {active_sql(as_of, 'c.')} then {cascade_sql('active_diff_from_as_of', qd)} end as current_days_active_bucket
from clean c, lab_qa, lab_qd"""
    y1, y2 = d.year - 2, d.year - 1
    drops = ", ".join([f"pledge_date_{d.year - 6}", f"pledge_date_{d.year - 5}"] + [f"stop_{y}" for y in range(d.year - 6, d.year)])
    ctes["active"] = f"""
select * exclude ({drops}),
  case when dnp_started_flag = 'Y' then 1 else 0 end as dnp_started_flag_number,
  case when dnp_stopped_flag = 'Y' then 1 else 0 end as dnp_stopped_flag_number,
  case when person_rcvd_18_mths_pledge = 'Y' then 1 else 0 end as person_rcvd_18_mths_pledge_num,
  case when seasonal_prior_1_yr_flag = 'Y' then 1 else 0 end as seasonal_prior_1_yr_flag_num,
  case when seasonal_prior_2_yr_flag = 'Y' then 1 else 0 end as seasonal_prior_2_yr_flag_num,
  case when seasonal_prior_3_yr_flag = 'Y' then 1 else 0 end as seasonal_prior_3_yr_flag_num,
  case when pledge_date_{y1} is not null then 1 else 0 end as pledge_date_{y1}_num,
  case when pledge_date_{y2} is not null then 1 else 0 end as pledge_date_{y2}_num
from labelled where {active_sql(as_of)}"""
    return ctes
