"""DuckDB twins of the analog views (``Fixtures``), used only by the oracle SQL.

The oracle engine has the base test tables registered; each oracle query
inlines the views it needs as common table expressions.
"""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {
    "sa": """
select o.o_orderkey as sa_id, o.o_custkey as account_id, cast(floor(o.o_custkey / 2.0) as bigint) as person_id,
       o.o_orderkey % 500 as premise_id, r.r_name as cis_division, c.c_mktsegment as customer_class, n.n_name as city,
       concat(cast(10000 + o.o_custkey as varchar(10)), '-', cast(1000 + o.o_orderkey % 500 as varchar(10))) as postal,
       case when o.o_orderkey % 97 = 0 then null else o.o_orderpriority end as rate_class_code,
       case when o.o_orderstatus = 'F' then '60' when o.o_orderstatus = 'O' then '20'
            when o.o_orderkey % 5 = 0 then '70' when o.o_orderkey % 5 = 1 then '10' else '40' end as sa_status_flag,
       cast(o.o_orderdate as date) as sa_start_date,
       coalesce(e.end_date, date '2099-12-31') as sa_end_date
from orders o
join customer c on o.o_custkey = c.c_custkey
join nation n on c.c_nationkey = n.n_nationkey
join region r on n.n_regionkey = r.r_regionkey
left join (select l_orderkey, max(case when l_shipdate > o_orderdate then cast(l_shipdate as date) end) as end_date
           from lineitem join orders on l_orderkey = o_orderkey group by l_orderkey) e on o.o_orderkey = e.l_orderkey""",
    "recdet": """
select make_date(year(sa_start_date), month(sa_start_date), 1) as month_start_date, sa_id, premise_id, 'Y' as started_flag, 'N' as stopped_flag,
       case when sa_id % 7 = 0 then null when sa_id % 11 = 0 then 'Y' else 'N' end as dnp_started_flag, 'N' as dnp_stopped_flag
from sa
union all
select make_date(year(sa_end_date), month(sa_end_date), 1), sa_id, premise_id, 'N', 'Y', null,
       case when sa_id % 3 = 0 then 'Y' else 'N' end
from sa where sa_end_date < date '2099-12-31'
union all
select make_date(year(sa_start_date), month(sa_start_date), 1), sa_id, premise_id + 1, 'Y', 'N', 'N', 'N' from sa where sa_id % 50 = 0""",
    "weather": """
select case when l_linestatus = 'O' then 'LGC' else 'MGE' end as trend_area_code, cast(l_shipdate as date) as degree_day_date,
       avg(l_quantity) as average_temperature, case when avg(l_quantity) < 65 then 65 - avg(l_quantity) else 0 end as degree_day,
       min(l_quantity) as minimum_temperature, max(l_quantity) as maximum_temperature
from lineitem group by l_linestatus, cast(l_shipdate as date)""",
    "ft": """
select l_orderkey as sa_id, case when l_returnflag = 'A' then 'PS' when l_returnflag = 'N' then 'BS' else 'PX' end as ft_type_flag,
       cast(l_shipdate as date) as post_date, l_partkey as parent_id, l_orderkey * 10 + l_linenumber as sibling_id,
       case when l_partkey % 13 = 0 then null else cast(l_shipdate + interval '30' day as date) end as arrears_date,
       l_extendedprice * (1 - l_discount) as current_amount, l_extendedprice as payoff_amount,
       case when l_linestatus = 'F' then 'Y' else 'N' end as frozen_sw
from lineitem""",
    "pay_seg": "select distinct sibling_id as integration_id, sibling_id + 1 as payment_id from ft where ft_type_flag = 'PS'",
    "pay": "select payment_id as integration_id, payment_id * 2 as pay_event_id from pay_seg",
    "pay_event": """
select (sibling_id + 1) * 2 as integration_id, max(post_date) as payment_date from ft where ft_type_flag = 'PS' group by sibling_id""",
    "credit": """
select c_custkey as account_id, cast(floor(c_acctbal) as int) as internal_credit_rating from customer where c_custkey % 10 <> 0""",
    "pledge": """
select cast(floor(o_custkey / 2.0) as bigint) as person_id, cast(o_orderdate as date) as pledge_dt, o_orderkey - o_orderkey % 3 as c1sa
from orders where o_orderpriority = '1-URGENT'""",
    "adj": """
select l_orderkey as sa_id, 'LPC' as adjustment_type_code, case when l_linestatus = 'F' then '50' else '20' end as adjustment_status_flag,
       cast(l_shipdate as date) as creation_date from lineitem where l_returnflag = 'R'""",
    "usage_fact": """
select l_orderkey as sa_id, l_quantity as billed_usage, last_day(cast(l_shipdate as date)) as last_day_of_period from lineitem""",
    "scored": """
select s.sa_id, s.label, s.prob, case when s.prob >= 0.5 then 1 else 0 end as pred, coalesce(p.payments, 0) as payments
from (select sa_id, label,
             round((((('0x' || substr(md5('s:' || cast(sa_id as varchar)), 1, 8))::bigint) / 4294967296.0) + 0.5 * label) / 1.5, 4) as prob
      from (select sa_id, case when sa_end_date between date '1998-03-01' and date '1998-08-27' then 1 else 0 end as label
            from sa where sa_start_date < date '1998-03-01' and sa_end_date >= date '1998-03-01') x) s
left join (select sa_id, count(*) as payments from ft group by sa_id) p on s.sa_id = p.sa_id""",
}

_DEPS_RE = re.compile(r"\b(" + "|".join(VIEWS) + r")\b")


def with_views(body: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``body`` with the analog views (and ``extra`` CTEs) it references."""
    extra = extra or {}
    order: list[str] = []

    def visit(name: str, text: str):
        if name in order:
            return
        for dep in dict.fromkeys(_DEPS_RE.findall(text)):
            if dep != name and dep not in order and dep in VIEWS:
                visit(dep, VIEWS[dep])
        for dep in extra:
            if dep != name and dep not in order and re.search(rf"\b{dep}\b", text):
                visit(dep, extra[dep])
        order.append(name)

    texts = {**VIEWS, **extra}
    for name in dict.fromkeys(_DEPS_RE.findall(body)):
        visit(name, texts[name])
    for name in extra:
        if re.search(rf"\b{name}\b", body):
            visit(name, extra[name])
    if not order:
        return body.strip()
    ctes = ",\n".join(f"{n} as ({texts[n].strip()})" for n in order)
    body = body.strip()
    if body[:5].lower() == "with ":
        return f"with {ctes},\n{body[5:]}"
    return f"with {ctes}\n{body}"
