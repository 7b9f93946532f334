"""Keys of the model evaluation, on the deterministic score column ``scored``."""

from __future__ import annotations

from churnscope.operators import evaluate as E
from churnscope.registry import oracle, register

CM = ("count_if(label = 0 and pred = 0) as tn, count_if(label = 0 and pred = 1) as fp, "
      "count_if(label = 1 and pred = 0) as fn, count_if(label = 1 and pred = 1) as tp")


@register("confusion_matrix", oracle(f"select {CM} from scored"))
def confusion_matrix(c):
    return E.confusion_matrix(c.scored)


@register(
    "savings_score",
    oracle(
        f"select tn, fp, fn, tp, cast(100 * tp - 10 * fp as bigint) as savings_report, cast(100 * tp - 10 * fn as bigint) as savings_scorer, "
        f"(tp + tn) / nullif(tp + tn + fp + fn, 0) as accuracy from (select {CM} from scored) cm"
    ),
)
def savings_score(c):
    return E.savings_score(c.scored)


def _report_sql() -> str:
    def cls(name, tp, fp, fn):
        p = f"{tp}::double / nullif({tp} + {fp}, 0)"
        r = f"{tp}::double / nullif({tp} + {fn}, 0)"
        return (f"select '{name}' as class, coalesce({p}, 0.0) as precision, coalesce({r}, 0.0) as recall, "
                f"coalesce(2 * ({p}) * ({r}) / nullif(({p}) + ({r}), 0), 0.0) as f1, {tp} + {fn} as support from cm")

    return (
        f"with cm as (select {CM} from scored), pc as ({cls('0', 'tn', 'fn', 'fp')} union all {cls('1', 'tp', 'fp', 'fn')}) "
        "select * from pc union all "
        "select 'macro avg', avg(precision), avg(recall), avg(f1), cast(sum(support) as bigint) from pc union all "
        "select 'weighted avg', sum(precision * support) / nullif(sum(support), 0), sum(recall * support) / nullif(sum(support), 0), "
        "sum(f1 * support) / nullif(sum(support), 0), cast(sum(support) as bigint) from pc union all "
        "select 'accuracy', null, null, (tp + tn) / nullif(tp + tn + fp + fn, 0), tp + tn + fp + fn from cm"
    )


@register("classification_report", oracle(_report_sql()))
def classification_report(c):
    return E.classification_report(c.scored)


@register(
    "roc_curve",
    oracle(
        "with per as (select prob as threshold, sum(label) as pos, sum(1 - label) as neg from scored group by prob), "
        "tot as (select sum(label) as p, sum(1 - label) as n from scored) "
        "select threshold, sum(neg) over (order by threshold desc rows between unbounded preceding and current row) / nullif(tot.n, 0) as fpr, "
        "sum(pos) over (order by threshold desc rows between unbounded preceding and current row) / nullif(tot.p, 0) as tpr from per, tot"
    ),
)
def roc_curve(c):
    return E.roc_curve(c.scored)


@register(
    "roc_auc",
    oracle(
        "with per as (select prob as s, count(*) as n, sum(label) as pos from scored group by prob), "
        "cc as (select *, sum(n) over (order by s rows between unbounded preceding and current row) as cum from per) "
        "select (sum(pos * (cum - n + (n + 1) / 2.0)) - sum(pos) * (sum(pos) + 1) / 2.0) / nullif(sum(pos) * sum(n - pos), 0) as auc from cc"
    ),
)
def roc_auc(c):
    return E.roc_auc(c.scored)


@register(
    "subgroup_rates",
    oracle(
        "select payments as subgroup, count(*) * 100.0::double / (select count(*) from scored where payments < 20) as population_pct, "
        "avg(label) * 100 as actual_stop_pct, avg(pred) * 100 as predicted_stop_pct from scored where payments < 20 group by payments"
    ),
)
def subgroup_rates(c):
    return E.subgroup_rates(c.scored).withColumnRenamed("group", "subgroup")


@register(
    "subgroup_error_rates",
    oracle(
        "select payments as subgroup, count_if(label = 0 and pred = 1) * 100.0::double / count(*) as actual0_pred1_pct, "
        "count_if(label = 1 and pred = 0) * 100.0::double / count(*) as actual1_pred0_pct, "
        "count_if(label = 1 and pred = 1) * 100.0::double / count(*) as actual1_pred1_pct, "
        "count_if(label = 0 and pred = 0) * 100.0::double / count(*) as actual0_pred0_pct from scored where payments < 20 group by payments"
    ),
)
def subgroup_error_rates(c):
    return E.subgroup_error_rates(c.scored).withColumnRenamed("group", "subgroup")


BINS_SQL = (
    "select round_even(prob, 1) as prob_bin, count(*) as rows, avg(label) as actual_rate, count_if(pred = 1) as predicted_stops, "
    "count_if(label = 1) as actual_stops from scored group by round_even(prob, 1)"
)


@register(
    "calibration_bins",
    oracle(f"select *, case when predicted_stops > 0 then actual_stops / predicted_stops end as predicted_stop_share from ({BINS_SQL}) b"),
)
def calibration_bins(c):
    return E.calibration_bins(c.scored)


@register(
    "threshold_policy",
    oracle(
        "select prob_bin, cast(sum(predicted_stops) over w as bigint) as cum_predicted, cast(sum(actual_stops) over w as bigint) as cum_actual, "
        "case when sum(predicted_stops) over w > 0 then sum(actual_stops) over w / sum(predicted_stops) over w end as cum_share "
        f"from ({BINS_SQL}) b window w as (order by prob_bin desc rows between unbounded preceding and current row)"
    ),
)
def threshold_policy(c):
    return E.threshold_policy(E.calibration_bins(c.scored))
