"""Model evaluation as aggregates over (label, prediction, probability) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnscope.operators.ordered import running_sum

# Fixed values.  Money score of the study: a correctly predicted stop saves 100, a call to an
# agreement that was not going to stop costs 10 (report); the model-search
# scorer instead charges 10 per missed stop and nothing per false alarm.
SAVINGS = {"report": {"tp": 100, "fp": -10, "fn": 0, "tn": 0}, "scorer": {"tp": 100, "fp": 0, "fn": -10, "tn": 0}}


def _cells(label: str, pred: str):
    y, p = F.col(label), F.col(pred)
    return {
        "tn": F.count_if((y == 0) & (p == 0)),
        "fp": F.count_if((y == 0) & (p == 1)),
        "fn": F.count_if((y == 1) & (p == 0)),
        "tp": F.count_if((y == 1) & (p == 1)),
    }


def confusion_matrix(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """All four cells, also when a cell (or the input) is empty."""
    return df.agg(*[v.alias(k) for k, v in _cells(label, pred).items()])


def savings_score(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    cm = confusion_matrix(df, label, pred)
    out = [F.col(c) for c in ("tn", "fp", "fn", "tp")]
    for name, m in SAVINGS.items():
        out.append(sum(F.col(c) * F.lit(w) for c, w in m.items()).cast("bigint").alias(f"savings_{name}"))
    out.append(F.try_divide(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")).alias("accuracy"))
    return cm.select(*out)


def classification_report(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """precision, recall, f1, support per class, macro and weighted averages, accuracy."""
    cells = confusion_matrix(df, label, pred)  # one row; all five rows come from it, the input is read once

    def ratio(top, bottom):
        return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))

    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp
    kinds = []
    for hit, extra, missed in ((tn, fn, fp), (tp, fp, fn)):
        prec, rec = F.try_divide(hit, hit + extra), F.try_divide(hit, hit + missed)
        kinds.append((ratio(hit, hit + extra), ratio(hit, hit + missed), ratio(2 * prec * rec, prec + rec), hit + missed))
    null = F.lit(None).cast("double")
    rows = [("0", *kinds[0]), ("1", *kinds[1])]
    rows.append(("macro avg", *[(kinds[0][i] + kinds[1][i]) / 2 for i in range(3)], n))
    rows.append(("weighted avg", *[F.try_divide(kinds[0][i] * kinds[0][3] + kinds[1][i] * kinds[1][3], n) for i in range(3)], n))
    rows.append(("accuracy", null, null, F.try_divide(tp + tn, n), n))
    names = ("class", "precision", "recall", "f1", "support")
    report = F.array(*[F.struct(*[(F.lit(v) if isinstance(v, str) else v).alias(c) for v, c in zip(r, names)]) for r in rows])
    return cells.select(F.inline(report))


def roc_curve(df: DataFrame, label: str = "label", score: str = "prob") -> DataFrame:
    """(threshold, fpr, tpr) at every distinct score, highest first.

    Per-score counts, then a two-phase running sum in descending score order.
    """
    per = df.groupBy(F.col(score).alias("threshold")).agg(
        F.sum(F.col(label)).cast("long").alias("pos"), F.sum(1 - F.col(label)).cast("long").alias("neg")
    )
    tot = df.agg(F.sum(F.col(label)).cast("long").alias("P"), F.sum(1 - F.col(label)).cast("long").alias("N")).first()
    cum = running_sum(per, ["threshold"], {"pos": "tp", "neg": "fp"}, ascending=False)
    return cum.select(
        "threshold",
        F.try_divide(F.col("fp"), F.lit(float(tot["N"] or 0))).alias("fpr"),
        F.try_divide(F.col("tp"), F.lit(float(tot["P"] or 0))).alias("tpr"),
    )


def roc_auc(df: DataFrame, label: str = "label", score: str = "prob") -> DataFrame:
    """AUC by the rank-sum formula with average ranks for tied scores."""
    per = df.groupBy(F.col(score).alias("s")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(label)).cast("long").alias("pos")
    )
    cum = running_sum(per, ["s"], {"n": "cum"})
    r1 = cum.agg(
        F.sum(F.col("pos") * (F.col("cum") - F.col("n") + (F.col("n") + 1) / 2.0)).alias("r1"),
        F.sum("pos").alias("n1"),
        F.sum(F.col("n") - F.col("pos")).alias("n0"),
    )
    return r1.select(
        F.try_divide(F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2.0, F.col("n1") * F.col("n0")).alias("auc")
    )


def subgroup_rates(df: DataFrame, key: str = "payments", below: int = 20, label: str = "label", pred: str = "pred"):
    """Per key value under ``below``: share of population (%), actual and predicted stop %."""
    g = df.filter(F.col(key) < below).groupBy(F.col(key).alias("group")).agg(
        F.count(F.lit(1)).alias("n"),
        (F.avg(F.col(label)) * 100).alias("actual_stop_pct"),
        (F.avg(F.col(pred)) * 100).alias("predicted_stop_pct"),
    )
    # the total is summed over the grouped rows, at most one per value under ``below``
    share = F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()).cast("double")
    return g.select("group", share.alias("population_pct"), "actual_stop_pct", "predicted_stop_pct")


def subgroup_error_rates(df: DataFrame, key: str = "payments", below: int = 20, label: str = "label", pred: str = "pred"):
    """Per key value: % of the group in each confusion cell (actual/predicted)."""
    y, p = F.col(label), F.col(pred)
    n = F.count(F.lit(1))
    return df.filter(F.col(key) < below).groupBy(F.col(key).alias("group")).agg(
        (F.count_if((y == 0) & (p == 1)) * 100.0 / n).alias("actual0_pred1_pct"),
        (F.count_if((y == 1) & (p == 0)) * 100.0 / n).alias("actual1_pred0_pct"),
        (F.count_if((y == 1) & (p == 1)) * 100.0 / n).alias("actual1_pred1_pct"),
        (F.count_if((y == 0) & (p == 0)) * 100.0 / n).alias("actual0_pred0_pct"),
    )


def calibration_bins(df: DataFrame, label: str = "label", pred: str = "pred", prob: str = "prob") -> DataFrame:
    """Probability rounded half-to-even to 0.1: rows, actual stop rate, predicted
    and actual stop counts, actual share among predicted."""
    b = F.bround(F.col(prob), 1)
    g = df.groupBy(b.alias("prob_bin")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(F.col(label)).alias("actual_rate"),
        F.count_if(F.col(pred) == 1).alias("predicted_stops"),
        F.count_if(F.col(label) == 1).alias("actual_stops"),
    )
    return g.withColumn("predicted_stop_share", F.try_divide(F.col("actual_stops"), F.col("predicted_stops")))


def threshold_policy(bins: DataFrame) -> DataFrame:
    """Cumulative predicted / actual stops from the highest probability bin down."""
    w = Window.orderBy(F.col("prob_bin").desc()).rowsBetween(Window.unboundedPreceding, 0)  # <= 11 bins
    return bins.select(
        "prob_bin",
        F.sum("predicted_stops").over(w).alias("cum_predicted"),
        F.sum("actual_stops").over(w).alias("cum_actual"),
    ).withColumn("cum_share", F.try_divide(F.col("cum_actual"), F.col("cum_predicted")))
