"""Hand-built edge cases and properties of the custom operators."""

import datetime as dt

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from churnscope.functions.asof import horizon_labels, lookback_bounds, season_bounds
from churnscope.functions.buckets import cascade_bucket
from churnscope.operators import evaluate as E
from churnscope.operators import sampling as R
from churnscope.operators.ordered import dense_index, ordered_lag, running_sum


def test_lookback_bounds_any_day():
    assert lookback_bounds("2019-03-01", 12) == (dt.date(2018, 3, 1), dt.date(2019, 2, 28))
    assert lookback_bounds("2019-03-01", 18) == (dt.date(2017, 9, 1), dt.date(2019, 2, 28))
    # mid-month and February: the window starts on the first of the month
    assert lookback_bounds("2019-02-15", 12) == (dt.date(2018, 2, 1), dt.date(2019, 2, 14))
    assert lookback_bounds("2020-01-31", 18) == (dt.date(2018, 7, 1), dt.date(2020, 1, 30))
    assert season_bounds("2019-03-01", 1)["off"] == (dt.date(2018, 3, 1), dt.date(2018, 6, 30))


def test_horizon_labels_monotone(spark):
    days = [dt.date(2019, 2, 28) + dt.timedelta(days=i) for i in range(30)] + [dt.date(2099, 12, 31)]
    df = spark.createDataFrame([(d,) for d in days], "sa_end_date date").select(*horizon_labels("2019-03-01"))
    rows = df.collect()
    assert all(r.stop_7_days <= r.stop_14_days <= r.stop_21_days for r in rows)
    assert sum(r.stop_7_days for r in rows) == 7 and sum(r.stop_21_days for r in rows) == 21


def test_cascade_bucket_ties_and_nulls(spark):
    df = spark.createDataFrame([(-150.0,), (-100.0,), (0.0,), (5.0,), (None,)], "x double")
    # tied edges: the later index wins, numbers skip
    out = [r.b for r in df.select(cascade_bucket("x", [-100, 0, 0, 5]).alias("b")).collect()]
    assert out == [None, 0, 2, 3, None]


def _skewed(spark):
    rows = [(1 if i % 3 else (i % 7), dt.date(2000, 1, 1) + dt.timedelta(days=i % 50), i) for i in range(3000)]
    rows += [(None, dt.date(2001, 1, 1), 10_000 + i) for i in range(5)]
    return spark.createDataFrame(rows, "k int, d date, id long")


def test_ordered_lag_matches_window_on_hot_key(spark):
    df = _skewed(spark).unionByName(spark.createDataFrame([(1, None, -1), (1, None, -2), (9, None, -3)], "k int, d date, id long"))
    # key 1 holds two thirds of the rows, over two months; by day every row of a key may be a segment
    out = {"d": "prev_d", "id": "prev_id"}
    plain = ordered_lag(df, "k", ["d", "id"], out, skew_safe=False)
    want = sorted(plain.select("id", "prev_d", "prev_id").collect())
    by_day = F.coalesce(F.col("d"), F.lit("0001-01-01").cast("date"))
    for segment in (None, by_day, F.lit(0)):
        safe = ordered_lag(df, "k", ["d", "id"], out, segment=segment)
        assert sorted(safe.select("id", "prev_d", "prev_id").collect()) == want
        assert all(r.prev_id is None for r in safe.filter(F.col("k").isNull()).collect())
    assert ordered_lag(df.limit(0), "k", ["d", "id"], out).count() == 0


def test_ordered_lag_spreads_one_key_over_many_tasks(spark):
    days = spark.range(6000).select(F.lit(7).alias("k"), F.date_add(F.lit("1990-01-01").cast("date"), (F.col("id") % 3000).cast("int")).alias("d"), "id")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = ordered_lag(days, "k", ["d", "id"], {"id": "prev"})
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(sizes) < 3000
    assert "Checkpoint" not in out._jdf.queryExecution().toString()


def test_running_sum_and_dense_index(spark):
    df = _skewed(spark).withColumn("v", F.col("id") % 5)
    got = running_sum(df, ["id"], {"v": "cum"}, n=6).select("id", "cum")
    want = df.select("id", F.sum("v").over(Window.orderBy("id")).alias("cum"))
    assert sorted(got.collect()) == sorted(want.collect())
    idx = dense_index(df, ["id"], "i", n=5).select("id", "i")
    ref = df.select("id", (F.row_number().over(Window.orderBy("id")) - 1).alias("i"))
    assert sorted(idx.collect()) == sorted(ref.collect())


def test_draws_exact_and_stable_under_repartition(spark):
    df = spark.range(97).select(F.col("id").alias("sa_id"), (F.col("id") % 2).alias("label"))
    a = R.draw_with_replacement(df, 500, "sa_id", "t:")
    b = R.draw_with_replacement(df.repartition(13), 500, "sa_id", "t:")
    assert a.count() == 500
    assert sorted(a.collect()) == sorted(b.collect())
    split_a = R.hash_split(df).select("sa_id", "is_test").collect()
    split_b = R.hash_split(df.repartition(5)).select("sa_id", "is_test").collect()
    assert sorted(split_a) == sorted(split_b)


def test_resample_class_sizes(spark):
    df = spark.range(200).select(F.col("id").alias("sa_id"), (F.col("id") % 10 == 0).cast("int").alias("label"))
    out = R.resample_classes(df, "label", {1: 300, 0: 50})
    counts = {r.label: r["count"] for r in out.groupBy("label").count().collect()}
    assert counts == {1: 300, 0: 50}


@pytest.mark.parametrize(
    "tp,predicted,savings", [(381, 1739, 24520), (784, 13960, -53360), (294, 5860, -26260), (61, 211, 4600)]
)
def test_published_savings_recompute(spark, tp, predicted, savings):
    # confusion cells of the published runs: positives predicted and hit
    rows = [(1, 1)] * tp + [(0, 1)] * (predicted - tp) + [(1, 0)] * 3 + [(0, 0)] * 5
    df = spark.createDataFrame(rows, "label int, pred int")
    got = E.savings_score(df).first()
    assert got.savings_report == savings
    assert got.savings_scorer == 100 * tp - 10 * 3


def test_report_stop_class_precision_recall(spark):
    # random forest: 381 of 1,739 predicted stops were right, 1,403 actual stops
    rows = [(1, 1)] * 381 + [(0, 1)] * (1739 - 381) + [(1, 0)] * (1403 - 381) + [(0, 0)] * 100
    rep = {r["class"]: r for r in E.classification_report(spark.createDataFrame(rows, "label int, pred int")).collect()}
    assert round(rep["1"].precision, 3) == 0.219
    assert round(rep["1"].recall, 3) == 0.272


def test_confusion_matrix_empty(spark):
    df = spark.createDataFrame([], "label int, pred int")
    r = E.confusion_matrix(df).first()
    assert (r.tn, r.fp, r.fn, r.tp) == (0, 0, 0, 0)


def test_auc_matches_mllib(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    rows = [(i % 3 == 0 and 1 or 0, round((i * 37 % 101) / 101.0, 2)) for i in range(400)]
    df = spark.createDataFrame(rows, "label int, prob double")
    ours = E.roc_auc(df).first().auc
    ev = BinaryClassificationEvaluator(rawPredictionCol="prob", labelCol="label", metricName="areaUnderROC")
    theirs = ev.evaluate(df.withColumn("label", F.col("label").cast("double")))
    assert abs(ours - theirs) < 1e-9


def test_csv_round_trip_keeps_null(spark, tmp_path):
    from churnscope.sources import csv_io

    df = spark.createDataFrame([(1, None, dt.date(2019, 3, 1)), (2, "x", None)], "id long, s string, d date")
    path = str(tmp_path / "rt")
    csv_io.sink_csv(df, path)
    back = csv_io.scan_csv_typed(spark, path, df.schema)
    assert sorted(back.collect()) == sorted(df.collect())


def test_pearson_p_value_matches_t_statistic(spark):
    import math

    from churnscope.operators import stats as ST

    rows = [(float(i), float((i * 7) % 11 + i / 3.0)) for i in range(60)]
    df = spark.createDataFrame(rows, "a double, b double")
    r = ST.pearson_ci(df, "a", "b").first().r
    n = len(rows)
    t = r * math.sqrt((n - 2) / (1 - r * r))
    p = ST.pearson_p_value(df, "a", "b")
    # two-sided p of a large |t| is tiny; of the same t via the normal approx it is close
    from statistics import NormalDist

    approx = 2 * (1 - NormalDist().cdf(abs(t)))
    assert 0.0 <= p <= 1.0
    assert abs(p - approx) < 0.05


def test_corr_constant_column_is_null_not_error(spark):
    from churnscope.operators.stats import pearson_matrix

    df = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert pearson_matrix(df, ["a", "b"]).first().r is None


def test_exact_quantiles_match_pandas(spark):
    import pandas as pd

    from churnscope.operators.ordered import exact_quantiles

    vals = [float((i * 37) % 101) for i in range(500)] + [None] * 5
    df = spark.createDataFrame([(v, v * 2 if v is not None else None) for v in vals], "x double, y double")
    got = exact_quantiles(df, ["x", "y"], (0.1, 0.25, 0.5, 0.9))
    s = pd.Series(vals, dtype="float64")
    for p, q in zip((0.1, 0.25, 0.5, 0.9), got["x"]):
        assert abs(q - s.quantile(p)) < 1e-9
    for p, q in zip((0.1, 0.25, 0.5, 0.9), got["y"]):
        assert abs(q - (s * 2).quantile(p)) < 1e-9


def test_draws_reach_beyond_32_bits(spark):
    from churnscope.functions.hashing import hash_bits

    top = spark.range(1000).select(hash_bits("id", "draw:").alias("h")).agg({"h": "max"}).first()[0]
    assert 2**58 < top < 2**60


def test_forest_depth_beyond_the_engine_raises(spark):
    import pytest

    from churnscope.operators.models import forest

    with pytest.raises(ValueError):
        forest(10, 35)
