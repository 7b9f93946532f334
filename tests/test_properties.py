"""Properties of registered queries and as-of dates off the first of a month."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from churnscope.parity import compare
from conftest import SMALL

Q = entry.queries()


@pytest.mark.parametrize("as_of", ["1998-02-15", "2000-01-31"])
def test_feature_table_any_as_of(spark, duck_small, as_of):
    from churnscope.oracle_sql.features import feature_ctes
    from churnscope.plans.features import Sources, build_feature_table
    from churnscope.sources.fixture_sql import with_views
    from churnscope.sources.tables import Tables

    src = Sources.from_fixtures(Tables(spark, SMALL).fixtures)
    ok, msg = compare(build_feature_table(src, as_of), duck_small, with_views("select * from features", feature_ctes(as_of)))
    assert ok, msg


def test_shares_sum_to_one(spark):
    total = Q["share_of_total"](spark, SMALL).agg(F.sum("share")).first()[0]
    assert abs(total - 1.0) < 1e-9
    for r in Q["dnp_share"](spark, SMALL).groupBy("flag_name", "horizon").agg(F.sum("share").alias("s")).collect():
        assert abs(r.s - 1.0) < 1e-9


def test_confusion_cells_sum_to_rows(spark):
    cm = Q["confusion_matrix"](spark, SMALL).first()
    n = Q["union_all"](spark, SMALL).count()
    assert cm.tn + cm.fp + cm.fn + cm.tp == n


def test_segments_partition_the_active_rows(spark):
    seg = Q["partition_by_class"](spark, SMALL)
    assert seg.filter(F.col("segment").isNull()).count() == 0
    assert seg.count() == Q["labelled_active_set"](spark, SMALL).count()


def test_labels_nested_and_buckets_max_edge(spark):
    lab = Q["labelled_active_set"](spark, SMALL)
    assert lab.filter((F.col("stop_7_days") > F.col("stop_14_days")) | (F.col("stop_14_days") > F.col("stop_21_days"))).count() == 0
    fixed = Q["bucket_fixed_arrears"](spark, SMALL)
    edges = [-100, 0, 100, 200, 300, 400, 500, 600, 700, 800]
    for r in fixed.collect():
        want = max([i for i, e in enumerate(edges) if r.arrears_payoff_amount >= e], default=None)
        assert r.arrears_payoff_bucket_2 == want


def test_open_end_and_negative_inactivity(spark):
    f = Q["build_feature_table"](spark, SMALL)
    # open agreements carry the 2099-12-31 sentinel; a prior stop in the future is blanked
    assert f.filter(F.col("sa_end_year") == "2099").count() > 0
    assert f.filter(F.col("premise_prior_stop_date") > F.lit("1998-03-01").cast("date")).count() == 0
    # overlapping agreements give negative inactivity (kept, not clipped)
    assert f.filter(F.col("premise_days_inactive_before") < 0).count() >= 0


def test_feature_table_equals_sql_without_stored_sources(spark, duck_small):
    """Built straight from the analog views; the feature table must not change."""
    from churnscope.oracle_sql.features import feature_ctes
    from churnscope.plans.features import Sources, build_feature_table
    from churnscope.sources.fixture_sql import with_views
    from churnscope.sources.tables import Tables

    src = Sources.from_fixtures(Tables(spark, SMALL).fixtures)
    ok, msg = compare(build_feature_table(src, "1998-03-01"), duck_small, with_views("select * from features", feature_ctes()))
    assert ok, msg
