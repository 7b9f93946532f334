"""Correlations against pandas and exact t probabilities."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from churnscope.operators import stats as ST


def _frame(seed=1, n=500):
    rng = np.random.default_rng(seed)
    x = pd.DataFrame({"a": rng.normal(1e6, 1, n), "b": rng.integers(0, 5, n).astype(float), "c": rng.exponential(2, n)})
    x["d"] = x["a"] * 2 + rng.normal(0, 1, n)
    x["e"] = 7.3
    x.loc[rng.random(n) < 0.3, "b"] = np.nan
    x.loc[rng.random(n) < 0.2, "c"] = np.nan
    x["f"] = np.nan
    return x


def _spark(spark, x):
    rows = [(i, *[None if math.isnan(v) else float(v) for v in r]) for i, r in enumerate(x.to_numpy())]
    return spark.createDataFrame(rows, "sa_id long, " + ", ".join(f"{c} double" for c in x.columns))


def test_pearson_matrix_equals_pandas_with_nulls(spark):
    x = _frame()
    got = {(r.column_a, r.column_b): r.r for r in ST.pearson_matrix(_spark(spark, x).repartition(7), list(x.columns)).collect()}
    want = x.corr()
    assert len(got) == 15
    for a, b in itertools.combinations(x.columns, 2):
        if math.isnan(want.loc[a, b]) or "e" in (a, b):
            assert got[a, b] is None
        else:
            assert abs(got[a, b] - want.loc[a, b]) < 1e-9
    empty = ST.pearson_matrix(_spark(spark, x).limit(0), ["a", "b"]).collect()
    assert [(r.column_a, r.r) for r in empty] == [("a", None)]


def test_pearson_matrix_reads_its_input_once(spark, tmp_path):
    _spark(spark, _frame()).write.parquet(str(tmp_path / "x"))
    out = ST.pearson_matrix(spark.read.parquet(str(tmp_path / "x")), ["a", "b", "c"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert str(tmp_path) not in plan  # the stored moments are read, not the rows


def _t_two_sided(r, n):
    """Simpson's rule over the density of t with n - 2 degrees of freedom."""
    v = n - 2
    t = abs(r) * math.sqrt(v / (1 - r * r))
    log_c = math.lgamma((v + 1) / 2) - math.lgamma(v / 2) - 0.5 * math.log(v * math.pi)
    x = np.linspace(0, t, 20001)
    y = np.exp(log_c - (v + 1) / 2 * np.log1p(x * x / v))
    area = (y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum()) * (x[1] - x[0]) / 3
    return 1 - 2 * area


@pytest.mark.parametrize("n", [3, 4, 5, 12, 101, 5000, 300_000])
def test_p_value_equals_the_integral(spark, n):
    v = n - 2
    # from an all but certain to an impossible null hypothesis, on both sides of the switch
    rs = [0.0] + [t / math.sqrt(v + t * t) for t in (1e-6, 0.1, 0.7, 1.0, 1.2, 2.0, 3.3, 6.0)]
    df = spark.createDataFrame([(r, float(n)) for r in rs] + [(-r, float(n)) for r in rs[1:]], "r double, n double")
    for row in df.select("r", ST.r_p_value(F.col("r"), F.col("n")).alias("p")).collect():
        assert abs(row.p - _t_two_sided(row.r, n)) < 1e-9


def test_p_value_edges(spark):
    df = spark.createDataFrame([(1.0, 10.0), (-1.0, 10.0), (None, 10.0), (0.5, 2.0), (0.999999, 1000.0)], "r double, n double")
    got = [r[0] for r in df.select(ST.r_p_value(F.col("r"), F.col("n"))).collect()]
    assert got[:4] == [0.0, 0.0, None, None] and 0 <= got[4] < 1e-300


@pytest.mark.parametrize("numbers", [ST.RANK_NUMBERS, 0])
def test_spearman_matrix_equals_pandas_with_nulls(spark, numbers):
    """Both ways to the ranks; columns with null patterns of their own, shared, overlapping and all null."""
    x = _frame(3, 300)
    x["a"] = x["a"].round(0)
    x["g"] = x["b"] * 2 + np.arange(300) % 3  # null where b is
    x.loc[:150, "h"] = np.arange(151) % 7
    got = {(r.column_a, r.column_b): r.r for r in ST.spearman_matrix(_spark(spark, x).repartition(5), list(x.columns), numbers=numbers).collect()}
    want = {}
    for a, b in itertools.combinations(x.columns, 2):
        both = x[[a, b]].dropna().rank()
        want[a, b] = both[a].corr(both[b]) if len(both) > 1 and both[a].nunique() > 1 and both[b].nunique() > 1 else math.nan
    assert set(got) == set(want)
    for pair, r in want.items():
        assert (got[pair] is None) == math.isnan(r), pair
        assert got[pair] is None or abs(got[pair] - r) < 1e-9, pair


def test_spearman_joins_only_the_columns_beyond_the_budget(spark, monkeypatch):
    """One column of many values is joined, the others are not; rows may share their key; nothing is pivoted."""
    x = _frame(4, 400)
    x["a"] = x["a"].round(0)
    x["b"] = x["a"] * 3
    asked = []
    monkeypatch.setattr(ST, "_joined_deviations", lambda df, counts, names, large, f=ST._joined_deviations: (asked.append(large), f(df, counts, names, large))[1])
    rows = _spark(spark, x).withColumn("sa_id", F.lit(7)).repartition(3)
    got = ST.spearman_matrix(rows, list(x.columns), numbers=600).collect()
    assert 0 < len(asked[0]) < len(x.columns) and "a" not in asked[0]
    for row in got:
        both = x[[row.column_a, row.column_b]].dropna().rank()
        want = both[row.column_a].corr(both[row.column_b]) if len(both) > 1 else math.nan
        assert (row.r is None) == math.isnan(want) and (row.r is None or abs(row.r - want) < 1e-9), (row, want)


def test_numeric_columns_are_those_of_the_active_set(spark):
    from churnscope.registry import context, load_all
    from churnscope.registry.analysis import NUMERIC_COLS
    from conftest import SMALL
    from pyspark.sql.types import NumericType

    load_all()
    fields = context(spark, SMALL).active.schema.fields
    ids = {"sa_id", "account_id", "person_id", "premise_id", "cis_division", "rate_class_code"}
    assert {f.name for f in fields if isinstance(f.dataType, NumericType)} - ids == set(NUMERIC_COLS)


@pytest.mark.parametrize("collected", [2_000_000, 0])
def test_quantiles_of_skewed_columns_equal_pandas(spark, collected):
    """Hot values, few values, one value, all null; ranks from collected counts and from a running sum."""
    from churnscope.operators.ordered import exact_quantiles

    rng = np.random.default_rng(9)
    x = pd.DataFrame({"a": np.where(rng.random(4000) < 0.4, 0.0, rng.normal(0, 1e6, 4000)), "b": rng.integers(0, 3, 4000).astype(float)})
    x["c"], x["d"], x["e"] = 2.5, np.nan, np.exp(rng.normal(0, 40, 4000))
    x.loc[rng.random(4000) < 0.2, "e"] = np.nan
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 0.999, 1.0]
    got = exact_quantiles(_spark(spark, x).repartition(6), list(x.columns), probs, collected=collected)
    for c in x.columns:
        want = x[c].quantile(probs).tolist() if x[c].notna().any() else []
        assert len(got[c]) == len(want) and all(abs(p - q) <= 1e-12 * max(1, abs(q)) for p, q in zip(got[c], want)), c
    assert exact_quantiles(_spark(spark, x).limit(0), ["a"], probs, collected=collected) == {"a": []}


@pytest.mark.parametrize("collected", [0, 2_000_000])
def test_brackets_of_one_value_make_no_rows(spark, monkeypatch, collected):
    """Flags, negative zero, a constant and a spread column; only the last one's values are counted one by one."""
    from churnscope.operators import ordered

    rng = np.random.default_rng(5)
    x = pd.DataFrame({"flag": (rng.random(4000) < 0.6) * 1.0, "zero": [-0.0, 0.0] * 2000, "one": [7.0] * 4000, "wide": rng.normal(size=4000)})
    stored, stage = [], ordered.stage_table
    monkeypatch.setattr(ordered, "stage_table", lambda df, name: stored.append(stage(df, name)) or stored[-1])
    probs = (0.25, 0.5, 0.75)
    got = ordered.exact_quantiles(_spark(spark, x), list(x.columns), probs, collected=collected)
    for name in x.columns:
        assert got[name] == pytest.approx(list(x[name].quantile(list(probs))), abs=1e-12)
    assert str(got["zero"][0]) == "0.0"
    assert all(set(t.toPandas()["v"]) <= set(x["wide"]) for t in stored)
    stored.clear()
    assert ordered.exact_quantiles(_spark(spark, x), ["one"], probs, collected=collected) == {"one": [7.0] * 3} and not stored
