"""10,000 replicates from counted label tuples."""

import numpy as np

import __spark_entry__ as entry
from churnscope.operators import sampling as R
from conftest import SMALL


def test_interval_is_that_of_the_resampled_rows(spark):
    rng = np.random.default_rng(5)
    x = (rng.random(4000) < 0.03).astype(int)
    y = [None if i % 10 == 0 else int(v) for i, v in enumerate(rng.random(4000) < 0.4)]
    df = spark.createDataFrame([(int(a), b) for a, b in zip(x, y)], "x int, y int")
    got = {r.column_name: r for r in R.bootstrap_mean_ci_grouped(df.repartition(7), ["x", "y"]).collect()}
    assert got == {r.column_name: r for r in R.bootstrap_mean_ci_grouped(df.coalesce(1), ["x", "y"]).collect()}
    for name, v in (("x", x), ("y", np.array([b for b in y if b is not None]))):
        means = rng.choice(v, (10_000, len(v))).mean(axis=1)
        half = np.diff(np.quantile(means, [0.025, 0.975]))[0] / 2
        assert abs(got[name].mean - v.mean()) < 1e-12
        for found, want in zip((got[name].ci_low, got[name].ci_high), np.quantile(means, [0.025, 0.975])):
            assert abs(found - want) < 0.1 * half


def test_every_replicate_is_drawn():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([0.0, 1.0]), pa.array([900, 100])], names=["x", "_n"])
    (out,) = R._poisson_sums(10_000, "boot:")([batch])
    w, s = out.column("w0").to_numpy(), out.column("s0").to_numpy()
    assert len(w) == 10_000 and len(set(out.column("rep").to_pylist())) == 10_000
    assert abs(w.mean() - 1000) < 2 and abs(w.var() - 1000) < 60 and abs(s.mean() - 100) < 0.6 and abs(s.var() - 100) < 6


def test_empty_table(spark):
    got = R.bootstrap_mean_ci_grouped(spark.createDataFrame([], "x int"), ["x"]).collect()
    assert [tuple(r) for r in got] == [("x", None, None, None)]


def test_registered_query_draws_ten_thousand(spark, monkeypatch):
    drawn = []
    real = R.bootstrap_mean_ci_grouped
    monkeypatch.setattr(R, "bootstrap_mean_ci_grouped", lambda *a, **k: drawn.append(k["replicates"]) or real(*a, **k))
    got = {r.column_name: r for r in entry.queries()["bootstrap_mean_ci_10000"](spark, SMALL).collect()}
    assert drawn == [10_000] and set(got) == {"stop_7_days", "stop_14_days", "stop_21_days"}
    assert all(r.ci_low <= r.mean <= r.ci_high for r in got.values())
