"""The blocked distance kernel against SQL over all pairs."""

import duckdb
import numpy as np
import pandas as pd
import pytest


def data(seed):
    rng = np.random.default_rng(seed)
    cols = [f"f{i}" for i in range(6)]
    train = pd.DataFrame(rng.integers(-3, 4, (240, 6)) * np.array([1, 0.1, 1000, 7, 1e6, 0.3]), columns=cols)
    train = pd.concat([train, train.sample(150, replace=True, random_state=seed)], ignore_index=True)  # copies
    train["label"] = (rng.random(len(train)) < 0.4).astype(float)
    train["row_id"] = rng.permutation(len(train))
    test = pd.DataFrame(rng.integers(-3, 4, (90, 6)) * np.array([1, 0.1, 1000, 7, 1e6, 0.3]), columns=cols)
    test["label"], test["sa_id"] = 0.0, np.arange(90)
    return cols, train, test


@pytest.mark.parametrize("block_bytes", [64 << 20, 6_000])
def test_knn_classify_equals_sql(spark, monkeypatch, block_bytes):
    from churnscope.operators import neighbors as N

    monkeypatch.setattr(N, "BLOCK_BYTES", block_bytes)
    cols, train, test = data(4)
    distance = "sqrt(" + " + ".join(f"(t.{c} - q.{c}) * (t.{c} - q.{c})" for c in cols) + ")"
    names = ", ".join(cols)
    want = duckdb.sql(f"""
        WITH rows AS (SELECT {names}, label, min(row_id) AS tid, count(*) AS m FROM train GROUP BY ALL),
        pairs AS (SELECT q.sa_id, t.label AS y, m, sum(m) OVER (PARTITION BY q.sa_id ORDER BY {distance}, tid) - m AS before
                  FROM test q, rows t),
        ks AS (SELECT unnest(generate_series(1, 11)) AS k)
        SELECT sa_id, k, sum(y * greatest(0, least(m, k - before))) / k AS prob FROM pairs, ks GROUP BY sa_id, k ORDER BY sa_id, k""").df()
    got = N.knn_classify(spark.createDataFrame(train), spark.createDataFrame(test), cols).toPandas().sort_values(["sa_id", "k"])
    assert np.allclose(got["prob"].to_numpy(), want["prob"].to_numpy(), atol=1e-12)
    assert got["k"].tolist() == want["k"].tolist()


def test_no_pairs_and_no_shuffle_of_queries(spark):
    from churnscope.operators.neighbors import knn_classify

    cols, train, test = data(5)
    out = knn_classify(spark.createDataFrame(train), spark.createDataFrame(test), cols)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_nulls_and_empty_sides(spark):
    from churnscope.operators.neighbors import knn_classify

    cols, train, test = data(6)
    train.loc[0, "f1"] = np.nan
    test.loc[0, "f2"] = np.nan
    ddl = ", ".join(f"{c} double" for c in [*cols, "label"])
    rows = lambda d, key: spark.createDataFrame(d.astype(object).where(d.notna(), None).values.tolist(), f"{ddl}, {key} long")
    out = knn_classify(rows(train, "row_id"), rows(test, "sa_id"), cols).toPandas()
    assert set(out["sa_id"]) == set(range(1, 90)) and len(out) == 89 * 11
    assert knn_classify(rows(train, "row_id").limit(0), rows(test, "sa_id"), cols).count() == 0
    assert knn_classify(rows(train, "row_id"), rows(test, "sa_id").limit(0), cols).count() == 0


@pytest.mark.parametrize("pairs", [1 << 22, 300])
@pytest.mark.parametrize("shape", ["clusters", "lattice", "far", "few"])
def test_boxes_lose_no_neighbour(monkeypatch, shape, pairs):
    """Against all distances, with ties, copies, a column that dwarfs the rest, and fewer rows than k."""
    from churnscope.operators import neighbors as N

    monkeypatch.setattr(N, "BOX", 16)
    monkeypatch.setattr(N, "PAIRS", pairs)
    rng = np.random.default_rng(3)
    x = {"clusters": rng.normal(size=(500, 7)) + 50 * rng.integers(0, 5, (500, 1)), "lattice": rng.integers(0, 3, (400, 7)).astype(float),
         "far": rng.normal(size=(500, 7)) * [1e9, 1, 1, 1, 1, 1, 1], "few": rng.normal(size=(6, 7))}[shape]
    q = np.concatenate([x[:40], x[:40] + rng.normal(size=(len(x[:40]), 7)), np.full((1, 7), 1e6)] * 2)
    tid, copies, k = rng.permutation(len(x)), rng.integers(1, 4, len(x)), 11
    got = list(zip(*(v.tolist() for v in N.nearest(N.index(x), tid, copies, q, k))))
    want = []
    for i, one in enumerate(q):
        dist, before = N._exact(x, np.broadcast_to(one, x.shape)), 0
        for c in np.lexsort((tid, dist)):
            if before >= k:
                break
            want.append((i, c, dist[c], before))
            before += copies[c]
    assert got == want


def test_far_boxes_are_not_compared(monkeypatch):
    """The work for a query grows with its neighbourhood, not with the training rows."""
    from churnscope.operators import neighbors as N

    rng = np.random.default_rng(8)
    x = rng.normal(size=(20_000, 8)) * [1e4, 1e4, 100, 100, 1, 1, 1, 1]
    rows, looked = N.index(x), []
    monkeypatch.setattr(N.np, "partition", lambda a, *r, f=np.partition, **k: (looked.append(a.size), f(a, *r, **k))[1])
    N.nearest(rows, np.arange(len(x)), np.ones(len(x), dtype=np.int64), x[:512] + 0.5, 11)
    assert sum(looked) < 0.25 * 512 * len(x)
