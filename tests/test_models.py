"""MLlib wrappers: sanity on small separable data (rows-only keys have no twin)."""

from pyspark.sql import functions as F

from churnscope.operators import evaluate as E
from churnscope.operators import models as M


def _separable(spark, n=400):
    rows = [(i, float(i % 2), float((i % 2) * 3 + (i % 7) / 7.0), float((i * 13) % 5)) for i in range(n)]
    return spark.createDataFrame(rows, "sa_id long, label double, x1 double, x2 double")


def test_logistic_separates_and_probabilities_are_valid(spark):
    df = _separable(spark)
    model = M.fit(df, ["x1", "x2"], M.logistic(df.count(), C=1.0))
    preds = M.predict(model, df)
    assert preds.filter((F.col("prob") < 0) | (F.col("prob") > 1)).count() == 0
    auc = E.roc_auc(preds.withColumn("label", F.col("label").cast("int"))).first().auc
    assert auc > 0.95


def test_forest_seeded_and_repeatable(spark):
    df = _separable(spark)
    a = M.predict(M.fit(df, ["x1", "x2"], M.forest(10, 5, "1")), df).orderBy("sa_id").collect()
    b = M.predict(M.fit(df, ["x1", "x2"], M.forest(10, 5, "1")), df).orderBy("sa_id").collect()
    assert a == b


def test_savings_evaluator_matches_report_cells(spark):
    rows = [(1.0, 1.0)] * 7 + [(0.0, 1.0)] * 5 + [(1.0, 0.0)] * 2 + [(0.0, 0.0)] * 9
    df = spark.createDataFrame(rows, "label double, prediction double")
    assert M.SavingsEvaluator("report").evaluate(df) == 100 * 7 - 10 * 5
    assert M.SavingsEvaluator("scorer").evaluate(df) == 100 * 7 - 10 * 2


def test_balanced_weights(spark):
    df = spark.createDataFrame([(1.0,)] * 10 + [(0.0,)] * 30, "label double")
    w = M.class_weights(df)
    assert abs(w[1.0] - 40 / (2 * 10)) < 1e-12 and abs(w[0.0] - 40 / (2 * 30)) < 1e-12


def test_sqrt_features_floor():
    assert M.sqrt_features(30) == "5" and M.sqrt_features(1) == "1"


def test_knn_matches_brute_force(spark):
    import numpy as np

    from churnscope.operators.neighbors import knn_classify, knn_neighbours

    rng = np.random.default_rng(7)
    tr = rng.normal(size=(300, 3)) * np.array([50.0, 3.0, 1.0])
    tr[::10] = tr[1::10]  # repeated rows, as after re-sampling with replacement
    tr[3::25] = tr[4]  # one row with many copies
    yt = (tr[:, 1] > 0).astype(float)
    te = rng.normal(size=(40, 3)) * np.array([50.0, 3.0, 1.0])
    train = spark.createDataFrame([(i, float(yt[i]), *map(float, tr[i])) for i in range(len(tr))],
                                  "row_id long, label double, a double, b double, c double")
    test = spark.createDataFrame([(1000 + i, 0.0, *map(float, te[i])) for i in range(len(te))],
                                 "sa_id long, label double, a double, b double, c double")
    # distinct rows with their copies and first id
    rows = {}
    for i in range(len(tr)):
        key = (float(yt[i]), *map(float, tr[i]))
        m, first = rows.get(key, (0, i))
        rows[key] = (m + 1, min(first, i))
    distinct = [(np.array(key[1:]), key[0], m, first) for key, (m, first) in rows.items()]
    k = 5
    got = {(r.sa_id, r.nb): (round(r.distance, 9), r.nb_label, r.weight)
           for r in knn_neighbours(train, test, ["a", "b", "c"], k, "row_id", "sa_id").collect()}
    want_prob = {}
    for i in range(len(te)):
        order = sorted(distinct, key=lambda r: (float(np.sqrt(((r[0] - te[i]) ** 2).sum())), r[3]))
        before, nb = 0, 0
        for x, y, m, _ in order:
            if before >= k:
                break
            nb += 1
            d = float(np.sqrt(((x - te[i]) ** 2).sum()))
            assert got[(1000 + i, nb)] == (round(d, 9), y, min(m, k - before))
            before += m
        assert (1000 + i, nb + 1) not in got
        for kk in (1, 3, 5):
            acc, b = 0.0, 0
            for x, y, m, _ in order:
                if b >= kk:
                    break
                acc += y * min(m, kk - b)
                b += m
            want_prob[(1000 + i, kk)] = acc / kk
    preds = knn_classify(train, test, ["a", "b", "c"], k_values=[1, 3, 5], train_id="row_id").collect()
    assert len(preds) == 3 * len(te)
    for r in preds:
        assert abs(r.prob - want_prob[(r.sa_id, r.k)]) < 1e-12
        assert r.pred == int(r.prob > 0.5)


def test_knn_best_k_by_money_cv(spark):
    from churnscope.operators.neighbors import knn_best_k

    rows = [(i, i // 3, float(i % 2), float((i % 2) * 5 + (i % 7) / 7.0), float((i * 13) % 5)) for i in range(300)]
    df = spark.createDataFrame(rows, "row_id long, sa_id long, label double, x1 double, x2 double")
    best, totals = knn_best_k(df, ["x1", "x2"], k_values=[1, 3, 5], folds=3)
    assert best in (1, 3, 5) and [k for k, _ in totals] == [1, 3, 5]
    assert max(v for _, v in totals) == dict(totals)[best]


def _data(spark, n=300):
    """Two features, labels that they do not separate."""
    rows = [(i, float((i * 7919 % 100) < 20 + 10 * (i % 6)), float(i % 6) + i % 11 / 11.0, float(i * 13 % 17)) for i in range(n)]
    return spark.createDataFrame(rows, "sa_id long, label double, x1 double, x2 double")


def test_forest_union_is_the_mean_of_its_trees(spark, monkeypatch, tmp_path):
    """Three sub-forests, one smaller; an interrupted fit goes on; the same call gives the same forest."""
    from pyspark.ml.functions import vector_to_array

    monkeypatch.setattr(M, "SUB_TREES", 4)
    df = _data(spark)
    folder = str(tmp_path / "forest")
    one = M.fit_forest(df, ["x1", "x2"], 10, 5, "1", folder=folder)
    assert [p.getNumTrees for p in one.parts] == [4, 4, 2] and one.trees == 10
    got = one.transform(df).orderBy("sa_id")
    p = [r[0] for r in got.select(vector_to_array("probability")[1]).collect()]
    each = []
    for part in one.parts:
        rows = part.transform(M.assembler(["x1", "x2"]).transform(df)).orderBy("sa_id")
        each.append([part.getNumTrees * r[0] for r in rows.select(vector_to_array("probability")[1]).collect()])
    assert max(abs(a - sum(b) / 10) for a, b in zip(p, zip(*each))) < 1e-12
    assert [r.prediction for r in got.collect()] == [float(x > 0.5) for x in p]
    assert abs(sum(one.featureImportances) - 1) < 1e-9
    # the last part is lost: the others are loaded, it is fitted again
    import shutil

    shutil.rmtree(f"{folder}/part-2")
    fits = []
    monkeypatch.setattr(M, "forest", lambda *a, f=M.forest, **k: (fits.append(a), f(*a, **k))[1])
    two = M.fit_forest(df, ["x1", "x2"], 10, 5, "1", folder=folder)
    assert len(fits) == 1
    q = [r[0] for r in two.transform(df).orderBy("sa_id").select(vector_to_array("probability")[1]).collect()]
    assert max(abs(a - b) for a, b in zip(p, q)) < 1e-12


def test_copies_as_weights_give_the_plain_solution(spark):
    """Coefficients on distinct rows equal those on all drawn rows; so does the score."""
    df = _data(spark)
    drawn = df.withColumn("c", F.explode(F.sequence(F.lit(1), (F.col("sa_id") % 7 + 1).cast("int")))).drop("c")
    n = drawn.count()
    rows = M.distinct_rows(drawn, ["x1", "x2"])
    assert rows.count() == df.count() and rows.agg(F.sum("copies")).first()[0] == n
    for C, penalty in ((1.0, "l2"), (100.0, "l1")):
        plain = M.fit(drawn, ["x1", "x2"], M.logistic(n, C, penalty).setTol(1e-12)).stages[-1]
        weighted = M.fit(rows, ["x1", "x2"], M.logistic(n, C, penalty, "copies").setTol(1e-12)).stages[-1]
        a, b = plain.coefficients.toArray(), weighted.coefficients.toArray()
        assert abs(a - b).max() < 1e-6 * max(1, abs(a).max())
    p = M.fit(rows, ["x1", "x2"], M.logistic(n, 1.0, "l2", "copies"))
    assert M.SavingsEvaluator("scorer", copiesCol="copies").evaluate(p.transform(rows)) == M.SavingsEvaluator("scorer").evaluate(p.transform(drawn))


def test_grid_search_and_svm_sweep_on_repeated_rows(spark):
    df = _data(spark)
    drawn = df.unionByName(df.filter("label = 1")).unionByName(df)
    for balanced in (False, True):
        cv, grid = M.grid_search(drawn, ["x1", "x2"], folds=3, balanced=balanced, Cs=(1.0, 100.0))
        assert len(cv.avgMetrics) == len(grid) == 4
    out = M.svm_sweep(drawn, df, ["x1", "x2"], Cs=(0.1, 1.0)).collect()
    assert [r.C for r in out] == [0.1, 1.0]
    for r in out:
        assert r.actual0_pred0 + r.actual0_pred1 + r.actual1_pred0 + r.actual1_pred1 == df.count()
        assert abs(r.accuracy - (r.actual0_pred0 + r.actual1_pred1) / df.count()) < 1e-12


def test_forests_predict_without_the_learners_nodes_in_the_plan(spark, monkeypatch, tmp_path):
    """Forests fitted side by side equal those fitted alone; their saved arrays give the
    learner's own probabilities, also for a tree of one leaf and three classes; NULL raises."""
    import pytest
    from pyspark.errors import PythonException
    from pyspark.ml.functions import vector_to_array

    monkeypatch.setattr(M, "SUB_TREES", 3)
    df = _data(spark)
    three = df.withColumn("label", F.when(F.col("sa_id") % 5 == 0, 2.0).otherwise(F.col("label")))
    single = df.withColumn("label", F.lit(0.0))
    requests = [{"train": t, "features": ["x1", "x2"], "trees": 5, "depth": d, "subset": "1", "folder": str(tmp_path / f"f{i}")}
                for i, (t, d) in enumerate([(df, 30), (three, 6), (single, 4)])]
    for request, model in zip(requests, M.fit_forests(requests)):
        alone = M.fit_forest(**{**request, "folder": None})
        assert alone.featureImportances == model.featureImportances
        out = model.transform(df)
        assert "ScalaUDF" not in out.select("prediction")._jdf.queryExecution().optimizedPlan().toString()
        got = {r.sa_id: list(r.p) for r in out.select("sa_id", vector_to_array("probability").alias("p")).collect()}
        for i, part in enumerate(model.parts):
            rows = part.transform(M.assembler(["x1", "x2"]).transform(df))
            for r in rows.select("sa_id", vector_to_array("probability").alias("p")).collect():
                got[r.sa_id] = [a - part.getNumTrees / model.trees * b for a, b in zip(got[r.sa_id], r.p)]
        assert max(abs(x) for p in got.values() for x in p) < 1e-12
    with pytest.raises(PythonException):
        model.transform(df.withColumn("x1", F.when(F.col("sa_id") > 5, F.col("x1")))).collect()


def _gathered(spark, df, features, weight=None):
    return M._counted(df, features, weight).value


def test_grown_tree_is_the_learners(spark, tmp_path):
    """All rows, all features: the tree that is grown from counted rows has the learner's nodes, shares and importances."""
    import numpy as np

    from churnscope.operators import forest as G

    df = _data(spark, 900).withColumn("x3", F.col("sa_id") * 37 % 211 - 100.0).withColumn("x4", F.lit(1.0))
    df = df.unionByName(df.filter("x1 > 3")).withColumn("w", F.when(F.col("label") == 1, 0.75).otherwise(3.0))
    three = df.withColumn("label", F.when(F.col("sa_id") % 5 == 0, 2.0).otherwise(F.col("label")))
    features = ["x1", "x2", "x3", "x4"]
    x = np.array(df.select(*features).collect())
    for i, (train, weight, depth) in enumerate([(df, None, 30), (df, "w", 30), (three, None, 30), (df, None, 3)]):
        rf = M.forest(1, depth, "all", weight).setBootstrap(False)
        path = str(tmp_path / f"t{i}")
        model = rf.fit(M.assembler(features).transform(train))
        model.write().save(path)
        want = M._tree_arrays(path, spark)
        rows = _gathered(spark, train, features, weight)
        grown = G.grow(rows, np.random.default_rng(1), depth, len(features), bag=False)
        got = G.end_to_end([grown["node"]], [grown["shares"]], rows[0])
        assert len(got[1]) == len(want[1]) == model.totalNumNodes > 5
        assert np.allclose(G.votes(got, x), G.votes(want, x), atol=1e-12)
        assert np.allclose(grown["importance"], model.featureImportances.toArray(), atol=1e-9)


def test_forests_grow_without_the_learners_passes(spark, monkeypatch):
    """The learner sends the statistics of every open node of a forest to one place, pass by pass; a grown forest needs none."""
    from pyspark.ml.classification import RandomForestClassifier

    df = _data(spark).withColumn("w", F.col("label") + 1)
    learned = M.fit(df, ["x1", "x2"], M.forest(60, 8, "1")).transform(df)
    both = {r.sa_id: r.prediction for r in learned.select("sa_id", "prediction").collect()}
    monkeypatch.setattr(RandomForestClassifier, "fit", lambda *a, **k: (_ for _ in ()).throw(AssertionError("a pass of the learner")))
    requests = [{"train": df, "features": ["x1", "x2"], "trees": 60, "depth": 8, "subset": s, "weight": w} for s, w in (("1", None), ("1", "w"), ("2", None))]
    models = M.fit_forests(requests)
    assert [m.trees for m in models] == [60, 60, 60]
    same = [r.prediction == both[r.sa_id] for r in models[0].transform(df).collect()]
    assert sum(same) >= 0.9 * len(same)  # other bags, the same law
    again = M.fit_forest(df.repartition(3, "x2"), ["x1", "x2"], 60, 8, "1")  # rows in another order
    assert again.featureImportances == models[0].featureImportances


def test_training_rows_beyond_the_bound_are_left_to_the_learner(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(M, "GATHERED_BYTES", 0)
    df = _data(spark)
    model = M.fit_forest(df, ["x1", "x2"], 6, 5, "1", folder=str(tmp_path / "f"))
    (part,) = model.parts
    p = [r[0] for r in M.predict(model, df).orderBy("sa_id").select("prob").collect()]
    q = [r[0] for r in M.predict(part, M.assembler(["x1", "x2"]).transform(df)).orderBy("sa_id").select("prob").collect()]
    assert max(abs(a - b) for a, b in zip(p, q)) < 1e-12 and model.trees == 6


def test_forest_training_rows_are_checked(spark):
    import pytest

    df = _data(spark)
    for bad in (df.withColumn("x1", F.when(F.col("sa_id") > 5, F.col("x1"))), df.withColumn("label", F.lit(0.5)), df.limit(0)):
        with pytest.raises(ValueError):
            M.fit_forest(bad, ["x1", "x2"], 2, 3, "1")
    assert [M.drawn_features(s, 30, 9) for s in ("sqrt", "all", "5", "log2", "onethird", "auto", "0.5")] == [6, 30, 5, 5, 10, 6, 15]


def test_segments_are_drawn_in_one_pass_as_one_by_one(spark, monkeypatch):
    from churnscope.operators import sampling as R

    rows = spark.range(600).select(F.col("id").alias("sa_id"), (F.col("id") % 4 == 0).cast("int").alias("label"),
                                   F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").alias("segment"))
    sizes = {"a": {1: 30, 0: 70}, "b": {1: 0, 0: 20}, "none": {1: 5, 0: 5}}
    passes = []
    monkeypatch.setattr(R, "dense_index", lambda *a, f=R.dense_index: (passes.append(a), f(*a))[1])
    got = R.resample_by_segment(rows, "label", "segment", sizes)
    assert len(passes) == 1
    alone = [R.resample_classes(rows.filter(F.col("segment") == s), "label", per, "sa_id", f"seg:{s}:") for s, per in sizes.items()]
    want = alone[0].unionByName(alone[1]).unionByName(alone[2])
    assert got.count() == 120 and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert R.resample_classes(rows, "label", {}).count() == 0
