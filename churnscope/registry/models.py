"""Keys of the model chapter (MLlib). Checked by rows: training is iterative
and has no SQL twin; the evaluation keys carry the exact checks."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from churnscope.functions import scalar as S
from churnscope.functions.asof import stopped_within
from churnscope.operators import evaluate as E
from churnscope.operators import models as M
from churnscope.operators import sampling as R
from churnscope.operators import stats as ST
from churnscope.registry import register
from churnscope.registry.analysis import SEGMENT_SIZES, STD_COLS, segment_col

LABEL_HORIZON = 180  # positives are rare in the test tables at 21 days

# The study's 30 features, its years moved to those of the test tables.
MODEL_FEATURES = [
    "usage_past_18_bucket", "city_num", "customer_class_num", "dnp_started_flag_number", "dnp_stopped_flag_number",
    "internal_credit_rating", "person_rcvd_18_mths_pledge_num", "payments_in_last_18_months", "bills_in_last_18_months",
    "arrears_payoff_amount", "total_payoff_amount", "late_payment_count", "seasonal_prior_1_yr_flag_num",
    "seasonal_prior_2_yr_flag_num", "seasonal_prior_3_yr_flag_num", "sa_start_avg_temp", "start_1992", "start_1993",
    "start_1994", "start_1995", "start_1996", "start_1997", "start_1998", "pledge_date_1996_num", "pledge_date_1997_num",
    "premise_days_inactive_before", "person_days_inactive_before", "premise_days_active_before",
    "person_days_active_before", "active_diff_from_as_of",
]
# dnp_stopped_flag_number says why the agreement stopped: a leak kept for
# parity with the study; SAFE_FEATURES drops it.
SAFE_FEATURES = [f for f in MODEL_FEATURES if f != "dnp_stopped_flag_number"]
ORDER = ["sa_id", "dnp_started_flag_number", "dnp_stopped_flag_number"]


def model_frame(c):
    a = c.active
    out = a.select(
        "sa_id", "customer_class",
        *[F.col(f) for f in MODEL_FEATURES if f not in ("usage_past_18_bucket", "city_num", "customer_class_num")],
        F.coalesce(F.col("usage_past_18_bucket"), F.lit(S.NO_BUCKET)).alias("usage_past_18_bucket"),
        S.label_encode("city", S.CITY_CODES).alias("city_num"),
        S.label_encode("customer_class", S.CLASS_CODES).alias("customer_class_num"),
        stopped_within(c.d, LABEL_HORIZON).cast("double").alias("label"),
    )
    return R.hash_split(out.withColumn("segment", segment_col()))


def _train(c):
    return model_frame(c).filter(F.col("is_test") == 0)


def _test(c):
    return model_frame(c).filter(F.col("is_test") == 1)


def _training_partitions(c, rows: int) -> int:
    """The re-sampled training set has a fixed size (it does not grow with the
    input): one partition per 5,000 rows, 8 at most, whatever the cluster is,
    because the learners draw their bags per partition."""
    return max(1, min(8, rows // 5000))


def resampled_train(c, sizes=None):
    """20,000 stops + 40,000 non-stops drawn from the training split, written
    once per session (every learner iterates over it many times)."""
    from churnscope.sources.csv_io import stage_table

    sizes = sizes or {1: 20000, 0: 40000}
    key = ("resampled_train", tuple(sorted(sizes.items())))
    cache = c.__dict__.setdefault("_model_inputs", {})
    if key not in cache:
        drawn = R.resample_classes(_train(c).withColumn("label_i", F.col("label").cast("int")), "label_i", sizes, key=ORDER)
        cache[key] = stage_table(drawn.repartition(_training_partitions(c, sum(sizes.values()))), "resampled_train")
    return cache[key]


def _n(df) -> int:
    return df.count()


@register("assemble_features")
def assemble_features(c):
    va = M.assembler(MODEL_FEATURES)
    return va.transform(model_frame(c)).select("sa_id", "label", "is_test", vector_to_array("features").alias("features"))


def _logistic_model(c):
    """Fitted once per session for both keys that use it."""
    if "_logistic" not in c.__dict__:
        tr = resampled_train(c)
        c.__dict__["_logistic"] = M.fit(tr, MODEL_FEATURES, M.logistic(_n(tr), C=1.0, penalty="l2"))
    return c.__dict__["_logistic"]


@register("logreg_fit")
def logreg_fit(c):
    return M.predict(_logistic_model(c), _test(c))


@register("logreg_balanced")
def logreg_balanced(c):
    tr = M.with_weights(resampled_train(c))
    model = M.fit(tr, MODEL_FEATURES, M.logistic(_n(tr), C=1.0, penalty="l2", weight="weight"))
    return M.predict(model, _test(c))


@register("grid_search_cv")
def grid_search_cv(c):
    tr = resampled_train(c)
    cv_model, grid = M.grid_search(tr, MODEL_FEATURES, folds=5)
    best = max(range(len(grid)), key=lambda i: cv_model.avgMetrics[i])
    n = _n(tr)
    rows = []
    for i, pm in enumerate(grid):
        vals = {p.name: v for p, v in pm.items()}
        rows.append((float(1.0 / (vals["regParam"] * n)), "l1" if vals["elasticNetParam"] == 1.0 else "l2",
                     float(cv_model.avgMetrics[i]), i == best))
    return c.spark.createDataFrame(rows, "C double, penalty string, mean_savings double, best boolean")


@register("cv_score")
def cv_score(c):
    te = _test(c)
    scores = M.cv_scores(te, MODEL_FEATURES, lambda n: M.logistic(n, C=1.0), folds=5)
    import statistics

    mean = statistics.fmean(scores)
    sd = statistics.pstdev(scores)
    rows = [(k, s, mean, 2 * sd, mean * len(scores)) for k, s in enumerate(scores)]
    return c.spark.createDataFrame(rows, "fold int, savings double, mean double, two_std double, total double")


def _forest_models(c, specs):
    """Forests of (trees, depth, subset, balanced), fitted once per session for all keys
    that use them; those not yet there are fitted side by side."""
    cache = c.__dict__.setdefault("_forests", {})
    new = [spec for spec in dict.fromkeys(specs) if spec not in cache]
    if new:
        tr = resampled_train(c)
        weighted = M.with_weights(tr) if any(balanced for *_, balanced in new) else None
        requests = [
            {"train": weighted if balanced else tr, "features": MODEL_FEATURES, "trees": trees, "depth": depth, "subset": subset,
             "weight": "weight" if balanced else None}
            for trees, depth, subset, balanced in new
        ]
        cache.update(zip(new, M.fit_forests(requests)))
    return [cache[spec] for spec in specs]


def _forest_model(c, trees, depth, subset, balanced):
    return _forest_models(c, [(trees, depth, subset, balanced)])[0]


@register("random_forest_fit")
def random_forest_fit(c):
    return M.predict(_forest_model(c, 1000, 30, M.sqrt_features(len(MODEL_FEATURES)), False), _test(c))


@register("rf_max_features_sweep")
def rf_max_features_sweep(c):
    te = _test(c)
    out = None
    models = _forest_models(c, [(1000, 30, str(k), False) for k in range(1, 6)])
    for k, model in enumerate(models, 1):
        p = E.savings_score(M.predict(model, te)).withColumn("max_features", F.lit(k))
        out = p if out is None else out.unionByName(p)
    return out


@register("rf_balanced")
def rf_balanced(c):
    return M.predict(_forest_model(c, 1000, 22, "5", True), _test(c))


# Trees and depth of the study's segment forests, with five features a split.
SEGMENT_FORESTS = {"residential": (100, 20), "landlord_builder": (8, 5), "other": (20, 5)}
BALANCED_FORESTS = {"residential": 100, "landlord_builder": 5, "other": 20}
DEFAULT_FORESTS = {"residential": 1000, "landlord_builder": 8, "other": 20}


def _segment_train(c, segment: str):
    """Re-sampled training rows of a segment; those of all segments are drawn in one pass and written once per session."""
    from churnscope.sources.csv_io import stage_table

    cache = c.__dict__.setdefault("_segment_inputs", {})
    if not cache:
        rows = _train(c).withColumn("label_i", F.col("label").cast("int"))
        drawn = stage_table(R.resample_by_segment(rows, "label_i", "segment", SEGMENT_SIZES, key=ORDER), "segment_train")
        cache.update({seg: drawn.filter(F.col("segment") == seg) for seg in SEGMENT_SIZES})
    return cache[segment]


@register("rf_by_segment")
def rf_by_segment(c):
    """Two forests per segment: at the study's depth, and with balanced classes at full depth."""
    te = _test(c)
    keys, requests = [], []
    for seg, (trees, depth) in SEGMENT_FORESTS.items():
        tr = _segment_train(c, seg)
        common = {"features": MODEL_FEATURES, "subset": "5"}
        keys += [(seg, "depth"), (seg, "balanced")]
        requests += [
            {"train": tr, "trees": trees, "depth": depth, **common},
            {"train": M.with_weights(tr), "trees": BALANCED_FORESTS[seg], "depth": None, "weight": "weight", **common},
        ]
    out = None
    for (seg, variant), model in zip(keys, M.fit_forests(requests)):
        p = M.predict(model, te.filter(F.col("segment") == seg)).withColumns({"segment": F.lit(seg), "variant": F.lit(variant)})
        out = p if out is None else out.unionByName(p)
    return out


@register("segment_feature_importance")
def segment_feature_importance(c):
    """Importances of a forest of full depth per segment."""
    subset = M.sqrt_features(len(MODEL_FEATURES))
    models = M.fit_forests([{"train": _segment_train(c, seg), "features": MODEL_FEATURES, "trees": n, "subset": subset} for seg, n in DEFAULT_FORESTS.items()])
    rows = [(seg, f, x) for seg, model in zip(DEFAULT_FORESTS, models) for f, x in M.feature_importance(model)]
    return c.spark.createDataFrame(rows, "segment string, feature string, importance double")


@register("feature_importance")
def feature_importance(c):
    model = _forest_model(c, 1000, 30, M.sqrt_features(len(MODEL_FEATURES)), False)
    rows = M.feature_importance(model)
    return c.spark.createDataFrame(rows, "feature string, importance double")


@register("linear_svc")
def linear_svc(c):
    tr = resampled_train(c)
    model = M.fit(tr, MODEL_FEATURES, M.linear_svc(_n(tr), C=4.0))
    return M.predict(model, _test(c))


@register("svm_sweep")
def svm_sweep(c):
    """Test accuracy and confusion cells of a linear SVM for each C of the study's sweep."""
    tr = resampled_train(c)
    return M.svm_sweep(tr, _test(c), MODEL_FEATURES)


@register("predict_proba")
def predict_proba(c):
    return M.predict(_logistic_model(c), _test(c)).filter(F.col("prob").isNotNull())


@register("knn_classify")
def knn_classify(c):
    """k-NN (k = 1..11, uniform vote) of the test split against the re-sampled
    training rows; exact neighbours from the distance kernel of ``operators.neighbors``;
    ``best_k`` marks the k chosen by 5-fold cross-validation in money."""
    from churnscope.operators.neighbors import knn_best_k
    from churnscope.operators.neighbors import knn_classify as knn

    tr = resampled_train(c).withColumn("row_id", F.col("draw") * 2 + F.col("label_i"))
    best, _ = knn_best_k(tr, MODEL_FEATURES, k_values=range(1, 12), folds=5)
    # one query per test row (an agreement can carry two fan-out rows)
    qid = F.col("sa_id") * 4 + F.col("dnp_started_flag_number") * 2 + F.col("dnp_stopped_flag_number")
    te = _test(c).withColumn("query_id", qid)
    out = knn(tr, te, MODEL_FEATURES, k_values=range(1, 12), train_id="row_id", query_id="query_id", keep=("sa_id",))
    return out.withColumn("best_k", (F.col("k") == F.lit(best))).drop("query_id")


@register("lasso_select")
def lasso_select(c):
    mf = R.hash_split(c.active.select("sa_id", *STD_COLS, stopped_within(c.d, LABEL_HORIZON).cast("double").alias("stop")))
    return ST.lasso_select(mf.filter(F.col("is_test") == 0), mf.filter(F.col("is_test") == 1), STD_COLS, "stop")


@register("train_score_report")
def train_score_report(c):
    """Split -> re-sample -> forest -> predict on the test split -> money and report."""
    preds = M.predict(_forest_model(c, 1000, 30, M.sqrt_features(len(MODEL_FEATURES)), False), _test(c))
    money = E.savings_score(preds)
    report = E.classification_report(preds)
    return report.withColumn("savings_report", F.lit(money.first()["savings_report"]))
