"""Supervised learning with Spark MLlib: logistic regression, forests, linear SVM,
grid search scored in money, per-fold scores, importances, predictions.

MLlib aggregates gradients in distributed passes; the driver-side values are class
counts, model coefficients and per-fold scores.  Forests grow tree by tree on the
executors from counted training rows (``forest.py``), which the driver gathers and
broadcasts while they are at most ``GATHERED_BYTES``; beyond, MLlib's forest learner
aggregates tree statistics in distributed passes.
"""

from __future__ import annotations

import json
import math
import uuid
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.classification import LinearSVC, LogisticRegression, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.errors import AnalysisException
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from churnscope.functions.hashing import hash_bits
from churnscope.operators.evaluate import SAVINGS
from churnscope.operators.forest import TREE, TYPES, counted_rows, grow_batches, pack, packed, votes
from churnscope.session import checkpoint_dir
from churnscope.sources.csv_io import stage_table

# Spark trees are limited to depth 30; the study asks for 35 in places.
MAX_SPARK_DEPTH = 30
SEED = 50


class SavingsEvaluator(Evaluator):
    """Money score of predictions (larger is better) for model selection."""

    variant = Param(Params._dummy(), "variant", "cost matrix: report or scorer", typeConverter=TypeConverters.toString)

    def __init__(self, variant: str = "scorer", labelCol: str = "label", predictionCol: str = "prediction", copiesCol: str | None = None):
        super().__init__()
        self._setDefault(variant="scorer")
        self._set(variant=variant)
        self.labelCol, self.predictionCol, self.copiesCol = labelCol, predictionCol, copiesCol

    def _evaluate(self, dataset: DataFrame) -> float:
        m = SAVINGS[self.getOrDefault(self.variant)]
        y, p = F.col(self.labelCol), F.col(self.predictionCol)
        n = F.col(self.copiesCol) if self.copiesCol else F.lit(1)
        cells = {"tp": (y == 1) & (p == 1), "fp": (y == 0) & (p == 1), "fn": (y == 1) & (p == 0), "tn": (y == 0) & (p == 0)}
        row = dataset.agg(*[F.coalesce(F.sum(F.when(c, n)), F.lit(0)).alias(k) for k, c in cells.items()]).first()
        return float(sum(row[k] * w for k, w in m.items()))

    def isLargerBetter(self) -> bool:
        return True


def assembler(features: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="error")


def class_weights(df: DataFrame, label: str = "label") -> dict[int, float]:
    """Balanced weights n / (k * n_c) from a two-row aggregate."""
    counts = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    n, k = sum(counts.values()), len(counts)
    return {c: n / (k * m) for c, m in counts.items()}


def with_weights(df: DataFrame, label: str = "label", col: str = "weight") -> DataFrame:
    w = class_weights(df, label)
    expr = None
    for c, v in w.items():
        expr = F.when(F.col(label) == c, F.lit(v)) if expr is None else expr.when(F.col(label) == c, F.lit(v))
    return df.withColumn(col, expr.otherwise(F.lit(1.0)))


def logistic(n_rows: int, C: float = 1.0, penalty: str = "l2", weight: str | None = None) -> LogisticRegression:
    """liblinear's C-form as MLlib's mean-loss form: regParam = 1 / (C n)."""
    lr = LogisticRegression(
        featuresCol="features", labelCol="label", regParam=1.0 / (C * max(n_rows, 1)),
        elasticNetParam=1.0 if penalty == "l1" else 0.0, standardization=False, maxIter=100,
    )
    if weight:
        lr.setWeightCol(weight)
    return lr


# Fixed, so that the same rows and seed give the same forest whatever the heap and
# the cluster are.  In the learner memory decides how many nodes share a data pass, and with
# it which node draws which features; a sub-forest's trees and partitions decide its bags.
SPLIT_MEMORY_MB = 128
SUB_TREES = 125
ROWS_PER_PARTITION = 100_000


def forest(trees: int, depth: int | None = None, subset: str = "sqrt", weight: str | None = None, seed: int = SEED) -> RandomForestClassifier:
    """Random forest; deep trees train level by level, so node ids are cached
    (checkpointed every 10 levels) and more nodes are split per data pass.
    The engine grows no tree deeper than ``MAX_SPARK_DEPTH``; ask for at most that."""
    if (depth or 0) > MAX_SPARK_DEPTH:
        raise ValueError(f"depth {depth} is beyond the engine's limit of {MAX_SPARK_DEPTH}")
    rf = RandomForestClassifier(
        featuresCol="features", labelCol="label", numTrees=trees,
        maxDepth=depth or MAX_SPARK_DEPTH, featureSubsetStrategy=subset, seed=seed,
        cacheNodeIds=True, checkpointInterval=10, maxMemoryInMB=SPLIT_MEMORY_MB,
    )
    if weight:
        rf.setWeightCol(weight)
    return rf


def _tree_arrays(path: str, spark):
    """The trees that the learner saved at ``path``, in their order, as ``pack`` lays them out."""
    nodes = spark.read.parquet(f"{path}/data").select(
        "treeID", "nodeData.id", "nodeData.leftChild", "nodeData.rightChild", "nodeData.split.featureIndex", "nodeData.split.numCategories",
        F.get("nodeData.split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"), "nodeData.impurityStats",
    )
    t = nodes.toArrow().sort_by([("treeID", "ascending"), ("id", "ascending")])
    col = {n: t[n].to_numpy() for n in t.column_names if n != "impurityStats"}
    inner = col["leftChild"] >= 0
    if (col["numCategories"][inner] >= 0).any():
        raise ValueError(f"{path}: a split on categories; features are numbers")
    stats = t["impurityStats"].combine_chunks().flatten().to_numpy().reshape(len(t), -1)
    first = np.flatnonzero(np.diff(col["treeID"], prepend=-1))  # node 0 of a tree is its root; ids leave no gap
    root = np.repeat(first, np.diff(first, append=len(t)))
    # the children of a node side by side: the roots, then every pair in the order of the parents
    place = np.zeros(len(t), dtype=np.int64)
    place[first] = np.arange(len(first))
    pair = len(first) + 2 * np.arange(inner.sum())
    place[(root + col["leftChild"])[inner]], place[(root + col["rightChild"])[inner]] = pair, pair + 1
    order, child = np.argsort(place), np.zeros(len(t), dtype=np.int64)
    child[inner] = pair
    inner = inner[order]
    feature = np.where(inner, col["featureIndex"][order], -1)
    return pack(feature, child[order], col["threshold"][order][inner].astype(float), stats[order][~inner], list(range(len(first))))


def _part_arrays(path: str, spark):
    try:
        return packed(spark.read.parquet(f"{path}/trees").select("tree", "node", "shares", "cuts").toArrow())
    except AnalysisException:
        return _tree_arrays(path, spark)


def _grown(path: str, spark) -> tuple[str, int, np.ndarray] | None:
    """Folder, number of trees and importances of a finished sub-forest; none where there is no such."""
    try:
        trees = spark.read.parquet(f"{path}/trees").select("tree", "importance").toArrow().sort_by("tree")
    except AnalysisException:  # not there, or not finished
        return None
    each = np.stack([np.frombuffer(b, dtype=float) for b in trees["importance"].to_pylist()]).sum(axis=0)
    return path, len(trees), each / each.sum() if each.sum() else each


def _learned(path: str) -> tuple[str, int, np.ndarray] | None:
    """The same of a sub-forest that the learner fitted."""
    try:
        model = RandomForestClassificationModel.load(path)
    except (AnalysisException, Py4JJavaError):
        return None
    return path, model.getNumTrees, model.featureImportances.toArray()


def _learners_model(path: str, width: int, spark) -> RandomForestClassificationModel:
    """A grown sub-forest as the learner's model: its nodes are written beside the trees in the learner's layout."""
    rows = spark.read.parquet(f"{path}/trees").toArrow().sort_by("tree").to_pylist()
    nodes, classes, cuts = [], 0, rows[0]["cuts"]
    for r in rows:
        t = {k: np.frombuffer(r[k], dtype=v) for k, v in TYPES.items()}
        node, n = t["node"], len(t["node"])
        leaf, child, number, feature = node < 0, (node >> 32).tolist(), (node >> 16 & 0xFFFF).tolist(), (node & 0xFFFF).tolist()
        classes = len(t["stats"]) // len(t["raw"])
        stats, raw = np.zeros((n, classes)), np.zeros(n, dtype=np.int64)
        stats[leaf], raw[leaf] = t["stats"].reshape(-1, classes), t["raw"]
        for i in reversed(np.flatnonzero(~leaf).tolist()):  # children come after their parent
            stats[i], raw[i] = stats[child[i] : child[i] + 2].sum(axis=0), raw[child[i] : child[i] + 2].sum()
        weight = stats.sum(axis=1)
        impurity = 1 - (np.divide(stats, weight[:, None], out=np.zeros_like(stats), where=weight[:, None] != 0) ** 2).sum(axis=1)
        for i in range(n):
            c = child[i]
            gain = -1.0 if leaf[i] else impurity[i] - (weight[c : c + 2] * impurity[c : c + 2]).sum() / weight[i]
            split = (-1, [], -1) if leaf[i] else (feature[i], [cuts[feature[i]][number[i]]], -1)
            kids = (-1, -1) if leaf[i] else (c, c + 1)
            nodes.append((r["tree"], (i, float(stats[i].argmax()), float(impurity[i]), stats[i].tolist(), int(raw[i]), float(gain), *kids, split)))
    split = "struct<featureIndex:int,leftCategoriesOrThreshold:array<double>,numCategories:int>"
    node = f"struct<id:int,prediction:double,impurity:double,impurityStats:array<double>,rawCount:bigint,gain:double,leftChild:int,rightChild:int,split:{split}>"
    spark.createDataFrame(nodes, f"treeID int, nodeData {node}").write.mode("overwrite").parquet(f"{path}/data")

    def about(kind: str, name: str, params: dict, **more) -> str:
        head = {"class": f"org.apache.spark.ml.classification.{kind}", "timestamp": 0, "sparkVersion": spark.version, "uid": name}
        return json.dumps({**head, "paramMap": {"impurity": "gini", **params}, "defaultParamMap": {}, **more})

    shape = {"numFeatures": width, "numClasses": classes}
    trees = [(r["tree"], about("DecisionTreeClassificationModel", f"dtc_{uuid.uuid4().hex[:12]}", {}, **shape), 1.0) for r in rows]
    spark.createDataFrame(trees, "treeID int, metadata string, weights double").write.mode("overwrite").parquet(f"{path}/treesMetadata")
    whole = about("RandomForestClassificationModel", f"RandomForestClassifier_{uuid.uuid4().hex[:12]}", {"numTrees": len(rows)}, numTrees=len(rows), **shape)
    spark.createDataFrame([(whole,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")
    return RandomForestClassificationModel.load(path)


def _union_votes(sent, features: list[str]):
    """Appends the mean of the trees' class probabilities; the last columns of a batch are the features."""

    def run(batches):
        for batch in batches:
            own = batch.num_columns - len(features)
            x = np.stack([np.asarray(c.fill_null(np.nan)) for c in batch.columns[own:]], axis=1)
            if np.isnan(x).any():
                raise ValueError(f"NULL or NaN among the features {features}")
            mean = sum(share * votes(part.value, x) for share, part in sent)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * mean.shape[1]), pa.array(mean.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:own], lists], names=[*batch.schema.names[:own], "_mean"])

    return run


def _likeliest():
    return (F.array_position("_mean", F.array_max("_mean")) - 1).cast("double")


class ForestUnion:
    """Sub-forests as one forest: every tree has one vote, whichever part grew it.

    ``saved`` holds of every sub-forest its folder, number of trees and importances.
    A part is a few arrays, read from its folder and broadcast once.
    """

    def __init__(self, features: list[str], saved: list[tuple[str, int, np.ndarray]]):
        self.features, self.saved = features, saved
        self.trees = sum(n for _, n, _ in saved)
        self._sent = None

    @property
    def parts(self) -> list[RandomForestClassificationModel]:
        """The learner's models, loaded from their folders; a grown part is first written there in the learner's layout."""
        spark = SparkSession.active()
        return [_learners_model(folder, len(self.features), spark) if _grown(folder, spark) else RandomForestClassificationModel.load(folder)
                for folder, _, _ in self.saved]

    @property
    def featureImportances(self) -> list[float]:
        """Mean of the trees' importances, in the order of ``features``."""
        return sum(n / self.trees * x for _, n, x in self.saved).tolist()

    def shares(self, df: DataFrame, keep: list[str]) -> DataFrame:
        """The columns ``keep`` of ``df`` and ``_mean``, the mean of the trees' class probabilities."""
        spark = df.sparkSession
        if self._sent is None:

            def send(part):
                return part[1] / self.trees, spark.sparkContext.broadcast(_part_arrays(part[0], spark))

            with ThreadPoolExecutor(2) as pool:  # a part at a time each; the driver holds few
                self._sent = list(pool.map(inheritable_thread_target(spark)(send), self.saved))
        wide = df.select(*[F.col(f"`{c}`") for c in keep], *[F.col(f).cast("double").alias(f"_x{i}") for i, f in enumerate(self.features)])
        # few rows of many trees each: the rows are dealt to all cores
        wide = wide.repartition(2 * spark.sparkContext.defaultParallelism)
        schema = StructType([*[df.schema[c] for c in keep], StructField("_mean", ArrayType(DoubleType()))])
        return wide.mapInArrow(_union_votes(self._sent, self.features), schema)

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``probability`` (mean of the trees') and ``prediction`` (the likeliest class, the smaller one on a tie)."""
        out = assembler(self.features).transform(self.shares(df, df.columns))
        return out.withColumn("probability", array_to_vector("_mean")).withColumn("prediction", _likeliest()).drop("_mean")


GATHERED_BYTES = 64 << 20  # distinct training rows that are counted on the driver
KINDS = 64  # labels and weights of a training set that a tree counts apart
TREES_PER_TASK = 5


def _counted(train: DataFrame, features: list[str], weight: str | None):
    """The training rows as ``forest.counted_rows`` broadcast, or none where they are too many."""
    spark = train.sparkSession
    own = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = train.select(F.col("label").cast("double").alias("_y"), own.alias("_w"), *[F.col(f).cast("double").alias(f"_x{i}") for i, f in enumerate(features)])
    rows = stage_table(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_n")), "forest_rows")
    if rows.count() * 8 * (len(features) + 3) > GATHERED_BYTES or rows.select("_y", "_w").distinct().limit(KINDS + 1).count() > KINDS:
        return None
    t = rows.toArrow()
    y, w, *x = [np.asarray(t[c].fill_null(np.nan) if t[c].null_count else t[c], dtype=float) for c in t.column_names[:-1]]
    return spark.sparkContext.broadcast(counted_rows(np.stack(x, axis=1), y, w, t["_n"].to_numpy()))


def fit_forests(requests: list[dict]) -> list[ForestUnion]:
    """Forests of any number of trees as sub-forests of ``SUB_TREES``, each with a seed of
    its own, fitted by concurrent jobs and saved in the shared folder.  A request holds
    the arguments of ``fit_forest``.

    The training rows are counted and broadcast once a training set, and every task
    grows whole trees from them (``operators.forest``).  Where the distinct rows are
    beyond ``GATHERED_BYTES`` the learner fits a sub-forest in distributed passes: it
    sends the statistics of every open node from every partition to one place, so
    it reads the rows in partitions of ``ROWS_PER_PARTITION``, and the cores are kept
    busy by the sub-forests of all forests.  A request with the ``folder`` of an
    interrupted one loads the sub-forests that it had finished.
    """
    spark = requests[0]["train"].sparkSession
    counted = {}

    def plan(train: DataFrame, features: list[str], trees: int, depth: int | None = None, subset: str = "sqrt",
             weight: str | None = None, folder: str | None = None):
        folder = folder or f"{checkpoint_dir(spark).rstrip('/')}/forests/{uuid.uuid4().hex}"
        key = (id(train), tuple(features), weight)
        if key not in counted:
            counted[key] = _counted(train, features, weight)
        sent, rows, partitions = counted[key], None, 1
        if sent is None:
            partitions = max(1, -(-train.count() // ROWS_PER_PARTITION))
            rows = assembler(features).transform(train).select("features", "label", *([weight] if weight else [])).coalesce(partitions)

        def part(i: int) -> tuple[str, int, np.ndarray]:
            path = f"{folder}/part-{i}"
            found = _grown(path, spark) or (_learned(path) if sent is None else None)
            if found:
                return found
            spec = forest(min(SUB_TREES, trees - i * SUB_TREES), depth, subset, weight, SEED + i)
            if sent is None:
                spec.fit(rows).write().overwrite().save(path)
                return _learned(path)
            n = spec.getNumTrees()
            run = grow_batches(sent, spec.getSeed(), spec.getMaxDepth(), drawn_features(spec.getFeatureSubsetStrategy(), len(features), trees))
            numbers = spark.range(0, n, 1, -(-n // TREES_PER_TASK)).select(F.col("id").cast("int").alias("tree"))
            numbers.mapInArrow(run, TREE).write.mode("overwrite").parquet(f"{path}/trees")
            return _grown(path, spark)

        return features, partitions, part, -(-trees // SUB_TREES)

    plans = [plan(**r) for r in requests]
    threads = max(1, spark.sparkContext.defaultParallelism // max(partitions for _, partitions, _, _ in plans))
    with ThreadPoolExecutor(threads) as pool:
        fits = [[pool.submit(inheritable_thread_target(spark)(part), i) for i in range(n)] for _, _, part, n in plans]
        return [ForestUnion(features, [f.result() for f in own]) for own, (features, *_) in zip(fits, plans)]


def fit_forest(train: DataFrame, features: list[str], trees: int, depth: int | None = None, subset: str = "sqrt",
               weight: str | None = None, folder: str | None = None) -> ForestUnion:
    """One forest of ``fit_forests``."""
    request = {"train": train, "features": features, "trees": trees, "depth": depth, "subset": subset, "weight": weight, "folder": folder}
    return fit_forests([request])[0]


def drawn_features(subset: str, width: int, trees: int) -> int:
    """Features that a node draws, by the learner's names: all, sqrt, log2, onethird, auto, a number or a share."""
    subset = subset.lower()
    if subset == "auto":
        subset = "sqrt" if trees > 1 else "all"
    named = {"all": width, "sqrt": math.ceil(math.sqrt(width)), "log2": math.ceil(math.log2(width)), "onethird": math.ceil(width / 3)}
    if subset in named:
        return max(1, named[subset])
    if subset.isdigit():
        return min(int(subset), width)
    return math.ceil(float(subset) * width)


def linear_svc(n_rows: int, C: float = 4.0) -> LinearSVC:
    return LinearSVC(featuresCol="features", labelCol="label", regParam=1.0 / (C * max(n_rows, 1)), maxIter=1000)


def svm_sweep(train: DataFrame, test: DataFrame, features: list[str], Cs=(0.01, 0.1, 1.0, 10.0, 100.0)) -> DataFrame:
    """C, accuracy and confusion cells on ``test`` of a linear SVM for every C, fitted
    on the distinct training rows with their copies as weights."""
    n = train.count()
    rows = stage_table(distinct_rows(train, features).coalesce(max(1, -(-n // ROWS_PER_PARTITION))), "svm_rows")
    out = None
    for C in Cs:
        p = predict(fit(rows, features, linear_svc(n, C).setWeightCol("copies")), test)
        y, z = F.col("label"), F.col("pred")
        cells = [F.count_if((y == a) & (z == b)).alias(f"actual{a}_pred{b}") for a in (0, 1) for b in (0, 1)]
        part = p.agg(*cells, F.avg((y == z).cast("double")).alias("accuracy")).withColumn("C", F.lit(C))
        out = part if out is None else out.unionByName(part)
    return out


def sqrt_features(n: int) -> str:
    """sklearn's ``max_features='sqrt'`` (floor); Spark's ``sqrt`` rounds up."""
    return str(max(1, int(math.sqrt(n))))


def fit(train: DataFrame, features: list[str], estimator):
    return Pipeline(stages=[assembler(features), estimator]).fit(train)


def predict(model, df: DataFrame, key: str = "sa_id") -> DataFrame:
    """(key, label, pred, prob) -- prob is the stop-class probability when the model has one."""
    if isinstance(model, ForestUnion):  # only what is asked for goes through Python
        out = model.shares(df, [key, "label"])
        return out.select(key, "label", _likeliest().cast("int").alias("pred"), F.col("_mean")[1].alias("prob"))
    out = model.transform(df)
    prob = (
        vector_to_array(F.col("probability"))[1] if "probability" in out.columns else F.lit(None).cast("double")
    )
    return out.select(key, "label", F.col("prediction").cast("int").alias("pred"), prob.alias("prob"))


def fold_column(df: DataFrame, folds: int, key: str = "sa_id", col: str = "fold") -> DataFrame:
    """Fold by a hash of the key, so copies of one re-sampled row stay in one fold."""
    return df.withColumn(col, (hash_bits(F.col(key), "fold:") % F.lit(folds)).cast("int"))


def distinct_rows(train: DataFrame, features: list[str], key: str = "sa_id", label: str = "label", copies: str = "copies") -> DataFrame:
    """The distinct rows of a re-sampled training set with their number of copies.

    A loss that is a sum over rows is the same sum over distinct rows with the
    copies as weights, so a learner without bagging finds the same solution.
    """
    return train.groupBy(key, label, *features).agg(F.count(F.lit(1)).cast("double").alias(copies))


def grid_search(train: DataFrame, features: list[str], folds: int = 5, balanced: bool = False,
                Cs=(1.0, 100.0, 10000.0), penalties=("l1", "l2"), parallelism: int = 4):
    """Grid over C and penalty, k folds on the key, scored by the savings scorer; refit best.

    Fitted on the distinct rows with their copies as weights; the weighted rows
    are stored, since every fit passes over them many times.
    """
    n = train.count()
    rows = distinct_rows(train, features)
    data = fold_column(rows, folds).withColumn("weight", F.col("copies"))
    if balanced:
        total = {r["label"]: r["m"] for r in rows.groupBy("label").agg(F.sum("copies").alias("m")).collect()}
        share = F.create_map(*[F.lit(float(x)) for c, m in total.items() for x in (c, n / (len(total) * m))])
        data = data.withColumn("weight", F.col("copies") * share[F.col("label").cast("double")])
    data = stage_table(data.repartition(max(1, -(-n // ROWS_PER_PARTITION)), "sa_id"), "grid_rows")
    lr = logistic(n, weight="weight")
    grid = (
        ParamGridBuilder()
        .addGrid(lr.regParam, [1.0 / (C * n) for C in Cs])
        .addGrid(lr.elasticNetParam, [1.0 if p == "l1" else 0.0 for p in penalties])
        .build()
    )
    cv = CrossValidator(
        estimator=Pipeline(stages=[assembler(features), lr]), estimatorParamMaps=grid,
        evaluator=SavingsEvaluator("scorer", copiesCol="copies"), foldCol="fold", numFolds=folds, parallelism=parallelism,
    )
    return cv.fit(data), grid


def cv_scores(df: DataFrame, features: list[str], estimator_factory, folds: int = 5, variant: str = "scorer") -> list[float]:
    """Score of the model on each fold after fitting on the other folds."""
    data = fold_column(df, folds)
    scores = []
    for k in range(folds):
        tr, te = data.filter(F.col("fold") != k), data.filter(F.col("fold") == k)
        model = fit(tr, features, estimator_factory(tr.count()))
        scores.append(SavingsEvaluator(variant).evaluate(model.transform(te)))
    return scores


def feature_importance(model: ForestUnion) -> list[tuple[str, float]]:
    return sorted(zip(model.features, model.featureImportances), key=lambda t: -t[1])
