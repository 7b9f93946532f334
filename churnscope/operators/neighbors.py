"""Exact k-nearest-neighbour classification by a blocked distance kernel.

The distinct training rows, with their copy counts, are cut into blocks of at
most ``BLOCK_BYTES``; a re-sampled training set of fixed size is one block.  A
block is broadcast as boxes of near rows, and every Arrow batch of queries is compared
with the boxes that may hold one of its k nearest, by a matrix product a box.  The
product gives squared distances up to a known rounding error: the rows that may
be among the k nearest within it (never fewer than k) get their exact distance, and
the k nearest are kept.  Where the features do not tell the boxes apart, all
boxes are compared, which is the plain search.  Queries are never
shuffled and no (query, training row) pair leaves a task; only with several
blocks are the lists of at most k rows per query and block brought together.

Order: distance, then the smallest training id of a row's copies.  Training rows
repeated by re-sampling are searched once and carry their copy count.

A training row with a NULL feature is at no distance and never a neighbour; a
query with one has no neighbours; an empty training set gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnscope.sources.csv_io import stage_table

BLOCK_BYTES = 64 << 20
BOX = 256  # training rows of one box
COLUMNS = 6  # the widest columns; a distance to a box is bounded by them
QUERIES = 2048  # queries searched together
PAIRS = 1 << 22  # (query, row) pairs held at once, unless a few queries have more
FEW = 64


def _boxes(x: np.ndarray) -> list[np.ndarray]:
    """The numbers of the rows of ``x`` in parts of at most ``BOX``, halved at the median of their widest column."""
    done, waiting = [], [np.arange(len(x))]
    while waiting:
        rows = waiting.pop()
        if len(rows) <= BOX:
            done.append(rows)
            continue
        own = x[rows]
        half = np.argpartition(own[:, np.argmax(own.max(axis=0) - own.min(axis=0))], len(rows) // 2)
        waiting += [rows[half[: len(rows) // 2]], rows[half[len(rows) // 2 :]]]
    return done


def index(x: np.ndarray):
    """Training rows for ``nearest``: the rows, their boxes (numbers of the rows, centre, rows and
    squared lengths from the centre) and the lower and upper corners of the boxes."""
    boxes = []
    for rows in _boxes(x) if len(x) else []:
        centre = x[rows].mean(axis=0)
        off = x[rows] - centre
        boxes.append((rows, centre, off, (off * off).sum(axis=1)))
    corners = [np.array([getattr(x[b[0]], end)(axis=0) for b in boxes]).reshape(len(boxes), x.shape[1]) for end in ("min", "max")]
    return x, boxes, *corners, np.argsort(-x.std(axis=0), kind="stable")[:COLUMNS]


def _exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distances of paired rows; squares are added feature by feature, as a SQL sum would."""
    total = np.zeros(len(x))
    for j in range(x.shape[1]):
        total += (x[:, j] - q[:, j]) ** 2
    return np.sqrt(total)


def _candidates(rows, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Pairs (query, row) that hold every row at most as far as a query's k-th nearest;
    none if there are more than ``PAIRS`` and the queries can be halved.

    A box farther from a query than its k nearest rows found so far is not looked at: the
    nearest box first, then all others by the distance to their corners.  A product
    of vectors from the box's centre gives squared distances up to a known error.
    """
    x, boxes, low, high, wide = rows
    least = np.zeros((len(q), len(boxes)))
    for j in wide:
        out = np.maximum(low[:, j] - q[:, j, None], q[:, j, None] - high[:, j])
        np.maximum(out, 0, out=out)
        least += out * out
    least *= 1 - 1e-12  # its own rounding
    upper = np.full((len(q), k), np.inf)  # squared distances of the k nearest so far, each at most this
    bound = np.full(len(q), np.inf)  # the largest of them
    found = []

    def look(at: np.ndarray, box) -> None:
        numbers, centre, off, size = box
        own = q[at] - centre
        length = (own * own).sum(axis=1)
        d = length[:, None] + size - 2.0 * (own @ off.T)
        error = 8 * (q.shape[1] + 4) * np.finfo(float).eps * (length + size.max())[:, None]
        upper[at] = best = np.partition(np.concatenate([upper[at], d + error], axis=1), k - 1, axis=1)[:, :k]
        bound[at] = best.max(axis=1)
        row, col = np.nonzero(d - error <= bound[at, None])
        found.append((at[row], numbers[col], (d - error)[row, col]))

    first = least.argmin(axis=1)
    order = np.argsort(first, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(first[order])) + 1):
        look(at, boxes[first[at[0]]])
    held = sum(len(row) for row, *_ in found)
    for b in range(len(boxes)):
        at = np.flatnonzero((least[:, b] <= bound) & (first != b))
        if len(at):
            look(at, boxes[b])
            held += len(found[-1][0])
        if held > PAIRS and len(q) > FEW:
            return None
    row, col, d = (np.concatenate(v) for v in zip(*found))
    kept = d <= bound[row]
    return row[kept], col[kept]


def nearest(rows, tid: np.ndarray, copies: np.ndarray, q: np.ndarray, k: int):
    """Of every row of ``q`` its nearest rows of the ``index`` until they hold ``k`` copies:
    query number, row number, distance, copies of the nearer rows."""
    pairs = _candidates(rows, q, k) if len(q) else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
    if pairs is None:
        half = len(q) // 2
        one, two = nearest(rows, tid, copies, q[:half], k), nearest(rows, tid, copies, q[half:], k)
        return (np.concatenate([one[0], two[0] + half]), *(np.concatenate(v) for v in zip(one[1:], two[1:])))
    row, col = pairs
    dist = _exact(rows[0][col], q[row])
    order = np.lexsort((tid[col], dist, row))
    row, col, dist = row[order], col[order], dist[order]
    before = np.cumsum(copies[col]) - copies[col]
    first = np.searchsorted(row, np.arange(len(q)))
    before -= before[np.minimum(first, max(len(row) - 1, 0))][row] if len(row) else 0
    keep = before < k
    return row[keep], col[keep], dist[keep], before[keep]


NEAR = "array<struct<d:double,tid:long,y:double,m:long,before:long>>"


def _kernel(sent, k: int, width: int):
    """Appends the list of nearest rows; the last ``width`` columns are the query's features."""

    def run(batches):
        rows, y, tid, copies = sent.value
        for batch in batches:
            other = batch.num_columns - width
            q = np.stack([np.asarray(c.cast(pa.float64()).fill_null(np.nan)) for c in batch.columns[other:]], axis=1)
            for a in range(0, len(q), QUERIES):
                part = batch.slice(a, QUERIES)
                whole = np.flatnonzero(~np.isnan(q[a : a + QUERIES]).any(axis=1))
                row, col, dist, before = nearest(rows, tid, copies, q[a : a + QUERIES][whole], k)
                counts = np.bincount(whole[row], minlength=part.num_rows)
                near = pa.StructArray.from_arrays(
                    [pa.array(dist), pa.array(tid[col]), pa.array(y[col]), pa.array(copies[col]), pa.array(before)], names=["d", "tid", "y", "m", "before"]
                )
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), near)
                yield pa.RecordBatch.from_arrays([*part.columns[:other], lists], names=[*part.schema.names[:other], "near"])

    return run


def nearest_lists(train: DataFrame, test: DataFrame, features: list[str], k: int, train_id: str, keep: list[str],
                  label: str = "label") -> DataFrame:
    """The columns ``keep`` of every row of ``test`` (they identify it) and ``near``: its
    nearest distinct training rows by distance, then id, until their copies reach ``k``."""
    spark = train.sparkSession
    t = train.select(F.col(train_id).cast("long").alias("_tid0"), F.col(label).cast("double").alias("_y"),
                     *[F.col(f).cast("double").alias(f) for f in features]).dropna(subset=features)
    t = stage_table(t.groupBy("_y", *features).agg(F.min("_tid0").alias("_tid"), F.count(F.lit(1)).alias("_m")), "knn_train")
    blocks = -(-t.count() * 8 * (len(features) + 3) // BLOCK_BYTES)
    q = test.select(*keep, *[F.col(f).cast("double").alias(f"_q_{f}") for f in features])
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in q.schema.fields[: len(keep)]) + f", near {NEAR}"
    found = None
    for block in range(blocks):
        part = t.filter(F.pmod(F.xxhash64("_tid"), F.lit(blocks)) == block).toPandas()  # about BLOCK_BYTES
        if not len(part):
            continue
        sent = spark.sparkContext.broadcast(
            (index(part[features].to_numpy(dtype=float)), part["_y"].to_numpy(dtype=float), part["_tid"].to_numpy(dtype=np.int64), part["_m"].to_numpy(dtype=np.int64))
        )
        near = q.mapInArrow(_kernel(sent, k, len(features)), ddl)
        found = near if found is None else found.unionByName(near)
    if found is None:
        return spark.createDataFrame([], ddl)
    if blocks > 1:
        found = found.groupBy(*keep).agg(F.array_sort(F.flatten(F.collect_list("near"))).alias("near"))
        before = F.transform("near", lambda x, i: x.withField("before", F.aggregate(F.slice("near", F.lit(1), i), F.lit(0).cast("long"), lambda s, y: s + y["m"])))
        found = found.withColumn("near", F.filter(before, lambda x: x["before"] < k))
    return found


def knn_neighbours(train: DataFrame, test: DataFrame, features: list[str], k: int, train_id: str, query_id: str,
                   label: str = "label") -> DataFrame:
    """For every query, the distinct training rows that make up its k nearest
    neighbours: (query id, rank, label, distance, weight), where ``weight`` is
    how many copies of that row fall among the k nearest."""
    found = nearest_lists(train, test, features, k, train_id, [query_id], label)
    return found.select(query_id, F.posexplode("near").alias("nb", "n")).select(
        query_id, (F.col("nb") + 1).alias("nb"), F.col("n.y").alias("nb_label"), F.col("n.d").alias("distance"),
        F.least(F.col("n.m"), F.lit(k) - F.col("n.before")).alias("weight"), F.col("n.before").alias("_before"),
    )


def knn_classify(train: DataFrame, test: DataFrame, features: list[str], k_values=range(1, 12), train_id: str = "row_id",
                 query_id: str = "sa_id", label: str = "label", keep: tuple[str, ...] = ()) -> DataFrame:
    """Uniform-vote k-NN for every k of ``k_values`` in one neighbour search:
    (query, k, prob = share of stop neighbours, pred = prob > 0.5, label) and the
    columns ``keep`` of ``test``."""
    columns = [query_id, label, *keep]
    found = nearest_lists(train, test, features, max(k_values), train_id, columns, label).filter(F.size("near") > 0)
    found = found.withColumn("k", F.explode(F.array(*[F.lit(k) for k in k_values])))
    # copies of a row counted among the k nearest: between 0 and all of them
    votes = F.aggregate("near", F.lit(0.0), lambda s, x: s + x["y"] * F.greatest(F.lit(0), F.least(x["m"], F.col("k") - x["before"])))
    out = found.withColumn("prob", votes / F.col("k"))
    return out.select(query_id, "k", F.col(label).cast("double").alias("label"), (F.col("prob") > 0.5).cast("int").alias("pred"), "prob", *keep)


def knn_best_k(train: DataFrame, features: list[str], k_values=range(1, 12), folds: int = 5, group_key: str = "sa_id",
               train_id: str = "row_id", label: str = "label") -> tuple[int, list[tuple[int, float]]]:
    """k chosen by k-fold cross-validation on the training rows, scored in money
    (100 per stop found, -10 per stop missed: the study's search scorer).

    Folds are a hash of ``group_key``, so copies of one re-sampled row never sit
    on both sides of a fold; each fold's distinct rows are the queries, weighted
    by their copy count.  Returns the best k (ties to the smaller k) and the
    per-k totals.
    """
    from churnscope.functions.hashing import hash_bits

    tr = train.withColumn("_fold", (hash_bits(F.col(group_key), "fold:") % F.lit(folds)).cast("int"))
    totals: dict[int, float] = {k: 0.0 for k in k_values}
    for f in range(folds):
        held = tr.filter(F.col("_fold") == f)
        queries = held.groupBy(F.col(label).cast("double").alias(label), *features).agg(
            F.min(train_id).alias("_qid"), F.count(F.lit(1)).alias("_copies")
        )
        preds = knn_classify(tr.filter(F.col("_fold") != f), queries, features, k_values, train_id, "_qid", label, ("_copies",))
        scored = preds.groupBy("k").agg(
            F.sum(
                F.col("_copies")
                * (F.when((F.col("label") == 1) & (F.col("pred") == 1), 100).when(F.col("label") == 1, -10).otherwise(0))
            ).alias("s")
        )
        for r in scored.collect():  # one row per k
            totals[r["k"]] += float(r["s"])
    best = max(sorted(totals), key=lambda k: totals[k])
    return best, sorted(totals.items())
