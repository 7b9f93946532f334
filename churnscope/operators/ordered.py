"""Skew-safe ordered scans: LAG within a key and global running sums.

A ``Window.partitionBy(key)`` puts every row of a key into one task; when one
premise or person holds a third of all rows that task is the job.  ``ordered_lag``
cuts every key into segments along the order and carries the last row of one to
the first row of the next.

Global running sums range-partition the rows on the order; each partition is
scanned in order by an Arrow batch function, and the only cross-partition
information is a table with one row per partition (its size is bounded by the
partition count, so broadcasting it is safe).  The range-partitioned, sorted rows
are checkpointed to the session's checkpoint directory before the scan: partition
ids and row order must be stable between the scan and its boundary fix-up, also
when a task is retried on another executor.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnscope.session import checkpoint_dir
from churnscope.sources.csv_io import stage_table

PID = "_cs_pid"
SEGMENT, PREVIOUS, CARRY = "_cs_segment", "_cs_previous", "_cs_carry"


def stable_checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (shared folder) that computes its input only once.

    Writing a checkpoint re-runs the plan unless it is persisted, so the input is
    persisted (memory, spilling to disk) for the duration of the write.
    """
    checkpoint_dir(df.sparkSession)
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    out = kept.checkpoint(eager=True)
    kept.unpersist()
    return out


def range_sorted(df: DataFrame, order_cols: list, n: int | None = None) -> DataFrame:
    """Range-partition and sort on ``order_cols``; checkpoint; tag partition ids.

    Without an explicit ``n`` the partition count is left to AQE, which merges
    adjacent (hence still ordered) small ranges.
    """
    ranged = df.repartitionByRange(n, *order_cols) if n else df.repartitionByRange(*order_cols)
    ranged = ranged.sortWithinPartitions(*order_cols)
    return stable_checkpoint(ranged).withColumn(PID, F.spark_partition_id())


def ordered_lag(
    df: DataFrame, key: str, order_cols: list[str], values: dict[str, str], skew_safe: bool = True, segment=None,
    stored: DataFrame | None = None,
) -> DataFrame:
    """``LAG(v, 1) OVER (PARTITION BY key ORDER BY order_cols)`` for each ``v -> out``.

    ``order_cols`` must make the order total within a key (add a unique id as
    the last tie-break).  Rows with a NULL key get NULL.

    A segmented scan with carry: the window runs inside (key, segment), where
    ``segment`` is a column that never falls along the order (by default the
    calendar month of the first order column), so a key of a third of all rows
    spans as many tasks as it has months.  The first row of a segment takes the
    last row of the key's segment before, from a table with one row per key and
    segment; per key that table is no longer than the calendar.  All keys take
    this path, nothing is collected or checkpointed.  ``skew_safe=False`` is the
    plain window over the key.
    """
    if not skew_safe:
        w = Window.partitionBy(key).orderBy(*order_cols)
        return df.select("*", *[F.when(F.col(key).isNotNull(), F.lag(v, 1).over(w)).alias(o) for v, o in values.items()])
    if segment is None:  # NULL comes first in the order
        segment = F.coalesce(F.trunc(order_cols[0], "MM"), F.lit("0001-01-01").cast("date"))
    own = F.struct(*values)
    w = Window.partitionBy(key, SEGMENT).orderBy(*order_cols)
    inside = df.withColumn(SEGMENT, segment).select("*", F.lag(own, 1).over(w).alias(PREVIOUS))
    ends = (df if stored is None else stored).filter(F.col(key).isNotNull()).groupBy(key, segment.alias(SEGMENT))
    ends = ends.agg(F.max_by(own, F.struct(*order_cols)).alias(PREVIOUS))
    before = Window.partitionBy(key).orderBy(SEGMENT)  # one row per segment
    carry = ends.select(key, SEGMENT, F.lag(PREVIOUS, 1).over(before).alias(CARRY)).filter(F.col(CARRY).isNotNull())
    joined = inside.join(carry, [key, SEGMENT], "left").withColumn(PREVIOUS, F.coalesce(PREVIOUS, CARRY))
    return joined.select(*df.columns, *[F.when(F.col(key).isNotNull(), F.col(f"{PREVIOUS}.{v}")).alias(o) for v, o in values.items()])


def _cumsum_batches(values: list[str], outs: list[str]):
    def scan(batches):
        run = {v: 0 for v in values}
        for pdf in batches:
            for v, o in zip(values, outs):
                cs = pdf[v].fillna(0).cumsum() + run[v]
                pdf[o] = cs
                if len(cs):
                    run[v] = cs.iloc[-1]
            yield pdf

    return scan


def running_sum(
    df: DataFrame, order_cols: list[str], values: dict[str, str], n: int | None = None, ascending: bool = True
) -> DataFrame:
    """Exact global running sums ``sum(v) over (order by order_cols rows unbounded preceding)``.

    Two phases: per-partition running sums in order, plus the total of all
    earlier partitions (one row per partition).  ``order_cols`` must be a total
    order for the result to be deterministic.
    """
    orders = [F.col(c).asc() if ascending else F.col(c).desc() for c in order_cols]
    sorted_df = range_sorted(df, orders, n)
    out_types = {
        o: (T.LongType() if isinstance(sorted_df.schema[v].dataType, T.IntegralType) else T.DoubleType())
        for v, o in values.items()
    }
    schema = T.StructType(list(sorted_df.schema.fields) + [T.StructField(o, out_types[o]) for o in values.values()])
    scanned = sorted_df.mapInPandas(_cumsum_batches(list(values), list(values.values())), schema)
    totals = sorted_df.groupBy(PID).agg(*[F.sum(v).alias(f"_t_{o}") for v, o in values.items()])
    before = Window.orderBy(PID).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        PID, *[F.coalesce(F.sum(f"_t_{o}").over(before), F.lit(0)).alias(f"_off_{o}") for o in values.values()]
    )  # one row per partition
    joined = scanned.join(F.broadcast(offsets), PID, "left")
    return joined.select(
        *df.columns, *[(F.col(o) + F.col(f"_off_{o}")).cast(out_types[o]).alias(o) for o in values.values()]
    )


def dense_index(df: DataFrame, order_cols: list[str], name: str = "idx", n: int | None = None) -> DataFrame:
    """0-based ``row_number() - 1`` over a total order, without a single-task window."""
    counted = df.withColumn("_one", F.lit(1).cast("long"))
    out = running_sum(counted, order_cols, {"_one": name}, n)
    return out.withColumn(name, F.col(name) - 1).drop("_one")


BRACKET = 1e-3  # ranks on either side of a quantile's approximate value, as a share of all
SKETCH = 10_000  # the sketch's ranks are right to 1 / SKETCH
COLLECTED = 2_000_000  # distinct values of all brackets that the driver ranks itself


def _brackets(df: DataFrame, columns: list[str], probs, width: float) -> dict[str, list[list[float]]]:
    """Per column, disjoint ascending value ranges that hold its quantiles, from one sketch aggregate."""
    ends = [min(max(p + d, 0.0), 1.0) for p in probs for d in (-width, width)]
    row = df.agg(*[F.percentile_approx(F.col(f"`{c}`").cast("double"), ends, SKETCH).alias(c) for c in columns]).first()
    out = {}
    for c in columns:
        out[c] = []
        for lo, hi in sorted(zip(row[c][::2], row[c][1::2])) if row[c] else []:
            if out[c] and lo <= out[c][-1][1]:
                out[c][-1][1] = max(hi, out[c][-1][1])
            else:
                out[c].append([lo, hi])
    return out


def exact_quantiles(df: DataFrame, columns: list[str], probs, n: int | None = None, collected: int = COLLECTED) -> dict[str, list[float]]:
    """Exact linear-interpolated quantiles (pandas ``quantile``, DuckDB
    ``quantile_cont``) of several columns, NULLs skipped.

    A sketch brackets every quantile by two values; one aggregate counts the rows
    below each bracket and those of a bracket of one value, another the rows of every
    distinct value inside the other brackets (a value repeated on a third of the rows
    is one counted row).  The wanted ranks are
    read off these counts: on the driver while there are at most ``collected`` of
    them, by a running sum over them beyond.  Rows are neither sorted nor handed
    to Python.  A bracket that misses its rank (the sketch bounds its error, so
    none should) is widened.
    """
    probs = list(probs)
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in columns]).first()
    wanted = {(c, q) for c in columns for p in probs for q in (math.floor((counts[c] - 1) * p), math.ceil((counts[c] - 1) * p)) if counts[c]}
    width, values = BRACKET, {}
    while wanted:
        ranges = [(c, lo, hi) for c, each in _brackets(df, sorted({c for c, _ in wanted}), probs, width).items() for lo, hi in each]
        x = [F.col(f"`{c}`").cast("double") for c, _, _ in ranges]
        one = [lo == hi for _, lo, hi in ranges]  # a bracket of one value needs no row of its own per input row
        tests = [F.count_if(v < F.lit(lo)).alias(f"b{i}") for i, (v, (_, lo, _)) in enumerate(zip(x, ranges))]
        tests += [F.count_if(x[i] == F.lit(ranges[i][1])).alias(f"e{i}") for i in range(len(ranges)) if one[i]]
        below = df.agg(*tests).first()
        same = pd.DataFrame([(i, ranges[i][1] + 0.0, below[f"e{i}"], below[f"e{i}"]) for i in range(len(ranges)) if one[i]], columns=["i", "v", "n", "upto"])
        within = {i: v.between(F.lit(lo), F.lit(hi)) for i, (v, (_, lo, hi)) in enumerate(zip(x, ranges)) if not one[i]}
        if within:
            inside = [F.struct(F.lit(i).alias("i"), F.when(w, x[i]).alias("v")) for i, w in within.items()]
            few = df.filter(reduce(or_, within.values()))  # most rows are in no bracket
            hit = few.select(F.explode(F.filter(F.array(*inside), lambda s: s["v"].isNotNull())).alias("s"))
            counted = stage_table(hit.groupBy(F.col("s.i").alias("i"), F.col("s.v").alias("v")).agg(F.count(F.lit(1)).alias("n")), "quantiles")
        if not within:
            table = same
        elif counted.count() <= collected:
            table = counted.orderBy("i", "v").toPandas()
            table["upto"] = table.groupby("i")["n"].cumsum()
        else:
            upto = running_sum(counted, ["i", "v"], {"n": "upto"}, n)
            start = {r["i"]: r["s"] for r in upto.groupBy("i").agg(F.min(F.col("upto") - F.col("n")).alias("s")).collect()}  # a row per bracket
            test = F.lit(False)
            for c, q in wanted:
                for i in [i for i, r in enumerate(ranges) if r[0] == c and i in start]:
                    rank = F.lit(q - below[f"b{i}"] + start[i])
                    test = test | ((F.col("i") == i) & (F.col("upto") > rank) & (F.col("upto") - F.col("n") <= rank))
            table = upto.filter(test).toPandas()
            table["upto"] -= table["i"].map(start)
        if within and len(same):
            table = pd.concat([table[list(same.columns)], same], ignore_index=True)
        for i, own in table.groupby("i"):
            c = ranges[i][0]
            first, last = own["upto"].to_numpy() - own["n"].to_numpy() + below[f"b{i}"], own["upto"].to_numpy() + below[f"b{i}"]
            for q in [q for d, q in wanted if d == c]:
                at = int(np.searchsorted(last, q, side="right"))
                if at < len(last) and first[at] <= q:
                    values[c, q] = float(own["v"].iloc[at])
        wanted -= set(values)
        width *= 10
        if wanted and width > 1:
            raise RuntimeError(f"ranks not found: {sorted(wanted)[:5]}")
    out = {}
    for c in columns:
        out[c] = []
        for p in probs if counts[c] else []:
            h = (counts[c] - 1) * p
            lo, hi = values[c, math.floor(h)], values[c, math.ceil(h)]
            out[c].append(lo + (h - math.floor(h)) * (hi - lo) if lo != hi else lo)
    return out
