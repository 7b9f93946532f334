"""Splits, exact-size re-sampling with replacement, Poisson bootstrap.

Every random choice is a hash of a key (see ``functions.hashing``), so a
split or a draw is the same after a task retry, a repartition or a rerun,
and it does not depend on the number of executors.
"""

from __future__ import annotations

import hashlib
import math
from functools import reduce
from operator import and_, or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnscope.functions.hashing import hash_bits, unit_hash
from churnscope.operators.ordered import dense_index

SPLIT_SALT = "split:"


def hash_split(df: DataFrame, key: str = "sa_id", test_fraction: float = 0.4, salt: str = SPLIT_SALT) -> DataFrame:
    """Add ``is_test`` (1 for the test share) from a hash of the key."""
    return df.withColumn("is_test", (unit_hash(key, salt) < F.lit(test_fraction)).cast("int"))


def draw_with_replacement(df: DataFrame, n: int, key: str | list[str], salt: str) -> DataFrame:
    """``n`` rows drawn uniformly with replacement, exactly ``n`` of them.

    Rows get a dense 0-based index in key order (two-phase, no single-task
    window); draw ``i`` takes index ``hash(salt, i) mod N``.  The draws are a
    range of ``n`` ids joined to the indexed rows, so nothing is collected and
    nothing is capped.
    """
    spark = df.sparkSession
    indexed = dense_index(df, [key] if isinstance(key, str) else list(key), "_idx")
    size = indexed.count()
    if size == 0 or n <= 0:
        return indexed.limit(0).select(F.lit(0).cast("long").alias("draw"), *df.columns)
    draws = spark.range(n).select(
        F.col("id").alias("draw"), (hash_bits(F.col("id"), salt) % F.lit(size)).alias("_idx")
    )
    return draws.join(indexed, "_idx").select("draw", *df.columns)


def _draw_groups(df: DataFrame, by: list[str], sizes: dict[tuple, int], keys: list[str], salts: dict[tuple, str]) -> DataFrame:
    """Per group of the columns ``by``, ``sizes[group]`` rows drawn with replacement.

    One dense index in (group, key) order serves every group: group ``g``
    owns indexes ``[offset_g, offset_g + N_g)`` and draw ``i`` of it takes
    ``offset_g + hash(salt_g, i) mod N_g`` -- the same rows as indexing each
    group on its own, with one ordered pass and one join.
    """
    spark = df.sparkSession
    wanted = reduce(or_, [reduce(and_, [F.col(c) == F.lit(v) for c, v in zip(by, group)]) for group in sizes], F.lit(False))
    sub = df.filter(wanted)
    counts = {tuple(r[c] for c in by): r["n"] for r in sub.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).collect()}
    offsets, acc = {}, 0
    for v in sorted(counts):
        offsets[v], acc = acc, acc + counts[v]
    draws = None
    for value, n in sizes.items():
        size = counts.get(value, 0)
        if size == 0 or n <= 0:
            continue
        part = spark.range(n).select(
            F.col("id").alias("draw"), (F.lit(offsets[value]) + hash_bits(F.col("id"), salts[value]) % F.lit(size)).alias("_idx")
        )
        draws = part if draws is None else draws.unionByName(part)
    if draws is None:
        return sub.limit(0).select(F.lit(0).cast("long").alias("draw"), *df.columns)
    indexed = dense_index(sub, [*by, *keys], "_idx")
    return draws.join(indexed, "_idx").select("draw", *df.columns)


def resample_classes(
    df: DataFrame, label: str, sizes: dict[int, int], key: str | list[str] = "sa_id", salt: str = "rs:"
) -> DataFrame:
    """Per class value, draw ``sizes[value]`` rows with replacement; stack the classes."""
    keys = [key] if isinstance(key, str) else list(key)
    return _draw_groups(df, [label], {(v,): n for v, n in sizes.items()}, keys, {(v,): f"{salt}{v}:" for v in sizes})


def upsample_minority(df: DataFrame, label: str, key: str = "sa_id", salt: str = "up:") -> DataFrame:
    """Positives drawn with replacement up to the number of negatives; negatives kept."""
    negatives = df.filter(F.col(label) == 0)
    n_neg = negatives.count()
    ups = draw_with_replacement(df.filter(F.col(label) == 1), n_neg, key, f"{salt}1:")
    return negatives.select(F.lit(None).cast("long").alias("draw"), *df.columns).unionByName(ups)


def downsample_majority(df: DataFrame, label: str, n: int, key: str = "sa_id", salt: str = "down:") -> DataFrame:
    """Negatives drawn (with replacement) to ``n``; positives kept."""
    downs = draw_with_replacement(df.filter(F.col(label) == 0), n, key, f"{salt}0:")
    pos = df.filter(F.col(label) == 1).select(F.lit(None).cast("long").alias("draw"), *df.columns)
    return downs.unionByName(pos)


def resample_by_segment(
    df: DataFrame, label: str, segment: str, sizes: dict[str, dict[int, int]], key: str | list[str] = "sa_id", salt: str = "seg:"
) -> DataFrame:
    """``resample_classes`` of every segment, in one ordered pass over all of them."""
    keys = [key] if isinstance(key, str) else list(key)
    groups = {(seg, v): n for seg, per_class in sizes.items() for v, n in per_class.items()}
    return _draw_groups(df, [segment, label], groups, keys, {(seg, v): f"{salt}{seg}:{v}:" for seg, v in groups})


def poisson_thresholds(k_max: int = 12) -> list[float]:
    """Cumulative Poisson(1) probabilities P(K <= k), k = 0..k_max."""
    out, acc, term = [], 0.0, math.exp(-1.0)
    for k in range(k_max + 1):
        if k > 0:
            term /= k
        acc += term
        out.append(acc)
    return out


def poisson_weight(u: Column, k_max: int = 12) -> Column:
    """Inverse CDF of Poisson(1) at ``u``: the number of thresholds ``<= u``."""
    w = None
    for c in poisson_thresholds(k_max):
        term = (u >= F.lit(c)).cast("int")
        w = term if w is None else w + term
    return w


def _poisson_sums(replicates: int, salt: str):
    """Per batch of (values, rows) groups: replicate, weights and weighted sums of each column, NULLs left out."""

    def run(batches):
        for batch in batches:
            *values, n = [c.to_pylist() for c in batch.columns]
            weight, total = np.zeros((len(values), replicates)), np.zeros((len(values), replicates))
            for i, rows in enumerate(n):
                group = [v[i] for v in values]
                seed = hashlib.md5(f"{salt}{group!r}".encode()).digest()
                drawn = np.random.Generator(np.random.Philox(int.from_bytes(seed, "little"))).poisson(rows, replicates)
                for j, x in enumerate(group):
                    if x is not None:
                        weight[j] += drawn
                        total[j] += drawn * x
            if n:
                names = [f"{what}{j}" for j in range(len(values)) for what in ("w", "s")]
                columns = [pa.array(a[j]) for j in range(len(values)) for a in (weight, total)]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(replicates, dtype=np.int32)), *columns], names=["rep", *names])

    return run


def bootstrap_mean_ci_grouped(
    df: DataFrame, columns: list[str], replicates: int = 10_000, alpha: float = 0.05, salt: str = "boot:"
) -> DataFrame:
    """``bootstrap_mean_ci`` for columns with few distinct tuples, as the 0/1 labels.

    Equal rows are counted first; the sum of their n independent Poisson(1)
    weights is Poisson(n), drawn per tuple and replicate from a generator seeded
    by the tuple's hash.  The work after the one aggregate is tuples x replicates,
    however many rows there are.
    """
    doubles = [F.col(c).cast("double").alias(c) for c in columns]
    groups = df.groupBy(*doubles).agg(F.count(F.lit(1)).alias("_n"))
    fields = ", ".join(f"w{j} double, s{j} double" for j in range(len(columns)))
    sums = groups.mapInArrow(_poisson_sums(replicates, salt), f"rep int, {fields}").groupBy("rep").agg(
        *[F.sum(f"{what}{j}").alias(f"{what}{j}") for j in range(len(columns)) for what in ("w", "s")]
    )
    bounds = F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))
    stats = sums.agg(*[F.percentile(F.try_divide(F.col(f"s{j}"), F.col(f"w{j}")), bounds).alias(c) for j, c in enumerate(columns)])
    ci = stats.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c)[0].alias("ci_low"), F.col(c)[1].alias("ci_high")) for c in columns
    ])))
    point = df.agg(*[F.avg(c).alias(c) for c in columns])
    mean = point.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("mean")) for c in columns])))
    return mean.join(ci, "column_name")  # one row per column on both sides


def bootstrap_mean_ci(
    df: DataFrame, columns: list[str], key: str = "sa_id", replicates: int = 10_000, alpha: float = 0.05, salt: str = "boot:"
) -> DataFrame:
    """Poisson bootstrap of the mean of each column: percentile interval.

    Each row gets an independent Poisson(1) weight per replicate (a hash of key
    and replicate); replicate sums are partially aggregated on the map side, so
    the shuffle carries one row per replicate and partition.
    """
    rep = F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("rep")
    rows = df.select(F.col(key), *[F.col(c) for c in columns], rep)
    u = unit_hash(F.concat(F.col(key).cast("string"), F.lit(":"), F.col("rep").cast("string")), salt)
    w = poisson_weight(u)
    weighted = rows.select("rep", w.alias("w"), *[(w * F.col(c)).alias(c) for c in columns])
    sums = weighted.groupBy("rep").agg(
        F.sum("w").cast("bigint").alias("sw"), *[F.sum(c).cast("bigint").alias(c) for c in columns]
    )
    means = sums.select("rep", *[F.try_divide(F.col(c), F.col("sw")).alias(c) for c in columns])
    lo, hi = alpha / 2, 1 - alpha / 2
    stats = means.agg(
        *[F.percentile(F.col(c), F.array(F.lit(lo), F.lit(hi))).alias(c) for c in columns]
    )
    point = df.agg(*[F.avg(c).alias(c) for c in columns])
    pairs_ci = ", ".join(f"'{c}', `{c}`[0], `{c}`[1]" for c in columns)
    ci = stats.selectExpr(f"stack({len(columns)}, {pairs_ci}) as (column_name, ci_low, ci_high)")
    pairs_pt = ", ".join(f"'{c}', `{c}`" for c in columns)
    pt = point.selectExpr(f"stack({len(columns)}, {pairs_pt}) as (column_name, mean)")
    return pt.join(ci, "column_name")  # one row per column on both sides
