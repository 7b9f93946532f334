"""Profiles of a table: value counts, describe, null counts, histograms.

Each profile is one aggregation job over all columns at once (generated
aggregate list, then ``stack`` to long form) instead of one job per column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _q(c: str) -> str:
    return f"`{c}`"


def value_counts_topk(df: DataFrame, column: str, ascending: bool = False, n: int = 5) -> DataFrame:
    """Most (or least) frequent values, NULL excluded; ties broken by the value."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(
        F.count(F.lit(1)).alias("count")
    )
    order = F.col("count").asc() if ascending else F.col("count").desc()
    return counts.orderBy(order, F.col("value").asc()).limit(n)


def minmax_values_topk(df: DataFrame, column: str, which: str = "max", n: int = 5) -> DataFrame:
    """The ``n`` largest (or smallest) distinct values with their counts."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(
        F.count(F.lit(1)).alias("count")
    )
    order = F.col("value").desc() if which == "max" else F.col("value").asc()
    return counts.orderBy(order).limit(n)


def describe_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, sample std, min, exact quartiles, max of each column, long form.

    Moments come from one aggregate; quartiles from one ordered pass over all
    columns (``exact_quantiles``), not from a per-group value map.
    """
    from churnscope.operators.ordered import exact_quantiles

    aggs = []
    for c in columns:
        x = F.col(c).cast("double")
        aggs += [
            F.count(x).alias(f"{c}__count"),
            F.avg(x).alias(f"{c}__mean"),
            F.stddev_samp(x).alias(f"{c}__std"),
            F.min(x).alias(f"{c}__min"),
            F.max(x).alias(f"{c}__max"),
        ]
    qs = exact_quantiles(df, columns, (0.25, 0.5, 0.75))
    rows = []
    for c in columns:
        q = qs.get(c) or [None, None, None]
        rows.append(
            F.struct(
                F.lit(c).alias("column_name"),
                *[F.col(f"{c}__{what}").alias(what) for what in ("count", "mean", "std", "min")],
                *[F.lit(v).cast("double").alias(n) for v, n in zip(q, ("q25", "q50", "q75"))],
                F.col(f"{c}__max").alias("max"),
            )
        )
    # one aggregate row turned into a row per column: the input is read once
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def describe_categorical_by_group(df: DataFrame, group: str, column: str) -> DataFrame:
    """Per group: non-null count, distinct values, most frequent value and its count."""
    per_value = df.filter(F.col(column).isNotNull()).groupBy(group, column).agg(F.count(F.lit(1)).alias("freq"))
    summary = per_value.groupBy(group).agg(
        F.sum("freq").cast("bigint").alias("count"),
        F.count(F.lit(1)).alias("unique"),
        # most frequent value, ties to the smallest value
        F.min_by(F.col(column), F.struct(-F.col("freq"), F.col(column))).alias("top"),
        F.max("freq").alias("freq"),
    )
    return summary


def null_profile(df: DataFrame, columns: list[str] | None = None, by: str | None = None) -> DataFrame:
    """Type and non-null count of every column, long form; with ``by`` per value of that column, NULL among them."""
    columns = columns or df.columns
    kinds = dict(df.dtypes)
    counts = [F.count(F.col(_q(c))).alias(f"n{i}") for i, c in enumerate(columns)]
    wide = df.groupBy(F.col(_q(by)).alias("_by")).agg(*counts) if by else df.agg(*counts)
    rows = ", ".join(f"'{c}', '{kinds[c]}', n{i}" for i, c in enumerate(columns))
    out = wide.selectExpr(*(["_by"] if by else []), f"stack({len(columns)}, {rows}) as (column_name, type, non_null)")
    return out.withColumnRenamed("_by", by) if by else out


def equal_width_histogram(df: DataFrame, column: str, bins: int, name: str) -> DataFrame:
    """numpy-style histogram: ``bins`` equal bins over [min, max], last bin closed.

    min and max are one scalar aggregate; empty bins are not listed.
    """
    x = F.col(column).cast("double")
    mm = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    if mm["lo"] is None:
        return df.sparkSession.createDataFrame([], f"histogram string, bin int, lower double, upper double, count bigint")
    lo, hi = float(mm["lo"]), float(mm["hi"])
    width = (hi - lo) if hi > lo else 1.0
    b = F.least(F.floor((x - F.lit(lo)) / F.lit(width) * F.lit(bins)), F.lit(bins - 1)).cast("int")
    counts = df.filter(x.isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    return counts.select(
        F.lit(name).alias("histogram"),
        "bin",
        (F.lit(lo) + F.col("bin") * F.lit(width) / F.lit(bins)).alias("lower"),
        (F.lit(lo) + (F.col("bin") + 1) * F.lit(width) / F.lit(bins)).alias("upper"),
        "count",
    )


def histograms_all_numeric(df: DataFrame, columns: list[str], bins: int = 10, subsets: dict | None = None) -> DataFrame:
    """Histogram of every listed column in one job: unpivot to (column, value),
    min/max per column (one row per column, broadcast), bin, count.

    ``subsets`` names conditions; each row counts in every set that it meets, the
    bins of a set span its own values, and ``rows`` tells the sets apart.
    """
    parts = ", ".join(f"'{c}', cast({_q(c)} as double)" for c in columns)
    sets = F.array_compact(F.array(*[F.when(w, F.lit(n)) for n, w in (subsets or {"all": F.lit(True)}).items()]))
    tagged = df.select(*[F.col(_q(c)) for c in columns], F.explode(sets).alias("_rows"))
    long = tagged.selectExpr("_rows as rows", f"stack({len(columns)}, {parts}) as (column_name, value)").filter(F.col("value").isNotNull())
    ranges = long.groupBy("rows", "column_name").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    width = F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(F.lit(1.0))
    binned = long.join(F.broadcast(ranges), ["rows", "column_name"]).select(
        "rows",
        "column_name",
        F.least(F.floor((F.col("value") - F.col("lo")) / width * F.lit(bins)), F.lit(bins - 1)).cast("int").alias("bin"),
    )
    counts = binned.groupBy("rows", "column_name", "bin").agg(F.count(F.lit(1)).alias("count"))
    return counts if subsets else counts.drop("rows")
