"""Bucket assignment by cascading thresholds ("the last satisfied edge wins")."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed bucket edges of the study.
ARREARS_EDGES = (-100, 0, 100, 200, 300, 400, 500, 600, 700, 800)
USAGE_EDGES = (0, 100, 200, 300, 400, 500, 750, 1000, 1500, 2500)
DECILE_FLOOR = -100
DECILE_PROBS = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)


def cascade_bucket(c: str | Column, edges) -> Column:
    """Index of the highest edge ``<= c``; NULL below the first edge or for NULL.

    With tied edges the higher index wins, so bucket numbers can skip, exactly
    like the sequence of overwriting assignments it replaces.
    """
    x = F.col(c) if isinstance(c, str) else c
    expr = None
    for i, e in reversed(list(enumerate(edges))):
        cond = x >= F.lit(e)
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    return expr.otherwise(F.lit(None).cast("int"))


def exact_quantiles(df: DataFrame, c: str, probs=DECILE_PROBS, where: Column | None = None) -> list[float]:
    """Exact linear-interpolated quantiles (pandas ``quantile``), nulls skipped.

    Computed by an ordered distributed pass (``operators.ordered``); only the
    ``len(probs)`` numbers come back to the driver.
    """
    from churnscope.operators.ordered import exact_quantiles as quantiles

    src = df if where is None else df.filter(where)
    return quantiles(src, [c], probs)[c]


def decile_bucket(df: DataFrame, c: str, name: str, where: Column | None = None, floor=DECILE_FLOOR) -> DataFrame:
    """Bucket 0 for ``c >= floor``, then ``i`` for ``c >= q_i`` (quantiles of the
    rows selected by ``where``, assigned only to those rows)."""
    qs = exact_quantiles(df, c, where=where)
    if not qs:
        return df.withColumn(name, F.lit(None).cast("int"))
    b = cascade_bucket(c, [floor, *qs])
    if where is not None:
        b = F.when(where, b)
    return df.withColumn(name, b.cast("int"))


def decile_buckets(df: DataFrame, specs, floor=DECILE_FLOOR) -> DataFrame:
    """Several ``decile_bucket`` columns from one ordered quantile pass.

    ``specs`` holds ``(column, name, where)``; a row outside ``where`` enters
    the quantiles of that column as NULL, which the pass skips.
    """
    from churnscope.operators.ordered import exact_quantiles as quantiles

    masked = [
        (F.col(c) if where is None else F.when(where, F.col(c))).alias(f"_q_{name}") for c, name, where in specs
    ]
    qs = quantiles(df.select(*masked), [f"_q_{name}" for _, name, _ in specs], DECILE_PROBS)
    for c, name, where in specs:
        edges = qs.get(f"_q_{name}") or []
        if not edges:
            df = df.withColumn(name, F.lit(None).cast("int"))
            continue
        b = cascade_bucket(c, [floor, *edges])
        df = df.withColumn(name, (b if where is None else F.when(where, b)).cast("int"))
    return df
