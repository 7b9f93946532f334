"""Correlation, confidence intervals, standardization, L1 feature selection."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnscope.operators.ordered import running_sum
from churnscope.sources.csv_io import stage_table


def corr(a: str, b: str):
    """Pearson r with pairwise NULL deletion; NULL (not an error) when a column
    is constant -- ``F.corr`` divides by a zero variance under ANSI mode."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.col(a).cast("double")), F.when(both, F.col(b).cast("double"))
    return F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))


def corr_sql(a: str, b: str) -> str:
    """DuckDB spelling of ``corr``."""
    x = f"case when {b} is not null then cast({a} as double) end"
    y = f"case when {a} is not null then cast({b} as double) end"
    return f"(covar_samp({x}, {y}) / nullif(stddev_samp({x}) * stddev_samp({y}), 0))"


MOMENTS = "a int, b int, n double, ma double, mb double, va double, vb double, c double"


def _moments(shift: list[float]):
    """Per task and pair of columns, over the rows that have both: count, means, squared deviations, their product."""

    def run(batches):
        k, total = len(shift), None
        for batch in batches:
            x = np.stack([np.asarray(c.cast(pa.float64()).fill_null(np.nan)) for c in batch.columns], axis=1) - np.array(shift)
            has = ~np.isnan(x)
            x, has = np.where(has, x, 0.0), has.astype(float)
            part = np.stack([has.T @ has, x.T @ has, (x * x).T @ has, x.T @ x])
            total = part if total is None else total + part
        if total is None:
            return
        i, j = np.triu_indices(k, 1)
        n, s, q, p = total[:, i, j]
        s2, q2 = total[1].T[i, j], total[2].T[i, j]  # the same of the second column
        some = n > 0
        i, j, n, s, q, p, s2, q2 = (v[some] for v in (i, j, n, s, q, p, s2, q2))
        columns = [i.astype(np.int32), j.astype(np.int32), n, s / n, s2 / n, np.maximum(q - s * s / n, 0), np.maximum(q2 - s2 * s2 / n, 0), p - s * s2 / n]
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in columns], names=["a", "b", "n", "ma", "mb", "va", "vb", "c"])

    return run


def pearson_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """All pairwise Pearson r in one scan (pairwise NULL deletion, as pandas; NULL for a constant column).

    Every task turns its rows into moment matrices, a matrix product each, and
    hands on one row per pair; these are stored and merged by pair.  Deviations
    are taken from one row's values, so a constant column has none at all, and
    what rounding leaves of a variance (1e-13 of the squared mean) counts as none.
    """
    spark = df.sparkSession
    names = spark.createDataFrame(list(enumerate(columns)), "i int, name string")
    values = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in columns])
    one = values.first()
    shift = [float(v) if v is not None else 0.0 for v in (one or [None] * len(columns))]
    parts = stage_table(values.mapInArrow(_moments(shift), MOMENTS), "moments")
    mean = parts.groupBy("a", "b").agg(*[(F.sum(F.col(m) * F.col("n")) / F.sum("n")).alias(f"t{m}") for m in ("ma", "mb")])
    off = [F.col(m) - F.col(f"t{m}") for m in ("ma", "mb")]
    terms = {"va": off[0] * off[0], "vb": off[1] * off[1], "c": off[0] * off[1]}
    merged = parts.join(F.broadcast(mean), ["a", "b"]).groupBy("a", "b").agg(  # one row per pair of columns
        F.sum("n").alias("n"), F.first("tma").alias("ma"), F.first("tmb").alias("mb"),
        *[F.sum(F.col(t) + F.col("n") * e).alias(t) for t, e in terms.items()],
    )
    spread = [F.when(F.col(v) > F.col("n") * F.col(m) * F.col(m) * 1e-13, F.sqrt(v)) for v, m in (("va", "ma"), ("vb", "mb"))]
    every = names.select(F.col("i").alias("a"), F.col("name").alias("column_a")).join(
        F.broadcast(names.select(F.col("i").alias("b"), F.col("name").alias("column_b"))), F.col("a") < F.col("b")
    )
    return every.join(F.broadcast(merged), ["a", "b"], "left").select("column_a", "column_b", F.try_divide("c", spread[0] * spread[1]).alias("r"))


RANK_NUMBERS = 8_000_000  # numbers of a broadcast rank table at most (64 MB)


class _Domains:
    """Which rows a pair of columns is ranked on: those with both values.

    Rows are told apart by their null pattern, the set of columns without a
    value; a domain is a set of patterns, and pairs with the same one share it.
    """

    def __init__(self, df: DataFrame, columns: list[str]):
        self.columns = columns
        counts = df.agg(F.count(F.lit(1)).alias("_all"), *[F.count(F.col(f"`{c}`")).alias(c) for c in columns]).first()
        self.nullable = [c for c in columns if counts[c] < counts["_all"]]
        patterns = [r["p"] for r in df.groupBy(self.pattern().alias("p")).agg(F.count(F.lit(1))).collect()]  # distinct patterns
        self.bit = {c: i for i, c in enumerate(self.nullable)}
        has = {c: frozenset(p for p in patterns if c not in self.bit or p[self.bit[c]] == "1") for c in columns}
        self.of = {(a, b): has[a] & has[b] for i, a in enumerate(columns) for b in columns[i + 1 :]}
        self.every = sorted(set(self.of.values()), key=lambda d: (-len(d), sorted(d)))
        self.number = {pair: self.every.index(d) for pair, d in self.of.items()}

    def pattern(self):
        """One character per nullable column: 1 where it has a value."""
        return F.concat(F.lit(""), *[F.when(F.col(f"`{c}`").isNull(), "0").otherwise("1") for c in self.nullable])

    def counts(self, df: DataFrame) -> DataFrame:
        """``_col, _val, _n0, _n1, ...``: rows with the value, in each domain."""
        rows = ", ".join(f"'{c}', cast(`{c}` as double)" for c in self.columns)
        long = df.select(self.pattern().alias("_p"), *[F.col(f"`{c}`") for c in self.columns]).selectExpr("_p", f"stack({len(self.columns)}, {rows}) as (_col, _val)")
        inside = [F.count_if(F.col("_p").isin(sorted(d)) if d else F.lit(False)).alias(f"_n{i}") for i, d in enumerate(self.every)]
        return long.filter("_val is not null").groupBy("_col", "_val").agg(*inside)


def _rank_products(sent):
    """Per task and pair: sums of squares and products of the ranks' deviations from their mean.

    A column without a table brings its deviations along, in every domain, after the columns.
    """

    def run(batches):
        columns, bits, domains, tables = sent.value
        joined = {c: i for i, c in enumerate(c for c, table in enumerate(tables) if table is None)}
        total = [np.zeros((len(columns), len(columns))) for _ in domains]
        for batch in batches:
            x = np.stack([np.asarray(c.cast(pa.float64()).fill_null(np.nan)) for c in batch.columns], axis=1)
            x, given = x[:, : len(columns)], x[:, len(columns) :]
            patterns = (~np.isnan(x[:, bits])).astype(np.int64) @ (1 << np.arange(len(bits), dtype=np.int64)) if bits else np.zeros(len(x), np.int64)
            place = [None if t is None else np.searchsorted(t[0], x[:, c]) for c, t in enumerate(tables)]
            for d, (members, used) in enumerate(domains):
                rows = np.flatnonzero(np.isin(patterns, members))
                own = [given[rows, joined[c] * len(domains) + d] if c in joined else tables[c][1][d][place[c][rows]] for c in used]
                r = np.stack(own, axis=1)
                total[d][np.ix_(used, used)] += r.T @ r
        for d, (_, used) in enumerate(domains):
            i, j = (np.array(used)[k] for k in np.triu_indices(len(used), 1))
            m = total[d]
            columns_out = [np.full(len(i), d, np.int32), i.astype(np.int32), j.astype(np.int32), m[i, j], m[i, i], m[j, j]]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in columns_out], names=["d", "a", "b", "c", "va", "vb"])

    return run


def spearman_matrix(df: DataFrame, columns: list[str], key: list[str] | str = "sa_id", numbers: int = RANK_NUMBERS) -> DataFrame:
    """Spearman matrix: Pearson r of average ranks, taken for each pair on the rows that
    have both values (as pandas; NULL for a constant column or no common row).
    NaN counts as NULL; ``key`` is not used, rows may share it.

    Rows per distinct value and domain (see ``_Domains``) are counted in one
    aggregate.  The columns of fewest values, while their counts fit ``numbers``,
    are ranked and broadcast.  Of every other column the ranks come from a running
    sum over its distinct values and are joined to the rows; a value on a third of
    the rows is a skewed partition of that join, whose row side is split at run
    time.  One scan of the rows turns every batch into matrices of rank products.
    """
    spark = df.sparkSession
    df = df.select(*[F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")).alias(c) for c in columns])
    domains = _Domains(df, columns)
    counts = stage_table(domains.counts(df), "rank_counts")
    names = [f"_n{i}" for i in range(len(domains.every))]
    used = [[c for c in columns if any(c in pair and n == d for pair, n in domains.number.items())] for d in range(len(names))]
    pairs = spark.createDataFrame([(a, b, n) for (a, b), n in domains.number.items()], "column_a string, column_b string, d int")
    sizes = {r["_col"]: r["count"] for r in counts.groupBy("_col").count().collect()}  # a row per column
    small, room = [], numbers
    for c in sorted(columns, key=lambda c: (sizes.get(c, 0), columns.index(c))):
        room -= sizes.get(c, 0) * (len(names) + 1)
        if room >= 0:
            small.append(c)
    table = counts.filter(F.col("_col").isin(small)).orderBy("_col", "_val").toPandas()
    tables = []
    for c in columns:
        own = table[table["_col"] == c]
        n = own[names].to_numpy(dtype=float).T
        ranks = np.cumsum(n, axis=1) - n + (n + 1) / 2
        tables.append((own["_val"].to_numpy(dtype=float), ranks - (n.sum(axis=1, keepdims=True) + 1) / 2) if c in small else None)
    at = {c: i for i, c in enumerate(columns)}
    number = lambda p: sum(1 << i for i, x in enumerate(p) if x == "1")
    spec = [(sorted(map(number, d)), [at[c] for c in u]) for d, u in zip(domains.every, used)]
    sent = spark.sparkContext.broadcast((columns, [at[c] for c in domains.nullable], spec, tables))
    large = [c for c in columns if c not in small]
    rows = _joined_deviations(df, counts, names, large).select(
        *columns, *[F.get(f"_rank_{c}", F.lit(d)).alias(f"_rank_{c}_{d}") for c in large for d in range(len(names))]
    )
    parts = rows.mapInArrow(_rank_products(sent), "d int, a int, b int, c double, va double, vb double")
    sums = parts.groupBy("d", "a", "b").agg(*[F.sum(x).alias(x) for x in ("c", "va", "vb")])
    name = F.array(*[F.lit(c) for c in columns])
    found = sums.select("d", F.get(name, F.col("a")).alias("column_a"), F.get(name, F.col("b")).alias("column_b"), "c", "va", "vb")
    root = [F.when(F.col(v) > 0, F.sqrt(v)) for v in ("va", "vb")]
    return pairs.join(found, ["column_a", "column_b", "d"], "left").select("column_a", "column_b", F.try_divide("c", root[0] * root[1]).alias("r"))


def _joined_deviations(df: DataFrame, counts: DataFrame, names: list[str], large: list[str]) -> DataFrame:
    """``df`` and for each column of ``large`` the array ``_rank_<column>``: in every domain
    the average rank of the row's value, less the mean rank."""
    if not large:
        return df
    counts = counts.filter(F.col("_col").isin(large))
    totals = {r["_col"]: r for r in counts.groupBy("_col").agg(*[F.sum(n).alias(n) for n in names]).collect()}  # a row per column
    before, seen = [], [0] * len(names)
    for c in sorted(totals):  # of a column: rows of the columns before it, and its mean ranks
        shift = [float(x) + (totals[c][n] + 1) / 2 for x, n in zip(seen, names)]
        before += [F.lit(c), F.array(*[F.lit(x) for x in shift])]
        seen = [x + totals[c][n] for x, n in zip(seen, names)]
    cum = running_sum(counts, ["_col", "_val"], {n: f"_c{n}" for n in names})
    shift = F.create_map(*before)[F.col("_col")] if before else F.array()
    ranks = [F.col(f"_c{n}") - F.col(n) + (F.col(n) + 1) / 2.0 - F.get(shift, F.lit(i)) for i, n in enumerate(names)]
    ranks = stage_table(cum.select("_col", "_val", F.array(*ranks).alias("_ranks")), "ranks")
    for c in large:
        df = df.join(ranks.filter(F.col("_col") == c).select(F.col("_val").alias(c), F.col("_ranks").alias(f"_rank_{c}")), c, "left")
    return df


Z_975 = NormalDist().inv_cdf(0.975)


def _beta_fraction(x, a, b, terms):
    """Continued fraction of the incomplete beta function, from its ``terms``-th pair of terms up."""

    def up(t, m):
        m = m.cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m - 1) * (a + b + m - 1) * x / ((a + 2 * m - 2) * (a + 2 * m - 1))
        return odd / (1 + even / (1 + t))

    return 1 / (1 + F.aggregate(F.sequence(terms, F.lit(1).cast("long"), F.lit(-1).cast("long")), F.lit(0.0), up))


def r_p_value(r, n):
    """Two-sided p-value of a correlation ``r`` over ``n`` rows (Student's t with n - 2
    degrees of freedom) as a column: the regularised incomplete beta function
    I(1 - r^2; n/2 - 1, 1/2).  NULL below three rows, 0 for r of 1 or -1."""
    a, x, y = (n - 2) / 2.0, 1 - r * r, r * r
    # gamma(a + 1/2) / gamma(a): asymptotic series at a + 8, brought down by the recurrence
    z = a + 8
    series = 1 - 1 / (8 * z) + 1 / (128 * z**2) + 5 / (1024 * z**3) - 21 / (32768 * z**4) - 399 / (262144 * z**5)
    ratio = F.sqrt(z) * series
    for i in range(8):
        ratio = ratio * (a + i) / (a + i + 0.5)
    scale = F.exp(a * F.log1p(-y)) * F.sqrt(y) * ratio / math.sqrt(math.pi)
    terms = (F.lit(100) + 6 * F.sqrt(a)).cast("long")
    low = scale / a * _beta_fraction(x, a, F.lit(0.5), terms)
    high = 1 - scale / 0.5 * _beta_fraction(y, F.lit(0.5), a, terms)
    p = F.when(y >= 1, F.lit(0.0)).when(x < (a + 1) / (a + 2.5), low).otherwise(high)
    return F.when((n > 2) & r.isNotNull(), F.greatest(p, F.lit(0.0)))


def pearson_cis(df: DataFrame, pairs: list[tuple[str, str]], alpha: float = 0.05) -> DataFrame:
    """r, n, p-value, Fisher-z interval and r^2 of every pair (rows with both values), in one pass."""
    z = NormalDist().inv_cdf(1 - alpha / 2)
    sides = []
    for i, (a, b) in enumerate(pairs):
        sides += [corr(a, b).alias(f"r{i}"), F.count(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), 1)).alias(f"n{i}")]
    rows = ", ".join(f"'{a}', '{b}', r{i}, n{i}" for i, (a, b) in enumerate(pairs))
    g = df.agg(*sides).selectExpr(f"stack({len(pairs)}, {rows}) as (column_a, column_b, r, n)")
    se = F.try_divide(F.lit(1.0), F.sqrt(F.col("n") - 3))
    return g.select(
        "column_a",
        "column_b",
        "r",
        "n",
        r_p_value(F.col("r"), F.col("n").cast("double")).alias("p_value"),
        F.tanh(F.atanh("r") - F.lit(z) * se).alias("ci_low"),
        F.tanh(F.atanh("r") + F.lit(z) * se).alias("ci_high"),
        (F.col("r") * F.col("r")).alias("r_squared"),
    )


def pearson_ci(df: DataFrame, a: str, b: str, alpha: float = 0.05) -> DataFrame:
    return pearson_cis(df, [(a, b)], alpha)


def pearson_p_value(df: DataFrame, a: str, b: str) -> float:
    """Two-sided p-value of one pair's r."""
    return pearson_ci(df, a, b).first()["p_value"]


def standardize(train: DataFrame, df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - mean_train) / std_train with the population std (sklearn's scaler)."""
    stats = train.agg(
        *[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]
    ).first()  # 2 numbers per column
    out = []
    for c in columns:
        m, s = stats[f"m_{c}"], stats[f"s_{c}"]
        s = s if s else 1.0
        out.append(((F.col(c) - F.lit(m)) / F.lit(s)).alias(c))
    keep = [c for c in df.columns if c not in columns]
    return df.select(*keep, *out)


def lasso_select(train: DataFrame, test: DataFrame, features: list[str], label: str, alpha: float = 1e-8) -> DataFrame:
    """L1 linear regression on standardized features: coefficients, R^2 on
    train and test (both scored on standardized features), non-zero count."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    tr = standardize(train, train, features)
    te = standardize(train, test, features)
    va = VectorAssembler(inputCols=features, outputCol="_x")
    lr = LinearRegression(featuresCol="_x", labelCol=label, elasticNetParam=1.0, regParam=alpha, standardization=False)
    model = lr.fit(va.transform(tr))
    r2_train = model.summary.r2
    r2_test = model.evaluate(va.transform(te)).r2
    spark = train.sparkSession
    coefs = [(f, float(c)) for f, c in zip(features, model.coefficients.toArray())]
    nonzero = sum(1 for _, c in coefs if c != 0.0)
    rows = [(f, c, float(r2_train), float(r2_test), nonzero) for f, c in coefs]
    return spark.createDataFrame(rows, "feature string, coefficient double, r2_train double, r2_test double, nonzero int")
