"""Registered queries: one per operator of the study, each with its DuckDB twin.

A query is a function ``Context -> DataFrame``; the context holds the input
tables of one data directory and the shared derived tables (feature table,
labelled rows, active set, score column), built lazily once per session.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from churnscope import DEFAULT_AS_OF
from churnscope.functions.asof import to_date
from churnscope.oracle_sql.analysis import analysis_ctes
from churnscope.sources.fixture_sql import with_views
from churnscope.sources.tables import Tables

QUERIES: dict[str, Callable[["Context"], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


_CTES = None


def oracle(body: str) -> str:
    """Oracle SQL with every view and derived table it references inlined."""
    global _CTES
    if _CTES is None:
        _CTES = analysis_ctes(DEFAULT_AS_OF)
    return with_views(body, _CTES)


class Context:
    def __init__(self, spark: SparkSession, sf_dir: str, as_of: str = DEFAULT_AS_OF, skew_safe: bool = True):
        self.spark = spark
        self.sf_dir = sf_dir
        self.as_of = as_of
        self.d = to_date(as_of)
        self.skew_safe = skew_safe
        self.tables = Tables(spark, sf_dir)
        self.fx = self.tables.fixtures

    @cached_property
    def src(self):
        """Source tables of the warehouse.  The two analog views that many
        stages read and that cost joins to derive (agreements; turn-on/off facts,
        three branches over the agreements) are written once as parquet tables in
        the shared folder, as the warehouse reads stored tables.  The other views
        are single projections of one input table and stay lazy: scanning them
        again costs no more than scanning a copy."""
        from churnscope.plans.features import Sources
        from churnscope.sources.csv_io import stage_table

        for name in ("sa", "recdet"):
            self.fx.__dict__[name] = stage_table(getattr(self.fx, name), name)
        return Sources.from_fixtures(self.fx)

    @cached_property
    def base(self) -> DataFrame:
        from churnscope.plans.features import base_agreements

        return base_agreements(self.src.sa)

    @cached_property
    def features(self) -> DataFrame:
        """The feature table, written once (the warehouse's final stage table)."""
        from churnscope.plans.features import build_feature_table
        from churnscope.sources.csv_io import stage_table

        return stage_table(build_feature_table(self.src, self.d, skew_safe=self.skew_safe), "features")

    @cached_property
    def clean(self) -> DataFrame:
        from churnscope.plans.chapters import clean_feature_table

        return clean_feature_table(self.features)

    @cached_property
    def labelled(self) -> DataFrame:
        """Labels and buckets are a few comparisons a row with bounds that are known
        once the quantiles are: worked out on reading the feature table, not stored beside it."""
        from churnscope.plans.chapters import labelled

        return labelled(self.clean, self.d)

    @cached_property
    def active(self) -> DataFrame:
        from churnscope.plans.chapters import active_set

        return active_set(self.labelled, self.d)

    @cached_property
    def scored(self) -> DataFrame:
        return self.fx.scored(self.as_of)


_CONTEXTS: dict[tuple, Context] = {}


def context(spark: SparkSession, sf_dir: str) -> Context:
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    if key not in _CONTEXTS:
        _CONTEXTS[key] = Context(spark, sf_dir.rstrip("/"))
    return _CONTEXTS[key]


def load_all():
    # registration order = listing order: relational keys first, model training last
    from churnscope.registry import warehouse  # noqa: F401, I001
    from churnscope.registry import analysis  # noqa: F401
    from churnscope.registry import evaluation  # noqa: F401
    from churnscope.registry import models  # noqa: F401

    return QUERIES, ORACLE
