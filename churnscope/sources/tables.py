"""Scans of the input tables.

``Tables`` reads each parquet table lazily; Catalyst prunes the columns a
query does not use and pushes its filters into the scan, so the loader never
selects columns itself.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

TABLE_NAMES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


class Tables:
    """Lazy handle on ``{root}/{name}.parquet`` for every input table."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLE_NAMES:
            df = self.read(name)
            self.__dict__[name] = df
            return df
        raise AttributeError(name)

    @cached_property
    def fixtures(self):
        from churnscope.sources.fixtures import Fixtures

        return Fixtures(self)


def scan_table(spark: SparkSession, root: str, name: str, columns: list[str]) -> DataFrame:
    """Read one warehouse table and project the used columns (``scan_table``)."""
    return Tables(spark, root).read(name).select(*columns)
