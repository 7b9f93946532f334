"""Helpers shared by the operators: shared-folder tables, row keys, components."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnscope.session import checkpoint_dir

#: Documents as the operators see them: other columns are never looked at.
DOC = "doc_id", "text"
BATCH_ROWS = 2_000


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder of the session."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def short_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ``BATCH_ROWS`` rows in this session: bounds the memory of tasks that hand on whole texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, _k, text``: null texts become empty, ``_k`` tells rows that share a doc_id apart.

    Equal rows share their key, and every operator gives equal rows equal results.
    """
    short_batches(docs.sparkSession)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("doc_id", "text").alias("_k"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest node reachable from every node of ``edges(a, b)``: columns ``node, comp``.

    Every round takes the smallest label among a node's neighbours, then jumps
    from a label to that label's own label.  Labels live in tables of the shared
    folder; the driver sees one count per round.  Long chains halve each round.
    """
    both = stage(
        edges.select(F.col("a").alias("node"), F.col("b").alias("to"))
        .union(edges.select(F.col("b").alias("node"), F.col("a").alias("to")))
        .distinct(),
        "edges",
    )
    labels = stage(
        both.groupBy("node").agg(F.min("to").alias("m")).select("node", F.least("node", "m").alias("comp")), "labels"
    )
    for _ in range(max_rounds):
        near = both.join(labels.select(F.col("node").alias("to"), F.col("comp").alias("near")), "to")
        best = near.groupBy("node").agg(F.min("near").alias("near"))
        hooked = labels.join(best, "node").select("node", "comp", F.least("comp", "near").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("comp").alias("jump"))
        moved = stage(
            hooked.join(jump, "next").select("node", F.col("comp").alias("old"), F.least("next", "jump").alias("comp")),
            "labels",
        )
        labels = moved.select("node", "comp")
        if moved.filter("old <> comp").limit(1).count() == 0:
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def schema(text: str) -> T.StructType:
    return T.StructType.fromDDL(text)
