"""Corpus pipeline: quality rules, near-duplicate removal, decontamination, mixing, token output.

Every stage takes ``(spark, docs, sf_dir)``, works on all rows that its
predecessor kept, and returns the columns of ``documents``; the last one
returns the written token table.  No SQL twin: trained trees, sampling by hash
and token files are not SQL; tests compare the stages with brute force.

Defined cases, for every stage: a null or empty text is an empty text; texts of
any length are handled whole; other columns, whatever their names, are passed on
unchanged; an empty table stays empty and keeps its columns.  A document is known
by its doc_id and text, so rows that share a doc_id but not a text are judged each
by itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnscope.llm.common import stage, table

#: Near duplicates: five-word shingles, similarity of 0.8 or more.
SHINGLE, PERCENT = 5, 80
BROADCAST_IDS = 1_000_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fixed rules and the trees accept.

    Equal rows are judged alike; a row without a doc_id has no label to learn
    from and is judged like any other.
    """
    from churnscope.llm.quality import accepted

    return accepted(docs, table(spark, sf_dir, "labels"))


def _without(docs: DataFrame, bad: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose (doc_id, _k) is not in ``bad``; a counted, short list goes to the rows, a longer one is shuffled."""
    bad = stage(bad.select(F.col("doc_id").alias("_d"), F.col("_k").alias("_h")).distinct(), "rejected")
    if bad.count() <= BROADCAST_IDS:
        bad = F.broadcast(bad)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rows = docs.select(row, F.col("doc_id").alias("_id"), F.xxhash64("doc_id", "text").alias("_hash"))
    return rows.join(bad, F.col("_id").eqNullSafe(F.col("_d")) & (F.col("_hash") == F.col("_h")), "left_anti").select("_row.*")


def _once(docs: DataFrame, twice: DataFrame) -> DataFrame:
    """One row of each (doc_id, _k) in ``twice``: that whose columns, as JSON, come first; all other rows as they are."""
    columns = docs.columns
    row = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row")
    rows = docs.select(row, F.col("doc_id").alias("_id"), F.xxhash64("doc_id", "text").alias("_hash"))
    keys = twice.select(F.col("doc_id").alias("_d"), F.col("_k").alias("_h"))
    same = F.col("_id").eqNullSafe(F.col("_d")) & (F.col("_hash") == F.col("_h"))
    one = rows.join(keys, same, "left_semi").groupBy("_id", "_hash").agg(F.min_by("_row", F.to_json("_row")).alias("_row"))
    return rows.join(keys, same, "left_anti").select("_row.*").unionByName(one.select("_row.*"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of every group.

    Of rows equal in doc_id and text one stays.  A row without a doc_id, or
    without words, is linked to nothing and stays.
    """
    from churnscope.llm.jaccard import jaccard_components

    found = stage(jaccard_components(docs, SHINGLE, PERCENT), "groups")
    kept = _without(docs, found.filter("doc_id <> component_id"))
    twice = found.groupBy("doc_id", "_k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id", "_k")
    twice = stage(twice, "repeated")
    many = twice.count()
    if not many:
        return kept
    return _once(kept, F.broadcast(twice) if many <= BROADCAST_IDS else twice)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage.

    Equal rows go or stay together; a row without a doc_id is judged by its text.
    """
    from churnscope.llm.decontaminate import decontaminate

    return _without(docs, decontaminate(docs, table(spark, sf_dir, "benchmark")).filter("n_hit > 0"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight takes them.

    A null source is a source; equal rows are sampled each by itself; a source
    without words gives nothing.
    """
    from churnscope.llm.mixing import mixed_rows

    return mixed_rows(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the mix in files; ``doc_id, start, n_tokens, ids_crc32`` read from them.

    A document that the mix takes twice is written twice; a row without a doc_id
    is written first.
    """
    from churnscope.llm.queries import tokenizer_file
    from churnscope.llm.tokens import read_tokens, write_tokens

    return read_tokens(spark, write_tokens(docs, tokenizer_file()))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
    ("token-ID binary output", token_output),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, fn in STAGES:
        docs = stage(fn(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
