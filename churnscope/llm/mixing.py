"""Mixing sources to target weights by systematic sampling (DataFrame functions only).

Within a source the documents stand in a fixed order (by size class, then by a
hash); the expected copies of each are prefix-summed, one offset per source is
added, and a document is emitted once per integer boundary that its interval
crosses.  Sorting by size class first makes the taken words, not only the taken
documents, come near the target.

The prefix sum has two levels, so no task holds a source: documents are counted
per (source, size class, slot), the counts are summed along each source, and
ranks are only taken inside a slot.  A source of ``n`` documents has about
``sqrt(n)`` slots, whatever its size.  Expected copies are whole multiples of
``2 ** -UNIT_BITS``, so all sums are exact and reruns agree.

Defined cases: a null text has size 0; a null source is a source of its own,
ranked last; a source without words has target 0 and none of its documents is
taken; equal rows are sampled one by one; an empty table gives an empty mix;
other columns are carried along only where ``mixed_rows`` returns rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnscope.llm.common import stage

WEIGHTS = (5, 2, 1)
SHARE = (3, 2)  # words of the mix per word of the input, as a fraction
MOST = 2  # copies of a document at most
UNIT_BITS = 20
SEED = 20240
_SPREAD = 16  # copies of the source table, so that one source's rows meet it in many tasks


def size_column(text="text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(rows: DataFrame, weights=WEIGHTS, share=SHARE, most: int = MOST) -> DataFrame:
    """One row per source of ``rows(source, size)``: ``source, n_docs, source_size, target``.

    Sources that would exceed ``most`` times their size stop there; filling the
    smallest ratio of limit to weight first gives the point where the repeated
    resharing of the excess ends.  The windows run over one row per source.
    """
    src = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights) + 1).cast("int")).cast("long")
    src = src.withColumn("w", weight)
    fill = Window.orderBy((F.col("source_size") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    every = fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    num, den = share
    src = src.select(
        "*",
        (num * F.sum("source_size").over(every) - den * most * F.coalesce(F.sum("source_size").over(before), F.lit(0))).alias("rest"),
        F.sum("w").over(fill.rowsBetween(0, Window.unboundedFollowing)).alias("w_rest"),
    )
    # rest / (den * w_rest): words per unit of weight for this source and all after it
    src = src.withColumn("full", F.col("source_size") * most * den * F.col("w_rest") <= F.col("rest") * F.col("w"))
    level = F.first(F.when(~F.col("full"), F.struct("rest", "w_rest")), ignorenulls=True).over(every)
    return src.withColumn("level", level).select(
        "source",
        "n_docs",
        "source_size",
        F.when(F.col("full"), (F.col("source_size") * most).cast("double"))
        .otherwise(F.col("w") * F.col("level.rest") / (den * F.col("level.w_rest")))
        .alias("target"),
    )


def _slotted(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """``rows`` with its source's figures, expected copies in units, size class and slot."""
    spread = sources.select(
        F.col("source").alias("_s"),
        "source_size",
        "target",
        F.ceil(F.sqrt("n_docs") / 4).alias("_slots"),
        F.explode(F.sequence(F.lit(0), F.lit(_SPREAD - 1))).alias("_salt"),
    )
    own = rows.withColumn("_mix", F.xxhash64(F.lit(SEED), "doc_id", "_k"))
    return own.join(
        spread, F.col("source").eqNullSafe(F.col("_s")) & (F.pmod("_mix", F.lit(_SPREAD)) == F.col("_salt"))
    ).select(
        *rows.columns,
        "_mix",
        "source_size",
        "target",
        F.when(F.col("source_size") > 0, F.round(F.col("target") / F.col("source_size") * (1 << UNIT_BITS)))
        .otherwise(0)
        .cast("long")
        .alias("_units"),
        F.floor(F.log2(F.col("size") + 1) * 4).cast("int").alias("_class"),
        F.pmod(F.shiftright("_mix", 8), F.col("_slots")).alias("_slot"),
    )


def copies(rows: DataFrame, sources: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """``rows`` (doc_id, _k, source, size, ...) with ``source_size, target, copies``.

    ``counted`` has the same documents in a narrow, stored form; the slots are counted from it.
    """
    slotted = _slotted(rows, sources)
    slots = (
        (slotted if counted is None else _slotted(counted, sources))
        .groupBy("source", "_class", "_slot")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    along = Window.partitionBy("source").orderBy("_class", "_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = slots.select(
        F.col("source").alias("_s"),
        F.col("_class").alias("_c"),
        F.col("_slot").alias("_t"),
        F.coalesce(F.sum("_n").over(along), F.lit(0)).alias("_start"),
    )
    inside = Window.partitionBy("source", "_class", "_slot").orderBy("_mix", "doc_id", "_k")
    ranked = slotted.withColumn("_rank", F.row_number().over(inside)).join(
        starts,
        F.col("source").eqNullSafe(F.col("_s")) & (F.col("_class") == F.col("_c")) & (F.col("_slot") == F.col("_t")),
    )
    offset = F.pmod(F.xxhash64(F.lit(SEED), F.lit("offset"), "source"), F.lit(1 << UNIT_BITS))
    end = offset + (F.col("_start") + F.col("_rank")) * F.col("_units")
    crossed = F.shiftright(end, UNIT_BITS) - F.shiftright(end - F.col("_units"), UNIT_BITS)
    return ranked.select(*rows.columns, "source_size", "target", crossed.alias("copies"))


def sizes(docs: DataFrame) -> DataFrame:
    """Narrow rows ``doc_id, _k, source, size`` of the documents, read from the texts once and stored."""
    return stage(
        docs.select("doc_id", F.xxhash64("doc_id", "text").alias("_k"), "source", size_column().alias("size")), "sizes"
    )


def mix(docs: DataFrame, **shares) -> DataFrame:
    """``doc_id, size, source, source_size, target, copies`` of every document."""
    narrow = sizes(docs)
    return copies(narrow, source_targets(narrow, **shares))


def mixed_rows(docs: DataFrame, **shares) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken."""
    narrow = sizes(docs)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    full = docs.select(row, "doc_id", F.xxhash64("doc_id", "text").alias("_k"), "source", size_column().alias("size"))
    taken = copies(full, source_targets(narrow, **shares), narrow).filter("copies > 0")
    return taken.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("_copy")).select("_row.*")
