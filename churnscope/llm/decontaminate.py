"""Benchmark decontamination by winnowing.

Documents and benchmark items keep the smallest 5-gram hash of every 6
consecutive 5-grams.  Two texts that share 10 words then share a fingerprint
inside them, so a join on fingerprints finds every shared span; each hit is
extended to the left and right over the words around it and counts once 10
words agree.  Items of fewer words are looked up whole, with their own length.

Fingerprints of documents pass a bit table of the benchmark's fingerprints
first.  Its size is fixed (``FILTER_BITS``) whatever the benchmark's size is:
a larger benchmark lets more fingerprints through to the join, none is lost.

Defined cases: a null or wordless text has no words, no hits and is clean; a
wordless item never occurs; repeated documents are judged alike; repeated
items count once by item_id (a null item_id occurs as the empty string);
an empty benchmark leaves everything clean; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnscope.llm import words as W
from churnscope.llm.common import keyed, schema, stage

SPAN = 10
FILTER_BITS = 22
_HASH = W.Hash(31, W.LOWER)

_HIT = "struct<h:bigint,m:int,at:int,ctx:array<bigint>>"
_ROW = f"doc_id bigint, _k bigint, n_words bigint, hits array<{_HIT}>"


def _kgram(span: int) -> int:
    return max(1, span // 2)


def _fingerprints(h, rows, span: int, short: list[int]):
    """Hash, length (0: winnowed) and first word of every fingerprint."""
    k = _kgram(span)
    out = [(*W.winnow(h, rows, k, span - k + 1), 0)]
    out += [(*W.grams(h, rows, m), m) for m in short]
    g = np.concatenate([x[0] for x in out])
    at = np.concatenate([x[1] for x in out]).astype(np.int64)
    m = np.concatenate([np.full(len(x[0]), x[2], dtype=np.int32) for x in out])
    return W.mix(g + W.U(0x9E37) * m.astype(np.uint64)), at, m


def _context(h, rows, at, m, span: int, outside: int) -> np.ndarray:
    """Hashes of the words around each fingerprint; ``outside`` stands beyond the text's ends."""
    k = _kgram(span)
    idx = at[:, None] + np.arange(k - span, span)[None, :]
    ok = (idx >= 0) & (idx < len(h))
    idx = np.where(ok, idx, 0)
    ok &= rows[idx] == rows[at][:, None]
    return np.where(ok, W.signed(h)[idx], np.int64(outside))


def _hits_array(row, h, m, at, ctx, n_rows: int) -> pa.Array:
    order = np.argsort(row, kind="stable")
    width = ctx.shape[1]
    lists = pa.ListArray.from_arrays(
        pa.array(np.arange(len(row) + 1, dtype=np.int32) * width), pa.array(ctx[order].reshape(-1))
    )
    rec = pa.StructArray.from_arrays(
        [pa.array(W.signed(h)[order]), pa.array(m[order].astype(np.int32)), pa.array(at[order].astype(np.int32)), lists],
        names=["h", "m", "at", "ctx"],
    )
    return pa.ListArray.from_arrays(pa.array(W.offsets_of(np.bincount(row, minlength=n_rows)).astype(np.int32)), rec)


def _scan(span: int, short: list[int], bits=None, outside: int = 0, whole_short: bool = False):
    """Per row: number of words and its fingerprints (those that pass the bit table)."""

    def run(batches):
        table = None if bits is None else bits.value
        for batch in batches:
            for part, data, off in W.texts(batch):
                n = part.stop - part.start
                starts, ends, rows = W.bounds(data, off, W.NOT_WORD)
                h = _HASH.words(data, starts, ends)
                counts = np.bincount(rows, minlength=n)
                lengths = sorted(set(counts[(counts > 0) & (counts < span)].tolist())) if whole_short else short
                g, at, m = _fingerprints(h, rows, span, lengths)
                if whole_short:  # an item of fewer words is one window
                    keep = np.where(m == 0, True, counts[rows[at]] == m) if len(at) else np.zeros(0, bool)
                else:
                    slot = (g >> W.U(64 - FILTER_BITS)).astype(np.int64)
                    keep = (table[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
                g, at, m = g[keep], at[keep], m[keep]
                ctx = _context(h, rows, at, m, span, outside)
                first = W.offsets_of(counts)[:-1]
                own = rows[at]
                src = batch.slice(part.start, n)
                yield pa.RecordBatch.from_arrays(
                    [src.column(0), src.column(1), pa.array(counts.astype(np.int64)),
                     _hits_array(own, g, m, at - first[own], ctx, n)],
                    names=["doc_id", "_k", "n_words", "hits"],
                )

    return run


def _extend(span: int):
    """Agreeing words around a shared fingerprint: first word and end of the run, if it is long enough."""
    k = _kgram(span)

    def run(batches):
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            width = 2 * span - k
            x, y = (np.asarray(b.column(c).flatten()).reshape(n, width) for c in ("d", "i"))
            m, at = np.asarray(b.column("m")), np.asarray(b.column("at"))
            same = x == y
            left = np.logical_and.accumulate(same[:, : span - k][:, ::-1], axis=1).sum(axis=1)
            right = np.logical_and.accumulate(same[:, span - k :], axis=1).sum(axis=1)
            short = m > 0
            whole = np.where(short, right >= m, (right >= k) & (left + right >= span))
            lo = np.where(short, at, at - left)
            hi = np.where(short, at + m, at + right)
            sel = pa.array(np.flatnonzero(whole))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(sel), b.column("_k").take(sel), b.column("item").take(sel),
                 pa.array(lo[whole].astype(np.int64)), pa.array(hi[whole].astype(np.int64))],
                names=["doc_id", "_k", "item", "lo", "hi"],
            )

    return run


def contaminated_words(docs: DataFrame, benchmark: DataFrame, span: int = SPAN) -> tuple[DataFrame, DataFrame]:
    """Scanned documents ``doc_id, _k, n_words, hits`` and spans ``doc_id, _k, item, lo, hi`` that occur in items."""
    spark = docs.sparkSession
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
        F.col("text"),
    )
    item_rows = items.select(F.xxhash64("item", "text").alias("doc_id"), F.lit(0).cast("long").alias("_k"), "text", "item")
    marks = (
        item_rows.select("doc_id", "_k", "text")
        .mapInArrow(_scan(span, [], outside=1, whole_short=True), schema(_ROW))
        .select("doc_id", F.explode("hits").alias("x"))
        .select("doc_id", "x.h", "x.m", F.col("x.ctx").alias("i"))
        .distinct()
    )
    marks = stage(
        marks.join(item_rows.select("doc_id", "item").distinct(), "doc_id").select("h", "m", "i", "item").distinct(),
        "benchmark",
    )
    short = sorted(r["m"] for r in marks.filter("m > 0").select("m").distinct().collect())  # below ``span`` values
    slot = f"shiftrightunsigned(h, {64 - FILTER_BITS})"
    set_bytes = (
        marks.selectExpr(f"shiftright({slot}, 3) AS byte", f"shiftleft(1, cast({slot} % 8 AS int)) AS bit")
        .groupBy("byte")
        .agg(F.bit_or("bit").alias("bits"))
        .collect()
    )  # at most 2 ** (FILTER_BITS - 3) rows
    table = np.zeros(1 << (FILTER_BITS - 3), dtype=np.uint8)
    for r in set_bytes:
        table[r["byte"]] = r["bits"]
    bits = spark.sparkContext.broadcast(table)
    scanned = stage(keyed(docs).mapInArrow(_scan(span, short, bits), schema(_ROW)), "scanned")
    found = (
        scanned.filter(F.size("hits") > 0)
        .select("doc_id", "_k", F.explode("hits").alias("x"))
        .select("doc_id", "_k", "x.h", "x.m", "x.at", F.col("x.ctx").alias("d"))
        .distinct()
    )
    spans = found.join(marks, ["h", "m"]).select("doc_id", "_k", "m", "at", "d", "i", "item")
    return scanned, spans.mapInArrow(_extend(span), schema("doc_id bigint, _k bigint, item string, lo bigint, hi bigint"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, span: int = SPAN) -> DataFrame:
    """``doc_id, _k, n_words, n_hit, items`` (sorted distinct item ids) of every document."""
    scanned, spans = contaminated_words(docs, benchmark, span)
    spans = stage(spans.distinct(), "spans")
    words = (
        spans.select("doc_id", "_k", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("w"))
        .distinct()
        .groupBy("doc_id", "_k")
        .agg(F.count(F.lit(1)).alias("n_hit"))
    )
    items = spans.groupBy("doc_id", "_k").agg(F.array_sort(F.collect_set("item")).alias("items"))
    hit = words.join(items, (words.doc_id.eqNullSafe(items.doc_id)) & (words._k == items._k)).select(
        words.doc_id.alias("d"), words._k.alias("k"), "n_hit", "items"
    )
    return scanned.join(hit, (F.col("doc_id").eqNullSafe(F.col("d"))) & (F.col("_k") == F.col("k")), "left").select(
        "doc_id",
        "_k",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )
