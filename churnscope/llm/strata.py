"""Ranked lexical search on a length-stratified index.

A document's normaliser m depends only on its length, so documents of equal m
form a stratum, and inside it a term's impact on the score depends only on its
frequency tf.  The index has rows of one stratum each: its documents, and for
every term and tf the list of documents with it.  A large stratum is dealt to
many tasks in pieces and has many rows, a row never more than ``POSTINGS``
postings unless one document has more.

A search computes the impact of every tf of a stratum once.  The sum of a
query's best impacts in a stratum bounds the scores there; strata are visited
from the highest bound on, and not at all where the bound is below the lowest of
the best scores so far.  Every task returns its best documents of every query,
and two rounds of windows keep the best of these, so no task sees all of them.

Scores are whole numbers: a term's weight is ``floor(1000 * ln((2 N + 2) /
(2 df + 1)))``, its impact ``10^9 tf div (1000 tf + 20 m)``, and m is ``50 +
(50 n N) div L`` for the n terms of a document, N documents with a term and L
terms in all.  Terms are known by 64-bit hashes: with a billion different terms
and a million query terms the chance that any two of them meet is 1 in 18,000.

Queries go to the index in blocks of about ``QUERY_TERMS`` distinct terms, so
what is broadcast is bounded, however many queries there are.

Defined cases: a null or termless document counts for nothing and is never
found, nor is one whose doc_id is null; a null or termless query finds nothing;
equal rows of documents count and are found each; equal rows of queries are one
query, different texts with one item_id are queries of their own; equal scores
are ordered by doc_id; empty tables give an empty result; other columns are
ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnscope.llm import words as W
from churnscope.llm.common import keyed, schema, stage

POSTINGS = 1 << 13  # of an index row
PIECE = 1 << 15  # postings of a stratum that are dealt to one task together
STRATA = 1_000_000  # strata up to which their sizes go to the documents instead of the documents being shuffled
BUILD, ROUND = 1 << 19, 1 << 19  # postings that a task holds while it builds, and while it searches
QUERY_TERMS = 1 << 20
FIRST_VISIT = 512  # documents scored before the first look at the bounds; doubles from visit to visit
EXACT_TERMS = 300_000  # a float holds the sum of so many terms' products exactly
SALT = 64
_HASH = W.Hash(12, W.LOWER)
INDEX = "m bigint, docs array<bigint>, terms array<bigint>, tfs array<int>, ends array<int>, posts array<int>"


def _terms(batch):
    """Per slice of a batch: its rows, and by row the distinct terms, their frequencies, how many there are, and all terms."""
    for part, data, off in W.texts(batch):
        rows = part.stop - part.start
        starts, ends, row = W.bounds(data, off, W.NOT_WORD)
        h = _HASH.words(data, starts, ends)
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        at = np.flatnonzero(new)
        yield batch.slice(part.start, rows), h[at], np.diff(np.append(at, len(h))), np.bincount(row[at], minlength=rows), np.bincount(row, minlength=rows)


def _list(values: np.ndarray, counts: np.ndarray, kind=None) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(W.offsets_of(counts).astype(np.int32)), pa.array(values, kind))


def _scan(batches):
    for batch in batches:
        for src, h, tf, distinct, n in _terms(batch):
            yield pa.RecordBatch.from_arrays(
                [src.column(0), src.column(1), pa.array(n.astype(np.int64)), _list(W.signed(h), distinct), _list(tf, distinct, pa.int32())],
                names=["doc_id", "_k", "n", "terms", "tfs"],
            )


def _flat(batch, name: str, kind) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column, and how many every row has."""
    col = batch.column(batch.schema.get_field_index(name))
    return np.asarray(col.flatten(), dtype=kind), np.asarray(col.value_lengths(), dtype=np.int64)


def _block(batches: list) -> pa.RecordBatch:
    """Index rows of documents that come by stratum."""
    table = pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
    doc, m = (np.asarray(table.column(i), dtype=np.int64) for i in (0, 1))
    terms, counts = _flat(table, "terms", np.int64)
    tfs, _ = _flat(table, "tfs", np.int32)
    total = np.cumsum(counts)
    new = np.ones(len(doc), bool)
    new[1:] = m[1:] != m[:-1]
    before = total - counts
    base = before[new][np.cumsum(new) - 1]  # postings before the document's stratum
    share = (total - 1 - base) // POSTINGS
    new[1:] |= share[1:] != share[:-1]
    row = np.cumsum(new) - 1
    rows = row[-1] + 1
    size = np.bincount(row, minlength=rows)
    local = np.arange(len(doc)) - W.offsets_of(size)[row]
    own, post = np.repeat(row, counts), np.repeat(local, counts)
    order = np.lexsort((post, tfs, terms, own))
    own, post, terms, tfs = own[order], post[order], terms[order], tfs[order]
    first = np.ones(len(own), bool)
    first[1:] = (terms[1:] != terms[:-1]) | (tfs[1:] != tfs[:-1]) | (own[1:] != own[:-1])
    at = np.flatnonzero(first)
    postings = W.offsets_of(np.bincount(own, minlength=rows))
    ends = np.append(at[1:], len(own)) - postings[own[at]]
    groups = np.bincount(own[at], minlength=rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(m[new]), _list(doc, size), _list(terms[at], groups), _list(tfs[at], groups, pa.int32()), _list(ends, groups, pa.int32()),
         _list(post, np.diff(postings), pa.int32())],
        names=["m", "docs", "terms", "tfs", "ends", "posts"],
    )


def _build(batches):
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += len(batch.column(2).flatten())
        if size >= BUILD:
            yield _block(held)
            held, size = [], 0
    if held:
        yield _block(held)


def build_index(docs: DataFrame) -> tuple[DataFrame, int, int]:
    """The index as a table of the shared folder, the number of documents with a term, and that of all terms."""
    scanned = keyed(docs).filter("doc_id IS NOT NULL").mapInArrow(_scan, schema("doc_id bigint, _k bigint, n bigint, terms array<bigint>, tfs array<int>"))
    scanned = stage(scanned.filter("n > 0"), "terms")
    n, total = scanned.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    m = F.expr(f"50 + (50 * n * {n}L) div {max(total, 1)}L")
    strata = scanned.groupBy(m.alias("m")).agg((F.floor(F.sum(F.size("terms")) / PIECE) + 1).alias("pieces"))
    strata = stage(strata, "strata")
    sizes = F.broadcast(strata) if strata.count() <= STRATA else strata
    dealt = scanned.select("doc_id", m.alias("m"), "terms", "tfs").join(sizes, "m")
    dealt = dealt.withColumn("piece", F.pmod(F.xxhash64("doc_id", "terms"), "pieces")).repartition("m", "piece")
    dealt = dealt.sortWithinPartitions("m", "piece", "doc_id").select("doc_id", "m", "terms", "tfs")
    return stage(dealt.mapInArrow(_build, schema(INDEX)), "index"), n, total


def _ranges(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one range after the other."""
    size = last - first
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())


class _Best:
    """The best documents of a query so far, best first."""

    def __init__(self, top: int):
        self.top, self.score, self.doc = top, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def least(self) -> int:
        """The score that a document needs at least."""
        return int(self.score[-1]) if len(self.score) == self.top else 1

    def add(self, score: np.ndarray, doc: np.ndarray) -> None:
        score, doc = np.concatenate([self.score, score]), np.concatenate([self.doc, doc])
        order = np.lexsort((doc, -score))[: self.top]
        self.score, self.doc = score[order], doc[order]


def _search_round(batches: list, known: np.ndarray, weight: np.ndarray, queries: list[np.ndarray], best: list[_Best]) -> None:
    table = pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
    m = np.asarray(table.column(0), dtype=np.int64)
    docs, sizes = _flat(table, "docs", np.int64)
    terms, groups = _flat(table, "terms", np.int64)
    tfs, _ = _flat(table, "tfs", np.int64)
    ends, _ = _flat(table, "ends", np.int64)
    posts, postings = _flat(table, "posts", np.int64)
    rows = len(m)
    row = np.repeat(np.arange(rows), groups)
    starts = np.zeros(len(ends), np.int64)
    starts[1:] = ends[:-1]
    starts[W.offsets_of(groups)[:-1][groups > 0]] = 0
    base = W.offsets_of(postings)[row]
    term = np.minimum(np.searchsorted(known, terms), len(known) - 1)
    wanted = np.flatnonzero(known[term] == terms)
    order = wanted[np.lexsort((row[wanted], term[wanted]))]
    term, row, tf, first, last = term[order], row[order], tfs[order], (base + starts)[order], (base + ends)[order]
    # the impact of every tf of a stratum, once
    kind, place = np.unique(np.stack([m[row], tf], axis=1), axis=0, return_inverse=True)
    impact = ((1_000_000_000 * kind[:, 1]) // (1000 * kind[:, 1] + 20 * kind[:, 0]))[place.reshape(-1)]
    own = np.repeat(np.arange(rows), postings)
    posts = posts + W.offsets_of(sizes)[own]
    # per term and row: its groups and its greatest impact
    new = np.ones(len(term), bool)
    new[1:] = (term[1:] != term[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    greatest = np.maximum.reduceat(impact, at) if len(at) else impact
    cell_row, cell_last = row[at], np.append(at[1:], len(term))
    cells = np.searchsorted(term[at], np.arange(len(known) + 1))
    for q, ids in enumerate(queries):
        cell = _ranges(cells[ids], cells[ids + 1])
        if not len(cell):
            continue
        value = np.repeat(weight[ids], cells[ids + 1] - cells[ids])
        total = np.zeros(rows, np.int64)
        np.add.at(total, cell_row[cell], value * greatest[cell])
        visits = np.argsort(-total, kind="stable")
        done, share = 0, FIRST_VISIT
        while done < rows:
            bound = max(best[q].least(), 1)
            if total[visits[done]] < bound:
                break
            till = done + 1 + int(np.searchsorted(np.cumsum(sizes[visits[done:]]), share))
            chosen = np.zeros(rows, bool)
            chosen[visits[done:till]] = True
            chosen &= total >= bound
            use = chosen[cell_row[cell]]
            group = _ranges(at[cell[use]], cell_last[cell[use]])
            gain = np.repeat(value[use], cell_last[cell[use]] - at[cell[use]]) * impact[group]
            hit = posts[_ranges(first[group], last[group])]
            gain = np.repeat(gain, last[group] - first[group])
            if len(ids) <= EXACT_TERMS:
                score = np.bincount(hit, weights=gain, minlength=len(docs)).astype(np.int64)
            else:
                score = np.zeros(len(docs), np.int64)
                np.add.at(score, hit, gain)
            good = np.flatnonzero(score >= bound)
            if len(good):
                best[q].add(score[good], docs[good])
            done, share = till, share * 2


def _search(queries, top: int):
    """Best documents of every query in the partition: query number, doc_id, score."""

    def run(batches):
        known, weight, ids = queries.value
        best = [_Best(top) for _ in ids]
        held, size = [], 0
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                held.append(batch.slice(a, 64))
                size += len(held[-1].column(5).flatten())
                if size >= ROUND:
                    _search_round(held, known, weight, ids, best)
                    held, size = [], 0
        if held:
            _search_round(held, known, weight, ids, best)
        for q, b in enumerate(best):
            if len(b.doc):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b.doc), q, np.int32)), pa.array(b.doc), pa.array(b.score)], names=["q", "doc_id", "score"])

    return run


def _count(known):
    """In how many documents of a batch each query term is."""

    def run(batches):
        terms = known.value
        for batch in batches:
            found, groups = _flat(batch, "terms", np.int64)
            ends, _ = _flat(batch, "ends", np.int64)
            size = np.diff(ends, prepend=0)
            head = W.offsets_of(groups)[:-1][groups > 0]
            size[head] = ends[head]
            at = np.minimum(np.searchsorted(terms, found), len(terms) - 1)
            hit = terms[at] == found
            n = np.bincount(at[hit], weights=size[hit], minlength=len(terms)).astype(np.int64)
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(terms[some]), pa.array(n[some])], names=["term", "df"])

    return run


def _query_terms(batches):
    for batch in batches:
        for src, h, _, distinct, _ in _terms(batch):
            yield pa.RecordBatch.from_arrays([src.column(0), src.column(1), _list(W.signed(h), distinct)], names=["doc_id", "_k", "terms"])


def search(index: DataFrame, documents: int, queries: DataFrame, top: int = 50) -> DataFrame:
    """``item_id, rank, doc_id, score`` of the ``top`` best documents of every row ``item_id, text`` of ``queries``."""
    spark = index.sparkSession
    asked = keyed(queries.select(F.col("item_id").alias("doc_id"), "text")).mapInArrow(_query_terms, schema("doc_id bigint, _k bigint, terms array<bigint>"))
    asked = stage(asked.filter(F.size("terms") > 0).distinct(), "queries")
    blocks = -(-(asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // QUERY_TERMS)
    found = None
    for block in range(blocks):
        rows = asked.filter(F.pmod("_k", F.lit(blocks)) == block).collect()
        if not rows:
            continue
        known = np.unique(np.concatenate([np.array(r["terms"], dtype=np.int64) for r in rows]))
        wide = spark.sparkContext.broadcast(known)
        count = index.select("terms", "ends").mapInArrow(_count(wide), schema("term bigint, df bigint")).groupBy("term").agg(F.sum("df").alias("df"))
        df = np.zeros(len(known), np.int64)
        for r in count.collect():
            df[np.searchsorted(known, r["term"])] = r["df"]
        weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * x + 1))) for x in df.tolist()], dtype=np.int64)
        ids = [np.searchsorted(known, np.array(r["terms"], dtype=np.int64)) for r in rows]
        sent = spark.sparkContext.broadcast((known, weight, ids))
        part = index.mapInArrow(_search(sent, top), schema("q int, doc_id bigint, score bigint"))
        items = spark.createDataFrame([(q, r["doc_id"]) for q, r in enumerate(rows)], "q int, item_id bigint")
        part = part.withColumn("block", F.lit(block)).join(F.broadcast(items), "q")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    best = [F.desc("score"), F.asc("doc_id")]
    near = Window.partitionBy("block", "q", "salt").orderBy(*best)
    found = found.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALT))).withColumn("rank", F.row_number().over(near)).filter(F.col("rank") <= top)
    last = Window.partitionBy("block", "q").orderBy(*best)
    found = found.withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= top)
    return found.select("item_id", "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, queries: DataFrame, top: int = 50) -> DataFrame:
    index, n, _ = build_index(docs)
    return search(index, n, queries, top)
