"""Substring deduplication by level-wise doubling.

The levels' window lengths double up to ``length`` (13, 25 and 50 words for 50).
Below the last, a level looks at one window of every run of consecutive ones,
that with the smallest hash (winnowing), chosen so that every full window has a
chosen one of each level inside.  The first level looks at all documents.  Only
what lies around a window that occurs in two or more documents can hold a longer
one that does, so the next level looks there alone; where no window repeats, the
levels end.  The last level looks at every full window that is left, and one is
removed where its words also start in a document with a smaller doc_id.  Windows
of greater lengths need no look: what they cover, windows of ``length`` cover.

Documents with equal word sequences are one class: all but the smallest
doc_id are removed whole, and only that one takes part in the levels.

Hashes are 64 bits wide.  A repeated window gives one row per document that has
it; the smallest doc_id is a partial aggregate, so frequent passages are never
gathered in one task.

Defined cases: a null or wordless text has no words, nothing is removed, and the
kept text is empty; a text shorter than the window is kept; repetitions inside
one document, and rows that share a doc_id, do not remove each other; a null
doc_id is neither smaller nor larger than any other, its row is kept whole; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnscope.llm import words as W
from churnscope.llm.common import keyed, schema, stage

LENGTH = 50
FIRST = 16  # the first level's windows are no longer than this
_HASH = W.Hash(6)
_EMPTY = hashlib.sha256(b"").hexdigest()


def _rows(batch):
    for part, data, off in W.texts(batch):
        starts, ends, rows = W.bounds(data, off, W.SPACE)
        n = part.stop - part.start
        yield batch.slice(part.start, n), data, off, starts, ends, rows, _HASH.words(data, starts, ends), np.bincount(rows, minlength=n)


def _lists(values: np.ndarray, row: np.ndarray, n: int) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(W.offsets_of(np.bincount(row, minlength=n)).astype(np.int32)), pa.array(W.signed(values)))


def level_lengths(length: int) -> list[int]:
    """Window lengths of the levels below the last, each at least half of the next."""
    out = [length]
    while out[0] > FIRST:
        out.insert(0, -(-out[0] // 2))
    return out[:-1] or [-(-length // 2)]


def _scan(length: int):
    """Per row: words, hash of the word sequence, digest of the whole text's words, and each level's chosen windows with their places."""
    levels = level_lengths(length)

    def run(batches):
        for batch in batches:
            for src, data, off, _, _, rows, h, n in _rows(batch):
                first = W.offsets_of(n)
                place = W.mix((np.arange(len(h)) - first[rows]).astype(np.uint64) + W.U(1))
                seq = np.zeros(len(n), np.uint64)
                np.add.at(seq, rows, W.mix(h ^ place))
                raw = data.tobytes()
                shas = [hashlib.sha256(b" ".join(raw[off[i] : off[i + 1]].split())).hexdigest() for i in range(len(n))]
                lists, names = [], []
                for i, k in enumerate(levels):
                    g, at = W.winnow(h, rows, k, length - k + 1)
                    lists += [_lists(g, rows[at], len(n)), _lists((at - first[rows[at]]).astype(np.uint64), rows[at], len(n))]
                    names += [f"h{i}", f"p{i}"]
                yield pa.RecordBatch.from_arrays(
                    [src.column(0), src.column(1), pa.array(n.astype(np.int64)), pa.array(W.signed(seq)), pa.array(shas, pa.string()), *lists],
                    names=["doc_id", "_k", "n_words", "seq", "sha", *names],
                )

    return run


def _around(length: int, k: int, longer: int):
    """The next level's windows that a full window shares with a repeated window of ``k`` words; ``hits``: the latter's places."""

    def run(batches):
        for batch in batches:
            doc, h, p, hits = batch.columns
            counts, found = (np.asarray(c.value_lengths(), dtype=np.int64) for c in (h, hits))
            far = 1 << 32  # apart from the places of other rows
            at = np.asarray(p.flatten(), dtype=np.int64) + np.repeat(np.arange(len(doc)), counts) * far
            hit = np.sort(np.asarray(hits.flatten(), dtype=np.int64) + np.repeat(np.arange(len(doc)), found) * far)
            keep = np.searchsorted(hit, at + longer - length) < np.searchsorted(hit, at + length - k, side="right")
            own = np.repeat(np.arange(len(doc)), counts)[keep]
            yield pa.RecordBatch.from_arrays(
                [doc.take(pa.array(own)), pa.array(np.asarray(h.flatten(), dtype=np.int64)[keep]), pa.array(at[keep] % far)], names=["doc_id", "h", "p"]
            )

    return run


def _extend(length: int):
    """Full windows around the repeated half windows of a row."""
    half = level_lengths(length)[-1]

    def run(batches):
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("halves"))
            done = 0
            for src, _, _, _, _, rows, h, n in _rows(batch):
                known = lists.slice(done, len(n))
                done += len(n)
                g, at = W.winnow(h, rows, half, length - half + 1)
                wanted = np.asarray(known.flatten(), dtype=np.int64).view(np.uint64)
                owner = np.repeat(np.arange(len(n)), np.asarray(known.value_lengths().fill_null(0)))
                hit = at[np.isin(W.mix(g + rows[at].astype(np.uint64)), W.mix(wanted + owner.astype(np.uint64)))]
                edge = np.zeros(len(h) + 1, np.int64)
                np.add.at(edge, np.maximum(hit - (length - half), 0), 1)
                np.add.at(edge, hit + 1, -1)
                open_ = np.cumsum(edge[:-1]) > 0
                full, start = W.grams(h, rows, length)
                keep = open_[start]
                yield pa.RecordBatch.from_arrays(
                    [src.column(0), src.column(1), src.column(2), _lists(full[keep], rows[start[keep]], len(n))],
                    names=["doc_id", "_k", "text", "windows"],
                )

    return run


def _cut(length: int):
    """Removed words and digest of the kept ones, given the windows found in smaller documents."""

    def run(batches):
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("hits"))
            done = 0
            for src, data, off, starts, ends, rows, h, n in _rows(batch):
                known = lists.slice(done, len(n))
                done += len(n)
                full, start = W.grams(h, rows, length)
                wanted = np.asarray(known.flatten(), dtype=np.int64).view(np.uint64)
                owner = np.repeat(np.arange(len(n)), np.asarray(known.value_lengths().fill_null(0)))
                hit = start[np.isin(W.mix(full + rows[start].astype(np.uint64)), W.mix(wanted + owner.astype(np.uint64)))]
                edge = np.zeros(len(h) + 1, np.int64)
                np.add.at(edge, hit, 1)
                np.add.at(edge, hit + length, -1)
                gone = np.cumsum(edge[:-1]) > 0
                first = W.offsets_of(n)
                raw = data.tobytes()
                texts = []
                for i in range(len(n)):
                    own = np.flatnonzero(~gone[first[i] : first[i + 1]]) + first[i]
                    texts.append(b" ".join([raw[a:b] for a, b in zip(starts[own], ends[own])]))
                yield pa.RecordBatch.from_arrays(
                    [src.column(0), src.column(1), pa.array(np.bincount(rows, weights=gone, minlength=len(n)).astype(np.int64)),
                     pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()), pa.array(texts, pa.binary()).cast(pa.string())],
                    names=["doc_id", "_k", "n_removed", "sha", "kept"],
                )

    return run


def cut_repeats(docs: DataFrame, length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """All documents ``doc_id, _k, n_words, sha, copy`` and those cut in part ``doc_id, _k, n_removed, sha, kept``."""
    docs = keyed(docs)
    levels = level_lengths(length)
    windows = [f"{x}{i}" for i in range(len(levels)) for x in "hp"]
    ddl = "doc_id bigint, _k bigint, n_words bigint, seq bigint, sha string" + "".join(f", {w} array<bigint>" for w in windows)
    scanned = stage(docs.mapInArrow(_scan(length), schema(ddl)), "level-windows")
    able = scanned.filter(f"doc_id IS NOT NULL AND n_words >= {length}")
    heads = stage(able.groupBy("seq", "n_words").agg(F.min("doc_id").alias("head")), "heads")
    rows = stage(
        scanned.join(heads, ["seq", "n_words"], "left").select(
            "doc_id", "_k", "n_words", "sha", F.coalesce(F.col("doc_id") > F.col("head"), F.lit(False)).alias("copy"),
            *[F.when(F.col("doc_id") == F.col("head"), F.col(w)).alias(w) for w in windows],
        ),
        "classes",
    )
    looked = rows.filter("h0 IS NOT NULL")
    found = looked.select("doc_id", F.explode(F.arrays_zip("h0", "p0")).alias("w")).select("doc_id", "w.h0", "w.p0").toDF("doc_id", "h", "p")
    for i, k in enumerate(levels):
        found = stage(found.distinct(), f"level-{k}")
        twice = found.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("h")
        hits = found.join(stage(twice, "repeated"), "h")  # stored: a window that many documents have may be split
        if i + 1 < len(levels):
            near = looked.join(hits.groupBy("doc_id").agg(F.collect_list("p").alias("hits")), "doc_id").select("doc_id", f"h{i + 1}", f"p{i + 1}", "hits")
            found = near.mapInArrow(_around(length, k, levels[i + 1]), schema("doc_id bigint, h bigint, p bigint"))
    candidates = hits.groupBy("doc_id").agg(F.collect_set("h").alias("halves"))
    grown = stage(
        docs.join(candidates, "doc_id").select("doc_id", "_k", "text", "halves").mapInArrow(
            _extend(length), schema("doc_id bigint, _k bigint, text string, windows array<bigint>")
        ),
        "windows",
    )
    full = grown.select("doc_id", F.explode("windows").alias("h"))
    lowest = full.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("h", "lo")
    later = full.join(stage(lowest, "lowest"), "h").filter("doc_id > lo").groupBy("doc_id").agg(F.collect_set("h").alias("hits"))
    cut = (
        grown.select("doc_id", "_k", "text")
        .join(later, "doc_id")
        .mapInArrow(_cut(length), schema("doc_id bigint, _k bigint, n_removed bigint, sha string, kept string"))
        .dropDuplicates(["doc_id", "_k"])
    )
    return rows.drop(*windows), cut


def substring_dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id, _k, n_words, n_removed, kept_sha256`` of every document."""
    rows, cut = cut_repeats(docs, length)
    part = cut.select(F.col("doc_id").alias("d"), F.col("_k").alias("k"), "n_removed", F.col("sha").alias("cut_sha"))
    return rows.join(part, (F.col("doc_id") == F.col("d")) & (F.col("_k") == F.col("k")), "left").select(
        "doc_id",
        "_k",
        "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(F.col("copy"), F.lit(_EMPTY)).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"),
    )
