"""Exact Jaccard join of word n-gram sets with vertical partitioning.

1. Equal sets are one class; only its smallest doc_id goes on.
2. Grams have one global order: those outside a bounded list of frequent grams
   first, by hash, then the listed ones, by hash.  Two sets that link share a
   gram among the first ``n - ceil(t * n) + 1`` of each (prefix filter).
3. Around every shared prefix gram, each class is paired with the gram's
   smallest and largest doc_id.  What links there is merged into components.
   Then classes that share a prefix gram and are still in different components
   are paired, and the components that link are merged.  Pairs inside a
   component need no further link, so a group of thousands of near copies stays
   near-linear.  A gram pairs two sets only where the shorter rest from it on
   could still hold the overlap; the first gram that linked sets share does.
4. A pair goes on only if its sizes and its parity bitmaps allow a link: the
   bitmaps differ in at most as many bits as the sets differ in grams.
5. The order is cut into ``FRAGMENTS`` fragments.  A pair's overlap is counted
   in each fragment by itself, and the counts are summed per pair.

The list of frequent grams (at most ``FREQUENT``) changes only how many pairs
are looked at, never which link.  No step holds a group in one task.

Defined cases: a null or wordless text has an empty set, links with nothing and
is its own component; fewer words than ``k`` make one gram of the whole text;
rows that share a doc_id but not a text are compared each by itself, and each
reports the smallest doc_id that its own text reaches; equal rows count once; a
null doc_id is passed through unlinked, its component null; an empty table gives
an empty result; other columns are ignored; ``percent`` is at least 50.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnscope.llm import words as W
from churnscope.llm.common import components, keyed, schema, stage

FREQUENT = 1 << 16
FREQUENT_FROM = 32  # documents of a scan task in which a gram must be to be reported
WAITING, HELD = 1_000_000, 1_500_000  # grams that a task collects before it counts them, and counted grams from which it forgets rare ones
FRAGMENTS = 8
MINI = 4  # longs of the short parity bitmap; the long one has at least a bit per gram
BROADCAST_IDS = 1_000_000  # wanted documents up to which their ids are sent to the scan instead of all texts shuffled
_HASH = W.Hash(10, W.LOWER)


def _sets(batch, k: int):
    """Distinct gram hashes of each row, rows in order, ascending within a row."""
    for part, data, off in W.texts(batch):
        n = part.stop - part.start
        starts, ends, rows = W.bounds(data, off, W.SPACE)
        h = _HASH.words(data, starts, ends)
        counts = np.bincount(rows, minlength=n)
        g, at = W.grams(h, rows, k)
        own = rows[at] if len(at) else np.zeros(0, np.int64)
        whole = [(W.grams(h, rows, m), m) for m in range(1, k) if (counts == m).any()]
        for (sg, sat), m in whole:
            keep = counts[rows[sat]] == m
            g = np.concatenate([g, W.mix(sg[keep] + W.U(m))])
            own = np.concatenate([own, rows[sat[keep]]])
        order = np.lexsort((g, own))
        g, own = g[order], own[order]
        if len(g):
            new = np.r_[True, (g[1:] != g[:-1]) | (own[1:] != own[:-1])]
            g, own = g[new], own[new]
        yield part, g, own, np.bincount(own, minlength=n)


def _merged(parts: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams, ascending, and the sum of each one's counts."""
    g, n = np.concatenate(parts), np.concatenate(counts)
    order = np.argsort(g)
    g, n = g[order], n[order]
    first = np.flatnonzero(np.r_[np.ones(min(1, len(g)), bool), g[1:] != g[:-1]])
    return g[first], np.add.reduceat(n, first) if len(first) else n


def _count_frequent(k: int, least: int):
    def run(batches):
        parts, counts, waiting = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
        for batch in batches:
            for _, g, _, _ in _sets(batch, k):
                parts.append(g)
                counts.append(np.ones(len(g), np.int64))
                waiting += len(g)
                if waiting > WAITING:
                    g, n = _merged(parts, counts)
                    keep = n > (2 if len(g) > HELD else 0)  # bounds the memory: rare grams so far start anew
                    parts, counts, waiting = [g[keep]], [n[keep]], 0
        g, n = _merged(parts, counts)
        keep = n >= least
        yield pa.RecordBatch.from_arrays([pa.array(W.signed(g[keep])), pa.array(n[keep])], names=["g", "n"])

    return run


def _scan(k: int, percent: int, frequent):
    """Set size, signature, parity bitmap and prefix of every row."""

    def run(batches):
        listed = frequent.value
        for batch in batches:
            for part, g, own, n in _sets(batch, k):
                rows = len(n)
                late = np.zeros(len(g), bool)
                if len(listed):
                    i = np.searchsorted(listed, g)
                    late = listed[np.minimum(i, len(listed) - 1)] == g
                first = W.offsets_of(n)
                sig = np.zeros(rows, np.uint64)
                longs = np.maximum(MINI, 1 << np.ceil(np.log2(np.maximum(n, 1) / 64 + 1e-9)).clip(0).astype(np.int64))
                base = W.offsets_of(longs)
                bits = np.zeros(base[-1], np.uint64)
                mini = np.zeros(rows * MINI, np.uint64)
                if len(g):
                    np.add.at(sig, own, W.mix(g ^ W.U(0xA5A5A5A5A5A5A5A5)))
                    slot, bit = (g >> W.U(6)).astype(np.int64), W.U(1) << (g & W.U(63))
                    np.bitwise_xor.at(bits, base[own] + (slot & (longs[own] - 1)), bit)
                    np.bitwise_xor.at(mini, own * MINI + (slot & (MINI - 1)), bit)
                order = np.lexsort((g, late, own))
                rank = np.arange(len(g)) - first[own]
                prefix = n - (percent * n + 99) // 100 + 1
                take = order[rank < prefix[own]]
                lists = pa.ListArray.from_arrays(
                    pa.array(W.offsets_of(np.bincount(own[take], minlength=rows)).astype(np.int32)), pa.array(W.signed(g)[take])
                )
                maps = pa.ListArray.from_arrays(pa.array(base.astype(np.int32)), pa.array(W.signed(bits)))
                minis = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * MINI), pa.array(W.signed(mini)))
                src = batch.slice(part.start, rows)
                yield pa.RecordBatch.from_arrays(
                    [src.column(0), src.column(1), pa.array(n.astype(np.int64)), pa.array(W.signed(sig)), minis, maps, lists],
                    names=["doc_id", "_k", "n", "sig", "mini", "bits", "prefix"],
                )

    return run


def _fragments(k: int):
    """The grams of every row, cut into fragments of the global order."""

    def run(batches):
        for batch in batches:
            for part, g, own, n in _sets(batch, k):
                frag = (g >> W.U(61)).astype(np.int64) * FRAGMENTS // 8
                key = own * FRAGMENTS + frag  # ascending: grams ascend within a row
                used, start = np.unique(key, return_index=True)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.append(start, len(g)).astype(np.int32)), pa.array(W.signed(g))
                )
                ids = batch.column(0).slice(part.start, len(n)).take(pa.array(used // FRAGMENTS))
                yield pa.RecordBatch.from_arrays([ids, pa.array((used % FRAGMENTS).astype(np.int32)), lists], names=["d", "f", "grams"])

    return run


def _rest(v):
    """Grams of a set from a prefix gram on; ``v`` packs the set's size above them."""
    return v.bitwiseAND(F.lit(0xFFFFFFFF))


def _long_enough(percent: int, v, w):
    """Whether two sets may link if they share no gram before this one."""
    return F.least(_rest(v), _rest(w)) * (100 + percent) >= (F.shiftright(v, 32) + F.shiftright(w, 32)) * percent


def _folded(bits, other):
    """A bitmap of twice the other's length, halved: parities of grams that meet in one bit add up."""
    half = F.size(bits) / 2
    two = F.zip_with(F.slice(bits, F.lit(1), half.cast("int")), F.slice(bits, (half + 1).cast("int"), half.cast("int")), lambda p, q: p.bitwiseXOR(q))
    return F.when(F.size(bits) > F.size(other), two).otherwise(bits)


def _possible(percent: int, bits: str):
    """Condition on sizes and bitmaps without which two sets can't link."""
    p, q = F.col(f"x.{bits}"), F.col(f"y.{bits}")
    differ = F.aggregate(
        F.zip_with(_folded(p, q), _folded(q, p), lambda v, w: F.bit_count(v.bitwiseXOR(w))), F.lit(0), lambda s, v: s + v
    )
    return (F.least("x.n", "y.n") * 100 >= F.greatest("x.n", "y.n") * percent) & (
        differ * (100 + percent) <= (F.col("x.n") + F.col("y.n")) * (100 - percent)
    )


def _linked(docs: DataFrame, classes: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs ``a, b`` (classes with sizes) that link: partial overlaps per fragment, summed."""
    pairs = stage(pairs, "pairs")
    wanted = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct()
    wanted = stage(classes.join(wanted.withColumnRenamed("doc_id", "node"), "node"), "wanted")
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    texts = docs.join(wanted, ["doc_id", "_k"]).dropDuplicates(["doc_id", "_k"]).select(F.col("node").alias("doc_id"), "text")
    cut = stage(texts.mapInArrow(_fragments(k), schema("d bigint, f int, grams array<bigint>")), "fragments")
    left = pairs.join(cut.select(F.col("d").alias("a"), "f", F.col("grams").alias("ga")), "a")
    both = left.join(cut.select(F.col("d").alias("b"), "f", F.col("grams").alias("gb")), ["b", "f"])
    part = both.select("a", "b", "na", "nb", F.size(F.array_intersect("ga", "gb")).cast("long").alias("o"))
    total = part.groupBy("a", "b", "na", "nb").agg(F.sum("o").alias("o"))
    return stage(total.filter(100 * F.col("o") >= percent * (F.col("na") + F.col("nb") - F.col("o"))).select("a", "b"), "links")


def jaccard_components(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """``doc_id, _k, n_shingles, component_id`` of every document."""
    if percent < 50:
        raise ValueError("bitmaps of linked sets differ in length by a factor of two at most: percent is at least 50")
    spark = docs.sparkSession
    docs = keyed(docs)
    listed = (
        docs.mapInArrow(_count_frequent(k, FREQUENT_FROM), schema("g bigint, n bigint"))
        .groupBy("g")
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "g")
        .limit(FREQUENT)
        .collect()
    )
    frequent = spark.sparkContext.broadcast(np.sort(np.array([r["g"] for r in listed], dtype=np.int64).view(np.uint64)))
    rows = stage(
        docs.mapInArrow(_scan(k, percent, frequent), schema("doc_id bigint, _k bigint, n bigint, sig bigint, mini array<bigint>, bits array<bigint>, prefix array<bigint>")),
        "sets",
    )
    narrow = rows.filter("doc_id IS NOT NULL AND n > 0").select("doc_id", "_k", "sig", "n")
    # a text is known by its doc_id; another text of the same doc_id by a number that no doc_id is near
    first = narrow.groupBy("doc_id").agg(F.min("_k").alias("first"))
    other = F.lit(-(2**63)).cast("long") + F.shiftrightunsigned(F.xxhash64("doc_id", "_k"), 2)
    own = narrow.distinct().join(first, "doc_id").withColumn("node", F.when(F.col("_k") == F.col("first"), F.col("doc_id")).otherwise(other))
    head = own.groupBy("sig", "n").agg(F.min("node").alias("head"), F.min("doc_id").alias("lowest"))
    member = stage(own.drop("first").join(head, ["sig", "n"]), "classes")
    classes = member.filter("node = head").select("node", "doc_id", "_k")
    lowest = member.filter("node = head").select("head", "lowest")
    reps = rows.join(classes, ["doc_id", "_k"]).withColumn("doc_id", F.col("node"))
    prefix = stage(
        reps.select("doc_id", "n", F.posexplode("prefix").alias("at", "g")).select(
            "g", "doc_id", (F.shiftleft("n", 32) + F.col("n") - F.col("at")).alias("v")
        ),
        "prefix",
    )
    side = stage(reps.select("doc_id", "n", "mini", "bits").distinct(), "bitmaps")
    ends = prefix.groupBy("g").agg(
        F.min("doc_id").alias("lo"),
        F.min_by("v", "doc_id").alias("vlo"),
        F.max("doc_id").alias("hi"),
        F.max_by("v", "doc_id").alias("vhi"),
        F.count(F.lit(1)).alias("docs"),
    )
    shared = stage(prefix.join(ends.filter("lo < hi"), "g"), "shared")

    def joined(pairs: DataFrame) -> DataFrame:
        x = side.select(F.col("doc_id").alias("a"), F.struct("n", "bits").alias("x"))
        y = side.select(F.col("doc_id").alias("b"), F.struct("n", "bits").alias("y"))
        return pairs.join(x, "a").join(y, "b").filter(_possible(percent, "bits")).select("a", "b", F.col("x.n").alias("na"), F.col("y.n").alias("nb"))

    to_lo, to_hi = _long_enough(percent, F.col("vlo"), F.col("v")), _long_enough(percent, F.col("vhi"), F.col("v"))
    hubs = (
        shared.select(
            F.explode(
                F.array(
                    F.when(to_lo, F.struct(F.col("lo").alias("a"), F.col("doc_id").alias("b"))),
                    F.when(to_hi, F.struct(F.col("doc_id").alias("a"), F.col("hi").alias("b"))),
                )
            ).alias("p")
        )
        .select("p.a", "p.b")
        .filter("a < b")
        .distinct()
    )
    comp = components(_linked(docs, classes, joined(hubs), k, percent))
    # a gram of two documents has no pair beyond (lo, hi)
    left = shared.filter("docs > 2").join(comp.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "g", "doc_id", "v", "lo", "hi", F.coalesce("comp", "doc_id").alias("comp")
    )
    mixed = left.groupBy("g").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).filter("c0 < c1").select("g")
    open_ = stage(left.join(mixed, "g").join(side.drop("bits"), "doc_id"), "open")
    x = open_.select("g", F.struct("n", "mini").alias("x"), F.col("v").alias("va"), F.col("doc_id").alias("a"), F.col("comp").alias("ca"), F.col("lo").alias("la"), F.col("hi").alias("ha"))
    y = open_.select("g", F.struct("n", "mini").alias("y"), F.col("v").alias("vb"), F.col("doc_id").alias("b"), F.col("comp").alias("cb"))
    tried = (F.col("a") == F.col("la")) | (F.col("b") == F.col("ha"))
    may = _long_enough(percent, F.col("va"), F.col("vb")) & _possible(percent, "mini")
    rest = x.join(y, (x.g == y.g) & (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & ~tried & may).select("a", "b")
    late = _linked(docs, classes, joined(rest.distinct()), k, percent)
    # links between components, then every class's component, then every copy's
    for end in "ab":
        root = comp.select(F.col("node").alias(end), F.col("comp").alias("root"))
        late = late.join(root, end, "left").withColumn(end, F.coalesce("root", end)).drop("root")
    joint = components(late).select(F.col("node").alias("comp"), F.col("comp").alias("joint"))
    placed = classes.select(F.col("node").alias("head")).join(comp.withColumnRenamed("node", "head"), "head", "left")
    placed = placed.select("head", F.coalesce("comp", "head").alias("comp")).join(joint, "comp", "left")
    placed = stage(placed.select("head", F.coalesce("joint", "comp").alias("comp")).join(lowest, "head"), "placed")
    smallest = placed.groupBy("comp").agg(F.min("lowest").alias("component_id"))
    found = member.select("doc_id", "_k", "head").join(placed.join(smallest, "comp").select("head", "component_id"), "head").drop("head")
    return rows.join(found, ["doc_id", "_k"], "left").select(
        "doc_id", "_k", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )
