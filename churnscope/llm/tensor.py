"""MinHash near-duplicate detection with tensored banding.

1. A document's set is hashed into two small collections of ``TABLES`` sub-keys,
   each made of ``ROWS`` minhashes.  A table key is a pair of sub-keys, one from
   each collection, so ``2 * TABLES * ROWS`` minhashes serve ``TABLES ** 2``
   tables of ``2 * ROWS`` minhashes each.  Two sets of similarity J share a key
   with probability ``(1 - (1 - J ** ROWS) ** TABLES) ** 2``: at J = 0.85 all but
   4 in a million with the values below, and more at every larger J.
2. Equal sets are one class; only its smallest document goes on.
3. A sub-key that no other document has can't be half of a shared table key: it
   goes before the pairs are formed, and with it most documents.
4. In every bucket each document is compared with the bucket's smallest one, and
   the links are merged into components.  Buckets that still hold documents of
   several components are opened: the documents outside a bucket's most frequent
   component are compared with all of other components, so a group of thousands
   of near copies is never paired with itself.  Of buckets that hold the same
   documents one is opened: two similar documents share dozens of keys.
5. A candidate goes on only if its sizes and its parity bitmaps allow a link:
   the bitmaps of two sets differ in at most as many bits as the sets differ in
   shingles.  What is left is decided by the full sets.

No step holds a bucket in one task, and no bucket is capped.

Defined cases: a null or wordless text has an empty set, links with nothing and
is its own component; fewer words than ``k`` make one shingle of the whole text;
rows that share a doc_id but not a text are compared each by itself, and both
report the smallest doc_id that their own text reaches; equal rows get equal
results; a null doc_id is passed on unlinked, its component null and ``kept``
true; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnscope.llm import words as W
from churnscope.llm.common import components, keyed, schema, stage

TABLES, ROWS = 14, 3
BROADCAST_IDS = 1_000_000  # candidate documents up to which their ids go to the texts instead of the texts being shuffled
LONGS = 8  # of a parity bitmap
_HASH, _SECOND = W.Hash(13, W.LOWER), W.U(0x9E3779B97F4A7C15)


def _shingles(batch, k: int):
    """Per slice of a batch: its rows, distinct shingle hashes by row, and set sizes."""
    for part, data, off in W.texts(batch):
        rows = part.stop - part.start
        starts, ends, row = W.bounds(data, off, W.SPACE)
        h = _HASH.words(data, starts, ends)
        length = np.bincount(row, minlength=rows)
        found, at = W.grams(h, row, k)
        owner = row[at]
        for m in range(1, k):  # texts shorter than a shingle
            if (length == m).any():
                short, at = W.grams(h, row, m)
                whole = length[row[at]] == m
                found = np.concatenate([found, W.mix(short[whole] + W.U(m))])
                owner = np.concatenate([owner, row[at[whole]]])
        order = np.lexsort((found, owner))
        found, owner = found[order], owner[order]
        new = np.ones(len(found), bool)
        new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
        found, owner = found[new], owner[new]
        yield batch.slice(part.start, rows), found, owner, np.bincount(owner, minlength=rows)


def _family(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(1300)
    return rng.integers(0, 2**32, count, dtype=np.uint32), rng.integers(0, 2**31, count, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def sub_keys(found: np.ndarray, size: np.ndarray, tables: int, rows: int) -> np.ndarray:
    """``2 * tables`` sub-keys of every non-empty set, one set per line."""
    first = W.offsets_of(size[size > 0])[:-1]
    short = (found >> W.U(32)).astype(np.uint32)
    flip, odd = _family(2 * tables * rows)
    out = np.empty((len(first), 2 * tables), dtype=np.uint64)
    for t in range(2 * tables if len(first) else 0):
        key = np.full(len(first), t + 1, dtype=np.uint64)
        for i in range(t * rows, (t + 1) * rows):
            key = W.mix(key * _SECOND + np.minimum.reduceat((short ^ flip[i]) * odd[i], first))
        out[:, t] = key
    return out


def _scan(k: int, tables: int, rows: int):
    """Set size, two sums that stand for the set, and its sub-keys."""

    def run(batches):
        for batch in batches:
            for src, found, owner, size in _shingles(batch, k):
                one, two = np.zeros(len(size), np.uint64), np.zeros(len(size), np.uint64)
                np.add.at(one, owner, W.mix(found ^ _SECOND))
                np.add.at(two, owner, W.mix(found * _SECOND + W.U(1)))
                keys = sub_keys(found, size, tables, rows)
                lists = pa.ListArray.from_arrays(
                    pa.array(W.offsets_of((size > 0) * 2 * tables).astype(np.int32)), pa.array(W.signed(keys.reshape(-1)))
                )
                yield pa.RecordBatch.from_arrays(
                    [src.column(0), src.column(1), pa.array(size.astype(np.int64)), pa.array(W.signed(one)), pa.array(W.signed(two)), lists],
                    names=["doc_id", "_k", "n", "one", "two", "keys"],
                )

    return run


def _bits(prefix: str) -> list[str]:
    return [f"{prefix}{i}" for i in range(LONGS)]


def _sets(k: int):
    def run(batches):
        for batch in batches:
            for src, found, owner, size in _shingles(batch, k):
                lists = pa.ListArray.from_arrays(pa.array(W.offsets_of(size).astype(np.int32)), pa.array(W.signed(found)))
                bits = np.zeros((LONGS, len(size)), np.uint64)
                np.bitwise_xor.at(bits, ((found >> W.U(6)) % W.U(LONGS), owner), W.U(1) << (found & W.U(63)))
                yield pa.RecordBatch.from_arrays(
                    [src.column(0), src.column(1), pa.array(size.astype(np.int64)), lists, *[pa.array(W.signed(b)) for b in bits]],
                    names=["doc_id", "_k", "n", "grams", *_bits("b")],
                )

    return run


def _buckets(reps: DataFrame, tables: int) -> DataFrame:
    """``key, doc_id, _k, n`` and the bucket's smallest document ``d0, k0, n0``, of keys that two documents share."""
    sub = stage(reps.select("doc_id", "_k", "n", F.posexplode("keys").alias("s", "h")), "sub-keys")
    twice = sub.groupBy("s", "h").agg(F.min("_k").alias("lo"), F.max("_k").alias("hi")).filter("lo < hi").select("s", "h")
    halves = sub.join(twice, ["s", "h"]).groupBy("doc_id", "_k", "n").agg(F.collect_list(F.struct("s", "h")).alias("live"))
    left, right = F.filter("live", lambda x: x["s"] < tables), F.filter("live", lambda x: x["s"] >= tables)
    pairs = F.flatten(F.transform(left, lambda u: F.transform(right, lambda v: F.xxhash64(u["s"], u["h"], v["s"], v["h"]))))
    rows = stage(halves.select("doc_id", "_k", "n", F.explode(pairs).alias("key")), "table-keys")
    ends = rows.groupBy("key").agg(
        F.min("doc_id").alias("d0"), F.min_by("_k", "doc_id").alias("k0"), F.min_by("n", "doc_id").alias("n0"),
        F.min("_k").alias("lo"), F.max("_k").alias("hi"),
    )
    return stage(rows.join(ends.filter("lo < hi").drop("lo", "hi"), "key"), "buckets")


def _alike(percent: int, n: str, m: str):
    """Sizes that allow a link."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def _possible(percent: int, x: str, y: str):
    """Sizes and bitmaps that allow a link, of columns ``n, b0, ...`` with these prefixes."""
    differ = sum(F.bit_count(F.col(a).bitwiseXOR(F.col(b))) for a, b in zip(_bits(f"{x}b"), _bits(f"{y}b")))
    total = F.col(f"{x}n") + F.col(f"{y}n")
    return _alike(percent, f"{x}n", f"{y}n") & (differ * (100 + percent) <= total * (100 - percent))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 85, tables: int = TABLES, rows: int = ROWS) -> DataFrame:
    """``doc_id, _k, n_shingles, component_id, kept`` of every document."""
    docs = keyed(docs)
    scanned = stage(docs.mapInArrow(_scan(k, tables, rows), schema("doc_id bigint, _k bigint, n bigint, one bigint, two bigint, keys array<bigint>")), "minhashes")
    node = F.struct("doc_id", "_k")
    own = scanned.filter("doc_id IS NOT NULL AND n > 0")
    classes = stage(own.groupBy("n", "one", "two").agg(F.min(node).alias("head")), "classes")
    heads = classes.select("head.doc_id", "head._k")
    buckets = _buckets(own.join(heads, ["doc_id", "_k"], "left_semi").dropDuplicates(["doc_id", "_k"]), tables)

    wanted = stage(buckets.select("doc_id", "_k").distinct(), "candidates")
    few = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    texts = docs.join(few, ["doc_id", "_k"], "left_semi")
    bitmap = ["n", *_bits("b")]
    ddl = "doc_id bigint, _k bigint, n bigint, grams array<bigint>" + "".join(f", {b} bigint" for b in bitmap[1:])
    sets = texts.mapInArrow(_sets(k), schema(ddl)).dropDuplicates(["doc_id", "_k"])
    sets = stage(sets.select(node.alias("node"), "grams", *bitmap), "sets")

    def side(end: str) -> DataFrame:
        """Sizes and bitmaps of the documents at one end of a pair."""
        return sets.select(F.col("node").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in bitmap])

    def linked(pairs: DataFrame) -> DataFrame:
        near = pairs.distinct().join(side("a"), "a").join(side("b"), "b").filter(_possible(percent, "a_", "b_")).select("a", "b")
        left = stage(near, "pairs").join(sets.select(F.col("node").alias("a"), F.col("grams").alias("x")), "a")
        both = left.join(sets.select(F.col("node").alias("b"), F.col("grams").alias("y")), "b")
        counted = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("o"), (F.size("x") + F.size("y")).alias("t"))
        return stage(counted.filter(F.col("o") * 100 >= (F.col("t") - F.col("o")) * percent).select("a", "b"), "links")

    hub = F.struct(F.col("d0").alias("doc_id"), F.col("k0").alias("_k"))
    comp = components(linked(buckets.filter(_alike(percent, "n", "n0")).select(hub.alias("a"), node.alias("b")).filter("a <> b")))

    placed = buckets.select("key", node.alias("node"), "n", hub.alias("hub")).join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    placed = stage(placed, "placed")
    members = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"x{i}") for i in range(2)]  # stand for the bucket's documents
    share = placed.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"), *members)
    major = share.groupBy("key").agg(
        F.max(F.struct("c", "comp")).alias("m"), F.count(F.lit(1)).alias("comps"), F.sum("c").alias("size"), *[F.bit_xor(f"x{i}").alias(f"x{i}") for i in range(2)]
    )
    # two similar documents share dozens of keys: of buckets with the same documents one is opened
    major = major.filter("comps > 1").groupBy("size", "x0", "x1").agg(F.min("key").alias("key"), F.min_by("m", "key").alias("m"))
    mixed = placed.drop("n").join(major.select("key", F.col("m.comp").alias("most")), "key")
    opened = stage(mixed.join(sets.select("node", *bitmap), "node"), "open")
    x = opened.filter("comp <> most").select("key", F.col("node").alias("a"), F.col("comp").alias("ca"), *[F.col(c).alias(f"a_{c}") for c in bitmap])
    y = opened.select("key", F.col("node").alias("b"), F.col("comp").alias("cb"), "most", "hub", *[F.col(c).alias(f"b_{c}") for c in bitmap])
    once = (F.col("cb") == F.col("most")) | (F.col("a") < F.col("b"))
    fresh = (F.col("b") != F.col("hub")) & (F.col("a") != F.col("hub"))  # the hub's own pairs are decided
    cross = x.join(y, (x.key == y.key) & (F.col("ca") != F.col("cb")) & once & fresh & _possible(percent, "a_", "b_"))
    late = linked(cross.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))

    for end in "ab":  # links between components
        root = comp.select(F.col("node").alias(end), F.col("comp").alias("root"))
        late = late.join(root, end, "left").withColumn(end, F.coalesce("root", end)).drop("root")
    joint = components(late).select(F.col("node").alias("comp"), F.col("comp").alias("joint"))
    roots = classes.select("n", "one", "two", F.col("head").alias("node")).join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    roots = roots.join(joint, "comp", "left").select("n", "one", "two", F.coalesce("joint", "comp")["doc_id"].alias("root"))
    full = scanned.drop("keys").join(stage(roots, "roots"), ["n", "one", "two"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return full.select(
        "doc_id", "_k", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")
    )
