"""Language-model scoring by prediction by partial matching over bytes.

The model is a trie of byte contexts up to ``ORDER`` bytes, kept as the table of
all ``ORDER + 1``-byte grams of the training texts with their counts (shorter
contexts are sums of it).  A byte is predicted by the longest context that has
seen it; every context that has not is left by an escape (method C: as probable
as the number of different symbols seen), and what it has seen is excluded from
the shorter ones.  The last resort is uniform.

Nothing is pruned and the model is never sent whole to anyone.  Texts are kept
in blocks of up to ``BLOCK`` bytes; a block asks for the grams and words that it
has, counts and costs are worked out per key, and each block gets its answers.
Tasks are bounded by a block, or by a share of the distinct grams.

Texts are A-Z lower-cased, have ``ORDER`` start bytes before and an end symbol
after them (0xFE, 0xFF: no UTF-8 text has them).

Defined cases: a null text is empty and scored as its end symbol; a null doc_id
is training text; repeated documents count as often as they are there; without
training texts every symbol has the uniform probability; an empty table gives
an empty result; a text longer than a block is a block of its own; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnscope.llm import words as W
from churnscope.llm.common import schema, short_batches, stage

ORDER = 5
BLOCK = 32 << 20
LEVEL = 6  # of zstd: texts of blocks are stored and shuffled
PIECE = 1 << 18  # bytes of a block worked on at once
FRESH = 1 << 18  # keys of a block held before they are merged
START, STOP = 0xFE, 0xFF
SYMBOLS = 255  # all byte values but the start byte
_HASH = W.Hash(1, W.LOWER)
_WORD, _GRAM = 0, 1


def _blocks(size: int):
    """One row per block: documents, their flags, offsets and compressed text."""

    def run(batches):
        task, number = TaskContext.get().partitionId(), 0
        ids, flags, lens, data, held = [], [], [], [], 0
        press = zstandard.ZstdCompressor(level=LEVEL).compressobj()

        def row():
            off = W.offsets_of(np.concatenate(lens))
            values = [(task << 32) + number, ids, flags, off.tolist(), b"".join([*data, press.flush()])]
            types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=["block", "ids", "train", "off", "text"])

        for batch in batches:
            for part, raw, off in W.texts(batch):
                n = part.stop - part.start
                if held and held + len(raw) > size:
                    yield row()
                    number, held = number + 1, 0
                    ids, flags, lens, data = [], [], [], []
                    press = zstandard.ZstdCompressor(level=LEVEL).compressobj()
                ids += batch.column(0).slice(part.start, n).to_pylist()
                flags += batch.column(1).slice(part.start, n).to_pylist()
                lens.append(np.diff(off))
                data.append(press.compress(raw))
                held += len(raw)
        if ids:
            yield row()

    return run


def _parts(off: list[int], text: bytes, size: int = PIECE):
    """Pieces of a block with whole documents: first document, bytes, offsets."""
    reader = zstandard.ZstdDecompressor().stream_reader(text)
    off = np.asarray(off, dtype=np.int64)
    a = 0
    while a < len(off) - 1:
        b = min(len(off) - 1, max(a + 1, int(np.searchsorted(off, off[a] + size, side="right")) - 1))
        data = np.empty(off[b] - off[a], dtype=np.uint8)
        got = 0
        while got < len(data):
            more = reader.readinto(memoryview(data)[got:])
            if not more:
                raise ValueError("a block ends before its documents")
            got += more
        yield a, data, off[a : b + 1] - off[a]
        a = b


def _grams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The gram that ends at every byte and end symbol, and the document of each."""
    n = len(off) - 1
    lens = np.diff(off)
    row = np.repeat(np.arange(n), lens)
    buf = np.full(len(data) + n * (ORDER + 1), START, dtype=np.uint8)
    buf[np.arange(len(data)) + ORDER + row * (ORDER + 1)] = W.LOWER[data]
    buf[off[1:] + (np.arange(n) + 1) * (ORDER + 1) - 1] = STOP
    g = np.zeros(len(buf) - ORDER, dtype=np.uint64)
    for j in range(ORDER + 1):
        g = (g << W.U(8)) | buf[j : len(buf) - ORDER + j]
    return g[buf[ORDER:] != START], np.repeat(np.arange(n), lens + 1)


def _merge(known, parts):
    """``known`` keys, ascending, and their counts, with those of ``parts``."""
    keys, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    n = np.bincount(back, weights=np.concatenate([p[1] for p in parts]), minlength=len(keys)).astype(np.int64)
    if not len(known[0]):
        return keys, n
    at = np.searchsorted(known[0], keys)
    old = known[0][np.minimum(at, len(known[0]) - 1)] == keys
    known[1][at[old]] += n[old]
    return np.insert(known[0], at[~old], keys[~old]), np.insert(known[1], at[~old], n[~old])


def _counted(keys: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys with their counts where ``train`` holds."""
    seen, n = np.unique(keys[train], return_counts=True)
    rest = np.unique(keys[~train])
    return np.concatenate([seen, rest]), np.concatenate([n, np.zeros(len(rest), np.int64)])


class Lookup:
    """Values of 64-bit keys that are all there: open addressing, probed for all keys at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(1.5 * len(keys) + 1))))
        used = np.zeros(1 << self.bits, bool)
        self.keys, self.values = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits)
        for a in range(0, len(keys), FRESH):
            self._put(keys[a : a + FRESH], values[a : a + FRESH], used)

    def _put(self, keys, values, used):
        at = self._slot(keys)
        while len(keys):
            free = ~used[at]
            self.keys[at[free]] = keys[free]
            used[at[free]] = True
            done = self.keys[at] == keys
            self.values[at[done]] = values[done]
            keys, values, at = keys[~done], values[~done], (at[~done] + 1) & (len(used) - 1)

    def _slot(self, keys):
        return (W.mix(keys) >> W.U(64 - self.bits)).astype(np.int64)

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        out = self.values[at]
        left = np.flatnonzero(self.keys[at] != keys)
        at = at[left]
        while len(left):
            at = (at + 1) & (len(self.keys) - 1)
            hit = self.keys[at] == keys[left]
            out[left[hit]] = self.values[at[hit]]
            left, at = left[~hit], at[~hit]
        return out


def _ask(batches):
    """Distinct words and grams of each block, with their counts in training documents."""
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for batch in batches:
        for r in batch.to_pylist():
            train = np.array(r["train"], dtype=bool)
            words, grams, new, fresh = none, none, {_WORD: [none], _GRAM: [none]}, 0
            for a, data, off in _parts(r["off"], r["text"]):
                starts, ends, rows = W.bounds(data, off, W.SPACE)
                new[_WORD].append(_counted(_HASH.words(data, starts, ends), train[a + rows]))
                g, own = _grams(data, off)
                new[_GRAM].append(_counted(g, train[a + own]))
                fresh += len(new[_WORD][-1][0]) + len(new[_GRAM][-1][0])
                if fresh > FRESH:
                    words, grams = _merge(words, new[_WORD]), _merge(grams, new[_GRAM])
                    new, fresh = {_WORD: [none], _GRAM: [none]}, 0
            for kind, known in ((_WORD, words), (_GRAM, grams)):
                keys, n = _merge(known, new[kind])
                for i in range(0, len(keys), 1 << 18):
                    k = keys[i : i + (1 << 18)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(k), kind, np.int8)), pa.array(W.signed(k)), pa.array(np.full(len(k), r["block"], np.int64)), pa.array(n[i : i + len(k)])],
                        names=["kind", "key", "block", "n"],
                    )


def costs(keys: np.ndarray, n: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """log10 probability of the last byte of every gram after its others.

    ``keys`` holds all grams of the contexts' last two bytes that occur in it;
    ``pairs[a, b]`` counts byte ``b`` after byte ``a`` in all training texts.
    """
    sym = (keys & W.U(255)).astype(np.int64)
    out = np.zeros(len(keys))
    open_ = np.ones(len(keys), bool)
    above_sum, above_kinds = np.zeros(len(keys)), np.zeros(len(keys))  # seen by longer contexts, as counted here

    def step(count, total, kinds):
        nonlocal open_
        seen = total > 0
        rest, fresh = total - above_sum, kinds - above_kinds
        whole = np.maximum(rest + fresh, 1)
        hit = open_ & (count > 0)
        out[hit] += np.log10(count[hit] / whole[hit])
        leave = open_ & ~hit & seen & (rest > 0)
        out[leave] += np.log10(fresh[leave] / whole[leave])
        open_ = open_ & ~hit

    def level(k):
        grams, back = np.unique(keys & W.U((1 << 8 * (k + 1)) - 1), return_inverse=True)
        count = np.bincount(back, weights=n, minlength=len(grams))
        contexts, own = np.unique(grams >> W.U(8), return_inverse=True)
        return grams, back, count, own

    for k in range(ORDER, 1, -1):
        grams, back, count, own = level(k)
        total, kinds = np.bincount(own, weights=count), np.bincount(own, weights=count > 0)
        step(count[back], total[own][back], kinds[own][back])
        # what this context has seen, counted in the next shorter context
        if k > 2:
            shorter, sback, scount, _ = level(k - 1)
            at = np.searchsorted(shorter, grams & W.U((1 << 8 * k) - 1))
            below = scount[at]
        else:
            below = pairs[((grams >> W.U(8)) & W.U(255)).astype(np.int64), (grams & W.U(255)).astype(np.int64)]
        seen_sum = np.bincount(own, weights=np.where(count > 0, below, 0))
        above_sum, above_kinds = seen_sum[own][back], kinds[own][back]
    last = ((keys >> W.U(8)) & W.U(255)).astype(np.int64)
    single = pairs.sum(axis=0)
    step(pairs[last, sym], pairs.sum(axis=1)[last], (pairs > 0).sum(axis=1)[last])
    above_sum, above_kinds = ((pairs > 0) * single[None, :]).sum(axis=1)[last], (pairs > 0).sum(axis=1)[last]
    step(single[sym], np.full(len(keys), single.sum()), np.full(len(keys), (single > 0).sum()))
    out[open_] -= np.log10(SYMBOLS - (single > 0).sum())
    return out


def _price(pairs: np.ndarray):
    def run(batches):
        held = [b for b in batches if b.num_rows]
        if held:
            t = pa.Table.from_batches(held)
            keys, n = t.column("key").to_numpy().view(np.uint64), t.column("n").to_numpy().astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(W.signed(keys)), pa.array(costs(keys, n, pairs))], names=["key", "value"])

    return run


def _score(n_train: int, vocabulary: int, train_docs: int):
    """Scores of a block's documents from its answers (kind, key, value)."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        kind = right.column("kind").to_numpy()
        tables = {}
        for k in (_WORD, _GRAM):
            keys, value = right.column("key").to_numpy()[kind == k].view(np.uint64), right.column("value").to_numpy()[kind == k]
            tables[k] = Lookup(keys, value)
        out = []
        for r in left.to_pylist():
            size = len(r["ids"])
            n_tokens, n_known, base, score = np.ones(size), np.zeros(size), np.zeros(size), np.zeros(size)
            for a, data, off in _parts(r["off"], r["text"]):
                n = len(off) - 1
                starts, ends, rows = W.bounds(data, off, W.SPACE)
                c = tables[_WORD][_HASH.words(data, starts, ends)]
                n_tokens[a : a + n] += np.bincount(rows, minlength=n)
                n_known[a : a + n] = np.bincount(rows, weights=c > 0, minlength=n)
                base[a : a + n] = np.bincount(rows, weights=np.log10((c + 1) / (n_train + vocabulary + 1)), minlength=n)
                g, own = _grams(data, off)
                score[a : a + n] = np.bincount(own, weights=tables[_GRAM][g], minlength=n)
            n_known += train_docs > 0
            base += np.log10((train_docs + 1) / (n_train + vocabulary + 1))
            out.append(
                pa.table({
                    "doc_id": pa.array(r["ids"], pa.int64()), "held_out": pa.array([not x for x in r["train"]], pa.bool_()), "n_tokens": n_tokens.astype(np.int64),
                    "n_known": n_known.astype(np.int64), "train_tokens": np.full(size, n_train, np.int64), "base_score": base, "score": score,
                })
            )
        return pa.concat_tables(out)

    return run


_OUT = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def ppm_score(docs: DataFrame, train: Column, block: int = BLOCK) -> DataFrame:
    """Scores of all documents by the model of those where ``train`` holds (null: it does)."""
    short_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(train, F.lit(True)).alias("train"), F.coalesce("text", F.lit("")).alias("text"))
    blocks = stage(
        rows.mapInArrow(_blocks(block), schema("block bigint, ids array<bigint>, train array<boolean>, off array<bigint>, text binary")), "blocks"
    )
    asked = stage(blocks.mapInArrow(_ask, schema("kind tinyint, key bigint, block bigint, n bigint")), "asked")
    counts = stage(asked.groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")  # each row of asked is shuffled once for it
    words, grams = (counts.filter(F.col("kind") == kind).select("key", "n") for kind in (_WORD, _GRAM))
    train_docs = blocks.select(F.sum(F.size(F.filter("train", lambda x: x)))).first()[0] or 0
    totals = words.agg(F.sum("n"), F.sum(F.when(F.col("n") > 0, 1))).first()
    n_train, vocabulary = (totals[0] or 0) + train_docs, (totals[1] or 0) + (train_docs > 0)
    pairs = np.zeros((256, 256))
    two = F.col("key").bitwiseAND(0xFFFF).cast("int")
    for r in grams.groupBy(two.alias("p")).agg(F.sum("n").alias("n")).collect():  # at most 65,536 rows
        pairs[r["p"] >> 8, r["p"] & 255] = r["n"]
    suffix = F.shiftright("key", 8).bitwiseAND(0xFFFF)
    priced = grams.repartition(suffix).mapInArrow(_price(pairs), schema("key bigint, value double"))
    known = words.select(F.lit(_WORD).cast("tinyint").alias("kind"), "key", F.col("n").cast("double").alias("value")).union(
        priced.select(F.lit(_GRAM).cast("tinyint"), "key", "value")
    )
    answers = asked.select("kind", "key", "block").join(known, ["key", "kind"]).select("block", "kind", "key", "value")
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score(n_train, vocabulary, train_docs), schema(_OUT))
