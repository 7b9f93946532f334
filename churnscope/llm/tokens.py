"""Token ids in a compressed table: encode, Re-Pair per frame of a shard, random-access decoding.

Documents are range-partitioned by doc_id; a shard is one range in ascending
order.  It is written as frames of about ``FRAME`` ids (whole documents), one
row of a Parquet table each: doc_ids, ids per document, offsets of the
documents in the symbols, symbols, rules, expansion lengths, and the number of
ids of the shard before the frame.  Spark's committed writer makes a lost task
harmless.  One document is decoded from its slice of the symbols and the rules.

Ids are those of the whole text.  The tokenizer lower-cases, drops white space
and joins neither across it nor across a change between ASCII letters, digits and
other printable ASCII but the apostrophe, so texts are cut there and each distinct
piece is encoded once per worker; a second, independent hash confirms that equal
hashes are equal pieces.  Batches
with special tokens or a capital sigma, whose case depends on what follows,
are cut at white space only.

Defined cases: a null or empty text has only the end id; rows of one doc_id
follow each other, ordered by text hash; null doc_ids come first; an empty
table gives an empty result; a text longer than a frame is a frame of its own;
other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from churnscope.llm import repair
from churnscope.llm import words as W
from churnscope.llm.common import keyed, schema, shared_path

FRAME = 1 << 20
END = 1
CACHE = 1_000_000  # pieces whose ids a worker keeps
JOINED = 250  # new pieces encoded at once
_WORD_END = "</w>"  # what the last token of a word ends with, in files that mark it
SLICE = 1 << 22  # bytes of text handled at once
_ONE, _TWO = W.Hash(8), W.Hash(88)
_KIND = np.zeros(256, np.uint8)  # 0: no piece is cut beside it
for _kind, _ranges in ((1, ((97, 122),)), (2, ((48, 57),)), (3, ((33, 38), (40, 47), (58, 64), (91, 96), (123, 126)))):
    _KIND[W._table(*_ranges)] = _kind
_FRAME_ROW = (
    "shard int, frame int, before bigint, n_ids bigint, first bigint, doc_ids array<bigint>, counts array<int>, "
    "offsets array<int>, symbols binary, rules binary, sizes binary"
)


class Pieces:
    """Ids of known pieces by hash: open addressing, probed for all pieces at once."""

    def __init__(self, bits: int = 16):
        self.n = 0
        self.keys, self.checks = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat, self.held = np.zeros(0, np.uint32), 0
        self._index(bits)

    def _index(self, bits: int) -> None:
        self.bits = bits
        self.slots = np.full(1 << bits, -1, np.int32)
        self._put(np.arange(self.n, dtype=np.int32))

    def _at(self, keys):
        return (keys >> W.U(64 - self.bits)).astype(np.int64)

    def _put(self, number):
        at = self._at(self.keys[number])
        while len(number):
            free = self.slots[at] < 0
            self.slots[at[free]] = number[free]
            left = self.slots[at] != number
            number, at = number[left], (at[left] + 1) & (len(self.slots) - 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Number of each piece; -1: not known."""
        if not self.n:
            return np.full(len(keys), -1, np.int32)
        at = self._at(keys)
        out = self.slots[at]
        left = np.flatnonzero((out >= 0) & (self.keys[out] != keys))
        at = at[left]
        while len(left):
            at = (at + 1) & (len(self.slots) - 1)
            i = out[left] = self.slots[at]
            more = (i >= 0) & (self.keys[i] != keys[left])
            left, at = left[more], at[more]
        return out

    def add(self, keys: np.ndarray, checks: np.ndarray, ids: list[bytes]) -> None:
        """``keys`` are distinct and not known."""
        fresh = np.frombuffer(b"".join(ids), dtype="<u4")
        size = np.fromiter((len(x) >> 2 for x in ids), np.int64, len(ids))
        n, held = self.n + len(keys), self.held + len(fresh)
        for name, need in (("keys", n), ("checks", n), ("begin", n), ("size", n), ("flat", held)):
            old = getattr(self, name)
            if len(old) < need:
                new = np.zeros(need + (need >> 1), old.dtype)
                new[: len(old)] = old
                setattr(self, name, new)
        self.keys[self.n : n], self.checks[self.n : n], self.size[self.n : n] = keys, checks, size
        self.begin[self.n : n] = self.held + np.cumsum(size) - size
        self.flat[self.held : held] = fresh
        first, self.n, self.held = self.n, n, held
        if 2 * n > len(self.slots):
            self._index(int(np.ceil(np.log2(4 * n))))
        else:
            self._put(np.arange(first, n, dtype=np.int32))


class Encoder:
    """Ids of batches of texts; one per worker process and tokenizer file."""

    _held: dict[str, "Encoder"] = {}

    @classmethod
    def of(cls, path: str) -> "Encoder":
        if path not in cls._held:
            cls._held[path] = cls(path)
        return cls._held[path]

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.last = np.zeros(self.size, bool)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.last[i] = token.endswith(_WORD_END)
        self.marks = bool(self.last.any())
        self.known = Pieces()

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, dtype="<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of pieces of ASCII letters, one word each: joined by spaces, a piece ends with its word's last token."""
        out = []
        for a in range(0, len(words), JOINED):
            part = words[a : a + JOINED]
            found = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.flatnonzero(self.last[found]) + 1
            if len(ends) != len(part) or ends[-1] != len(found):
                out += self._encode(part)
                continue
            raw, at = found.tobytes(), (4 * ends).tolist()
            out += [raw[x:y] for x, y in zip([0, *at], at)]
        return out

    def _encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces without white space."""
        word = [self.marks and x.isascii() and x.isalpha() for x in pieces]
        words = iter(self._encode_words([x for x, w in zip(pieces, word) if w]))
        others = iter(self._encode_others([x for x, w in zip(pieces, word) if not w]))
        return [next(words) if w else next(others) for w in word]

    def _encode_others(self, pieces: list[str]) -> list[bytes]:
        """Many are joined by spaces, and each id goes to the piece where its token begins."""
        out = []
        for a in range(0, len(pieces), JOINED):
            part = pieces[a : a + JOINED]
            found = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            starts = W.offsets_of(np.fromiter(map(len, part), np.int64, len(part)) + 1)[:-1]
            begin = np.fromiter(chain.from_iterable(found.offsets), np.int64, 2 * len(found.ids))[::2]
            piece = np.searchsorted(starts, begin, side="right") - 1
            if (piece[1:] < piece[:-1]).any():
                out += self._encode(part)
                continue
            raw = np.array(found.ids, dtype="<u4").tobytes()
            at = (W.offsets_of(np.bincount(piece, minlength=len(part))) * 4).tolist()
            out += [raw[x:y] for x, y in zip(at, at[1:])]
        return out

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, end ids included, and the number of ids of each row."""
        n = len(off) - 1
        whole = np.zeros(len(data), bool)  # documents that are cut at white space only
        for mark in (b"<|", b"\xce\xa3"):
            at = np.flatnonzero((data[:-1] == mark[0]) & (data[1:] == mark[1]))
            row = np.searchsorted(off, at, side="right") - 1
            for i in np.unique(row[at + 1 < off[row + 1]]):
                whole[off[i] : off[i + 1]] = True
        joins = np.zeros(len(data), bool)  # a mark that follows may be joined to the capital, which NFC does before the case is folded
        joins[:-1] = data[1:] > 127
        joins[off[1:][off[1:] > 0] - 1] = False
        data = np.where(whole | joins, data, W.LOWER[data])
        kind = _KIND[data]
        cut = np.zeros(len(data), bool)
        cut[1:] = (kind[:-1] != kind[1:]) & (kind[:-1] > 0) & (kind[1:] > 0) & ~whole[1:]
        starts, ends, rows = W.bounds(data, off, W.SPACE, cut)
        h, check = _ONE.words(data, starts, ends), _TWO.words(data, starts, ends)
        if self.known.n > CACHE:
            self.known = Pieces()
        known = self.known
        back = known.find(h)
        new = np.flatnonzero(back < 0)
        if len(new):
            keys, first = np.unique(h[new], return_index=True)
            at = new[first]
            raw = data.tobytes()
            known.add(keys, check[at], self._encode_pieces([raw[x:y].decode() for x, y in zip(starts[at].tolist(), ends[at].tolist())]))
            back[new] = known.find(h[new])
        if len(back) and not np.array_equal(known.checks[back], check):  # two pieces with one hash: encode the texts as they are
            raw, known = data.tobytes(), Pieces()
            known.add(np.arange(n, dtype=np.uint64), np.zeros(n, np.uint64), self._encode([raw[off[i] : off[i + 1]].decode() for i in range(n)]))
            back, rows = np.arange(n), np.arange(n)
        per_word = known.size[back] if len(back) else np.zeros(0, np.int64)
        per_row = np.bincount(rows, weights=per_word, minlength=n).astype(np.int64)
        total = int(per_word.sum())
        source = np.repeat(known.begin[back] - (np.cumsum(per_word) - per_word), per_word) + np.arange(total) if total else np.zeros(0, np.int64)
        out = np.full(total + n, END, dtype=np.uint32)
        out[np.arange(total) + np.repeat(np.arange(n), per_row)] = known.flat[source]
        return out, per_row + 1


def _frame_row(shard, frame, before, docs, counts, ids, first) -> pa.RecordBatch:
    symbols, rules, stops = repair.compress(ids, np.cumsum(counts), first)
    values = [shard, frame, before, len(ids), first, docs, counts.tolist(), stops.tolist(), symbols.tobytes(), rules.tobytes(),
              repair.lengths(rules, first).astype("<i8").tobytes()]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()),
             pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=[f.split()[0] for f in _FRAME_ROW.split(", ")])


def _write(path: str, frame_ids: int):
    def run(batches):
        coder = Encoder.of(path)
        shard = TaskContext.get().partitionId()
        frame = before = held = 0
        docs, counts, ids = [], [], []
        for batch in batches:
            for part, data, off in W.texts(batch, size=SLICE):
                got, n = coder.encode(data, off)
                docs += batch.column(0).slice(part.start, part.stop - part.start).to_pylist()
                counts.append(n)
                ids.append(got)
                held += len(got)
                if held >= frame_ids:
                    yield _frame_row(shard, frame, before, docs, np.concatenate(counts), np.concatenate(ids), coder.size)
                    frame, before, held = frame + 1, before + held, 0
                    docs, counts, ids = [], [], []
        if docs:
            yield _frame_row(shard, frame, before, docs, np.concatenate(counts), np.concatenate(ids), coder.size)

    return run


def write_tokens(docs: DataFrame, tokenizer: str, path: str | None = None, frame_ids: int = FRAME) -> str:
    """Write the ids of ``docs`` in ascending doc_id order; returns the folder."""
    path = path or shared_path(docs.sparkSession, "tokens")
    ranged = keyed(docs).repartitionByRange("doc_id", "_k").sortWithinPartitions("doc_id", "_k", "text").select("doc_id", "text")
    ranged.mapInArrow(_write(tokenizer, frame_ids), schema(_FRAME_ROW)).write.option("compression", "zstd").parquet(path)
    return path


def decode_documents(row: dict, wanted: list[int] | None = None) -> list[np.ndarray]:
    """Ids of the documents at ``wanted`` places of a frame (None: all), each from its own symbols."""
    symbols = np.frombuffer(row["symbols"], dtype="<u4")
    rules = np.frombuffer(row["rules"], dtype="<u4").reshape(-1, 2)
    sizes = np.frombuffer(row["sizes"], dtype="<i8")
    if wanted is None:
        ids, _ = repair.expand(symbols, rules, sizes, row["first"])
        return np.split(ids, np.cumsum(row["counts"])[:-1]) if len(row["counts"]) else []
    at = row["offsets"]
    return [repair.expand(symbols[at[i] : at[i + 1]], rules, sizes, row["first"])[0] for i in wanted]


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, decoded from the files."""
    frames = spark.read.schema(schema(_FRAME_ROW)).parquet(path)
    totals = frames.groupBy("shard").agg(F.max(F.col("before") + F.col("n_ids")).alias("n"))
    along = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    bases = totals.select("shard", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("base"))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = decode_documents(row)
                n = np.array([len(x) for x in ids], dtype=np.int64)
                start = row["before"] + np.cumsum(n) - n
                crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["shard"]] * len(ids), pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(start, pa.int64()),
                     pa.array(n), pa.array(crc, pa.int64())],
                    names=["shard", "doc_id", "start", "n_tokens", "ids_crc32"],
                )

    found = frames.mapInArrow(run, schema("shard int, doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"))
    return found.join(bases, "shard").select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")
