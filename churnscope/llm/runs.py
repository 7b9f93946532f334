"""Periodic runs of words by longest common extensions on suffix trees.

A run is a stretch of consecutive words with smallest period q and at least
``max(LEAST, 2 * q)`` words that no neighbouring word extends keeping q.

1. A run repeats each of its stretches of ``LEAST // 2`` words q words later or
   earlier, and these stretches cover it.  Words that no such repeated stretch
   of their document covers are in no run, so they are put aside, again and
   again within what is left, until nothing more goes.  What is left of a
   document becomes one string: its pieces, with a symbol between two pieces
   that occurs nowhere else, so that nothing repeats across.
2. Ukkonen's algorithm builds the suffix tree of the string and of its reversal.
   An Euler tour of each with a sparse table of minima gives the depth of the
   lowest common ancestor of two leaves, and so the longest common extension of
   two places to the right or left, in constant time.
3. Every run has a root that is the longest Lyndon word at its start, for the
   order of the symbols or for the opposite one.  The longest Lyndon word at a
   place ends before the next smaller suffix; both orders are read off the tree.
   Each of these candidates is extended in both directions.

One document at a time is in memory; there is no shuffle.  Words are compared by
64-bit hashes within one document.

Defined cases: a null or wordless text has no words and no runs, its collapsed
text is empty; a repeated row is treated like the first; a null doc_id is passed
through; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from churnscope.llm import words as W
from churnscope.llm.common import keyed, schema

LEAST = 12
_HASH = W.Hash(11)
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _repeated(h: np.ndarray, group: np.ndarray, k: int) -> np.ndarray:
    """Words covered by a stretch of ``k`` words that occurs twice in their group."""
    g, at = W.grams(h, group, k)
    key = W.mix(g + group[at].astype(np.uint64) * W.U(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edge = np.zeros(len(h) + 1, np.int64)
    hit = at[twice]
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + k, -1)
    return np.cumsum(edge[:-1]) > 0


def pieces(h: np.ndarray, row: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the words that may lie in a run, and the piece of each: a piece is a stretch of one row."""
    at, group = np.arange(len(h)), row
    while len(at):
        keep = _repeated(h[at], group, least // 2)
        new = np.ones(len(at), bool)
        new[1:] = (group[1:] != group[:-1]) | ~keep[:-1]
        piece = np.cumsum(new)[keep]
        if not len(piece):
            return at[:0], group[:0]
        long = np.bincount(piece)[piece] >= least
        left, group = at[keep][long], piece[long]
        if len(left) == len(at):
            break
        at = left
    return at, group


def suffix_tree(s: list[int], kinds: int) -> tuple[list[int], list[int], dict[int, int]]:
    """Ukkonen's tree of ``s``, whose last symbol occurs once: first and end index of every edge, and children by ``node * kinds + symbol``."""
    n = len(s)
    first, end, link, child = [0], [0], [0], {}
    node = length = edge = waiting = 0
    for i, c in enumerate(s):
        waiting += 1
        made = 0
        while waiting:
            if not length:
                edge = i
            key = node * kinds + s[edge]
            below = child.get(key)
            if below is None:
                child[key] = len(first)
                first.append(i)
                end.append(n)
                link.append(0)
                if made:
                    link[made] = node
                    made = 0
            else:
                a = first[below]
                span = end[below] - a
                if length >= span:
                    node, edge, length = below, edge + span, length - span
                    continue
                if s[a + length] == c:
                    length += 1
                    if made:
                        link[made] = node
                    break
                inner = len(first)
                first += (a, i)
                end += (a + length, n)
                link += (0, 0)
                child[key] = inner
                child[inner * kinds + c] = inner + 1
                first[below] = a + length
                child[inner * kinds + s[a + length]] = below
                if made:
                    link[made] = inner
                made = inner
            waiting -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = i - waiting + 1
    return first, end, child


class Extensions:
    """Longest common extensions of places of ``s`` to the right; ``s`` holds symbols from 1, 0 is put at its end."""

    def __init__(self, s: np.ndarray):
        n, kinds = len(s) + 1, int(s.max(initial=0)) + 1
        first, end, child = suffix_tree([*s.tolist(), 0], kinds)
        key = np.fromiter(child.keys(), np.int64, len(child))
        to = np.fromiter(child.values(), np.int64, len(child))
        order = np.argsort(key)
        self.symbol, self.to = (key % kinds)[order], to[order].tolist()
        self.range = np.searchsorted((key // kinds)[order], np.arange(len(first) + 1)).tolist()
        span = np.subtract(end, first).tolist()
        self.n, self.leaf = n, [e == n for e in end]
        self.leaf[0] = False
        depth = [0] * len(first)
        tour, place = [], np.zeros(n, np.int64)
        todo = [0]  # a node as ~node: come back to it
        while todo:
            v = todo.pop()
            if v < 0:
                tour.append(depth[~v])
                continue
            if self.leaf[v]:
                place[n - depth[v]] = len(tour)
                tour.append(depth[v])
                continue
            tour.append(depth[v])
            for w in self.to[self.range[v + 1] - 1 : self.range[v] - 1 if self.range[v] else None : -1]:
                depth[w] = depth[v] + span[w]
                todo += (~v, w)
        self.depth, self.place = depth, place
        self.minima = [np.array(tour, dtype=np.int32)]
        while 2 << len(self.minima) - 1 <= len(tour):
            step = 1 << len(self.minima) - 1
            self.minima.append(np.minimum(self.minima[-1][:-step], self.minima[-1][step:]))

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Equal symbols from ``i`` and ``j`` (other places) on."""
        a, b = np.minimum(self.place[i], self.place[j]), np.maximum(self.place[i], self.place[j]) + 1
        level = np.frexp((b - a).astype(float))[1] - 1
        out = np.zeros(len(i), np.int64)
        for k in np.unique(level):
            own = level == k
            out[own] = np.minimum(self.minima[k][a[own]], self.minima[k][b[own] - (1 << int(k))])
        return out

    def ranks(self) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of all suffixes in the order of the symbols, and in the opposite one; an end comes before any symbol in both."""
        up = np.argsort(np.argsort(self.place))
        down = np.zeros(self.n, np.int64)
        todo, seen = [0], 0
        while todo:
            v = todo.pop()
            if self.leaf[v]:
                down[self.n - self.depth[v]] = seen
                seen += 1
                continue
            a, b = self.range[v], self.range[v + 1]
            if self.symbol[a] == 0:  # pushed last, so visited first
                todo += self.to[a + 1 : b]
                todo.append(self.to[a])
            else:
                todo += self.to[a:b]
        return up, down


def lyndon_ends(rank: np.ndarray) -> np.ndarray:
    """Ends of the longest Lyndon words: the next smaller suffix of every place but the last."""
    rank = rank.tolist()
    after = [0] * len(rank)
    for i in range(len(rank) - 2, -1, -1):
        j, own = i + 1, rank[i]
        while rank[j] > own:
            j = after[j]
        after[i] = j
    return np.array(after[:-1], dtype=np.int64)


def runs(s: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Start, length and period of all runs of ``s`` (symbols from 1), by start, then period."""
    n = len(s)
    if n < least:
        return np.zeros((0, 3), np.int64)
    right, left = Extensions(s), Extensions(s[::-1])
    i = np.arange(n)
    found = []
    for rank in right.ranks():
        p = lyndon_ends(rank) - i
        start = i - left(n - i, n - i - p)
        length = i + p + right(i, i + p) - start
        ok = length >= np.maximum(least, 2 * p)
        found.append(np.stack([start[ok], length[ok], p[ok]], axis=1))
    found = np.unique(np.concatenate(found), axis=0)
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def document_runs(h: np.ndarray, at: np.ndarray, piece: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Runs of one document, given its words' hashes and which words are left in which piece."""
    _, symbol = np.unique(h[at], return_inverse=True)
    cut = np.flatnonzero(np.r_[False, piece[1:] != piece[:-1]])
    kinds = int(symbol.max()) + 2
    s = np.insert(symbol + 1, cut, np.arange(kinds, kinds + len(cut)))
    place = np.insert(at, cut, -1)
    found = runs(s, least)
    found[:, 0] = place[found[:, 0]]
    return found


def _scan(least: int):
    def run(batches):
        for batch in batches:
            for part, data, off in W.texts(batch):
                rows = part.stop - part.start
                starts, ends, row = W.bounds(data, off, W.SPACE)
                h = _HASH.words(data, starts, ends)
                count = np.bincount(row, minlength=rows)
                first = W.offsets_of(count)
                raw = data.tobytes()
                at, piece = pieces(h, row, least)
                bound = np.searchsorted(row[at], np.arange(rows + 1))
                found, collapsed = [], []
                for r in range(rows):
                    text = raw[off[r] : off[r + 1]].split()
                    own = slice(bound[r], bound[r + 1])
                    got = np.zeros((0, 3), np.int64)
                    if own.start < own.stop:
                        got = document_runs(h[first[r] : first[r + 1]], at[own] - first[r], piece[own], least)
                    if len(got):
                        edge = np.zeros(len(text) + 1, np.int64)
                        np.add.at(edge, got[:, 0] + got[:, 2], 1)
                        np.add.at(edge, got[:, 0] + got[:, 1], -1)
                        text = [text[x] for x in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
                    found.append(got)
                    collapsed.append(b" ".join(text))
                every = np.concatenate(found)
                lists = pa.ListArray.from_arrays(
                    pa.array(W.offsets_of(np.array([len(x) for x in found])).astype(np.int32)),
                    pa.StructArray.from_arrays([pa.array(every[:, c]) for c in range(3)], fields=list(_RUN)),
                )
                src = batch.slice(part.start, rows)
                yield pa.RecordBatch.from_arrays(
                    [src.column(0), src.column(1), pa.array(count.astype(np.int64)), lists, pa.array(collapsed, pa.binary()).cast(pa.string())],
                    names=["doc_id", "_k", "n_words", "runs", "collapsed"],
                )

    return run


def periodic_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``doc_id, _k, n_words, runs, collapsed`` of every document.

    ``runs`` are structs ``start, length, period`` by start, then period;
    ``collapsed`` are the words that no run holds after its first period.
    """
    return keyed(docs).mapInArrow(
        _scan(least),
        schema("doc_id bigint, _k bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"),
    )
