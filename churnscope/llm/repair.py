"""Re-Pair over arrays of token ids: rules, symbols and expansion lengths of one shard.

The most frequent neighbouring pair is replaced by a new symbol until no pair
occurs ``LEAST`` times.  A round takes, from the most frequent pair down, every
pair that cannot overlap one taken before it (no id is first in one and second in
another), so that their counts stay right; in a stretch of one id the pairs are
taken from the left.  Pairs never span two documents, so every document is a
slice of the symbols and can be decoded without its neighbours.

Symbols are linked to their neighbours, and a round looks only at places whose
pair was frequent before or is new: a pair that is rare once stays rare.
"""

from __future__ import annotations

import numpy as np

LEAST = 24  # occurrences of a replaced pair
_BITS = 18


def _choose(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indexes of the pairs of a round."""
    firsts, seconds, chosen = set(), set(), []
    left, right = (keys >> np.uint64(32)).tolist(), (keys & np.uint64(0xFFFFFFFF)).tolist()
    for i in np.argsort(-counts, kind="stable").tolist():
        a, b = left[i], right[i]
        if a in seconds or b in firsts or (a == b and (a in firsts or b in seconds)):
            continue
        firsts.add(a)
        seconds.add(b)
        chosen.append(i)
    return np.array(chosen, dtype=np.int64)


def compress(ids: np.ndarray, ends: np.ndarray, first: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, rules (left, right) and offsets of the documents in the symbols; ``ends``: end of each document."""
    n = len(ids)
    seq = ids.astype(np.uint32)
    last = np.zeros(n, bool)
    last[ends[ends > 0] - 1] = True
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    gone = np.zeros(n, bool)
    rules: list[np.ndarray] = []
    made = 0
    at = np.flatnonzero(~last)  # places whose pair may be frequent, ascending
    while len(at):
        left, right = seq[at], seq[after[at]]
        equal = skip = np.flatnonzero(left == right)
        if len(equal):  # every second place of a stretch of one id overlaps the one before
            e = at[equal]
            start = np.ones(len(e), bool)
            start[1:] = before[e[1:]] != e[:-1]
            place = np.arange(len(e))
            skip = equal[(place - np.maximum.accumulate(np.where(start, place, 0))) % 2 == 1]
        pair = (left.astype(np.uint64) << np.uint64(32)) | right
        slot = ((pair * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BITS)).view(np.int64)
        seen = np.bincount(slot, minlength=1 << _BITS)
        seen -= np.bincount(slot[skip], minlength=1 << _BITS)
        use = np.ones(len(at), bool)
        use[skip] = False
        often = np.flatnonzero((seen >= least)[slot])
        at, pair, use, slot = at[often], pair[often], use[often], slot[often]
        keys, counts = np.unique(pair[use] if len(skip) else pair, return_counts=True)
        keys, counts = keys[counts >= least], counts[counts >= least]
        if not len(keys):
            break
        chosen = _choose(keys, counts)
        # one chosen pair a slot, the most frequent: another has its turn in a later round
        chosen = chosen[np.argsort(counts[chosen], kind="stable")]
        home = ((keys[chosen] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BITS)).astype(np.int32)
        number = np.full(1 << _BITS, -1, np.int32)
        number[home] = np.arange(len(chosen))
        chosen = chosen[np.sort(number[number >= 0])]
        home = ((keys[chosen] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BITS)).astype(np.int32)
        number[home] = np.arange(len(chosen))
        i = number[slot]
        hit = np.flatnonzero(use & (i >= 0))
        hit = hit[keys[chosen][i[hit]] == pair[hit]]
        p = at[hit]
        q = after[p]
        seq[p] = first + made + i[hit]
        last[p] = last[q]
        gone[q] = True
        far = after[q]
        after[p] = far
        inside = far < n
        before[far[inside]] = p[inside]
        rules.append(np.stack([keys[chosen] >> np.uint64(32), keys[chosen] & np.uint64(0xFFFFFFFF)], axis=1))
        made += len(chosen)
        near = before[p]
        near = near[near >= 0]
        if 8 * (len(at) + len(near)) < n:  # few places: sort them; many: mark them
            at = np.sort(np.concatenate([at, near]), kind="stable")  # two ascending runs
            keep = ~(gone[at] | last[at])
            keep[1:] &= at[1:] != at[:-1]
            at = at[keep]
        else:
            mark = np.zeros(n, bool)
            mark[at] = mark[near] = True
            at = np.flatnonzero(mark & ~(gone | last))
    stops = np.zeros(len(ends) + 1, np.int64)
    size = np.diff(np.concatenate([[0], ends]))
    stops[1:][size > 0] = np.flatnonzero(last[~gone]) + 1
    stops = np.maximum.accumulate(stops)
    every = np.concatenate(rules) if rules else np.zeros((0, 2))
    return seq[~gone], every.astype(np.uint32), stops


def lengths(rules: np.ndarray, first: int) -> np.ndarray:
    """Ids that each rule stands for."""
    out = np.ones(len(rules), np.int64)
    for i, (a, b) in enumerate(rules.tolist()):
        out[i] = (out[a - first] if a >= first else 1) + (out[b - first] if b >= first else 1)
    return out


def expand(symbols: np.ndarray, rules: np.ndarray, sizes: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the symbols, and how many each symbol stands for."""
    if not len(symbols):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    flat = np.zeros(begin[-1] + 1, np.uint32)
    for i, (a, b) in enumerate(rules.tolist()):
        p = begin[i]
        for s in (a, b):
            if s < first:
                flat[p] = s
                p += 1
            else:
                n = sizes[s - first]
                flat[p : p + n] = flat[begin[s - first] : begin[s - first] + n]
                p += n
    rule = symbols >= first
    index = np.where(rule, symbols.astype(np.int64) - first, 0)
    n = np.where(rule, sizes[index] if len(sizes) else 1, 1)
    where = np.repeat(begin[index] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    return np.where(np.repeat(rule, n), flat[np.minimum(where, len(flat) - 1)], np.repeat(symbols, n)).astype(np.uint32), n
