"""Words of Arrow text columns as numpy arrays: bounds and 64-bit hashes, without a Python object per word.

A word's hash is a polynomial over random byte values, read off one prefix sum
per chunk; a window's hash is built from its words' hashes by doubling.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64


def _table(*ranges) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    for lo, hi in ranges:
        out[lo : hi + 1] = True
    return out


#: Separators of the two word definitions.
SPACE = _table((0x20, 0x20), (0x09, 0x0D))
NOT_WORD = _table((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))

SAME = np.arange(256, dtype=np.uint8)
LOWER = SAME.copy()
LOWER[65:91] += 32

CHUNK = 1 << 19  # bytes hashed at once
BATCH = 1 << 20  # bytes of text handled at once; one longer text stays whole


class Hash:
    """One polynomial family; ``seed`` gives independent ones."""

    def __init__(self, seed: int, fold: np.ndarray = SAME):
        rng = np.random.default_rng(seed)
        values = rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
        self.values = values[fold]
        self.r = int(rng.integers(2**40, 2**62)) * 8 + 3
        self.powers = self.inverses = np.ones(0, dtype=np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            for name, base in (("powers", self.r), ("inverses", pow(self.r, -1, 2**64))):
                a = np.full(n, base % 2**64, dtype=np.uint64)
                a[:1] = 1
                setattr(self, name, np.cumprod(a, dtype=np.uint64))

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = np.empty(len(starts), dtype=np.uint64)
        a = 0
        while a < len(starts):
            b = max(a + 1, int(np.searchsorted(ends, starts[a] + CHUNK, side="right")))
            lo, hi = int(starts[a]), int(ends[b - 1])
            self._grow(max(CHUNK, hi - lo))
            sums = np.zeros(hi - lo + 1, dtype=np.uint64)
            np.cumsum(self.values[data[lo:hi]] * self.powers[: hi - lo], out=sums[1:])
            s = starts[a:b] - lo
            out[a:b] = (sums[ends[a:b] - lo] - sums[s]) * self.inverses[s]
            a = b
        return mix(out)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(32))
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(29)
    x *= U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def bounds(data: np.ndarray, offsets: np.ndarray, sep: np.ndarray, cut: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the row of each; words end where their row ends, and before a byte in ``cut``."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, dtype=np.int64)
        return z, z, z
    inside = ~sep[data]
    before = np.zeros(n, dtype=bool)
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = False
    after = np.zeros(n, dtype=bool)
    after[:-1] = inside[1:]
    tails = offsets[1:][offsets[1:] > 0] - 1
    after[tails] = False
    if cut is not None:
        before[cut] = False
        after[:-1][cut[1:]] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def texts(batch: pa.RecordBatch, name: str = "text", size: int = BATCH):
    """Slices of a batch with at most ``size`` bytes of text (one row at least): row slice, bytes, offsets."""
    col = batch.column(batch.schema.get_field_index(name))
    col = col.cast(pa.large_string()) if not pa.types.is_large_string(col.type) else col
    if col.null_count:
        col = col.fill_null("")
    _, off, data = col.buffers()
    off = np.frombuffer(off, dtype=np.int64)[col.offset : col.offset + len(col) + 1] if off else np.zeros(1, np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, dtype=np.uint8)
    a, n = 0, len(col)
    while a < n:
        b = min(n, max(a + 1, int(np.searchsorted(off, off[a] + size, side="right")) - 1))
        yield slice(a, b), data[off[a] : off[b]], (off[a : b + 1] - off[a]).astype(np.int64)
        a = b


def window_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Unmixed hash of every ``k`` consecutive entries of ``h``, by doubling."""
    r = U(0xB492B66FBE98F273)
    if k == 1:
        return h
    half = window_hash(h, k // 2)
    m = k // 2
    n = max(0, len(h) - k + 1)
    with np.errstate(over="ignore"):
        two = half[:n] * U(pow(int(r), m, 2**64)) + half[m : m + n]
        return two if k == 2 * m else two * r + h[k - 1 : k - 1 + n]


def grams(h: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``k``-word windows that lie in one row, and their first words' indexes."""
    if len(h) < k:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    at = np.flatnonzero(rows[: len(rows) - k + 1] == rows[k - 1 :])
    return mix(window_hash(h, k)[at]), at


def winnow(h: np.ndarray, rows: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Rightmost smallest ``k``-gram hash of every ``w`` consecutive ones in a row: hashes, word indexes.

    Two rows that share ``k + w - 1`` words select the same window inside them.
    """
    span = k + w - 1
    if len(h) < span:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    g = mix(window_hash(h, k))
    best, at, m = g, np.arange(len(g)), 1
    while m < w:
        step = min(m, w - m)
        left, right = best[:-step], best[step:]
        later = right <= left
        best, at = np.where(later, right, left), np.where(later, at[step:], at[:-step])
        m += step
    whole = rows[: len(h) - span + 1] == rows[span - 1 :]
    at = at[: len(whole)][whole]
    at = at[np.flatnonzero(np.r_[True, at[1:] != at[:-1]])] if len(at) else at
    return g[at], at


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def offsets_of(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
