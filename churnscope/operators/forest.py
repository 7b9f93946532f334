"""Random forest trees grown one by one from counted, binned rows.

The rules are those of MLlib's forest learner (Gini, at most ``BINS`` bins a feature,
features drawn per node, nodes split while the gain is above zero, sibling leaves of
one class merged); of the same bag and the same drawn features it grows the same tree.
Three things are arranged otherwise:

* Thresholds come from all training rows, not from a sample of 10,000.
* Rows that fall in the same bins with the same label and weight are one counted row.
  A copy is drawn Poisson(1) times, so ``m`` copies are drawn Poisson(m) times together:
  the bags have the law of the bags over single copies.
* A tree draws from a generator keyed by the seed and its number.  The counted rows are
  sorted, so a forest depends neither on the order of its rows nor on the cluster.

A tree needs the counted rows only, a byte per feature; a task grows some whole trees
and no statistics of open nodes are sent anywhere.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BINS = 32
EPSILON = np.finfo(float).eps  # a child of less impurity is a leaf
MAX_CLASSES = 100

# a row of a grown tree: its number and these arrays
TYPES = {"node": np.int64, "shares": np.float64, "stats": np.float64, "raw": np.int64, "importance": np.float64}
TREE = ", ".join(["tree int", *[f"{k} binary" for k in TYPES], "cuts array<array<double>>"])


def cut_points(values: np.ndarray, weights: np.ndarray, bins: int = BINS) -> np.ndarray:
    """At most ``bins - 1`` thresholds between the distinct values, near to equal weights a bin."""
    values, at = np.unique(values, return_inverse=True)
    middle = (values[:-1] + values[1:]) / 2
    if len(values) <= bins:
        return middle
    count = np.bincount(at, weights)
    stride = count.sum() / bins
    cuts, seen, target = [], float(count[0]), stride
    for i, n in enumerate(count[1:].tolist()):
        if abs(seen - target) < abs(seen + n - target):
            cuts.append(i)
            target += stride
        seen += n
    return middle[cuts]


def counted_rows(x: np.ndarray, label: np.ndarray, weight: np.ndarray, copies: np.ndarray):
    """Of training rows with their copies: thresholds per feature, bins of the distinct binned
    rows, the kind (label and weight) and copies of each, and per kind its weight in its class."""
    if np.isnan(x).any() or np.isnan(label).any() or np.isnan(weight).any():
        raise ValueError("NULL or NaN in a training row")
    if (label < 0).any() or (label != np.floor(label)).any() or label.max(initial=0) >= MAX_CLASSES:
        raise ValueError(f"labels must be whole numbers from 0 to {MAX_CLASSES - 1}")
    if (weight < 0).any():
        raise ValueError("negative weight")
    some = weight > 0
    if not some.any():
        raise ValueError("no training row")
    x, label, weight, copies = x[some], label[some], weight[some], copies[some]
    kinds, kind = np.unique(np.stack([label, weight], axis=1), axis=0, return_inverse=True)
    classes = np.zeros((len(kinds), int(label.max()) + 1))
    classes[np.arange(len(kinds)), kinds[:, 0].astype(int)] = kinds[:, 1]
    bins = min(BINS, int(copies.sum()))
    cuts = [cut_points(c, weight * copies, bins) for c in x.T]
    binned = np.stack([np.searchsorted(c, v) for c, v in zip(cuts, x.T)] + [kind.ravel()], axis=1)
    binned, at = np.unique(binned, axis=0, return_inverse=True)
    copies = np.bincount(at.ravel(), copies).astype(np.int64)
    return cuts, binned[:, :-1].astype(np.uint8), binned[:, -1].copy(), copies, classes


def _gini(stats: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Impurity from weights per class (first axis), class by class as the learner subtracts them."""
    out = np.ones(len(total))
    for s in stats:
        share = s / total
        out -= share * share
    return out


def _splits(slot, row, kind, drawn, nodes, flat, chosen, classes, bins):
    """The best split of every node among its ``chosen`` features: gain (0 if none), feature, bin,
    counts on the left; and the node's weight.  ``row`` and ``slot`` place a row in ``flat`` and ``nodes``."""
    n, kinds = len(nodes), nodes.shape[1]
    plain = np.array_equal(classes, np.eye(kinds))
    per_class = (lambda c: c) if plain else (lambda c: classes.T @ c)
    stats = per_class(nodes.T)
    total = stats.sum(axis=0)
    impurity = _gini(stats, total)
    many = nodes.sum(axis=1)
    best, feature, cut, left = np.zeros(n), np.full(n, -1), np.zeros(n, dtype=np.int64), np.zeros((n, kinds))
    where, every = slot * bins, np.arange(n)
    for f in chosen.T:
        cell = where + flat.take(row + f.take(slot))
        counts = np.bincount(cell + kind * (n * bins), drawn, kinds * n * bins).reshape(kinds, n, bins)
        used = np.flatnonzero(counts.any(axis=0))
        upto = counts.cumsum(axis=2).reshape(kinds, -1)
        node = used // bins
        low = upto[:, used]
        inner = low.sum(axis=0) < many[node]  # nothing is left above the last used bin
        used, node, low = used[inner], node[inner], low[:, inner]
        a, b = per_class(low), per_class(nodes.T[:, node] - low)
        wa, wb = a.sum(axis=0), b.sum(axis=0)
        both = wa + wb
        gain = np.zeros(n * bins)
        gain[used] = impurity[node] - wa / both * _gini(a, wa) - wb / both * _gini(b, wb)
        top = gain.reshape(n, bins).argmax(axis=1)
        gain = gain[every * bins + top]
        better = np.flatnonzero(gain > best)
        best[better], feature[better], cut[better] = gain[better], f[better], top[better]
        left[better] = upto[:, better * bins + top[better]].T
    return best, feature, cut, left, total


def grow(rows, rng: np.random.Generator, depth: int, subset: int, bag: bool = True):
    """One tree: its nodes as ``pack`` numbers them, per leaf its class shares, its weights by class
    and its drawn rows, and the features' importances."""
    cuts, binned, kind, copies, classes = rows
    width, kinds = binned.shape[1], len(classes)
    flat, bins = binned.ravel(), int(binned.max(initial=0)) + 1
    times = rng.poisson(copies) if bag else copies
    row = np.flatnonzero(times)
    drawn, kind, row = times[row].astype(float), kind[row], row * width
    slot = np.zeros(len(row), dtype=np.int64)
    counts = [np.bincount(kind, drawn, kinds)[None]]  # of every level, its nodes
    feature, cut, child, worth = [], [], [], []
    waiting = np.arange(1 if len(row) else 0)  # nodes of the level that may be split
    for level in range(depth + 1):
        feature.append(np.full(len(counts[level]), -1))
        for at_level in (cut, child, worth):
            at_level.append(np.zeros(len(counts[level]), dtype=np.int64 if at_level is not worth else float))
        if not len(waiting) or level == depth:
            break
        chosen = np.broadcast_to(np.arange(width), (len(waiting), width))
        if subset < width:
            chosen = np.argsort(rng.random(chosen.shape), axis=1)[:, :subset]
        nodes = counts[level][waiting]
        gain, f, c, left, total = _splits(slot, row, kind, drawn, nodes, flat, chosen, classes, bins)
        split = np.flatnonzero(gain > 0)
        if not len(split):
            break
        at = waiting[split]
        feature[level][at], cut[level][at], child[level][at], worth[level][at] = f[split], c[split], 2 * np.arange(len(split)), (gain * total)[split]
        counts.append(np.stack([left[split], nodes[split] - left[split]], axis=1).reshape(-1, kinds))
        stats = classes.T @ counts[-1].T
        waiting = np.flatnonzero(np.abs(_gini(stats, stats.sum(axis=0))) >= EPSILON) if level + 1 < depth else np.arange(0)
        # rows go on to the children that may be split
        slots = np.full(2 * len(split) + 2, -1)  # the last two: children of a leaf
        slots[waiting] = np.arange(len(waiting))
        rank = np.full(len(nodes), len(split))
        rank[split] = np.arange(len(split))
        slot = slots[2 * rank.take(slot) + (flat.take(row + f.take(slot)) > c.take(slot))]
        kept = np.flatnonzero(slot >= 0)
        slot, row, kind, drawn = slot[kept], row[kept], kind[kept], drawn[kept]
    # from the bottom up, two leaves of one class become one
    for level in reversed(range(len(counts) - 1)):
        at = np.flatnonzero(feature[level] >= 0)
        best, leaf, c = (counts[level + 1] @ classes).argmax(axis=1), feature[level + 1] < 0, child[level][at]
        feature[level][at[leaf[c] & leaf[c + 1] & (best[c] == best[c + 1])]] = -1
    importance, reached, first, leaf = np.zeros(width), np.arange(1), 0, 0
    out = {"node": [], "stats": [], "raw": []}
    for level in range(len(counts)):
        f, first = feature[level][reached], first + len(reached)
        inner = f >= 0
        at, leaves = reached[inner], counts[level][reached[~inner]]
        node = np.empty(len(reached), dtype=np.int64)
        node[inner] = (first + 2 * np.arange(len(at)) << 32) | (cut[level][at] << 16) | f[inner]
        node[~inner] = -1 - leaf - np.arange(len(leaves))
        out["node"].append(node), out["stats"].append(leaves @ classes), out["raw"].append(leaves.sum(axis=1))
        importance += np.bincount(f[inner], worth[level][at], width)
        leaf += len(leaves)
        reached = (child[level][at][:, None] + np.arange(2)).ravel()
        if not len(reached):
            break
    total, out = importance.sum(), {k: np.concatenate(v) for k, v in out.items()}
    return out | {"shares": _shares(out["stats"]), "importance": importance / total if total else importance}


def grow_batches(sent, seed: int, depth: int, subset: int, bag: bool = True):
    """A tree for every number of the first column."""

    def run(batches):
        for batch in batches:
            for tree in batch.column(0).to_pylist():
                grown = grow(sent.value, np.random.Generator(np.random.Philox(key=[seed, tree])), depth, subset, bag)
                columns = [pa.array([tree], pa.int32()), *[pa.array([grown[k].astype(t).tobytes()], pa.binary()) for k, t in TYPES.items()]]
                cuts = [c.tolist() for c in sent.value[0]] if tree == 0 else None  # those of all trees
                yield pa.RecordBatch.from_arrays([*columns, pa.array([cuts], pa.list_(pa.list_(pa.float64())))], names=["tree", *TYPES, "cuts"])

    return run


def _shares(stats: np.ndarray) -> np.ndarray:
    total = np.cumsum(stats, axis=1)[:, -1:]
    return np.divide(stats, total, out=np.zeros_like(stats), where=total != 0)


def pack(feature: np.ndarray, child: np.ndarray, threshold: np.ndarray, stats: np.ndarray, starts: list[int]):
    """Trees laid end to end, for ``votes``: where each starts, of every node one number (left child, whose
    neighbour is the right one, number of the threshold and feature of an inner one, below zero ``-1 - leaf``),
    class shares of the leaves, thresholds by feature.  ``feature`` is -1 in a leaf; ``threshold`` is of the
    inner nodes, ``stats`` (a row each) of the leaves, both in the order of the nodes."""
    inner = np.flatnonzero(feature >= 0)
    own = feature[inner].astype(np.int64)
    cuts, at = [], np.zeros(len(inner), dtype=np.int64)
    for f in range(int(own.max(initial=-1)) + 1):
        mine = np.flatnonzero(own == f)
        values, at[mine] = np.unique(threshold[mine], return_inverse=True)
        cuts.append(values)
    if len(cuts) > 1 << 15 or max(map(len, cuts), default=0) >= 1 << 15:
        raise ValueError("too many features or thresholds")
    node = np.full(len(feature), -1, dtype=np.int64)
    node[inner] = (child[inner].astype(np.int64) << 32) | (at << 16) | own
    leaf = feature < 0
    node[leaf] = -np.arange(1, leaf.sum() + 1)
    return starts, node, _shares(stats), cuts


def end_to_end(nodes: list[np.ndarray], shares: list[np.ndarray], cuts: list[np.ndarray]):
    """``pack`` of grown trees."""
    starts = np.cumsum([0, *map(len, nodes)])
    node, leaves, classes = np.concatenate(nodes), 0, 1
    for start, end in zip(starts, starts[1:]):
        own = node[start:end]
        inner = own >= 0
        own += np.where(inner, start << 32, -leaves)
        count = len(own) - np.count_nonzero(inner)
        leaves += count
        classes = len(shares[0].ravel()) // count if start == 0 else classes
    return starts[:-1].tolist(), node, np.concatenate([v.ravel() for v in shares]).reshape(leaves, classes), cuts


def packed(rows: pa.Table):
    """``end_to_end`` of rows of ``TREE``."""
    rows = rows.sort_by("tree")
    nodes, shares = ([np.frombuffer(v.as_buffer(), dtype=TYPES[k]) for v in rows[k]] for k in ("node", "shares"))
    return end_to_end(nodes, shares, [np.array(c) for c in rows["cuts"][0].as_py()])


def votes(part, x: np.ndarray) -> np.ndarray:
    """Class probabilities of the rows of ``x`` by one sub-forest; votes are added tree by tree, as the learner's model adds them."""
    starts, node, shares, cuts = part
    out = np.zeros((len(x), shares.shape[1]))
    width = max(1, len(cuts))
    bins = np.zeros((len(x), width), dtype=np.int16)
    for f, c in enumerate(cuts):
        bins[:, f] = np.searchsorted(c, x[:, f])  # x > c[j] where more than j thresholds are less than x
    bins, first = bins.ravel(), np.arange(len(x)) * width
    for start in starts:
        leaf = np.zeros(len(x), dtype=np.int64)
        every, row, at = None, first, np.full(len(x), node[start])
        while len(at):
            inner = at >= 0
            going = np.count_nonzero(inner)
            if going < len(at):
                done = np.flatnonzero(~inner)
                leaf[done if every is None else every[done]] = -1 - at[done]
                left = np.flatnonzero(inner)
                every, row, at = left if every is None else every[left], row[left], at[left]
            right = bins.take(row + (at & 0xFFFF)) > ((at >> 16) & 0xFFFF)
            at = node.take((at >> 32) + right)
        out += shares[leaf]
    total = np.cumsum(out, axis=1)[:, -1:]
    return np.divide(out, total, out=out, where=total != 0)
