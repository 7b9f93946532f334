"""A block is asked for and scored piece by piece: its tasks do not hold it whole, and lose nothing between pieces."""

import tracemalloc

import numpy as np
import pyarrow as pa


def _blocks(rows, monkeypatch):
    from churnscope.llm import ppm

    class Task:
        get = staticmethod(lambda: Task)
        partitionId = staticmethod(lambda: 0)

    monkeypatch.setattr(ppm, "TaskContext", Task)
    batch = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.bool_(), pa.string()))], names=["doc_id", "train", "text"])
    return list(ppm._blocks(ppm.BLOCK)(iter([batch])))


def _rows(n):
    rng = np.random.default_rng(5)
    words = np.array(["".join(chr(97 + c) for c in rng.integers(0, 20, 1 + rng.integers(0, 9))) for _ in range(20_000)])
    return [(i, i % 7 != 2, " ".join(words[rng.integers(0, len(words), 4_000)])) for i in range(n)]


def test_a_block_is_asked_for_in_bounded_memory(monkeypatch):
    from churnscope.llm import ppm

    blocks = _blocks(_rows(250), monkeypatch)  # 5 MB of text
    assert len(blocks) == 1
    tracemalloc.start()
    for _ in ppm._ask(iter(blocks)):
        pass
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert peak < 170, peak


def test_counts_and_texts_are_whole_over_many_pieces(monkeypatch):
    from churnscope.llm import ppm

    rows = [*_rows(80), (80, True, ""), (81, True, "x" * (2 * ppm.PIECE)), (82, False, "")]
    blocks = _blocks(rows, monkeypatch)
    block = blocks[0].to_pylist()[0]
    texts = [x[off[i] : off[i + 1]].tobytes().decode() for _, x, off in ppm._parts(block["off"], block["text"]) for i in range(len(off) - 1)]
    assert texts == [r[2] for r in rows]
    data = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    grams, own = ppm._grams(data, np.asarray(block["off"]))
    keys, back = np.unique(grams, return_inverse=True)
    n = np.bincount(back, weights=np.array([r[1] for r in rows])[own]).astype(int)
    asked = pa.Table.from_batches(list(ppm._ask(iter(blocks)))).to_pydict()
    got = {np.int64(k).view(np.uint64): v for kind, k, v in zip(asked["kind"], asked["key"], asked["n"]) if kind == ppm._GRAM}
    assert got == dict(zip(keys, n.tolist()))
    found = ppm.Lookup(keys, n.astype(float))
    assert np.array_equal(found[grams], n[back])
