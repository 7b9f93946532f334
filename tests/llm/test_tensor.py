"""Tensored MinHash against all pairs, on the edge cases of its docstring."""

import random

import numpy as np

from test_llm_operators import as_rows, frame, jaccard_brute, texts


def test_tensored_minhash_equals_all_pairs(spark):
    from churnscope.llm.tensor import near_duplicates

    rows = [(i * 3 % 101 + 100, t) for i, t in enumerate(texts())]
    rows += [rows[12], rows[-3]]
    got = near_duplicates(frame(spark, rows))
    want = [(*r, r[0] == r[2]) for r in jaccard_brute(rows, 5, 85)]
    assert as_rows(got, "doc_id", "n_shingles", "component_id", "kept") == want
    assert near_duplicates(frame(spark, rows).limit(0)).count() == 0


def test_tensored_minhash_chains(spark):
    """Drifting texts: buckets that hold several components, links that only the opened buckets give."""
    from churnscope.llm.tensor import near_duplicates

    rng = random.Random(13)
    base = [[rng.choice("abcdefgh") + str(rng.randint(0, 9)) for _ in range(rng.randint(30, 150))] for _ in range(4)]
    for _ in range(90):
        w = list(rng.choice(base))
        if rng.random() < 0.8:
            w[rng.randrange(len(w))] = rng.choice("abcdefgh")
        base.append(w[rng.randint(0, 2) : len(w) - rng.randint(0, 3)])
    rows = list(zip(rng.sample(range(1000), len(base)), (" ".join(w) for w in base)))
    got = as_rows(near_duplicates(frame(spark, rows)), "doc_id", "n_shingles", "component_id")
    assert got == jaccard_brute(rows, 5, 85)
    assert 4 < len({c for _, _, c in got}) < len(rows)


def test_rows_of_one_id_are_compared_each_by_itself(spark):
    from churnscope.llm.tensor import near_duplicates

    rng = random.Random(5)
    one, two = (" ".join(str(rng.random()) for _ in range(60)) for _ in "ab")
    rows = [(1, one), (2, one), (2, two), (2, two), (3, two.replace(two.split()[0], "x")), (None, one), (4, None), (5, " ")]
    got = near_duplicates(frame(spark, rows)).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got), key=str) == sorted(
        [(1, 56, 1, True), (2, 56, 1, False), (2, 56, 2, True), (2, 56, 2, True), (3, 56, 2, False), (None, 56, None, True), (4, 0, 4, True), (5, 0, 5, True)],
        key=str,
    )


def test_sub_keys_agree_as_often_as_the_sets():
    from churnscope.llm.tensor import sub_keys

    rng = np.random.default_rng(1)
    sets = [rng.integers(0, 2**63, 100, dtype=np.uint64) for _ in range(200)]
    half = [np.concatenate([s[:90], rng.integers(0, 2**63, 10, dtype=np.uint64)]) for s in sets]
    size = np.full(200, 100)
    one, two = (sub_keys(np.concatenate(x), size, 20, 1) for x in (sets, half))
    assert abs((one == two).mean() - 90 / 110) < 0.02


def test_jaccard_join_keys_texts_not_ids(spark):
    """The n-gram join: another text of a doc_id has links of its own."""
    import pytest

    from churnscope.llm.jaccard import jaccard_components

    rng = random.Random(6)
    one, two = (" ".join(str(rng.random()) for _ in range(60)) for _ in "ab")
    rows = [(1, one), (2, one), (2, two), (2, two), (3, two.replace(two.split()[0], "x")), (None, one), (4, None), (0, "y " + two)]
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in jaccard_components(frame(spark, rows)).collect() if r.doc_id is not None)
    assert got == [(-1, 58, 0), (1, 57, 1), (2, 57, 0), (2, 57, 0), (2, 57, 1), (3, 57, 0), (4, 0, 4)]
    with pytest.raises(ValueError):
        jaccard_components(frame(spark, rows), percent=49)


def test_buckets_of_the_same_documents_are_opened_once(spark, monkeypatch):
    """Two documents just below the limit share dozens of keys, but are compared once."""
    from churnscope.llm import tensor

    rows_of = {}

    def counted(df, name, real=tensor.stage):
        out = real(df, name)
        rows_of[name] = out.count()
        return out

    monkeypatch.setattr(tensor, "stage", counted)
    words = [f"w{i}" for i in range(300)]
    other = [w + "x" if i % 60 == 30 else w for i, w in enumerate(words)]
    rows = [(1, " ".join(words)), (2, " ".join(other))]
    got = as_rows(tensor.near_duplicates(frame(spark, rows)), "doc_id", "n_shingles", "component_id")
    assert got == [(1, 296, 1), (2, 296, 2)]  # 271 shingles of 321 in common
    assert rows_of["buckets"] > 20
    assert rows_of["open"] == 2
