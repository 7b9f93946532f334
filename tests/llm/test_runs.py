"""Periodic runs against brute force over all periods, and on the edge cases of the docstring."""

import random

import numpy as np
import pytest

from test_llm_operators import frame, texts, words


def brute(w, least=12):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, q, n) for (s, n), q in found.items())


@pytest.mark.parametrize("least", [2, 5, 12])
def test_runs_of_random_strings(least):
    from churnscope.llm.runs import W, document_runs, pieces, runs

    rng = random.Random(least)
    for _ in range(400):
        n, kinds = rng.randint(0, 70), rng.choice([1, 2, 3, 9])
        w = [rng.randint(1, kinds) for _ in range(n)]
        if n and rng.random() < 0.5:
            a = rng.randrange(n)
            p = rng.randint(1, n - a)
            w = [w[i if i < a else a + (i - a) % p] for i in range(n)]
        s = np.array(w, dtype=np.int64)
        want = brute(w, least)
        assert [(a, q, m) for a, m, q in runs(s, least).tolist()] == want
        if n and least > 3:
            at, piece = pieces(W.mix(s.astype(np.uint64) + W.U(99)), np.zeros(n, np.int64), least)
            got = document_runs(s, at, piece, least).tolist() if len(at) else []
            assert [(a, q, m) for a, m, q in got] == want


def test_extensions_are_longest_common():
    from churnscope.llm.runs import Extensions

    rng = np.random.default_rng(2)
    s = rng.integers(1, 4, 300)
    lce = Extensions(s)
    i, j = rng.integers(0, 300, 500), rng.integers(0, 301, 500)
    i, j = i[i != j], j[i != j]
    for a, b, n in zip(i.tolist(), j.tolist(), lce(i, j).tolist()):
        k = 0
        while max(a, b) + k < 300 and s[a + k] == s[b + k]:
            k += 1
        assert k == n
    up, down = lce.ranks()
    code = "".join(map(str, s))
    assert up[:-1].tolist() == np.argsort(np.argsort([code[a:] for a in range(300)])).__add__(1).tolist()
    flipped = code.translate(str.maketrans("123", "321"))
    assert down[:-1].tolist() == np.argsort(np.argsort([flipped[a:] for a in range(300)])).__add__(1).tolist()


def test_periodic_runs(spark):
    from churnscope.llm.runs import periodic_runs

    rng = random.Random(3)
    rows = [(i + 1, t) for i, t in enumerate(texts())]
    for i in range(60):
        part = [rng.choice("abcdé") for _ in range(rng.randint(1, 40))]
        line = part * rng.randint(1, 9) + part[: rng.randint(0, len(part))]
        rows.append((200 + i, "\n".join(" ".join(x) for x in (line, [rng.choice("abx") for _ in range(rng.randint(0, 40))], line)) + " "))
    rows += [rows[-1], (None, "x " * 20), (900, "the same line \n" * 2000)]
    got = sorted((r.doc_id or 0, r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in periodic_runs(frame(spark, rows)).collect())
    want = []
    for d, t in rows:
        w = words(t)
        found = brute(w) if len(w) < 5000 else []
        gone = {i for s, q, n in found for i in range(s + q, s + n)}
        want.append((d or 0, len(w), tuple((s, n, q) for s, q, n in found), " ".join(x for i, x in enumerate(w) if i not in gone)))
    long = {d for d, n, *_ in want if n >= 5000}
    assert [x for x in got if x[0] not in long] == sorted(x for x in want if x[0] not in long)
    assert {x[1:] for x in got if x[0] == 900} == {(6000, ((0, 6000, 3),), "the same line")}
    assert periodic_runs(frame(spark, rows).limit(0)).count() == 0


def test_planted_period_of_the_query(spark, tmp_path):
    """The repeated documents of ``op11_periodic_runs``: a null text, and one word, among them."""
    import zlib

    from churnscope.llm.queries import QUERIES

    rng = random.Random(4)
    ids = [i for i in range(5000) if zlib.crc32(str(i).encode()) % 10 == 0][:40] + [1, 2]
    rows = [(d, " ".join(str(rng.randint(0, 10**6)) for _ in range(rng.randint(0, 200)))) for d in ids]
    rows[:3] = [(ids[0], None), (ids[1], "one"), (ids[2], " ")]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op11_periodic_runs"](spark, str(tmp_path)).collect()}
    for d, t in rows:
        w, h = words(t), zlib.crc32(str(d).encode())
        if h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[i if i < a else a + (i - a) % p] for i in range(len(w))]
        found = sorted(brute(w), key=lambda x: (-x[2], x[0], x[1]))
        r = got[d]
        assert r.n_runs == len(found)
        want = (found[0][0], found[0][2], found[0][1], 1000 * found[0][2] // found[0][1]) if found else (None,) * 4
        assert (r.start, r.length, r.period, r.exponent_milli) == want
