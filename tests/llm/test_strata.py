"""Ranked search against scoring every document, and on the edge cases of its docstring."""

import collections
import math
import random
import re

import numpy as np
import pyarrow as pa

from test_llm_operators import low

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def brute(docs, queries, top):
    docs = [(d, collections.Counter(re.findall(TERM, low(t or "")))) for d, t in docs if d is not None]
    docs = [(d, c) for d, c in docs if c]
    n, total = len(docs), sum(sum(c.values()) for _, c in docs)
    df = collections.Counter(t for _, c in docs for t in c)
    out = []
    for item, text in queries:
        terms = set(re.findall(TERM, low(text or "")))
        scored = []
        for d, c in docs:
            m = 50 + 50 * sum(c.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if score > 0:
                scored.append((-score, d))
        out += [(item, r + 1, d, -s) for r, (s, d) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    vocab = [rng.choice("abcÉdß") + str(i % 40 if i % 3 else i) for i in range(300)]
    pick = lambda n: " ".join(vocab[int(rng.random() ** 3 * 300)] + rng.choice(["", ".", ", X"]) for _ in range(n))
    docs = [(i * 7 % 997, pick(rng.choice([1, 5, 5, 5, 30, 200]))) for i in range(400)]
    docs += [(2000, None), (2001, " .;"), (None, "a1 a2"), docs[5], docs[5], (2002, docs[6][1]), (2003, pick(9000))]
    items = [(i, pick(rng.randint(1, 40))) for i in range(12)] + [(50, None), (51, "--"), (52, "absentterm")]
    return docs, items


def test_ranked_search(spark):
    from churnscope.llm.strata import ranked_search

    docs, items = corpus(1)
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, m long, terms string").repartition(5)
    q = spark.createDataFrame([(*r, 2) for r in [*items, items[0]]], "item_id long, text string, doc_id int")
    for top in (50, 3):
        got = sorted(tuple(r) for r in ranked_search(d, q, top).collect())
        assert got == brute(docs, items, top)
    assert ranked_search(d.limit(0), q).count() == 0
    assert ranked_search(d, q.limit(0)).count() == 0
    both = spark.createDataFrame([(1, "a1"), (1, "c4 d7")], "item_id long, text string")
    assert sorted(tuple(r) for r in ranked_search(d, both, 2).collect()) == brute(docs, [(1, "a1"), (1, "c4 d7")], 2)


def test_split_strata_and_skipped_visits(monkeypatch):
    """Rows of a few postings, many visits, many rounds: the same documents; and visits are skipped."""
    from churnscope.llm import strata as S

    monkeypatch.setattr(S, "POSTINGS", 40)
    monkeypatch.setattr(S, "FIRST_VISIT", 3)
    docs, items = corpus(2)
    docs = [(d, t) for d, t in docs if d is not None]
    scanned = pa.Table.from_batches(list(S._scan([pa.RecordBatch.from_pydict({"doc_id": [d for d, _ in docs], "_k": [0] * len(docs), "text": [t or "" for _, t in docs]})])))
    scanned = scanned.filter(pa.compute.greater(scanned["n"], 0))
    n, total = len(scanned), sum(scanned["n"].to_pylist())
    m = np.array([50 + 50 * x * n // total for x in scanned["n"].to_pylist()])
    order = np.lexsort((scanned["doc_id"].to_numpy(), m))
    rows = scanned.drop_columns(["_k", "n"]).add_column(1, "m", pa.array(m)).take(pa.array(order))
    blocks = [S._block(rows.slice(a, 100).to_batches()) for a in range(0, n, 100)]
    assert max(len(x) for b in blocks for x in b.column("posts").to_pylist()) > 40  # one long document
    assert sum(len(x) for b in blocks for x in b.column("docs").to_pylist()) == n

    class Sent:
        pass

    known = np.unique(np.concatenate([np.array(x, dtype=np.int64) for x in scanned["terms"].to_pylist()]))
    Sent.value = known
    df = collections.Counter()
    for b in S._count(Sent)(blocks):
        df.update(dict(zip(b.column(0).to_pylist(), b.column(1).to_pylist())))
    ids, weight = [], np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in known.tolist()])
    text = pa.RecordBatch.from_pydict({"doc_id": [i for i, _ in items], "_k": [0] * len(items), "text": [t or "" for _, t in items]})
    for b in S._query_terms([text]):
        for terms in b.column("terms").to_pylist():
            at = np.searchsorted(known, np.array(terms, dtype=np.int64))
            ids.append(at[known[np.minimum(at, len(known) - 1)] == np.array(terms, dtype=np.int64)])
    best, scored = [S._Best(5) for _ in ids], []
    count = np.bincount
    monkeypatch.setattr(S.np, "bincount", lambda x, weights=None, minlength=0: (scored.append(len(x)) if weights is not None else None, count(x, weights, minlength))[1])
    for b in blocks:
        S._search_round([b], known, weight, ids, best)
    got = sorted((items[q][0], r + 1, int(d), int(s)) for q, x in enumerate(best) for r, (d, s) in enumerate(zip(x.doc, x.score)))
    assert got == brute(docs, items, 5)
    assert sum(scored) < 0.8 * sum(df[t] for q in ids for t in known[q].tolist())
