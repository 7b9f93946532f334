"""Pipeline stages on repeated ids, equal rows, nulls, clashing columns and empty tables."""

import random

import corpus_pipeline as P
from conftest import SMALL
from test_llm_operators import frame, jaccard_brute, texts


def odd_rows():
    rng = random.Random(8)
    one, two = (" ".join(str(rng.random()) for _ in range(80)) for _ in "ab")
    rows = [(i + 10, t) for i, t in enumerate(texts()[:40])]
    near = two.replace(two.split()[3], "x")
    return rows + [(1, one), (2, one), (2, two), (2, two), (3, near), (None, one), (None, one), (4, None), (4, None), (5, ""), rows[9], (6, near)]


def as_set(df):
    return sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=str)


def test_near_duplicates_keep_one_of_each_group(spark):
    rows = odd_rows()
    docs = frame(spark, rows)
    kept = P.near_duplicates(spark, docs, SMALL)
    assert kept.columns == docs.columns
    # a document is its id and text: the brute force knows each by a number of its own, in order of its id
    known = sorted({r for r in rows if r[0] is not None}, key=lambda r: (r[0], r[1] or ""))
    comp = {n: c for n, _, c in jaccard_brute(list(enumerate(t for _, t in known)), 5, 80)}
    smallest = {}
    for n, c in comp.items():
        smallest[c] = min(smallest.get(c, known[n][0]), known[n][0])
    want = [known[n] for n, c in comp.items() if known[n][0] == smallest[c]] + [(None, rows[-7][1])]
    assert as_set(kept) == sorted(want, key=str)
    assert (2, rows[42][1]) in want and (3, rows[44][1]) not in want and (6, rows[44][1]) not in want


def test_every_stage_on_odd_and_empty_tables(spark):
    from churnscope.llm.common import stage

    docs = frame(spark, odd_rows())
    for table in (docs, docs.limit(0)):
        for name, fn in P.STAGES[:-1]:
            out = stage(fn(spark, table, SMALL), "test")
            assert out.columns == table.columns and out.dtypes == table.dtypes, name
            if "mixing" not in name:
                assert out.select("doc_id", "text").exceptAll(table.select("doc_id", "text")).count() == 0, name
            if table is not docs:
                assert out.count() == 0, name
        out = P.STAGES[-1][1](spark, table, SMALL)
        assert out.count() == table.count()


def test_equal_rows_are_judged_alike(spark):
    docs = frame(spark, odd_rows())
    for fn in (P.quality_rules, P.decontamination):
        left = fn(spark, docs, SMALL).groupBy("doc_id", "text").count().collect()
        before = {(r.doc_id, r.text): r["count"] for r in docs.groupBy("doc_id", "text").count().collect()}
        assert all(before[r.doc_id, r.text] == r["count"] for r in left)
