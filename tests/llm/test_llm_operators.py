"""Every operator against brute force, on the edge cases of its docstring."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SMALL

SPACE = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
DOC = "doc_id long, text string, lang string, source string, n_chars long, n long, g string, key string, block long, _k int"


def low(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def texts():
    rng = random.Random(7)
    vocab = [a + b for a in ("ab", "Cé", "do", "ex", "ßu") for b in ("la", "mi", "no.", "pe,", "qu")] + ["|", "#x"]
    passage = " ".join(rng.choice(vocab) for _ in range(70))
    out = [None, "", " \t\n", "one", "two words", "a b c", "Aa aa AA aA " * 30]
    for i in range(40):
        out.append("\n".join(" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(1, 9))))
    base = " ".join(rng.choice(vocab) + str(rng.randint(0, 999)) for _ in range(160))
    for i in range(8):  # near copies
        w = base.split()
        w[rng.randrange(len(w))] = "new"
        out.append(" ".join(w))
    out += [base, base, base.upper(), passage, "start " + passage + " end", passage[:200]]
    out += [passage + "\n" + out[12], " ".join(rng.choice(vocab) for _ in range(30_000))]
    return out


@pytest.fixture(scope="module")
def rows():
    out = [(i * 3 % 101 + 100, t) for i, t in enumerate(texts())]
    return [*out, out[12], out[-3]]  # repeated rows


def frame(spark, rows, ddl=DOC):
    full = [(d, t, "en", None if (d or 0) % 5 == 0 else f"s{(d or 0) % 3}", 0, 1, "x", "y", 2, 3) for d, t in rows]
    return spark.createDataFrame(full, ddl).repartition(3)


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).cache()


def words(t, pattern=SPACE):
    return re.findall(pattern, t or "")


def as_rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_ppm(spark, docs, rows):
    from churnscope.llm.ppm import ORDER, ppm_score

    import math

    train = [(d, t) for d, t in rows if zlib.crc32(str(d).encode()) % 7 != 2]
    count = collections.Counter(w for _, t in train for w in [*words(low(t or "")), None])
    total, kinds = sum(count.values()), len(count)
    trie = collections.defaultdict(collections.Counter)
    symbols = lambda t: [254] * ORDER + list(low(t or "").encode()) + [255]
    for _, t in train:
        s = symbols(t)
        for j in range(ORDER, len(s)):
            for k in range(ORDER + 1):
                trie[tuple(s[j - k : j])][s[j]] += 1

    def cost(s, j):
        out, gone = 0.0, set()
        for k in range(ORDER, -1, -1):
            seen = {a: n for a, n in trie.get(tuple(s[j - k : j]), {}).items() if a not in gone}
            n, d = sum(seen.values()), len(seen)
            if s[j] in seen:
                return out + math.log10(seen[s[j]] / (n + d))
            if n:
                out += math.log10(d / (n + d))
            gone |= set(seen)
        return out - math.log10(255 - len(gone))

    want = []
    for d, t in rows:
        w, s = [*words(low(t or "")), None], symbols(t)
        if len(s) < 5000:
            want.append((d, zlib.crc32(str(d).encode()) % 7 == 2, len(w), sum(count[x] > 0 for x in w), total,
                         round(sum(math.log10((count[x] + 1) / (total + kinds + 1)) for x in w), 5),
                         round(sum(cost(s, j) for j in range(ORDER, len(s))), 5)))
    got = ppm_score(docs, F.crc32(F.col("doc_id").cast("string")) % 7 != 2, block=4000)
    got = [(*r[:5], round(r[5], 5), round(r[6], 5)) for r in as_rows(got, *got.columns)]
    assert [r for r in got if r[0] in {x[0] for x in want}] == sorted(want)


def test_ppm_probabilities_sum_to_one():
    from churnscope.llm.ppm import START, costs

    rng = np.random.default_rng(3)
    text = rng.integers(97, 101, 400)
    g = np.array([int.from_bytes(bytes(text[i : i + 5].tolist()), "big") for i in range(395)], dtype=np.uint64)
    pairs = np.zeros((256, 256))
    for x in g:
        pairs[(int(x) >> 8) & 255, int(x) & 255] += 1
    keys, n = np.unique(g, return_counts=True)
    for context in (int(keys[0]) >> 8, int(keys[7]) >> 8):
        every = np.array([context << 8 | b for b in range(256) if b != START], dtype=np.uint64)
        own = [int(k) & 0xFFFF00 == (context & 0xFFFF) << 8 for k in keys]
        table = dict(zip(keys[own].tolist(), n[own].tolist())) | {k: 0 for k in every.tolist() if k not in keys}
        k = np.array(sorted(table), dtype=np.uint64)
        p = 10 ** costs(k, np.array([table[x] for x in k.tolist()], dtype=float), pairs)
        assert abs(p[np.isin(k, every)].sum() - 1) < 1e-9


def test_quality_statistics(spark, docs, rows):
    from churnscope.llm.quality import accepted, quality

    labels = spark.createDataFrame([(rows[i][0], i % 2, 0) for i in range(8, 40)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    want = []
    for d, t in rows:
        w = words(t)
        three = collections.Counter(zip(w, w[1:], w[2:]))
        hit = {i + j for i, x in enumerate(zip(w, w[1:], w[2:])) if three[x] > 1 for j in range(3)}
        seen = collections.Counter(x for x in (t or "").split("\n") if words(x))
        dup = sum(seen.values()) - len(seen)
        want.append((d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(hit),
                     len(w) < 50 or 100 * len(hit) > 50 * len(w)))
    got = quality(docs, labels)
    assert as_rows(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == sorted(want)
    kept = sorted(r.doc_id for r in got.filter("kept").collect())
    assert sorted(r.doc_id for r in accepted(docs, labels).collect()) == kept
    assert accepted(docs, labels.limit(0)).count() == sum(not r[-1] for r in want)


def test_trees_are_monotonic_and_learn():
    from churnscope.llm.trees import fit

    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = ((x[:, 0] + 0.3 * np.sin(9 * x[:, 1]) + 0.1 * rng.normal(size=3000)) < 0.6).astype(float)
    model = fit(x[:2000], y[:2000], [-1, 0, 0])
    assert ((model.score(x[2000:]) > 0) == y[2000:]).mean() > 0.85
    grid = np.repeat(rng.random((50, 3)), 20, axis=0)
    grid[:, 0] = np.tile(np.linspace(0, 1, 20), 50)
    assert (np.diff(model.score(grid).reshape(50, 20), axis=1) <= 1e-12).all()


def test_decontaminate(spark, docs, rows):
    from churnscope.llm.decontaminate import decontaminate

    w = words(low(rows[10][1]), ALNUM)
    items = [(1, " ".join(w[3:15]) + " zz"), (2, "TWO, words"), (3, None), (4, ""), (4, "one"), (5, " ".join(w[:9])), (10, " ".join(w[:10])), (11, "never here at all")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = []
    for d, t in rows:
        x, hit, found = words(low(t or ""), ALNUM), set(), set()
        for i, it in items:
            y = words(low(it or ""), ALNUM)
            m = min(len(y), 10)
            wins = {tuple(y[p : p + m]) for p in range(len(y) - m + 1)} if m else set()
            for p in range(len(x) - m + 1):
                if tuple(x[p : p + m]) in wins:
                    hit |= set(range(p, p + m))
                    found.add(str(i))
        want.append((d, len(x), len(hit), ",".join(sorted(found))))
    got = decontaminate(docs, bench)
    assert as_rows(got, "doc_id", "n_words", "n_hit", F.concat_ws(",", "items")) == sorted(want)
    assert decontaminate(docs, bench.limit(0)).filter("n_hit > 0").count() == 0


def test_quotes(spark):
    from churnscope.llm.quotes import reply_ordered

    data = [(1, 0, "a", "Hello  there\nsecond line"), (1, 1, "b", "> hello there\nmine"), (1, 2, "a", ">> Hello there\n> mine\nthird"),
            (1, 3, "b", "> unknown\nfree"), (1, 4, "c", "> second line\n> Hello there\n> mine"), (2, 1, "a", "> Hello there"),
            (None, 1, "a", "> x"), (3, None, "a", None), (1, 3, "b", "> unknown\nfree")]
    df = spark.createDataFrame([(*r, 9) for r in data], "conv_id long, turn long, role string, text string, lines int")
    got = {(r.conv_id, r.turn): r for r in reply_ordered(df).collect()}
    assert reply_ordered(df).count() == len(data)
    assert [got[1, i].parent_turn for i in range(5)] == [None, 0, 1, None, 0]
    assert [got[1, i].thread_turn for i in range(5)] == [0, 0, 0, 3, 0]
    assert [got[1, i].depth for i in range(5)] == [0, 1, 2, 0, 1]
    assert [got[1, i].text for i in (1, 2, 3, 4)] == ["mine", "third", "free", ""]
    assert got[2, 1].unlinked_lines == 1 and got[None, 1].parent_turn is None and got[3, None].text == ""
    assert reply_ordered(df.limit(0)).count() == 0


def test_mix(spark, docs, rows):
    from churnscope.llm.mixing import mix, mixed_rows

    got = mix(docs).collect()
    size = collections.Counter()
    for r in got:
        size[r.source] += r["size"]
    total, order = sum(size.values()), sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, left, open_ = {}, 1.5 * total, set(order)
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * size[s]}
        if not over:
            break
        target |= {s: 2.0 * size[s] for s in over}
        left -= sum(2 * size[s] for s in over)
        open_ -= over
    target |= share
    assert sorted((r.doc_id, r["size"]) for r in got) == sorted((d, len(words(t))) for d, t in rows)
    assert all(abs(r.target - target[r.source]) < 1e-6 and 0 <= r.copies <= 2 for r in got)
    again = mix(docs.repartition(7))
    assert as_rows(again, "doc_id", "copies") == sorted((r.doc_id, r.copies) for r in got)
    full = mixed_rows(docs)
    assert full.columns == docs.columns and full.count() == sum(r.copies for r in got)
    assert mix(docs.limit(0)).count() == 0


def test_mix_comes_near_its_targets(spark):
    from churnscope.llm.mixing import mix

    got = mix(spark.read.parquet(f"{SMALL}/../sf0.1/documents.parquet"))
    for r in got.groupBy("source").agg(F.first("target").alias("t"), F.sum(F.col("size") * F.col("copies")).alias("w")).collect():
        assert abs(r.w - r.t) <= 0.03 * r.t + 500


def test_substrings(spark, docs, rows):
    from churnscope.llm.substrings import substring_dedup

    n = 12
    first = {}
    for d, t in rows:
        w = words(t)
        for p in range(len(w) - n + 1):
            k = tuple(w[p : p + n])
            first[k] = min(first.get(k, d), d)
    want = []
    for d, t in rows:
        w = words(t)
        gone = {p + j for p in range(len(w) - n + 1) if first[tuple(w[p : p + n])] < d for j in range(n)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        want.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    got = substring_dedup(docs, n)
    assert as_rows(got, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(want)
    assert substring_dedup(docs.limit(0)).count() == 0


def test_hosts(spark):
    from churnscope.llm.hosts import judge

    urls = ["http://Example.NET/en/x?y", "https://a.example.net/de/", "http://notexample.com/de/", "ftp://x.example.com:80/de/", "x.org/fr/",
            "http://b.org/fr/#z", "http://c.net", None, "", "http://", "a://b://c/d", "http://www.example.com/de/1"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)] + [(50 + i, f"http://bad.co.uk/{i}", "") for i in range(30)], "page_id long, url string, domain string")
    good = spark.createDataFrame([(50 + i, False) for i in range(20)] + [(1, True), (None, True), (2, None)], "page_id long, good boolean")
    got = {r.page_id: r for r in judge(pages, good).collect()}
    assert len(got) == 42
    assert [got[i].rule for i in range(12)] == ["example.net/en/", "net/", None, None, None, "org/fr/", None, None, None, None, None, "example.com/de/"]
    assert got[0].host == "example.net" and got[0].path == "/en/x" and got[3].host == "x.example.com:80"
    assert got[10].host == "b:" and got[10].path == "//c/d" and got[7].host == "" and got[6].path == ""
    assert got[0].verdict == "allow" and got[1].verdict == "block" and got[55].verdict == "block"
    assert judge(pages.limit(0), good).count() == 0 and judge(pages, good.limit(0)).count() == 42


def test_tokens(spark, docs, rows):
    from tokenizers import Tokenizer

    from churnscope.llm.queries import tokenizer_file
    from churnscope.llm.tokens import decode_documents, read_tokens, write_tokens

    coder = Tokenizer.from_file(tokenizer_file())
    ids = {}
    for d, t in rows:
        ids[d] = np.array(coder.encode(t or "", add_special_tokens=False).ids + [1], dtype="<u4")
    path = write_tokens(docs, tokenizer_file(), frame_ids=2000)
    got = read_tokens(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted(d for d, _ in rows)
    at = 0
    for r in got:
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids[r.doc_id]), zlib.crc32(ids[r.doc_id].tobytes()))
        at += r.n_tokens
    for frame_row in spark.read.parquet(path).collect():
        for i, d in enumerate(frame_row.doc_ids):
            assert np.array_equal(decode_documents(frame_row.asDict(), [i])[0], ids[d])
    assert read_tokens(spark, write_tokens(docs.limit(0), tokenizer_file())).count() == 0


def test_warc(spark):
    from churnscope.llm.warc import page_of, read_warc, write_warc

    body = "WARC/1.0\r\n\r\né" * 200
    data = [(1, "http://a/\nb", body), (2, None, body), (7, "u", body), (3, "u", "x"), (4, "u", "x"), (5, "u", None), (6, "u", "y" * 300_000), (None, "u", body)]
    pages = spark.createDataFrame([(*r, 1) for r in data], "page_id long, url string, html string, record_type int").repartition(3)
    path = write_warc(pages)
    got = read_warc(spark, path).select("*", page_of(F.col("record_id")).alias("page"), page_of(F.col("refers_to_id")).alias("to")).collect()
    assert len(got) == len(data)
    by = {r.page: r for r in got}
    for page, url, html in data:
        raw = (html or "").encode()
        r = by[page]
        assert r.sha1 == hashlib.sha1(raw).hexdigest() and r.payload_bytes == len(raw)
        assert (r.record_type, r.to) == (("revisit", 7) if page in (1, 2) else ("response", None))
        assert r.payload is None if page in (1, 2) else bytes(r.payload) == raw
    assert by[1].target_uri == "http://a/%0Ab" and by[2].target_uri is None
    revisits = read_warc(spark, path, payload=False).filter("record_type = 'revisit'")
    assert "PushedFilters" in revisits._jdf.queryExecution().toString() or revisits.count() == 2
    assert revisits.count() == 2 and read_warc(spark, path).filter("record_id = '<urn:page:4>'").count() == 1
    assert read_warc(spark, write_warc(pages.limit(0))).count() == 0


def jaccard_brute(rows, k, percent):
    sets = {}
    for d, t in rows:
        w = words(low(t or ""))
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    comp = {d: d for d in sets}
    links = []
    for a in sets:
        for b in sets:
            o = len(sets[a] & sets[b])
            if o and 100 * o >= percent * len(sets[a] | sets[b]):
                links.append((a, b))
    for _ in sets:
        before = dict(comp)
        for a, b in links:
            comp[a] = comp[b] = min(comp[a], comp[b])
        if comp == before:
            break
    return sorted((d, len(sets[d]), comp[d]) for d, _ in rows)


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80)])
def test_jaccard(spark, docs, rows, k, percent):
    from churnscope.llm.jaccard import jaccard_components

    got = jaccard_components(docs, k, percent)
    assert as_rows(got, "doc_id", "n_shingles", "component_id") == jaccard_brute(rows, k, percent)
    assert jaccard_components(docs.limit(0)).count() == 0


def test_jaccard_chains_of_edits(spark):
    """Texts that drift apart by edits, cuts and additions: links of many sizes, groups that only later pairs join."""
    from churnscope.llm.jaccard import jaccard_components

    rng = random.Random(10)
    texts = [[rng.choice("abcdefgh") + str(rng.randint(0, 3)) for _ in range(rng.randint(20, 120))] for _ in range(4)]
    for _ in range(80):
        w = list(rng.choice(texts))
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = rng.choice("abcdefgh")
        w = w[: len(w) - rng.randint(0, len(w) // 8)] + [rng.choice("abc") for _ in range(rng.randint(0, 4))]
        texts.append(w[rng.randint(0, 3) :])
    rows = list(zip(rng.sample(range(1000), len(texts)), (" ".join(w) for w in texts)))
    got = as_rows(jaccard_components(frame(spark, rows)), "doc_id", "n_shingles", "component_id")
    assert got == jaccard_brute(rows, 4, 85)
    assert 4 < len({c for _, _, c in got}) < len(rows)


def test_pipeline_stages(spark):
    import corpus_pipeline
    from churnscope.llm.common import stage

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    start, columns = docs.count(), docs.columns
    for name, fn in corpus_pipeline.STAGES[:-1]:
        after = stage(fn(spark, docs, SMALL), "test")
        assert after.columns == columns and after.count() > 0
        if "mixing" not in name:
            assert after.join(docs, columns, "left_anti").count() == 0
        docs = after
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert out.count() == docs.count() <= 2 * start
