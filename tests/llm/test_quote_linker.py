"""Quotation linking against a plain linker over random conversations."""

import collections
import random
import re

WINDOW = 4


def lines_of(text):
    """(line number, level, content) of all lines with content."""
    out = []
    for i, x in enumerate(re.split("\r?\n", text or "")):
        marks = re.match(r"^[ \t]*(>[> \t]*)", x)
        content = re.sub(r"\s+", " ", x[marks.end() :] if marks else x).strip(" ").lower()
        if content:
            out.append((i, marks[1].count(">") if marks else 0, content))
    return out


def units(text):
    """(level, lines, unit, is a window) of all lines and windows."""
    found, words = [], []
    for i, level, content in lines_of(text):
        found.append((level, [i], content, 0))
        for w in content.split(" "):
            w = re.sub(r"^[^\w]+|[^\w]+$", "", w)
            if w:
                words.append((w, i, level))
    for a in range(len(words) - WINDOW + 1):
        part = words[a : a + WINDOW]
        if len({x[2] for x in part}) == 1:
            found.append((part[0][2], sorted({x[1] for x in part}), " ".join(x[0] for x in part), 1))
    return found


def brute(rows):
    """parent, thread, depth, quoted and unlinked lines of every row."""
    messages = sorted({(c, t, x or "") for c, t, x in rows})
    first = {}
    for c, t, x in messages:
        for level, _, unit, window in units(x):
            if level == 0:
                for u in {unit} if window else {unit, *re.split(r"(?<=[.!?]) ", unit)}:
                    first[c, u] = min(first.get((c, u), t), t)
    info, by_turn = {}, collections.defaultdict(list)
    for c, t, x in messages:
        votes = collections.defaultdict(collections.Counter)
        for level, on, unit, window in units(x):
            if level > 0:
                o = first.get((c, unit))
                for i in on:
                    votes[level, i][window, o if o is not None and o < t else None] += 1
        per, quoted, unlinked = collections.Counter(), 0, 0
        for (level, _), v in votes.items():
            best = max(((w, n, o) for (w, o), n in v.items() if o is not None), default=None)
            quoted += 1
            unlinked += best is None
            if level == 1 and best:
                per[best[2]] += 1
        best = max(((n, o) for o, n in per.items()), default=None)
        info[c, t, x] = best, quoted, unlinked
        if best:
            by_turn[c, t].append(best)
    out = []
    for c, t, x in rows:
        best, quoted, unlinked = info[c, t, x or ""]
        thread, depth, up = t, 0, best
        while up:
            thread, depth = up[1], depth + 1
            up = max(by_turn[c, thread], default=None)
        out.append((c, t, best[1] if best else -1, thread, depth, quoted, unlinked))
    return sorted(out)


def conversations(seed):
    rng = random.Random(seed)
    vocab = ["the", "Ship", "(left)", "port,", "Monday.", "why?", "été", "no", "42", "yes!", "“so”", "and"]
    said, rows = collections.defaultdict(list), []
    text = lambda: "\n".join(" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(1, 4)))
    for conv in range(12):
        for turn in range(rng.randint(1, 9)):
            parts = []
            for _ in range(rng.randint(0, 3)):
                if said[conv] and rng.random() < 0.7:
                    quoted = rng.choice(said[conv])
                    if rng.random() < 0.5 and quoted.replace(">", " ").split():  # another width, or a part
                        w = quoted.replace(">", " ").split()
                        a, n = rng.randint(0, len(w) - 1), rng.randint(2, 6)
                        w = w[a:]
                        quoted = "\n".join(" ".join(w[i : i + n]) for i in range(0, len(w), n))
                    parts.append("\n".join(rng.choice(["> ", ">", " >> " if rng.random() < 0.2 else "> "]) + x for x in quoted.split("\n")))
                parts.append(text())
            body = rng.choice(["\n", "\n\n", "\r\n"]).join(parts)
            rows.append((conv, turn, body))
            said[conv].append(body)
            if rng.random() < 0.1:
                rows.append(rows[-1])
            if rng.random() < 0.15:  # another message of the same turn
                rows.append((conv, turn, "> " + rng.choice(said[conv]).replace("\n", "\n> ") + "\nown words here"))
    return rows


def test_links_equal_a_plain_linker(spark):
    from churnscope.llm.quotes import reply_ordered

    rows = [(100 * s + c, t, x) for s in range(4) for c, t, x in conversations(s)]
    df = spark.createDataFrame([(c, t, "a", x, 1) for c, t, x in rows], "conv_id long, turn long, role string, text string, copy int")
    got = reply_ordered(df.repartition(5)).collect()
    want = brute(rows)
    assert sum(x[2] >= 0 for x in want) > 50
    assert sorted((r.conv_id, r.turn, -1 if r.parent_turn is None else r.parent_turn, r.thread_turn, r.depth, r.quoted_lines, r.unlinked_lines) for r in got) == want


def test_repeated_rows_and_shared_turns(spark):
    from churnscope.llm.quotes import reply_ordered

    long = " ".join(f"w{i}" for i in range(30_000))
    data = [(1, 0, "hello there my friend"), (1, 1, "> hello there my friend\nyes"), (1, 1, "> hello there my friend\nyes"),
            (1, 2, "> hello there my friend\nfirst"), (1, 2, "no quote at all"), (1, 2, None), (2, 0, long), (2, 1, "> " + long + "\nok")]
    df = spark.createDataFrame([(c, t, "a", x) for c, t, x in data], "conv_id long, turn long, role string, text string")
    got = sorted((r.conv_id, r.turn, r.text[:10], -1 if r.parent_turn is None else r.parent_turn, r.quoted_lines) for r in reply_ordered(df).collect())
    assert got == sorted([(1, 0, "hello ther", -1, 0), (1, 1, "yes", 0, 1), (1, 1, "yes", 0, 1), (1, 2, "first", 0, 1), (1, 2, "no quote a", -1, 0),
                          (1, 2, "", -1, 0), (2, 0, long[:10], -1, 0), (2, 1, "ok", 0, 1)])
