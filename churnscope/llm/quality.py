"""Quality rules: fixed rules, then gradient-boosted trees over document statistics.

All statistics are computed for whole texts of all documents.  The trees are
fitted on the driver from at most ``SAMPLE`` labelled rows of statistics (those
with the smallest hash of doc_id), a documented bound; they are monotonic: more
symbols, repeated words, repeated lines, capitals or exclamation marks never
raise a score.  Scoring is a vectorised walk through flat node arrays.

Defined cases: a null or wordless text has statistics 0 and fails the rules;
null labels are ignored, of repeated labels the lowest counts; without labels
of both kinds the rules alone decide; repeated documents are judged alike; an
empty table gives an empty result; other columns are carried along by
``accepted`` and ignored otherwise.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnscope.llm import words as W
from churnscope.llm.common import keyed, schema, stage
from churnscope.llm.trees import Trees, fit

SAMPLE = 20_000
LEAST_PROBABILITY = 0.5
MIN_WORDS = 50
MOST_REPEATED = 50  # percent of the words
_HASH = W.Hash(2)

#: Statistics, and the direction in which each may move the score.
STATS = {
    "n_words": 0, "word_chars": 0, "n_symbols": 0, "n_dup_lines": 0, "n_repeat_words": 0, "n_lines": 0, "n_distinct": 0,
    "n_upper": 0, "n_letters": 0, "n_digits": 0, "n_marks": 0, "n_stops": 0,
}
FEATURES = {
    "words": 0, "word_length": 0, "symbols_per_word": -1, "dup_line_share": -1, "repeat_share": -1, "distinct_share": 0,
    "upper_share": -1, "letter_share": 0, "digit_share": 0, "marks_per_word": -1, "stops_per_word": 0, "words_per_line": 0,
}


def _of(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_UPPER = W._table((65, 90))
_LETTER = W._table((65, 90), (97, 122), (128, 255))
_LEAD = ~W._table((128, 191)) & ~W.SPACE  # first bytes of the code points in words
_KINDS = {
    "word_chars": _LEAD, "n_symbols": _of(b"#*$%&|<>"), "n_upper": _UPPER, "n_letters": _LETTER,
    "n_digits": W._table((48, 57)), "n_marks": _of(b"!?"), "n_stops": _of(b"."),
}


def _in_row(row: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Hashes that are equal only within a row."""
    return W.mix(h + W.mix(row.astype(np.uint64) + W.U(1)))


def _distinct(row: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    first = np.unique(_in_row(row, h), return_index=True)[1]
    return np.bincount(row[first], minlength=n)


def _statistics(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    n = len(off) - 1
    out = {}
    for name, kind in _KINDS.items():
        sums = np.zeros(len(data) + 1, np.int64)
        np.cumsum(kind[data], out=sums[1:])
        out[name] = sums[off[1:]] - sums[off[:-1]]
    starts, ends, rows = W.bounds(data, off, W.SPACE)
    h = _HASH.words(data, starts, ends)
    out["n_words"] = np.bincount(rows, minlength=n)
    out["n_distinct"] = _distinct(rows, h, n)
    # lines with a word; a line's hash covers all its bytes
    a, b, line_row = W.bounds(data, off, _of(b"\n"))
    filled = np.searchsorted(starts, b, side="left") > np.searchsorted(starts, a, side="left")
    a, b, line_row = a[filled], b[filled], line_row[filled]
    out["n_lines"] = np.bincount(line_row, minlength=n)
    out["n_dup_lines"] = out["n_lines"] - _distinct(line_row, _HASH.words(data, a, b), n)
    # words inside three-word windows that the text has twice or more
    g, at = W.grams(h, rows, 3)
    key = _in_row(rows[at], g)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.r_[False, same] | np.r_[same, False] if len(key) else np.zeros(0, bool)
    cover = np.zeros(len(h), bool)
    hit = at[order[twice]]
    for j in range(3):
        cover[hit + j] = True
    out["n_repeat_words"] = np.bincount(rows[cover], minlength=n)
    return {k: out[k].astype(np.int64) for k in STATS}


def _features(s: dict[str, np.ndarray]) -> np.ndarray:
    s = {k: v.astype(np.float64) for k, v in s.items()}
    words, lines, chars = (np.maximum(s[k], 1) for k in ("n_words", "n_lines", "word_chars"))
    cols = {
        "words": s["n_words"], "word_length": s["word_chars"] / words, "symbols_per_word": s["n_symbols"] / words,
        "dup_line_share": s["n_dup_lines"] / lines, "repeat_share": s["n_repeat_words"] / words,
        "distinct_share": s["n_distinct"] / words, "upper_share": s["n_upper"] / np.maximum(s["n_letters"], 1),
        "letter_share": s["n_letters"] / chars, "digit_share": s["n_digits"] / chars,
        "marks_per_word": s["n_marks"] / words, "stops_per_word": s["n_stops"] / words, "words_per_line": s["n_words"] / lines,
    }
    return np.stack([cols[k] for k in FEATURES], axis=1)


def _verdicts(s: dict[str, np.ndarray], model: Trees, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    failed = (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MOST_REPEATED * s["n_words"])
    p = 1 / (1 + np.exp(-model.score(_features(s))))
    return failed, p, ~failed & (p >= least)


def statistics(docs: DataFrame) -> DataFrame:
    """``doc_id, _k`` and the statistics of every document, stored."""

    def run(batches):
        for batch in batches:
            for part, data, off in W.texts(batch):
                src = batch.slice(part.start, part.stop - part.start)
                s = _statistics(data, off)
                yield pa.RecordBatch.from_arrays([src.column(0), src.column(1), *map(pa.array, s.values())], names=["doc_id", "_k", *s])

    fields = ", ".join(f"{k} bigint" for k in STATS)
    return stage(keyed(docs).mapInArrow(run, schema(f"doc_id bigint, _k bigint, {fields}")), "statistics")


def train(stats: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Trees from the labelled rows with the smallest hash of doc_id, at most ``sample``."""
    marks = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("_quality"))
    # hashes up to twice the sample's share first: no task sends the driver a sample of its own
    share = min(1.0, 2 * sample / max(1, marks.count()))
    drawn = F.xxhash64("doc_id") <= min(2**63 - 1, int(share * 2**64) - 2**63)
    rows = stats.join(marks.filter(drawn), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "_k").limit(sample).toPandas()
    x = _features({k: rows[k].to_numpy() for k in STATS})
    return fit(x, (rows["_quality"].to_numpy() > 0).astype(np.float64), list(FEATURES.values()))


def quality(docs: DataFrame, labels: DataFrame, least: float = LEAST_PROBABILITY) -> DataFrame:
    """``doc_id, _k``, the statistics, ``base_failed, probability, kept`` of every document."""
    stats = statistics(docs)
    model = train(stats, labels)

    def run(batches):
        for b in batches:
            s = {k: np.asarray(b.column(b.schema.get_field_index(k))) for k in STATS}
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, _verdicts(s, model, least))], names=[*b.schema.names, "base_failed", "probability", "kept"])

    extra = schema("base_failed boolean, probability double, kept boolean").fields
    return stats.mapInArrow(run, type(stats.schema)(stats.schema.fields + extra))


def accepted(docs: DataFrame, labels: DataFrame, least: float = LEAST_PROBABILITY) -> DataFrame:
    """The rows of ``docs``, all columns, that pass the rules and the trees; no shuffle of texts."""
    model = train(statistics(docs), labels)

    def run(batches):
        for batch in batches:
            for part, data, off in W.texts(batch):
                keep = _verdicts(_statistics(data, off), model, least)[2]
                yield batch.slice(part.start, part.stop - part.start).filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
