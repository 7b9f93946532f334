"""Re-Pair leaves no frequent pair; pieces encoded together have the ids that they have alone."""

import collections
import itertools
import random

import numpy as np


def pairs(docs):
    """Occurrences of neighbouring pairs; in a stretch of n equal ids the pair of two occurs n // 2 times."""
    found = collections.Counter()
    for d in docs:
        for a, b in zip(d, d[1:]):
            found[a, b] += a != b
        for a, run in itertools.groupby(d):
            found[a, a] += len(list(run)) // 2
    return found


def test_no_frequent_pair_is_left_and_decoding_is_exact():
    from churnscope.llm import repair as R

    rng = np.random.default_rng(0)
    for _ in range(300):
        kinds, least = rng.integers(1, 8), int(rng.integers(2, 6))
        docs = [rng.integers(0, kinds, rng.integers(0, 60)).astype(np.uint32) for _ in range(rng.integers(0, 8))]
        ids, ends = np.concatenate([*docs, np.zeros(0, np.uint32)]), np.cumsum([len(d) for d in docs]).astype(np.int64)
        symbols, rules, at = R.compress(ids, ends, 100, least)
        sizes = R.lengths(rules, 100)
        assert (R.expand(symbols, rules, sizes, 100)[0] == ids).all()
        parts = [symbols[a:b] for a, b in zip(at, at[1:])]
        for d, p in zip(docs, parts):  # each document from its own symbols
            assert (R.expand(p, rules, sizes, 100)[0] == d).all()
        assert max(pairs([p.tolist() for p in parts]).values(), default=0) < least


def test_equal_ids_are_paired_from_the_left():
    from churnscope.llm import repair as R

    symbols, rules, at = R.compress(np.full(13, 7, np.uint32), np.array([13]), 100, 3)
    assert rules.tolist()[0] == [7, 7] and symbols[-1] == 7
    assert R.expand(symbols, rules, R.lengths(rules, 100), 100)[0].tolist() == [7] * 13


def test_joined_pieces_have_their_own_ids():
    from churnscope.llm.queries import tokenizer_file
    from churnscope.llm.tokens import Encoder

    rng = random.Random(1)
    chars = [*"abcXYZ019'’.,!?-_#@/ΣσςéÉJß", "̌", "́", " ", "　", "日", "ﬁ", "İ", "😀", "‍", "don't", "<|endoftext|>", "</w>", "Ǆ"]
    pieces = ["".join(rng.choice(chars) for _ in range(rng.randint(1, 7))) for _ in range(20_000)]
    coder = Encoder(tokenizer_file())
    assert coder._encode_pieces(pieces) == coder._encode(pieces)


def test_level_lengths_double():
    from churnscope.llm.substrings import level_lengths

    assert level_lengths(50) == [13, 25] and level_lengths(200) == [13, 25, 50, 100] and level_lengths(6) == [3]
    for n in (6, 17, 50, 333):
        each = [*level_lengths(n), n]
        assert all(a < b <= 2 * a for a, b in zip(each, each[1:]))
