"""Texts are cut at every change of kind inside ASCII, and known pieces are found by hash."""

import numpy as np
import pyarrow as pa
import pytest


@pytest.fixture(scope="module")
def path():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _encoded(coder, texts):
    from churnscope.llm import words as W

    out = []
    for _, data, off in W.texts(pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])):
        ids, n = coder.encode(data, off)
        out += np.split(ids, np.cumsum(n)[:-1])
    return [x[:-1].tolist() for x in out]


def _plain(coder, texts):
    return [coder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_word_is_encoded_once_whatever_stands_beside_it(path, monkeypatch):
    from churnscope.llm.tokens import Encoder

    coder, asked = Encoder(path), []
    kept = coder._encode_pieces
    monkeypatch.setattr(coder, "_encode_pieces", lambda pieces: asked.extend(pieces) or kept(pieces))
    texts = [" ".join(f"{w}{m}" for m in ("%%%", "&&&", "$$$", "***", "-", "|", "7", "#", "(", "_")) for w in ("mentenle", "onhath", "ingbe", "röded")]
    assert _encoded(coder, texts) == _plain(coder, texts)
    assert len(asked) <= 3 + 10 + 2 * 10  # the mark after röded is cut off as well
    assert _encoded(coder, texts[::-1]) == _plain(coder, texts[::-1])


def test_ids_are_the_tokenizers_for_odd_neighbours(path):
    from churnscope.llm.tokens import Encoder

    rng = np.random.default_rng(11)
    parts = ["a", "S", "ve", "LL", "the", "'", "'s", "'", "7", "20", "%", "&&", "|", "<", "<|", "|>", "=", "_", "^", "`", "~", "̸", "́", "é", "ß", "Σ",
             "٣", "²", "中", " ", "\t", "\n", "\x00", "\x7f", "\x1f", "\xa0", ".", ",", "!", "@", "\\", "/", "K"]
    texts = ["".join(parts[i] for i in rng.integers(0, len(parts), rng.integers(0, 14))) for _ in range(6_000)]
    coder = Encoder(path)
    got = _encoded(coder, texts)
    bad = [(t, a, b) for t, a, b in zip(texts, got, _plain(coder, texts)) if a != b]
    assert not bad, bad[:3]


def test_known_pieces_are_found_and_others_not():
    from churnscope.llm.tokens import Pieces

    rng = np.random.default_rng(3)
    keys = np.unique(np.concatenate([rng.integers(0, 2**63, 5_000, dtype=np.uint64), np.arange(300, dtype=np.uint64)]))  # the last ones share a place
    known = Pieces(bits=4)
    assert known.find(keys[:3]).tolist() == [-1, -1, -1]
    for part in np.array_split(rng.permutation(keys), 7):
        assert (known.find(part) == -1).all()
        known.add(part, part ^ np.uint64(1), [np.full(int(k) % 4, int(k) % 1000, "<u4").tobytes() for k in part.tolist()])
    i = known.find(keys)
    assert np.array_equal(known.keys[i], keys) and np.array_equal(known.checks[i], keys ^ np.uint64(1))
    assert np.array_equal(known.size[i], (keys % 4).astype(int))
    assert all((known.flat[b : b + n] == k % 1000).all() for b, n, k in zip(known.begin[i].tolist(), known.size[i].tolist(), keys.tolist()))
    assert (known.find(keys + np.uint64(2**63)) == -1).all()


def test_two_pieces_of_one_hash_are_told_apart(path, monkeypatch):
    from churnscope.llm import tokens

    coder = tokens.Encoder(path)
    real = tokens._ONE.words
    monkeypatch.setattr(tokens._ONE, "words", lambda *a: real(*a) & np.uint64(7))
    for texts in (["one two three four five six", "seven, eight nine"], ["ten eleven", "", "one twelve"]):
        assert _encoded(coder, texts) == _plain(coder, texts)


def test_words_and_other_pieces_keep_their_order(path, monkeypatch):
    from churnscope.llm.tokens import Encoder

    coder = Encoder(path)
    pieces = ["mentenle", "don't", "%%%", "a", "röd", "zz" * 300, "7", "ofthouenes"] * 90
    want = coder._encode(pieces)
    assert coder._encode_pieces(pieces) == want
    assert coder._encode_words([x for x in pieces if x.isascii() and x.isalpha()]) == [w for x, w in zip(pieces, want) if x.isascii() and x.isalpha()]
    assert coder._encode_pieces([]) == []
    monkeypatch.setattr(coder, "last", np.zeros_like(coder.last))  # words whose last tokens are not told apart are encoded one by one
    assert coder._encode_pieces(pieces) == want
    monkeypatch.setattr(coder, "marks", False)
    assert coder._encode_pieces(pieces) == want
