"""Ids of texts whose capitals may be composed with what follows them."""

import numpy as np
import pytest

PAIRS = ["J̌", "H̱", "T̈", "T̈́", "W̊", "Y̊"]
TEXTS = [*PAIRS, *["Aa." + p + "Zz, " + p for p in PAIRS], "J", "̌A", "İ Å", "a<", "|ENDOFTEXT|>", "<|ENDOFTEXT|> Ab.Cd", "<|endoftext|>",
         "ΑΣ.A Σ", "T", "", "̈", "One.Two,J̌;Three"]


@pytest.mark.parametrize("texts", [TEXTS, TEXTS[::-1], *[[t] for t in TEXTS], [], [""]])
def test_ids_are_those_of_the_whole_text(texts):
    from churnscope.llm.queries import tokenizer_file
    from churnscope.llm.tokens import END, Encoder

    coder = Encoder(tokenizer_file())
    raw = [t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    ids, n = coder.encode(np.frombuffer(b"".join(raw), dtype=np.uint8), off)
    want = [[*coder.tokenizer.encode(t, add_special_tokens=False).ids, END] for t in texts]
    assert n.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]
