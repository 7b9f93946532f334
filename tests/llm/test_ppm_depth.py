"""Contexts of five bytes are told apart."""

import numpy as np
import pytest


def test_the_fifth_byte_counts():
    from churnscope.llm.ppm import costs

    keys = np.array(sorted(int.from_bytes(g, "big") for g in (b"xabcdp", b"yabcdq")), dtype=np.uint64)
    pairs = np.zeros((256, 256))
    pairs[ord("d"), ord("p")] = pairs[ord("d"), ord("q")] = 1
    # one symbol seen once: half for it, half for the escape; contexts of four bytes have seen two symbols
    assert 10 ** costs(keys, np.ones(2), pairs) == pytest.approx([0.5, 0.5])
