"""The tree of halves against the library's own encoding of whole texts."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from kawara.llm import bpe

C = bpe.coder(bpe.vocabulary())
PARTS = st.sampled_from(["the", "Ing ", ",", ".", "'s", "123", "<|endoftext|>", "<|startoftext|>", "<|end", " ", "\n\n", "é", "é", "́", "İ", "Σ", "ſ", " ", " ", "\x1c", "汉字", "🙂", "ab|", "###", "x" * 30, "ThE."])


def plain(text):
    return np.array(C.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@settings(max_examples=300, deadline=None)
@given(st.lists(PARTS, max_size=60), st.integers(1, 40))
def test_tree_equals_whole(parts, leaf):
    text = "".join(parts)
    old, bpe.LEAF = bpe.LEAF, leaf
    try:
        assert C.encode(text) == plain(text)
    finally:
        bpe.LEAF = old
    assert C.leaf(text) == plain(text)
    assert C.decode(plain(text)) == C.tokenizer.decode(C.tokenizer.encode(text, add_special_tokens=False).ids, skip_special_tokens=False)


def test_unsplit():
    rng = np.random.default_rng(1)
    for letters in ("ab", "abcdefgh", "theing", "aeé"):
        text = "".join(rng.choice(list(letters), 5000))
        old, bpe.LEAF = bpe.LEAF, 300
        try:
            assert C.encode(text) == plain(text)
        finally:
            bpe.LEAF = old
