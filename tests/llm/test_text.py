import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftframe.llm.text import WORD_PATTERN, cut_long, sliced, words_of

LOWER = {c: c + 32 for c in range(65, 91)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=8))
def test_words_are_those_of_the_pattern(texts):
    words = words_of([t.encode() for t in texts])
    for k, text in enumerate(texts):
        found = [
            words.data[words.starts[i] : words.ends[i]].tobytes().decode()
            for i in range(words.first[k], words.first[k + 1])
        ]
        assert found == re.findall(WORD_PATTERN, text.translate(LOWER))


def test_hashes_do_not_depend_on_the_place():
    long = ["a" * 300_000, "b c " * 100_000, "a" * 300_000, "c"]
    words = words_of([t.encode() for t in long])
    hashes = words.hashes()
    assert hashes[0] == hashes[words.first[2]]
    assert len(np.unique(hashes)) == 3
    assert hashes[words.first[3]] == hashes[words.first[1] + 1]


@pytest.mark.parametrize("most", [1, 10, 1000])
def test_slices_and_cuts_lose_nothing(most):
    texts = [b"", b"one two three", b"x" * 50, b" "]
    assert [t for part in sliced(texts, most) for t in part] == texts
    parts, owner = cut_long(texts, most)
    assert [b"".join(p for p, o in zip(parts, owner, strict=True) if o == k) for k in range(4)] == texts
