"""Text primitives against plain Python."""

import numpy as np
import pytest

from quillstack.llm import _text

TEXTS = ["", None, "one", " a  b\tc\n", "Ä b\x0bc" * 3, "word " * 1000, "x" * 5000]


def test_word_hashes_agree_by_word(monkeypatch):
    whole, owner = _text.word_hashes(TEXTS)
    words = [[w for w in __import__("re").split("[ \t\n\x0b\x0c\r]+", t or "") if w] for t in TEXTS]
    assert np.bincount(owner, minlength=len(TEXTS)).tolist() == [len(w) for w in words]
    seen = {}
    for h, w in zip(whole.tolist(), [w for ws in words for w in ws]):
        assert seen.setdefault(w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), h) == h
    assert len(set(seen.values())) == len(seen)
    monkeypatch.setattr(_text, "CHUNK", 64)
    again, owner2 = _text.word_hashes(TEXTS)
    assert (again == whole).all() and (owner2 == owner).all()


@pytest.mark.parametrize("n,want", [(0, 0), (1, 1), (4, 1), (5, 1), (6, 2), (9, 5)])
def test_shingle_counts(n, want):
    words, owner = _text.word_hashes([" ".join(map(str, range(n)))])
    assert len(_text.shingles(words, owner, 5, 1)[0]) == want


def test_shingles_stay_in_their_text():
    a, b = "a b c d e f", "e f a b c d"
    words, owner = _text.word_hashes([a, b])
    both = _text.shingles(words, owner, 5, 2)
    alone = [_text.shingles(*_text.word_hashes([t]), 5, 1)[0] for t in (a, b)]
    assert both[0].tolist() == [*alone[0].tolist(), *alone[1].tolist()]
