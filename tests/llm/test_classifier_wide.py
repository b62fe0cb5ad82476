"""Texts of very many word shapes keep their shape trigrams."""

import numpy as np

from orrery.llm import classifier


def trigrams(shapes):
    names, at = np.unique(shapes, return_inverse=True)
    got = {(int(a), int(b), int(c)) for a, b, c in zip(at[:-2], at[1:-1], at[2:], strict=True)}
    a, b, c = (names[np.array(x)] for x in zip(*got, strict=True))
    t = a * np.uint64(5) + b * np.uint64(3) + c + np.uint64(13)
    hashed = classifier._mixed(t + np.uint64(101 * 4))
    return set((hashed >> np.uint64(64 - classifier.BITS)).astype(np.int64).tolist())


def shaped(monkeypatch, n):
    """A text whose n words have shapes of their own."""
    rng = np.random.default_rng(3)
    words, shapes = rng.integers(1, 1 << 63, n, dtype=np.uint64), rng.permutation(np.arange(1, n + 1, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    monkeypatch.setattr(classifier, "_hash_words", lambda b: (words.copy(), shapes.copy()))
    return shapes


def test_shape_trigrams_of_a_very_wide_text(monkeypatch):
    shapes = shaped(monkeypatch, (1 << 20) + 5)
    monkeypatch.setattr(classifier, "BITS", 30)
    assert trigrams(shapes) <= set(classifier.features(b"x", 30).tolist())


def test_shape_trigrams_of_a_short_text():
    text = b"Ab c1 Ab c1 D-e Ab c1 D-e 7 x 7 x 7"
    _, shapes = classifier._hash_words(np.frombuffer(text, np.uint8))
    assert trigrams(shapes) <= set(classifier.features(text).tolist())
    assert len(classifier.features(b"one")) and len(classifier.features(b"one two"))
