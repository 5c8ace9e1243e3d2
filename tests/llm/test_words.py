"""Word hashes do not depend on where a word stands, nor on how the bytes are cut."""

import numpy as np

from riskweave.llm import words


def hashes(text, monkeypatch=None, span=None):
    if span:
        monkeypatch.setattr(words, "SPAN", span)
        words._powers.cache_clear()
    data = np.frombuffer(text.encode(), np.uint8)
    found = words.find_words(data, np.array([0, len(data)]))
    out = words.word_hashes(data, found)
    if span:
        monkeypatch.undo()
        words._powers.cache_clear()
    return out


def test_short_words_hash_alike_for_any_span(monkeypatch):
    text = " ".join(f"w{k % 37} é{k}" for k in range(300))
    np.testing.assert_array_equal(hashes(text), hashes(text, monkeypatch, 16))
    assert len(set(hashes(text).tolist())) == len(set(text.split()))


def test_words_longer_than_the_span(monkeypatch):
    a, b = "x" * 100, "x" * 99 + "y"
    found = hashes(f"s {a} t {b} u {a} {a}x", monkeypatch, 16).tolist()
    assert found[1] == found[5] and len(set(found)) == 6
