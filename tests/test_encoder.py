"""The hashing encoder against its plain form, and the hashes that it saves."""

import hashlib

import numpy as np

from lumenrank.functions import vectors


def plain_encode(texts, dimensions):
    import regex

    out = np.zeros((len(texts), dimensions))
    for row, text in enumerate(texts):
        for term in regex.findall(r"[\p{L}\p{N}]+", (text or "").lower()):
            h = int.from_bytes(hashlib.blake2b(term.encode(), digest_size=8).digest(), "little")
            out[row, h % dimensions] += 1 if h >> 63 else -1
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, size, where=size > 0, out=np.zeros_like(out))


def test_encoder_hashes_a_word_once(monkeypatch):
    texts = ["Word word, other", "", None, "...", "ÀÉ straße ½ x_y ×÷ µª", "İx Σας – “word”", "日本語 word", "word " * 1000, "".join(map(chr, range(1, 600)))]
    for n in (64, 1024):
        assert np.array_equal(vectors.HashingEncoder(n).encode(texts), plain_encode(texts, n))
    assert vectors.HashingEncoder().encode([]).shape == (0, 64) and vectors.HashingEncoder().encode(["", None]).shape == (2, 64)
    calls, own = [], hashlib.blake2b
    monkeypatch.setattr(hashlib, "blake2b", lambda *a, **k: calls.append(a) or own(*a, **k))
    vectors.HashingEncoder().encode(["word other word " * 1000] * 10)
    assert len(calls) <= 3  # each distinct one, and the nothing between two spaces
