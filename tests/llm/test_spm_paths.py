"""Paths of all words are relaxed together; long words, windows and odd texts."""

import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from marketlens.llm import spm

PIECE = public_tokenizers.path("piece_bpe_32k.model")


class Asked(dict):
    n = 0

    def get(self, key, default=None):
        self.n += 1
        return super().get(key, default)


def made_up(n, letters, seed, size=9):
    r = random.Random(seed)
    return ["".join(r.choice(letters) for _ in range(r.randrange(1, size))) for _ in range(n)]


def test_pairs_are_not_looked_up_one_by_one():
    enc = spm.SuffixEncoder(PIECE)
    words = [spm.SPACE + w for w in made_up(4000, "etaoinshrdlu", 5)]
    first = enc.encode_words(words)
    enc.fits = Asked(enc.fits)
    assert enc.encode_words(words) == first
    assert enc.fits.n < 1000  # some pairs share a place


def test_odd_texts_of_a_batch_share_one_index(monkeypatch):
    calls, real = [], spm.SuffixEncoder._edges
    monkeypatch.setattr(spm.SuffixEncoder, "_edges", lambda self, cp, n: calls.append(n) or real(self, cp, n))
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    texts = ["  ".join(made_up(20, "abc ", s)) for s in range(30)]
    raw = spm.encode_batch(texts, PIECE)
    assert len(calls) == 1
    assert [np.frombuffer(r, "<i4").tolist() for r in raw] == [lib.encode(t) for t in texts]


@pytest.mark.parametrize("window", (1 << 18, 61, 7))
def test_long_words_and_windows(monkeypatch, window):
    monkeypatch.setattr(spm, "WINDOW", window)
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    texts = made_up(150, "abeé日😀\x00\x01-", 6) + made_up(4, "theandoŕ,", 7, 400) + ["a" * 200, "日本" * 90]
    got = spm.SuffixEncoder(PIECE).encode_words([spm.SPACE + t for t in texts])
    assert got == [lib.encode(t) for t in texts]
    assert spm.SuffixEncoder(PIECE).encode_words([]) == []
    assert spm.SuffixEncoder(PIECE).encode_words(["", "a", ""])[::2] == [[], []]


def test_parts_of_words():
    enc = spm.encoder(PIECE)
    parts, count = enc.parts([spm.SPACE + "the", "", "a\x00\x01b", "日"])
    assert "".join(parts) == spm.SPACE + "thea\x00\x01b日" and count[0] == 1 and count[1] == 0 and sum(count) == len(parts)
    assert enc.parts([]) == ([], [])
