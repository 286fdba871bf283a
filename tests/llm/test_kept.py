"""What a worker keeps, and the token counts of every prefix of a piece."""

import public_tokenizers

from marketlens.llm import bpe, common

BYTE = public_tokenizers.path("byte_bpe_50k.json")


def test_a_worker_drops_what_another_operator_kept(monkeypatch):
    monkeypatch.setattr(common, "_LAST", [""])
    monkeypatch.setattr(common, "_KEPT", [])
    made = []
    table = common.kept(2)(lambda path: made.append(path) or {path: 1})
    for operator in ("packing", "packing", "langid", "packing"):
        common.begin(operator)
        table("a")
    assert made == ["a"] * 3  # the second task of an operator finds it; after another operator it is made again


def test_the_tokenizers_are_dropped(monkeypatch):
    monkeypatch.setattr(common, "_LAST", ["packing"])
    bpe.id_cache(BYTE)["word"]
    common.begin("packing")
    assert bpe.id_cache.cache_info().currsize and bpe.prefix_bpe.cache_info().currsize
    common.begin("langid")
    assert not any(f.cache_info().currsize for f in (bpe.id_cache, bpe.prefix_bpe, bpe.count_cache, bpe.library))


def test_counts_of_prefixes_equal_merging_by_definition():
    model = bpe.PrefixBPE(BYTE)
    for word in (" internationalisation", " aaaaaaaaaa", "你好世界", " Straßenbahn", " 1234567", "'''", " x"):
        piece = word.encode()
        assert model.piece_counts(piece) == [len(model.merge(piece[:k])) for k in range(len(piece) + 1)]
        words = bpe.library(BYTE).model.tokenize("".join(next(c for c, b in bpe._byte_letters().items() if b == x) for x in piece))
        assert model.merge(piece) == [t.id for t in words]
