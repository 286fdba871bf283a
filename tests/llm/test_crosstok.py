"""Cross-tokenizer alignment against a version by definition."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from marketlens.llm import crosstok

BYTE = public_tokenizers.path("byte_bpe_50k.json")
PIECE = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, copies long, digest string, block int, pair string, n int, id string, `a.b` int"
EXTRA = (1, "d", 2, "p", 3, "i", 4)


@pytest.fixture(scope="module")
def both():
    a = Tokenizer.from_file(BYTE)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    letters = {}
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [x for x in range(256) if x not in plain]
    for x in plain:
        letters[chr(x)] = x
    for i, x in enumerate(rest):
        letters[chr(256 + i)] = x

    def encode(text):
        """[(id, bytes)] of both, or None."""
        if not text:
            return None
        want = (" " + text).encode()
        xs = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        ys = []
        for i in b.encode(text):
            p = b.id_to_piece(i)
            ys.append((i, bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()))
        return (xs, ys) if b"".join(x[1] for x in xs) == want == b"".join(y[1] for y in ys) else None

    return encode


def cut(xs, ys):
    """The groups, by walking over both to the next common end."""
    out, i, j = [], 0, 0
    while i < len(xs):
        g, h, n, m = [xs[i][0]], [ys[j][0]], len(xs[i][1]), len(ys[j][1])
        i, j = i + 1, j + 1
        while n != m:
            if n < m:
                g.append(xs[i][0])
                n += len(xs[i][1])
                i += 1
            else:
                h.append(ys[j][0])
                m += len(ys[j][1])
                j += 1
        out.append((g, h))
    return out


def brute(rows, encode):
    groups = []
    for _, text in rows:
        e = encode(text)
        groups.append(cut(*e) if e else [])
    linked = [Counter((a, b) for g, h in gs for a in g for b in h) for gs in groups]
    count = Counter(p for x in linked for p in x)
    best = {}
    for (a, _), n in count.items():
        best[a] = max(best.get(a, 0), n)
    out = []
    for (i, _), gs, x in zip(rows, groups, linked):
        s = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in gs)
        out.append((i, sum(len(g) for g, _ in gs), sum(len(h) for _, h in gs), len(gs), sum(x.values()),
                    sum(n for p, n in x.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in x.items()),
                    hashlib.sha256(s.encode()).hexdigest() if s else ""))
    return sorted(out, key=repr)


def table(spark, rows):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA).repartition(3)


def run(df, **how):
    return sorted((tuple(r) for r in crosstok.align(df, BYTE, PIECE, **how).collect()), key=repr)


ODD = [(1, None), (2, ""), (3, " "), (4, "   two  spaces   "), (5, "<|endoftext|> <s> </s> <unk> <0x41>"), (6, "日本語のテキスト 🙂🙂"), (7, "a▁b"),
       (8, "ﬁne ½ ２ Å"), (9, "\x00\x01 control"), (10, "tab\there\nline\r\nend"), (11, "=" * 3000 + "-" * 1777), (12, "aaaa" * 500),
       (None, "null id"), (13, "same text"), (14, "same text"), (14, "same text"), (15, "same text "), (16, "<0x41>"),
       (17, "déjà vu — naïve façade"), (18, "x" * 60000), (19, "word " * 9000)]


@pytest.mark.parametrize("block_pairs", [1, 50, crosstok.BLOCK_PAIRS])
def test_odd_texts(spark, both, block_pairs):
    assert run(table(spark, ODD), block_pairs=block_pairs) == brute(ODD, both)


def test_random_texts_many_copies(spark, both):
    r = np.random.default_rng(2)
    letters = list("abcdefgh éßñ ñ日本🙂\n\t.,-<>|") + [" the ", "ing ", " of"]
    rows = [(i, "".join(r.choice(letters, int(r.integers(1, 60))))) for i in range(150)] + [(200 + i, "the hot text of all") for i in range(120)]
    assert run(table(spark, rows)) == brute(rows, both)


def test_words_aligned_alone_are_aligned_as_in_their_text(both):
    """The remembered words against whole texts, with a small memory."""
    import duckdb
    texts = [r[0] for r in duckdb.sql("SELECT text FROM '/root/testdata/sf0.001/documents.parquet' WHERE text != ''").fetchall()]
    texts += [t.replace("e", "e  ", 3).replace("a", "\u3000a", 2) + " \n" for t in texts[:20]] + [t for _, t in ODD if t]
    pair, crosstok.WORDS = crosstok.Pair(BYTE, PIECE), 3000
    try:
        for at in range(0, len(texts), 7):
            for text, (counts, out, codes, weights) in zip(texts[at:at + 7], pair.align(texts[at:at + 7])):
                e = both(text)
                groups = cut(*e) if e else []
                linked = Counter(a << 32 | b for g, h in groups for a in g for b in h)
                assert out == ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
                assert counts.tolist() == [sum(len(g) for g, _ in groups), sum(len(h) for _, h in groups), len(groups), sum(linked.values())]
                assert dict(zip(codes.tolist(), weights.tolist())) == linked
    finally:
        crosstok.WORDS = 600_000


def test_empty_tables(spark):
    assert run(table(spark, ODD).limit(0)) == []
    assert run(table(spark, [(1, None), (2, "")])) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_wide_groups_are_products():
    r = np.random.default_rng(3)
    size_a, size_b = np.array([1, 40, 3, 1]), np.array([1, 30, 2, 90])
    a, b = r.integers(0, 9, size_a.sum()), r.integers(0, 7, size_b.sum())
    want, i, j = Counter(), 0, 0
    for x, y in zip(size_a, size_b):
        want.update((int(p) << 32) + int(q) for p in a[i:i + x] for q in b[j:j + y])
        i, j = i + x, j + y
    codes, weights = crosstok.links(a.astype(np.int64), b.astype(np.int64), size_a, size_b)
    assert dict(zip(codes.tolist(), weights.tolist())) == want and (np.diff(codes) > 0).all()
