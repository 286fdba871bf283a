"""Operators whose core is a function of one text or page, against brute force."""

import random

import numpy as np
import public_tokenizers
import pytest

from marketlens.llm import bpe, html_main, langid, packing, simhash, spm, token_count

BYTE = public_tokenizers.path("byte_bpe_50k.json")
PIECE = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", "a", " a", "a ", "  a  b\n\n c \t d", "it's we're they'll 'rx 'll I'd", "foo <|endoftext|> bar<|endoftext|>",
       "<|endoftext|", "12 34²½ a_b", "\x1c x\x1cy", "a b c", "日本語 テキスト", "é é", "😀😀 x😀", "a\n\n\nb  \n",
       "x" * 3000, "''😀\t²²", "word " * 500]
BITS = ["a", "th", "e", "'", "s", "re", "ll", " ", "  ", "\n", "\t", "<|endoftext|>", "1", "23", "!", "é", "日", " ", "_", "²",
        "\x1c", "😀", "'re", "n", "▁", "<0x0A>", "\x00", "ing"]


def mixed(n, longest, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(BITS) for _ in range(r.randint(0, longest))) for _ in range(n)]


def by_library(text):
    return len(bpe.library(BYTE).encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("text", ODD + mixed(100, 40))
def test_count_is_the_librarys(text):
    assert token_count.count_text(text, BYTE) == by_library(text)


def test_chunks_encode_independently():
    for text in ODD + mixed(300, 30):
        head, *rest = bpe.chunks(text)
        assert by_library(head) + sum(by_library(" " + c) for c in rest) == by_library(text)
        assert " ".join([head, *rest]) == text


def test_every_prefix_count_is_exact():
    known = bpe.prefix_bpe(BYTE)
    for text in [t for t in ODD if len(t) < 100] + mixed(300, 12):
        assert known.prefix_counts(text).tolist() == [by_library(text[:k]) for k in range(len(text) + 1)]


@pytest.mark.parametrize("budget", [0, 1, 3, 10])
def test_longest_prefix_within_a_budget(budget):
    for text in [t for t in ODD if len(t) < 100] + mixed(60, 20):
        fits = [k for k in range(len(text) + 1) if by_library(text[:k]) <= budget]
        assert token_count.longest_prefix(text, BYTE, budget) == max(fits)
    assert token_count.longest_prefix(None, BYTE, budget) == 0


def test_sentencepiece_encoding_and_decoding_are_the_librarys():
    import sentencepiece
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    texts = ODD + mixed(800, 14) + ["ab" * 2000 + " " * 40 + "c", "▁x", " ", "   "]
    for text, raw in zip(texts, spm.encode_batch(texts, PIECE)):
        ids = np.frombuffer(raw, "<i4")
        assert ids.tolist() == lib.encode(text), text[:60]
        assert spm.encoder(PIECE).decode(ids) == lib.decode(ids.tolist())
    assert spm.encode_batch([None, ""], PIECE) == [b"", b""]


def test_windows_of_the_suffix_index_join(monkeypatch):
    words = [spm.SPACE + w for w in "the quick brown foxes jumped over thirteen lazily sleeping dogs".split()] * 3
    whole = spm.encoder(PIECE).encode_words(words)
    monkeypatch.setattr(spm, "WINDOW", 7)
    assert spm.encoder(PIECE).encode_words(words) == whole


def brute_fullest(counts, capacity):
    best = 0
    items = [x for x, n in counts.items() for _ in range(n)]
    for mask in range(1 << len(items)):
        s = sum(x for i, x in enumerate(items) if mask >> i & 1)
        if best < s <= capacity:
            best = s
    return best


def test_fullest_window_is_closest_to_capacity():
    r = random.Random(3)
    for _ in range(60):
        counts: dict[int, int] = {}
        for _ in range(r.randint(0, 9)):
            x = r.randint(1, 40)
            counts[x] = counts.get(x, 0) + 1
        got = packing.fullest(counts, 64)
        assert all(got[x] <= counts[x] for x in got)
        assert sum(x * k for x, k in got.items()) == brute_fullest(counts, 64)


def test_plan_uses_the_histogram_exactly():
    r = random.Random(4)
    counts = {x: r.randint(1, 10 ** 9) for x in range(1, 1024)}
    plan = packing.plan_windows(counts)
    used: dict[int, int] = {}
    for pattern, times in plan:
        assert sum(x * k for x, k in pattern.items()) <= 1024
        for x, k in pattern.items():
            used[x] = used.get(x, 0) + k * times
    assert used == counts
    assert len(plan) < 5000  # the plan's size hangs on the window, not on the counts
    tokens = sum(x * n for x, n in counts.items())
    assert sum(t for _, t in plan) * 1024 - tokens < tokens // 50


def slow_fingerprint(text):
    import xxhash
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    k = min(4, len(words))
    hs = [xxhash.xxh64_intdigest(b" ".join(words[i:i + k]), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


@pytest.mark.parametrize("text", [None, "", " \n\t", "a", "A b c d", "É é Z z e f g h", "one two three four " * 50])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_pigeonring_keys_and_chain_lose_no_pair():
    """Any two fingerprints within 4 bits share a key whose chain keeps its
    budgets; none beyond 4 bits passes the last one."""
    import pyarrow as pa
    r = random.Random(5)
    allowed = simhash.budgets(4)
    assert allowed == [0, 1, 2, 3, 4]
    for _ in range(400):
        a = r.getrandbits(64)
        d = r.randint(0, 6)
        b = a
        for bit in r.sample(range(64), d):
            b ^= 1 << bit
        keys = []
        for x in (a, b):
            batch = pa.RecordBatch.from_arrays([pa.array(np.array([x], np.uint64).view(np.int64))], names=["fp"])
            keys.append({k for t in simhash._file_keys(iter([batch])) for k in t.column("bucket").to_pylist()})
        shared = keys[0] & keys[1]
        ok = any(simhash._linked(np.array([a], np.uint64), np.array([b], np.uint64), k >> 30, allowed)[0] for k in shared)
        assert ok == (d <= 4)


def test_bucket_forest_joins_what_links_join(monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 16)
    r = random.Random(6)
    for _ in range(10):
        base = r.getrandbits(13)  # first segment equal, some bits of the others set
        m = np.array(sorted({base | sum(1 << b for b in r.sample(range(26, 64), r.randint(0, 5))) for _ in range(120)}), np.uint64)
        link = simhash._linked(m[:, None], m[None, :], 0, simhash.budgets(4))

        def closure(edges):
            label = list(range(len(m)))
            for _ in range(len(m)):
                before = list(label)
                for i, j in edges:
                    label[i] = label[j] = min(label[i], label[j])
                if label == before:
                    return label
            return label

        child, root = simhash._forest(m, 0, simhash.budgets(4))
        assert len(child) < len(m)
        assert closure(list(zip(child.tolist(), root.tolist()))) == closure(list(zip(*map(lambda x: x.tolist(), np.nonzero(link)))))


def slow_code_length(samples, text, order, min_count, alphabet):
    """PPM by definition, one byte at a time, with dictionaries."""
    import math
    from collections import Counter, defaultdict
    pad = b"\n" * order
    seen = {g: defaultdict(Counter) for g in samples}
    both: Counter = Counter()
    for g, ts in samples.items():
        s = b"".join(pad + t for t in ts) + pad
        for i in range(order, len(s)):
            for k in range(order + 1):
                seen[g][s[i - k:i]][s[i]] += 1
            both[s[i - order:i]] += 1
    out = {}
    for g in samples:
        s, bits = pad + text, 0.0
        for i in range(order, len(s)):
            p = 1.0
            for k in range(order, -1, -1):
                c = s[i - k:i]
                if k == order and k and both[c] < min_count:
                    continue
                f = seen[g].get(c)
                if not f:
                    continue
                n, d = sum(f.values()), len(f)
                if s[i] in f:
                    p *= f[s[i]] / (n + d)
                    break
                p *= d / (n + d)
            else:
                p /= 256
            bits -= math.log2(p)
        out[g] = bits
    return out


def test_code_lengths_are_those_of_the_definition(monkeypatch):
    samples = {"xx": [b"the cat sat on the mat", b"the hat"], "yy": [b"la vie est belle", b"le chat et la vie"]}
    trees = langid.ContextTrees(samples, max_order=3, min_count=2)
    texts = [b"the chat", b"", b"la vie", b"\xff\xfe zz the", b"q", b"the cat " * 40]
    got = trees.code_lengths(texts)
    for t, row in zip(texts, got):
        want = slow_code_length(samples, t, 3, 2, trees.alphabet)
        assert row == pytest.approx([want[g] for g in trees.langs], rel=1e-5)
    monkeypatch.setattr(langid, "BLOCK", 16)  # texts longer than a block are scored in parts
    assert trees.code_lengths(texts) == pytest.approx(got, rel=1e-5)


@pytest.mark.parametrize("text,yes", [(None, False), ("", False), ("12 _ ½Ⅷ!", False), ("12a", True), ("Ⅷ é", True), ("日", True)])
def test_has_letter(text, yes):
    assert langid.has_letter(text) is yes


PAGE = """<!DOCTYPE html><html><head><title>T &amp; T</title><style>p{margin:0}</style><script>var t="</p>";</script></head>
<body><nav><ul><li><a href="/x">menu one</a></li></ul></nav><!-- <p>no</p> --><div class="ad">buy this now</div>
<article><h1>T &amp; T</h1><p><b>First  words\nof it.<br><p>Second&nbsp;part <i>in</i>side.</p><aside>see also that</aside>
<div class="cookie-notice">we use cookies</div><p>Third 1 &lt; 2.</p><form><input><p>name</p></form></article>
<div id="comments"><p>a reader says something long about this</p></div><footer>&copy; x all rights</footer>"""
TEXT = "T & T\n\nFirst words of it.\n\nSecond part inside.\n\nThird 1 < 2."


@pytest.mark.parametrize("weights", [html_main.learn([PAGE] * 3), html_main.learn([])])
def test_main_text(weights):
    assert html_main.main_text(PAGE, weights) == TEXT
    assert html_main.main_text(PAGE.replace("article>", "div>"), html_main.learn([PAGE])) == TEXT
    for empty in (None, "", "<html><body></body></html>", "<script>x"):
        assert html_main.main_text(empty, weights) == ""


def test_region_is_the_best_contiguous_run():
    r = random.Random(7)
    for _ in range(200):
        found = [(f"w:{r.randint(0, 5)}", "x", r.randint(1, 3), False) for _ in range(r.randint(0, 12))]
        weights = {f"w:{i}": r.choice([-2.0, -1.0, 0.5, 1.5]) for i in range(6)}
        a, b = html_main.region(found, weights)

        def score(i, j):
            return sum(weights[f] * n for f, _, n, _ in found[i:j])
        best = max((score(i, j) for i in range(len(found) + 1) for j in range(i, len(found) + 1)), default=0)
        assert score(a, b) == pytest.approx(max(best, 0))


def test_articles_nested_in_main_are_inside():
    words = "some words of a real article that goes on for a while"
    page = (f"<html><body><div><span>menu entry list</span></div><main><div><span>by line</span></div><article><h1>Title here</h1><p>{words}</p><p>{words}</p></article></main>"
            "<div><span>other foot words</span></div></body></html>")
    weights = html_main.learn([page] * 20)
    assert weights["w:p"] > 0 and weights["w:h1"] > 0 and weights["w:div"] < 0
    assert html_main.main_text(page, weights) == f"Title here\n\n{words}\n\n{words}"


@pytest.mark.parametrize("attributes", ['style="overflow:hidden"', 'data-path="/hidden/x"', 'title="the hidden truth"',
                                        'class="with-sidebar"', 'class="entry-header"', 'class="widget"', 'id="related"'])
def test_wrappers_of_the_article_stay(attributes):
    body = "<h1>Title here</h1><p>Some words of the text</p>"
    text = "Title here\n\nSome words of the text"
    assert html_main.main_text(f"<div {attributes}><article>{body}</article></div>", html_main.DEFAULT) == text


def test_hidden_and_named_parts_go():
    for part in ("<div hidden>x y</div>", '<div hidden="">x y</div>', '<div aria-hidden="true">x y</div>', "<div class='box Widget'>x y</div>",
                 '<div id="comments"><article>x y</article></div>'):
        page = f"<main><article><p>Some words</p></article>{part}<p>and more of them</p></main>"
        assert html_main.main_text(page, html_main.DEFAULT) == "Some words\n\nand more of them", part


@pytest.mark.parametrize("icon", ["<svg/>", '<svg class="i" />', "<math/>"])
def test_self_closed_icons_end_themselves(icon):
    page = f"<div>{icon}</div><article><p>Some {icon}words</p><svg><text>gone</text></svg></article>"
    assert html_main.main_text(page, html_main.DEFAULT) == "Some words"
