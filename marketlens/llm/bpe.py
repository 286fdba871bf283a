"""Byte-pair encoding by prefix dynamic programming.

The last token of the encoding of a prefix is the only token t that ends there
and fits the last token u of the encoding of the prefix before t; u and t fit
if the pair encodes to itself. So one left-to-right pass over a piece finds,
for every prefix, its last token and its exact token count, without ever
encoding a prefix again.

Texts are cut at single spaces between two other characters: there every
pre-tokenizer piece ends, so the chunks between encode independently, and a
chunk met before is looked up.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

import numpy as np
import regex

from .common import kept

# The pre-tokenizer pattern of the vocabulary, and its special string.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

# Latin letters and then marks other than an apostrophe: after a space these
# are a piece of letters and, if there are marks, a piece of marks.
_PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\[-`{-~]*)")
_RARE = re.compile(r"[^\S \n]")
_CUT = re.compile(r"(?<=\S) (?=\S)")
_ODD = re.compile(r" \s|\s |\A | \Z")
CACHE = 600_000  # chunks a worker remembers, and a sixth as many pieces
LONG = 64  # longer chunks are not remembered


def chunks(text: str) -> list[str]:
    """The text without its single inner spaces: chunk 0 stands as it is,
    every other chunk is preceded by one space."""
    odd = "  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " " or (
        _RARE.search(text) and _ODD.search(text))
    return _CUT.split(text) if odd else text.split(" ")


class ChunkCache(dict):
    """Value of each chunk that follows a space, made when first asked for.
    Chunks are remembered in two generations of half the size: when the young
    one is full it replaces the old one, so frequent chunks stay."""

    def __init__(self, make, size: int = CACHE):
        super().__init__()
        self.make, self.half, self.older = make, size // 2, {}

    def __missing__(self, chunk: str):
        got = self.older.get(chunk)
        if got is None:
            got = self.make(chunk)
        if len(chunk) <= LONG:
            if len(self) >= self.half:
                self.older = dict(self)
                self.clear()
            self[chunk] = got
        return got


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file:
    printable Latin-1 stands for itself, the rest for U+0100 upwards."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixBPE:
    """Exact token counts of prefixes under a byte-level BPE vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        vocab = {w: i for w, i in spec["model"]["vocab"].items() if w not in self.special}
        self.ids = {bytes(letters[c] for c in w): i for w, i in vocab.items()}
        self.bytes = {i: w for w, i in self.ids.items()}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        # every beginning of a token: its id if it is one, else -1
        self.begins = {w[:k]: -1 for w in self.ids for k in range(1, len(w))} | self.ids
        self.fits: dict[int, bool] = {}
        self.pattern = regex.compile(PATTERN)
        self.stop = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        # a special string that may lie inside a plain chunk forbids the short way
        self.plain = _PLAIN.fullmatch if not any(
            _PLAIN.fullmatch("x" + w.strip(" ")) for w in self.special) else lambda chunk: None

    def merge(self, piece: bytes) -> list[int]:
        """Encoding by definition: the best-ranked pair first, leftmost on ties."""
        out, merges = [self.ids[piece[i:i + 1]] for i in range(len(piece))], self.merges.get
        # the merge of each pair of neighbours; only those beside a merged pair change
        found = [merges(p) for p in zip(out, out[1:])]
        while True:
            best, at = None, -1
            for i, m in enumerate(found):
                if m is not None and (best is None or m[0] < best[0]):
                    best, at = m, i
            if best is None:
                return out
            out[at:at + 2] = [best[1]]
            del found[at]
            if at:
                found[at - 1] = merges((out[at - 1], out[at]))
            if at < len(found):
                found[at] = merges((out[at], out[at + 1]))

    def fit(self, u: int, t: int) -> bool:
        """Whether t may follow u; u = -1: whether t may begin a piece."""
        key = u * 65536 + t
        got = self.fits.get(key)
        if got is None:
            got = self.merge(self.bytes[t]) == [t] if u < 0 else (
                self.fit(-1, t) and self.merge(self.bytes[u] + self.bytes[t]) == [u, t])
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            self.fits[key] = got
        return got

    def piece_counts(self, piece: bytes) -> list[int]:
        """Token count of every prefix of one pre-tokenizer piece."""
        n, begins, fits, fit = len(piece), self.begins.get, self.fits, self.fit
        last, count = [-1] * (n + 1), [0] * (n + 1)
        for i in range(n):  # the last token of piece[:i] is known here
            u, size = last[i], count[i] + 1
            row = u * 65536
            for j in range(i + 1, n + 1):
                t = begins(piece[i:j])
                if t is None:
                    break
                if t >= 0 and not count[j]:
                    ok = fits.get(row + t)
                    if ok is None:
                        ok = fit(u, t)
                    if ok:
                        last[j], count[j] = t, size
        return count

    def pieces(self, text: str) -> list[str | int]:
        """Pre-tokenizer pieces; a special string is its id."""
        if self.stop is None or not (found := list(self.stop.finditer(text))):
            return self.pattern.findall(text)
        out, at = [], 0
        for m in found:
            out += self.pattern.findall(text[at:m.start()])
            out.append(self.special[m[0]])
            at = m.end()
        return out + self.pattern.findall(text[at:])

    @lru_cache(maxsize=200_000)  # noqa: B019 - one object per worker
    def piece_total(self, piece: str) -> int:
        return self.piece_counts(piece.encode("utf-8", "surrogatepass"))[-1]

    def count(self, text: str) -> int:
        return sum(1 if isinstance(p, int) else self.piece_total(p) for p in self.pieces(text))

    def prefix_counts(self, text: str) -> np.ndarray:
        """Exact token count of text[:k] for k = 0..len(text).

        Prefixes that end inside a piece read that piece's table. Three kinds
        of prefix end in other pieces than the whole text has: in white space
        (its run is one piece then), within a contraction and within a special
        string; their last pieces are taken by themselves."""
        out = np.zeros(len(text) + 1, np.int64)
        at = total = 0
        run_at, run_total = 0, 0  # where the present run of white space began, and the count before it
        segment = 0  # where the text after the last special string begins
        for p in self.pieces(text):
            if isinstance(p, int):
                word = next(w for w, i in self.special.items() if i == p)
                for k in range(1, len(word)):
                    out[at + k] = self.count(text[segment:at + k])+ out[segment]
                at, total = at + len(word), total + 1
                out[at] = total
                segment = run_at = at
                run_total = total
                continue
            table = self.piece_counts(p.encode("utf-8", "surrogatepass"))
            size = 0
            contraction = p in ("'re", "'ve", "'ll")
            for k, c in enumerate(p, 1):
                size += len(c.encode("utf-8", "surrogatepass"))
                out[at + k] = total + table[size]
                if c.isspace() and not "\x1c" <= c <= "\x1f":
                    if k == 1 and (at == 0 or not text[at - 1].isspace() or "\x1c" <= text[at - 1] <= "\x1f" or at == segment):
                        run_at, run_total = at, total
                    if at + k - run_at > 1:
                        out[at + k] = run_total + self.piece_total(text[run_at:at + k])
                elif contraction and k == 2:
                    out[at + k] = total + self.piece_total("'") + self.piece_total(c)
            at, total = at + len(p), total + table[-1]
            out[at] = total if not p[-1].isspace() else out[at]
        return out


@kept(4)
def prefix_bpe(path: str) -> PrefixBPE:
    return PrefixBPE(path)


@kept(4)
def library(path: str):
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


@kept(4)
def id_cache(path: str) -> ChunkCache:
    """Chunk -> its ids as little-endian 32-bit numbers, by the library's
    model. Only a piece that is not remembered is encoded."""
    bpe, tokenize = prefix_bpe(path), library(path).model.tokenize
    letter = {b: c for c, b in _byte_letters().items()}
    space = letter[32]
    known: dict[str | int, bytes] = {i: array("I", [i]).tobytes() for i in bpe.special.values()}
    fixed = dict(known)

    def encode(piece: str) -> bytes:
        word = piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(letter)
        return array("I", [t.id for t in tokenize(word)]).tobytes()

    def remembered(piece: str) -> bytes:
        got = known.get(piece)
        if got is None:
            got = encode(piece)
            if len(piece) <= LONG:
                if len(known) > CACHE // 6:
                    known.clear()
                    known.update(fixed)
                known[piece] = got
        return got

    def make(chunk: str) -> bytes:
        if m := bpe.plain(chunk):
            word, marks = m.groups()
            if marks:
                return cache[word] + remembered(marks)
            if word.isascii():
                return array("I", [t.id for t in tokenize(space + word)]).tobytes()
            return encode(" " + word)
        return b"".join(map(remembered, bpe.pieces(" " + chunk)))

    cache = ChunkCache(make)
    return cache


@kept(4)
def count_cache(path: str) -> ChunkCache:
    """Chunk -> its token count, by prefix dynamic programming."""
    bpe = prefix_bpe(path)

    def make(chunk: str) -> int:
        if m := bpe.plain(chunk):
            word, marks = m.groups()
            return cache[word] + bpe.piece_total(marks) if marks else bpe.piece_counts((" " + word).encode())[-1]
        return bpe.count(" " + chunk)

    cache = ChunkCache(make)
    return cache
