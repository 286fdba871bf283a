"""SentencePiece BPE encoding by suffix-array matching, and decoding.

The code points of a batch's unknown words are concatenated and their suffixes
sorted, as far as the longest piece. A binary search finds every vocabulary
piece's range of suffixes, hence all its occurrences: edges from one position
to another. The edges are sorted by position in their word and relaxed, those at
the same position of all words at once: an edge extends the best path to its
start if its piece fits after that path's last one, that is, if the two encode
to themselves. Exactly one edge into each position fits, so the path that
remains is the encoding by merges.
"""

from __future__ import annotations

from itertools import filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import LONG
from .common import kept, map_texts, quoted

SPACE = "▁"
WINDOW = 1 << 18  # positions indexed at once
KNOWN = 450_000  # words, word parts and pairs of tokens a worker remembers of each kind
_END = 0x110000  # stands between words; no code point
_BITS = 22  # a token in a pair: a piece's id, or _CHAR + code point of a character without a piece
_CHAR = 1 << 21
_UNMET = -2  # a position that no path has reached; -1: a word begins
_FEW = 64  # positions of a word relaxed with those of other words, and words worth it
_SLOTS = 20  # bits of the number of recent answers of ``fit`` looked up at once


class SuffixEncoder:
    def __init__(self, path: str):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.byte_id = {}
        self.score: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        raw = []
        for i in range(n):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(p[3:5], 16)] = i
                raw.append(bytes([int(p[3:5], 16)]))
            elif sp.is_control(i):
                raw.append(b"")
            elif sp.is_unknown(i):
                raw.append(" ⁇ ".encode())
            else:
                self.score[p], self.ids[p] = sp.get_score(i), i
                raw.append(p.replace(SPACE, " ").encode())
        self.unknown = sp.unk_id()
        self.text = {i: p for p, i in self.ids.items()}
        self.fits: dict[int, bool] = {}
        # neighbours that some piece holds; between others no merge ever crosses
        self.joined = np.array(sorted({(ord(a) << 21) | ord(b) for p in self.ids for a, b in zip(p, p[1:])}), np.int64)
        self.slot_key = np.full(1 << _SLOTS, np.iinfo(np.int64).min)
        self.slot_fits = np.zeros(1 << _SLOTS, bool)
        # pieces as rows of code points, in the order of their strings
        order = sorted(self.ids)
        self.longest = max(map(len, order))
        self.piece_id = np.array([self.ids[p] for p in order])
        self.piece_len = np.array([len(p) for p in order])
        self.piece_cp = np.full((len(order), self.longest), -1, np.int64)
        for k, p in enumerate(order):
            self.piece_cp[k, :len(p)] = list(map(ord, p))
        self.single = np.array(sorted(ord(p) for p in order if len(p) == 1))
        self.out_len = np.array([len(r) for r in raw])
        self.out_at = np.cumsum(self.out_len) - self.out_len
        self.out = np.frombuffer(b"".join(raw), np.uint8)

    def merge(self, text: str) -> list[str]:
        """Encoding by definition: merge the neighbours whose joined piece has
        the best score, leftmost on ties, until none is left."""
        out, score = list(text), self.score
        while True:
            best, at = None, -1
            for i in range(len(out) - 1):
                s = score.get(out[i] + out[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return out
            out[at:at + 2] = [out[at] + out[at + 1]]

    def _string(self, token: int) -> str:
        return chr(token - _CHAR) if token >= _CHAR else self.text[token]

    def fit(self, u: int, t: int) -> bool:
        """Whether token t may follow token u (-1: may begin a word)."""
        key = (u << _BITS) | t
        got = self.fits.get(key)
        if got is None:
            b = self._string(t)
            if u < 0:
                got = self.merge(b) == [b]
            else:
                a = self._string(u)
                got = self.fit(-1, t) and self.merge(a + b) == [a, b]
            if len(self.fits) > 2 * KNOWN:
                self.fits.clear()
            self.fits[key] = got
        return got

    def _edges(self, cp: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, token) of every occurrence of a piece that starts in
        cp[:n]. cp[n:] is what the last ones look ahead to."""
        size = len(cp)
        # suffixes in order of their first ``longest`` code points, by doubling
        _, rank = np.unique(cp, return_inverse=True)
        width = 1
        while width < self.longest:
            after = np.zeros(size, np.int64)
            after[:-width or None] = rank[width:] + 1 if width < size else 0
            _, rank = np.unique(rank * (size + 2) + after, return_inverse=True)
            width *= 2
        suffixes = np.argsort(rank, kind="stable")
        suffixes = suffixes[suffixes < n]
        # every piece's range of suffixes, one code point deeper at a time
        low = np.zeros(len(self.piece_id), np.int64)
        high = np.full(len(self.piece_id), len(suffixes))
        padded = np.concatenate([cp, np.full(self.longest, -2)])
        for depth in range(self.longest):
            live = np.flatnonzero((self.piece_len > depth) & (low < high))
            if not len(live):
                break
            want = self.piece_cp[live, depth]
            bounds = []
            for above in (0, 1):
                lo, hi = low[live].copy(), high[live].copy()
                while (open_ := lo < hi).any():
                    mid = (lo + hi) // 2
                    got = padded[suffixes[np.minimum(mid, len(suffixes) - 1)] + depth]
                    right = open_ & (got < want + above)
                    lo = np.where(right, mid + 1, lo)
                    hi = np.where(open_ & ~right, mid, hi)
                bounds.append(lo)
            low[live], high[live] = bounds
        found = np.maximum(high - low, 0)
        which = np.repeat(np.arange(len(found)), found)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(found) - found, found)
        start, length, token = suffixes[low[which] + nth], self.piece_len[which], self.piece_id[which]
        lone = np.flatnonzero(~np.isin(cp[:n], self.single) & (cp[:n] != _END))
        start = np.concatenate([start, lone])
        length = np.concatenate([length, np.ones(len(lone), np.int64)])
        token = np.concatenate([token, _CHAR + cp[lone]])
        return start, length, token

    def parts(self, words: list[str]) -> tuple[list[str], list[int]]:
        """The words cut wherever no piece holds the two characters, and how
        many parts each has: the parts encode independently and recur more
        often than words."""
        joined = "".join(words)
        ends = np.cumsum([len(w) for w in words], dtype=np.int64)
        cp = _code_points(joined)
        inner = np.ones(len(cp), bool)  # whether a position is inside its part
        if len(cp) > 1:
            pair = (cp[:-1] << 21) | cp[1:]
            at = np.minimum(np.searchsorted(self.joined, pair), max(len(self.joined) - 1, 0))
            inner[1:] = self.joined[at] == pair if len(self.joined) else False
        inner[0:1] = False
        inner[ends[ends < len(cp)]] = False
        begins = np.flatnonzero(~inner)
        upto = np.searchsorted(begins, ends)
        cuts = [*begins.tolist(), len(joined)]
        return [joined[a:b] for a, b in zip(cuts, cuts[1:])], np.diff(upto, prepend=0).tolist()

    def _fitting(self, key: np.ndarray) -> np.ndarray:
        """``fit`` of many pairs: the recent answers first."""
        slot = (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _SLOTS)
        out = self.slot_fits[slot]
        miss = np.flatnonzero(self.slot_key[slot] != key)
        if len(miss):
            asked, back = np.unique(key[miss], return_inverse=True)
            get = self.fits.get
            got = []
            for k in asked.tolist():
                ok = get(k)
                got.append(self.fit(k >> _BITS, k & ((1 << _BITS) - 1)) if ok is None else ok)
            out[miss] = np.array(got)[back]
            # of pairs that share a slot the same one is kept in both arrays
            last, which = np.unique(slot[miss], return_index=True)
            self.slot_key[last], self.slot_fits[last] = key[miss][which], out[miss][which]
        return out

    def _relax(self, edges: tuple, at: int, offset: np.ndarray, last: np.ndarray, back: np.ndarray) -> None:
        """Extend the paths (last token and its start, by position) along the
        edges of a window that begins at ``at``; ``offset`` is the place of
        every edge's start in its word."""
        start, size, token = edges
        start = start + at
        place = np.minimum(offset, _FEW).astype(np.uint8)
        order = np.argsort(place, kind="stable")
        bounds = np.searchsorted(place[order], np.arange(_FEW + 2))
        for a, b in zip(bounds[:_FEW].tolist(), bounds[1:].tolist()):
            e = order[a:b]
            e = e[last[start[e]] != _UNMET]
            if len(e):
                s, t = start[e], token[e]
                ok = self._fitting((last[s] << _BITS) | t)
                s, t, to = s[ok], t[ok], (s + size[e])[ok]
                last[to], back[to] = t, s
        rest = order[bounds[_FEW]:]  # the ends of long words, one by one
        rest = rest[np.argsort(start[rest], kind="stable")]
        last_, back_, fits, fit = memoryview(last), memoryview(back), self.fits, self.fit
        for k in range(0, len(rest), 1 << 16):
            some = rest[k:k + (1 << 16)]
            for s, n, t in zip(start[some].tolist(), size[some].tolist(), token[some].tolist()):
                u = last_[s]
                if u == _UNMET:
                    continue
                ok = fits.get((u << _BITS) | t)
                if ok is None:
                    ok = fit(u, t)
                if ok:
                    last_[s + n], back_[s + n] = t, s

    def encode_joined(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words (spaces already as U+2581) one after the other, and
        how many each word has."""
        cp = _code_points("".join(w + "\x00" for w in words))
        ends = np.cumsum([len(w) + 1 for w in words], dtype=np.int64) - 1
        cp[ends] = _END
        total = len(cp)
        begins = np.concatenate([[0], ends + 1])
        last, back = np.full(total + 1, _UNMET), np.zeros(total + 1, np.int64)
        last[begins] = -1
        place = np.arange(total) - np.repeat(begins[:-1], np.diff(begins))
        for at in range(0, total, WINDOW):
            n = min(WINDOW, total - at)
            edges = self._edges(cp[at:at + n + self.longest], n)
            self._relax(edges, at, place[at + edges[0]], last, back)
        # back along the paths, of all words at once and then of the longest few
        met = np.zeros(total + 1, bool)
        here = ends[ends > begins[:-1]]
        while len(here) > _FEW:
            met[here] = True
            here = back[here]
            here = here[last[here] != -1]
        last_, back_, met_ = memoryview(last), memoryview(back), memoryview(met)
        for k in here.tolist():
            while last_[k] != -1:
                met_[k] = True
                k = back_[k]
        at = np.flatnonzero(met)
        ids = last[at]
        size = np.ones(len(ids), np.int64)
        lone = ids >= _CHAR
        if lone.any():
            unknown = [[self.byte_id[x] for x in chr(t - _CHAR).encode("utf-8", "surrogatepass")] if self.byte_id else [self.unknown]
                       for t in ids[lone].tolist()]
            size[lone] = [len(x) for x in unknown]
            ids = np.repeat(ids, size)
            ids[np.repeat(lone, size)] = np.concatenate(unknown)
        count = np.bincount(np.searchsorted(ends, at), weights=size, minlength=len(words)).astype(np.int64)
        return ids.astype("<i4"), count

    def encode_raw(self, words: list[str]) -> list[bytes]:
        """Ids of each word as little-endian 32-bit numbers."""
        ids, count = self.encode_joined(words)
        raw, upto = ids.tobytes(), (4 * np.cumsum(count)).tolist()
        return [raw[a:b] for a, b in zip([0, *upto], upto)]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of each word (spaces already as U+2581)."""
        return [np.frombuffer(x, "<i4").tolist() for x in self.encode_raw(words)]

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids, without the space that encoding puts first."""
        if not len(ids):
            return ""
        size = self.out_len[ids]
        at = np.repeat(self.out_at[ids] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        text = self.out[at].tobytes().decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def words_of(text: str) -> list[str]:
    """The text, with the space put first that encoding adds, cut before every
    run of spaces: no piece holds a space after another character. Word 0 is
    not preceded by a space here; the others are."""
    return text.replace(SPACE, " ").split(" ")


def word_ids(parts: list[str]) -> list[str]:
    """Words as the encoder sees them: empty parts are spaces of a run."""
    out, run = [], 1
    for p in parts:
        if p == "":
            run += 1
        else:
            out.append(SPACE * run + p)
            run = 1
    return out + [SPACE * (run - 1)] if run > 1 else out


@kept(2)
def encoder(path: str) -> SuffixEncoder:
    return SuffixEncoder(path)


class WordCache(dict):
    """Values of chunks that follow a space. ``fill`` makes the values of all
    unknown chunks of a batch at once; the size stays bounded."""

    def __init__(self, make, size: int):
        super().__init__()
        self.make, self.size, self.long = make, size, []

    def fill(self, parts: list[list[str]]) -> None:
        if len(self) > self.size:
            self.clear()
        new: set[str] = set()
        for p in parts:
            new.update(p)
        new = list(filterfalse(self.__contains__, new))
        self.update(zip(new, self.make(new)))
        self.long = [c for c in new if len(c) > LONG]

    def trim(self) -> None:
        for c in self.long:
            del self[c]
        self.long = []


@kept(2)
def word_cache(path: str) -> WordCache:
    enc = encoder(path)
    known: dict[str, bytes] = {}

    def make(words: list[str]) -> list[bytes]:
        parts, count = enc.parts([SPACE + w for w in words])
        if len(known) > KNOWN:
            known.clear()
        new = list(set(parts).difference(known))
        known.update(zip(new, enc.encode_raw(new)))
        value, out, at = list(map(known.__getitem__, parts)), [], 0
        for n in count:
            out.append(value[at] if n == 1 else b"".join(value[at:at + n]))
            at += n
        for p in new:
            if len(p) > LONG:
                del known[p]
        return out
    return WordCache(make, KNOWN)


def encode_batch(texts: list, path: str) -> list[bytes]:
    """Ids of each text as little-endian 32-bit numbers; null and empty: none."""
    known, enc = word_cache(path), encoder(path)
    parts = [words_of(t) if t else [] for t in texts]
    # runs of spaces, or one at an end: their words are not remembered
    odd = {i: word_ids(p) for i, p in enumerate(parts) if p and "" in p}
    known.fill([p for i, p in enumerate(parts) if i not in odd])
    once = list({w for p in odd.values() for w in p})
    spaced = dict(zip(once, enc.encode_raw(once))).__getitem__
    value = known.__getitem__
    out = [b"".join(map(spaced, odd[i]) if i in odd else map(value, p)) for i, p in enumerate(parts)]
    known.trim()
    return out


def _as_lists(raw: list[bytes]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(r) // 4 for r in raw])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(raw), "<i4")))


def spm_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = False) -> DataFrame:
    """(id, ids array<int>) of every row: the encoding of the whole text; with
    ``decode`` also ``decoded``, the text that the ids give back.

    Null and empty texts have no ids; repeated rows are each encoded; an empty
    table gives an empty result; other columns are ignored. No shuffle.
    """
    def compute(texts: list) -> dict:
        raw = encode_batch(texts, path)
        out = {"ids": _as_lists(raw)}
        if decode:
            out["decoded"] = pa.array([encoder(path).decode(np.frombuffer(r, "<i4")) for r in raw], pa.string())
        return out

    rows = docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text"))
    return map_texts(rows, ["id"], compute, f"id {docs.schema[id_col].dataType.simpleString()}, ids array<int>"
                     + ", decoded string" * decode)


def spm_decode(encoded: DataFrame, path: str, keep: list[str]) -> DataFrame:
    """Columns ``keep`` and ``decoded``, the text of the column ``ids`` (null
    ids: the empty text)."""
    schema = ", ".join(f"{c} {encoded.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        enc = encoder(path)
        for b in batches:
            texts = [enc.decode(np.array(x, np.int64)) if x else "" for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(texts, pa.string())], names=[*keep, "decoded"])

    return encoded.mapInArrow(run, f"{schema}, decoded string")
