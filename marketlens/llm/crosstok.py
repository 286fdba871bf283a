"""Alignment of two tokenizers over a corpus, each distinct text once.

The rows are shuffled by their full text, so that copies become one text with
a multiplicity (combined before the shuffle: a text that a third of the rows
share is one row per task). Each distinct text is encoded by both tokenizers;
byte offsets where a token of either ends cut both into groups, and all tokens
of a group are linked. The pair counts of the corpus are sums of
multiplicities. Both tokenizers part a text at single spaces between words, so
a worker remembers how the words it met were aligned.

The way back from the counts to the texts goes by blocks of texts. A block is
closed when its texts hold ``BLOCK_PAIRS`` distinct pairs (counted per text),
which bounds what a task holds; the distinct pairs of a block meet their counts
in one join, and block and counts are cogrouped, so the pairs of a text never
travel one by one. At last the measures of a text join the rows by its digest.
"""

from __future__ import annotations

import hashlib
import os
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.operators.joins import heavy_groups, salted_join
from marketlens.session import write_through

from .bpe import LONG, chunks, prefix_bpe
from .common import quoted

BLOCK_PAIRS = 1 << 19
TEXTS = 200  # encoded at a time
WORDS = 600_000  # chunks of a text a worker remembers
SHORT = 32  # tokens up to which a chunk is aligned token by token
WIDE = 64  # links of a group from which its ids are counted before they are paired
ALIGNED = ("digest binary, copies long, block long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
           "pairs array<long>, links array<long>")
MEASURES = "digest binary, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class Pair:
    """Both tokenizers, and the bytes and the number of bytes of their ids."""

    def __init__(self, byte_path: str, piece_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(byte_path)
        self.a.encode_special_tokens = True  # special strings inside a text are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        known = prefix_bpe(byte_path)
        special = {i: w.encode() for w, i in known.special.items()}
        self.a_bytes = [special.get(i) or known.bytes.get(i, b"") for i in range(self.a.get_vocab_size())]
        self.b_bytes = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i)
                        else self.b.id_to_piece(i).replace("▁", " ").encode() for i in range(self.b.get_piece_size())]
        if max(len(self.a_bytes), len(self.b_bytes)) > 1 << 31:
            raise ValueError("ids of more than 31 bits")
        self.a_len, self.b_len = ([len(x) for x in t] for t in (self.a_bytes, self.b_bytes))
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        # no piece goes on over a space, so no merge of B crosses the cuts; A's pieces end there anyway
        pieces = map(self.b.id_to_piece, range(self.b.get_piece_size()))
        self.parts = (lambda t: [t]) if any(x != "▁" == y for p in pieces for x, y in zip(p, p[1:])) else chunks
        self.young, self.old = {}, {}  # aligned chunks, in two generations of half the size

    def encode(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        """Ids of both, and none for a text whose bytes either does not give back."""
        both = zip(self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False), self.b.encode(texts, num_threads=1))
        out = []
        for t, (x, b) in zip(texts, both):
            a, want = x.ids, (" " + t).encode()
            whole = t and b"".join(map(self.a_bytes.__getitem__, a)) == want and b"".join(map(self.b_bytes.__getitem__, b)) == want
            out.append((a, b) if whole else ([], []))
        return out

    def groups(self, a: list[int], b: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each side in every group."""
        ends_a, ends_b = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        at = np.flatnonzero(ends_b[np.minimum(np.searchsorted(ends_b, ends_a), len(ends_b) - 1)] == ends_a)
        other = np.searchsorted(ends_b, ends_a[at])
        return np.diff(at, prepend=-1), np.diff(other, prepend=-1)

    def _short(self, a: list[int], b: list[int]) -> tuple[int, str, list[int]]:
        """Groups, their text and the pair of every link, token by token."""
        a_len, b_len, out, codes, i, j, n = self.a_len, self.b_len, [], [], 0, 0, len(a)
        while i < n:
            x, y = a[i], b[j]
            gap = a_len[x] - b_len[y]
            i, j = i + 1, j + 1
            if not gap:
                out.append(f"{x}|{y}")
                codes.append(x << 32 | y)
                continue
            g, h = [x], [y]
            while gap:
                if gap < 0:
                    x = a[i]
                    g.append(x)
                    gap += a_len[x]
                    i += 1
                else:
                    y = b[j]
                    h.append(y)
                    gap -= b_len[y]
                    j += 1
            out.append(",".join(map(str, g)) + "|" + ",".join(map(str, h)))
            codes += [x << 32 | y for x in g for y in h]
        return len(out), ";".join(out), codes

    def _aligned(self, parts: list[str]) -> list[tuple | None]:
        """Per chunk: n_a, n_b, n_groups, n_links as bytes, the text of the
        groups, the pair of every link as bytes, and for long chunks instead
        the distinct pairs and their links. None if its bytes are not given back."""
        out = []
        for a, b in self.encode(parts):
            if not a:
                out.append(None)
            elif len(a) <= SHORT >= len(b):
                n_groups, text, codes = self._short(a, b)
                out.append((array("q", (len(a), len(b), n_groups, len(codes))).tobytes(), text, array("q", codes).tobytes(), None))
            else:
                size_a, size_b = self.groups(a, b)
                found = links(np.array(a, np.int64), np.array(b, np.int64), size_a, size_b)
                out.append((array("q", (len(a), len(b), len(size_a), int(found[1].sum()))).tobytes(), groups_text(a, b, size_a, size_b), b"", found))
        return out

    def align(self, texts: list[str]) -> list[tuple]:
        """Per text (counts, text of the groups, distinct pairs, their links)."""
        parts = [self.parts(t) for t in texts]
        wanted, young, old = set().union(*parts), self.young, self.old
        here, new = {}, []
        for c in wanted:
            got = young.get(c, young)
            if got is young and (got := old.get(c, young)) is young:
                new.append(c)
            else:
                here[c] = got
        here.update(zip(new, self._aligned(new)))
        young.update((c, x) for c, x in here.items() if len(c) <= LONG)
        if len(young) > WORDS // 2:
            self.young, self.old = {}, young
        out = []
        for p in parts:
            got = [here[c] for c in p]
            if None in got:
                out.append((np.zeros(4, np.int64), "", *[np.zeros(0, np.int64)] * 2))
                continue
            counts, texts_of, codes, long = zip(*got)
            counts = np.frombuffer(b"".join(counts), np.int64).reshape(-1, 4).sum(axis=0)
            long = [x for x in long if x]
            out.append((counts, ";".join(texts_of), *summed(np.frombuffer(b"".join(codes), np.int64), long)))
        return out


def summed(codes: np.ndarray, long: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs, ascending, with their links: one for each of ``codes``,
    and the counted ones of ``long``."""
    if not long:
        codes = np.sort(codes)
        first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
        return codes[first], np.diff(first, append=len(codes))
    weights = np.concatenate([np.ones(len(codes), np.int64), *[w for _, w in long]])
    codes = np.concatenate([codes, *[c for c, _ in long]])
    order = np.argsort(codes)
    codes = codes[order]
    first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    return codes[first], np.add.reduceat(weights[order], first)


@lru_cache(maxsize=2)
def pair_of(byte_path: str, piece_path: str) -> Pair:
    return Pair(byte_path, piece_path)


def links(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct linked id pairs (a << 32 | b, ascending) and their links.
    Groups with many links have their ids counted first, so that repeats are
    products and not rows."""
    product = size_a * size_b
    start_a, start_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b
    narrow = product <= WIDE
    p = product[narrow]
    k = np.arange(p.sum()) - np.repeat(np.cumsum(p) - p, p)  # number of a link within its group
    width = np.repeat(size_b[narrow], p)
    codes = [a[np.repeat(start_a[narrow], p) + k // width] << 32 | b[np.repeat(start_b[narrow], p) + k % width]]
    weights = [np.ones(len(k), np.int64)]
    for g in np.flatnonzero(~narrow):
        x, nx = np.unique(a[start_a[g]:start_a[g] + size_a[g]], return_counts=True)
        y, ny = np.unique(b[start_b[g]:start_b[g] + size_b[g]], return_counts=True)
        codes.append((x[:, None] << 32 | y[None, :]).ravel())
        weights.append((nx[:, None] * ny[None, :]).ravel())
    code, weight = np.concatenate(codes), np.concatenate(weights)
    order = np.argsort(code, kind="stable")
    code = code[order]
    first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1]))) if len(code) else np.zeros(0, np.int64)
    return code[first], np.add.reduceat(weight[order], first) if len(code) else np.zeros(0, np.int64)


def groups_text(a: list[int], b: list[int], size_a: np.ndarray, size_b: np.ndarray) -> str:
    """``a1,a2|b1;a3|b2,b3``: decimal ids in order."""
    out, i, j = [], 0, 0
    for x, y in zip(size_a.tolist(), size_b.tolist()):
        out.append(",".join(map(str, a[i:i + x])) + "|" + ",".join(map(str, b[j:j + y])))
        i, j = i + x, j + y
    return ";".join(out)


def _align(byte_path: str, piece_path: str, block_pairs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, part = pair_of(byte_path, piece_path), TaskContext.get().partitionId()
        block, held = part << 32, 0
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS):
                rows = whole.slice(at, TEXTS)
                cols = {c: [] for c in ("block", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "links")}
                for counts, text, codes, weights in pair.align(rows.column("text").to_pylist()):
                    sha = hashlib.sha256(text.encode()).hexdigest() if text else ""
                    if held and held + len(codes) > block_pairs:
                        block, held = block + 1, 0
                    held += len(codes)
                    for c, v in zip(cols, (block, *counts.tolist(), sha, codes, weights)):
                        cols[c].append(v)
                many = pa.list_(pa.int64())
                types = [pa.int64()] * 5 + [pa.string(), many, many]
                yield pa.RecordBatch.from_arrays(
                    [rows.column("digest"), rows.column("copies"), *[pa.array(v, t) for v, t in zip(cols.values(), types)]],
                    names=["digest", "copies", *cols])

    return run


def _measure(texts: pa.Table, counts: pa.Table) -> pa.Table:
    """The sums of a block's texts over its pairs' counts."""
    order = np.argsort(counts["pair"].to_numpy())
    known, count, best = (counts[c].to_numpy()[order] for c in ("pair", "n", "best"))
    at = np.searchsorted(known, pc.list_flatten(texts["pairs"]).to_numpy())
    weight = pc.list_flatten(texts["links"]).to_numpy()
    size = pc.list_value_length(texts["pairs"]).to_numpy()
    ends = np.cumsum(size)

    def sums(v: np.ndarray) -> np.ndarray:
        run = np.concatenate(([0], np.cumsum(v)))
        return run[ends] - run[ends - size]

    n_best, total = sums(weight * (count[at] == best[at])), sums(weight * count[at])
    cols = {c: texts[c] for c in ("digest", "n_a", "n_b", "n_groups", "n_links")}
    cols |= {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(total, pa.int64()), "groups_sha256": texts["groups_sha256"]}
    return pa.table(cols)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(block, pair, n, best): for the pairs of each block the number of rows
    whose text holds the pair linked, and the highest such number among the
    pairs with the same first id."""
    held = write_through(aligned.select("block", "copies", F.explode("pairs").alias("pair")).groupBy("block", "pair").agg(
        F.sum("copies").alias("n")), "block-pairs")
    counts = write_through(held.groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    first = F.shiftright("pair", 32)
    # one row per id of the first vocabulary: the vocabulary bounds the broadcast
    best = counts.groupBy(first.alias("a")).agg(F.max("n").alias("best"))
    counts = counts.withColumn("a", first).join(F.broadcast(best), "a").drop("a")
    return held.select("block", "pair").join(counts, "pair")


def align(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text",
          block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """One row per row of ``docs``: (id, n_a, n_b, n_groups, n_links, n_best,
    count_sum, groups_sha256).

    A is the byte-level vocabulary, which reads a space and the text; B the
    piece model, which reads the text and puts a space before it itself.
    A null or empty text, and one whose bytes a tokenizer does not give back
    (normalised or foreign characters), has no tokens: zeros and an empty
    string. ``count_sum`` sums over the links how many rows of ``docs`` hold
    the pair linked; ``n_best`` counts the links whose pair is the most
    frequent of its A id, ties included. Repeated rows count as rows of their
    own; a null id is kept; an empty table gives an empty result; other columns
    are ignored."""
    text = quoted(text_col)
    digest = F.unhex(F.sha2(F.col("text"), 256)).alias("digest")
    texts = docs.select(text.alias("text")).where("text != ''").groupBy("text").agg(F.count("*").alias("copies"))
    aligned = write_through(texts.select("text", digest, "copies").mapInArrow(_align(byte_path, piece_path, block_pairs), ALIGNED), "aligned")
    counts = pair_counts(aligned)
    measures = aligned.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(_measure, MEASURES)
    rows = docs.select(quoted(id_col).alias("id"), F.when(text != "", text).alias("text")).select("id", digest)
    told = salted_join(rows, measures, ["digest"], "left", hot=heavy_groups(aligned, ["digest"], "copies"))
    sums = [c for c in measures.columns if c not in ("digest", "groups_sha256")]
    return told.select("id", *[F.coalesce(c, F.lit(0)).alias(c) for c in sums], F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
