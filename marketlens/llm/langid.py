"""Language identification by prediction by partial matching.

For every language, a context tree holds which bytes followed each context of
up to ``MAX_ORDER`` bytes in a labelled sample. A byte that a context has not
seen costs an escape to the next shorter context (method C: as many escape
counts as distinct followers), down to a uniform byte. The statistics stay
frozen while scoring, so a text's code length under a language is a sum over
its bytes, each looked up by the longest context in the trees; the shortest
code wins.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts, quoted

MAX_ORDER = 3
SAMPLE_ROWS = 250  # labelled rows a language is learned from, and
SAMPLE_TOTAL = 4000  # rows of all languages together, and
SAMPLE_CHARS = 4000  # at most so many characters of each: the bound of the sample
MIN_COUNT = 3  # a longest context seen less often in the sample is left to its suffix
MAX_LANGUAGES = 200  # the rarer ones are learned as one, under the name of the most frequent of them
MODEL_CELLS = 12_000_000  # contexts x bytes x languages of the trees: the bound of the broadcast model
FOREIGN = 2.5  # a text that costs so many times the usual bits per byte of its language is in none of them;
SHORT = 500  # one of fewer bytes tells too little for that
UNKNOWN = "und"
BLOCK = 1 << 20  # bytes scored at once

_PAD = b"\n" * MAX_ORDER
_LETTER = re.compile(r"[^\W\d_]")


def held_out(id_col: str = "doc_id") -> Column:
    """Rows kept from training: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(quoted(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def has_letter(text: str | None) -> bool:
    if not text:
        return False
    m = _LETTER.search(text)
    if m is None or m[0].isalpha():
        return m is not None
    return any(c.isalpha() for c in text)  # numerals such as a Roman one match the class too


class ContextTrees:
    """The trees of all languages over one set of contexts (states). Beyond
    ``MODEL_CELLS`` the contexts seen least often are left to their suffix."""

    def __init__(self, samples: dict[str, list[bytes]], max_order: int = MAX_ORDER, min_count: int = MIN_COUNT):
        self.langs = sorted(samples)
        texts = {g: b"".join(_PAD + t for t in samples[g]) + _PAD for g in self.langs}
        present = sorted(set().union(*map(set, texts.values()))) if texts else []
        self.alphabet = len(present) + 1  # the last symbol: any byte that the samples lack
        self.symbol = np.full(256, self.alphabet - 1, np.int64)
        self.symbol[present] = np.arange(len(present))
        a, n_lang = self.alphabet, len(self.langs)
        coded = [self.symbol[np.frombuffer(texts[g], np.uint8)] for g in self.langs]

        def context(s: np.ndarray, k: int) -> np.ndarray:
            """Code of the k symbols before each position from max_order on."""
            c = np.zeros(max(0, len(s) - max_order), np.int64)
            for i in range(k, 0, -1):
                c = c * a + s[max_order - i:len(s) - i]
            return c

        # order 0 has one state; P: (state, symbol, language)
        below = np.full((1, a, n_lang), 1 / 256)
        self.codes, tables = [], []
        room = MODEL_CELLS // max(1, a * n_lang) - 1
        for k in range(max_order + 1):
            pairs = [np.unique(context(s, k) * a + s[max_order:], return_counts=True) for s in coded]
            codes = np.unique(np.concatenate([p // a for p, _ in pairs])) if pairs else np.zeros(0, np.int64)
            if k and len(codes):
                total = np.zeros(len(codes), np.int64)
                for p, n in pairs:
                    np.add.at(total, np.searchsorted(codes, p // a), n)
                if k == max_order:
                    codes, total = codes[total >= min_count], total[total >= min_count]
                if len(codes) > room:
                    codes = np.sort(codes[np.lexsort((codes, -total))[:room]])
            if k == 0:
                codes = np.zeros(1, np.int64)
                suffix = np.zeros(1, np.int64)
            else:
                shorter = codes % a ** (k - 1)
                codes = codes[np.isin(shorter, self.codes[-1])]
                suffix = np.searchsorted(self.codes[-1], codes % a ** (k - 1))
                room -= len(codes)
            table = below[suffix].copy()
            for g, (p, n) in enumerate(pairs):
                at = np.searchsorted(codes, p // a)
                ok = (at < len(codes)) & (codes[np.minimum(at, len(codes) - 1)] == p // a) if len(codes) else np.zeros(len(p), bool)
                at, sym, n = at[ok], (p % a)[ok], n[ok]
                seen, kinds = np.zeros(len(codes)), np.zeros(len(codes))
                np.add.at(seen, at, n)
                np.add.at(kinds, at, 1)
                escape = np.where(seen > 0, kinds / np.maximum(seen + kinds, 1), 1.0)
                table[:, :, g] *= escape[:, None]
                table[at, sym, g] = n / (seen + kinds)[at]
            self.codes.append(codes)
            tables.append(table)
            below = table
        self.cost = -np.log2(np.concatenate(tables)).reshape(-1, n_lang).astype(np.float32) if n_lang else np.zeros((0, 0), np.float32)
        # state of every possible context of max_order symbols: its longest suffix in the trees
        first = np.cumsum([0] + [len(c) for c in self.codes])
        state = np.zeros(a ** max_order, np.int32)
        for k in range(1, max_order + 1):
            view = state.reshape(-1, a ** k)
            view[:, self.codes[k]] = (first[k] + np.arange(len(self.codes[k]))).astype(np.int32)
        self.state, self.max_order = state, max_order
        # usual bits per byte of each language: the median of its sample
        self.usual = np.zeros(n_lang)
        for g, name in enumerate(self.langs):
            some = [t for t in samples[name] if t][:SAMPLE_TOTAL // 100]
            if some:
                self.usual[g] = np.median(self.code_lengths(some)[:, g] / np.array([len(t) for t in some]))

    def _costs(self, symbols: np.ndarray) -> np.ndarray:
        """(position, language) code lengths of all symbols after the first max_order."""
        n, k = len(symbols), self.max_order
        c = np.zeros(n - k, np.int64)
        for i in range(k, 0, -1):
            c *= self.alphabet
            c += symbols[k - i:n - i]
        at = self.state[c].astype(np.int64)
        at *= self.alphabet
        at += symbols[k:]
        return self.cost.take(at, axis=0)

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """(text, language): bits of each whole text."""
        out = np.zeros((len(texts), len(self.langs)))
        group, size = [], 0
        for i, t in enumerate(texts):
            if len(t) > BLOCK:
                for at in range(0, len(t), BLOCK):
                    head = _PAD if at == 0 else t[at - self.max_order:at]
                    out[i] += self._costs(self.symbol[np.frombuffer(head + t[at:at + BLOCK], np.uint8)]).sum(0, dtype=np.float64)
                continue
            group.append(i)
            size += len(t)
            if size >= BLOCK:
                self._score(texts, group, out)
                group, size = [], 0
        self._score(texts, group, out)
        return out

    def _score(self, texts: list[bytes], group: list[int], out: np.ndarray) -> None:
        group = [i for i in group if texts[i]]
        if not group:
            return
        cost = self._costs(self.symbol[np.frombuffer(b"".join(_PAD + texts[i] for i in group), np.uint8)])
        size = np.array([len(texts[i]) for i in group])
        begin = np.cumsum(size + self.max_order) - size - self.max_order
        cuts = np.stack([begin, begin + size], axis=1).ravel()[:-1]  # text, padding, text, ...
        out[group] = np.add.reduceat(cost, cuts, axis=0, dtype=np.float64)[::2]


def sample_texts(docs: DataFrame, id_col: str, text_col: str, lang_col: str, rows: int = SAMPLE_ROWS,
                 chars: int = SAMPLE_CHARS) -> dict[str, list[bytes]]:
    """Up to ``rows`` labelled rows of each language that are not held out
    (fewer if there are many languages), ``chars`` characters of each at most:
    those with the smallest hash of id and text. Spark bounds them per language
    before they come to the driver, however often an id or a text repeats."""
    known = docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text"), quoted(lang_col).cast("string").alias("lang"))
    known = known.where("id is not null and text is not null and lang is not null").where(~held_out("id"))
    different = F.approx_count_distinct(F.xxhash64("id", "text")).alias("n")
    count = known.groupBy("lang").agg(different, F.count("*").alias("rows")).orderBy(F.desc("rows"), "lang")
    n = {r["lang"]: r["n"] for r in count.limit(MAX_LANGUAGES).collect()}
    if not n:
        return {}
    if len(n) == MAX_LANGUAGES:  # the last one stands for all rarer ones
        *own, last = n
        known = known.withColumn("lang", F.when(F.col("lang").isin(own), F.col("lang")).otherwise(last))
        n[last] = known.where(F.col("lang") == last).agg(different).first()["n"]
    rows = min(rows, max(1, SAMPLE_TOTAL // len(n)))
    pick = F.shiftrightunsigned(F.xxhash64("id", "text"), 33) / float(1 << 31)  # 0 to 1
    share = F.create_map(*[x for g, c in n.items() for x in (F.lit(g), F.lit(min(1.0, (1.8 * rows + 20) / c)))])
    some = known.where(pick <= share[F.col("lang")]).select("lang", "id", pick.alias("pick"), F.substring("text", 1, chars).alias("text"))
    order = Window.partitionBy("lang").orderBy("pick", F.col("id").cast("string"), "text")
    got = some.withColumn("i", F.row_number().over(order)).where(F.col("i") <= rows).collect()
    out: dict[str, list[bytes]] = {}
    for r in sorted(got, key=lambda r: (r["lang"], r["i"])):
        out.setdefault(r["lang"], []).append(r["text"].encode())
    return out


def _predict(model):
    def compute(texts: list) -> dict:
        trees: ContextTrees = model.value
        letters = [has_letter(t) for t in texts]
        raw = [t.encode() if ok else b"" for t, ok in zip(texts, letters)]
        lang, score, bits, usual = [UNKNOWN] * len(texts), *(np.zeros(len(texts)) for _ in range(3))
        if trees.langs:
            total = trees.code_lengths(raw)
            best = total.argmin(axis=1)
            low = total[np.arange(len(texts)), best]
            with np.errstate(under="ignore"):
                weight = 1 / np.exp2(np.maximum(low[:, None] - total, -1074)).sum(axis=1)
            for i, ok in enumerate(letters):
                if ok:
                    lang[i], score[i], bits[i] = trees.langs[best[i]], weight[i], low[i] / len(raw[i])
                    usual[i] = trees.usual[best[i]]
        return {"__llm_lang": pa.array(lang, pa.string()), "__llm_score": pa.array(score), "__llm_bits": pa.array(bits),
                "__llm_usual": pa.array(usual)}
    return compute


def fit_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> ContextTrees:
    return ContextTrees(sample_texts(docs, id_col, text_col, lang_col))


def predict_languages(docs: DataFrame, trees: ContextTrees, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns ``keep`` plus __llm_lang, __llm_score, __llm_bits (bits per byte)
    and __llm_usual (that of the language) of every row; no shuffle. The whole
    text counts. ``und`` (score 0) if it is null or has no letter, or if no
    language was learned; of equal code lengths the first language by name
    wins. The score is the language's share of the posterior under equal
    priors. Columns of ``docs`` may have any name but those."""
    model = docs.sparkSession.sparkContext.broadcast(trees)  # bounded by MODEL_CELLS
    names = {c: "text" if c == text_col else f"__keep{i}" for i, c in enumerate(keep)}
    rows = docs.select(*[quoted(c).alias(x) for c, x in ({text_col: "text"} | names).items()])
    found = [T.StructField("__llm_lang", T.StringType()), *[T.StructField(c, T.DoubleType()) for c in ("__llm_score", "__llm_bits", "__llm_usual")]]
    schema = T.StructType([T.StructField(x, docs.schema[c].dataType) for c, x in names.items()] + found)
    out = map_texts(rows, list(names.values()), _predict(model), schema)
    return out.select(*[F.col(x).alias(c) for c, x in names.items()], *[f.name for f in found])


def languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, held_out, lang_pred, score, bits_per_byte) of every row, learned
    from the rows of ``docs`` that have a language and are not held out. Null
    ids are not held out and not learned from; repeated rows are each
    predicted; an empty table gives an empty result."""
    trees = fit_languages(docs, id_col, text_col, lang_col)
    out = predict_languages(docs, trees, [id_col], text_col)
    return out.select(quoted(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col("__llm_lang").alias("lang_pred"),
                      F.col("__llm_score").alias("score"), F.col("__llm_bits").alias("bits_per_byte"))


def drop_unknown(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                 min_score: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text has a language
    (not ``und``) that holds at least ``min_score`` of the posterior, and that
    costs less than ``FOREIGN`` times the usual bits per byte of it: a text in a
    language that was not learned costs more (texts under ``SHORT`` bytes are
    not judged by that). Null and empty texts go; repeated
    rows are each judged; an empty table stays empty."""
    trees = fit_languages(docs, id_col, text_col, lang_col)
    out = predict_languages(docs, trees, docs.columns, text_col)
    own = (F.col("__llm_bits") < FOREIGN * F.col("__llm_usual")) | (F.octet_length(quoted(text_col)) < SHORT)
    return out.where((F.col("__llm_lang") != UNKNOWN) & (F.col("__llm_score") >= min_score) & own).select(*[quoted(c) for c in docs.columns])
