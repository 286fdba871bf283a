"""Token counts of whole texts by prefix dynamic programming."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import chunks, count_cache, prefix_bpe
from .common import map_texts, quoted

LIMIT = 1024


def count_text(text: str | None, path: str) -> int:
    return prefix_bpe(path).count(text or "")


def longest_prefix(text: str | None, path: str, budget: int) -> int:
    """Code points of the longest prefix of at most ``budget`` tokens, read
    from the counts of the chunks and of the prefixes of one chunk."""
    parts = chunks(text or "")
    bpe, known = prefix_bpe(path), count_cache(path)
    return _cut(parts, [bpe.count(parts[0]), *(known[c] for c in parts[1:])], bpe, budget)


def _cut(parts: list[str], counts: list[int], bpe, budget: int) -> int:
    total = at = 0
    for k, (c, n) in enumerate(zip(parts, counts)):
        size = len(c) + (k > 0)
        if total + n > budget:
            inside = bpe.prefix_counts((" " if k else "") + c)
            fits = [i for i in range(size + 1) if total + inside[i] <= budget]
            return at + fits[-1]
        total, at = total + n, at + size
    return at


def _counts(path: str, limit: int):
    def compute(texts: list) -> dict:
        texts = [t or "" for t in texts]
        bpe, known = prefix_bpe(path), count_cache(path)
        n_tokens, fit_chars = [], []
        parts = [chunks(t) for t in texts]
        value = known.__getitem__
        for p in parts:
            first = bpe.count(p[0])
            n = first + sum(map(value, p[1:]))
            n_tokens.append(n)
            fit_chars.append(sum(map(len, p)) + len(p) - 1 if n <= limit else _cut(
                p, [first, *map(value, p[1:])], bpe, limit))
        return {"n_bytes": pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()),
                "n_tokens": pa.array(n_tokens, pa.int64()),
                "over_limit": pa.array([n > limit for n in n_tokens], pa.bool_()),
                "prefix_chars": pa.array(fit_chars, pa.int64())}
    return compute


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row per row of ``docs``: (id, n_bytes, n_tokens, over_limit,
    prefix_chars): the tokens of the whole text, whether they exceed ``limit``,
    and the code points of the longest prefix within it.

    Null text counts as empty (0 tokens); repeated rows are each counted; an
    empty table gives an empty result; other columns are ignored. No shuffle.
    """
    rows = docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text"))
    id_type = docs.schema[id_col].dataType.simpleString()
    return map_texts(rows, ["id"], _counts(path, limit),
                     f"id {id_type}, n_bytes long, n_tokens long, over_limit boolean, prefix_chars long")
