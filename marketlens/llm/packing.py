"""Sequence packing by minimum bin slack.

A document becomes pieces: full windows, and one rest shorter than a window.
Which rests share a window depends on their lengths alone, so the plan is made
on the histogram of lengths (at most ``window - 1`` numbers, whatever the
corpus): the longest remaining length opens a window, and a subset-sum dynamic
program over bitsets finds the multiset of remaining lengths that fills it
closest to capacity. The counts are traced back, and the pattern is used as
often as they allow. Pieces are numbered within their length (a count per
partition, a running sum over partitions), and the number of a piece alone
tells its window and offset.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlens.session import write_through

from .bpe import chunks, id_cache, library
from .common import begin, quoted

WINDOW = 1024
END_ID = 0


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset {length: copies}, within ``counts``, whose sum is closest
    to ``capacity`` from below. Of equal sums the one with more of the longer
    lengths, so that short ones stay for later windows."""
    mask = (1 << (capacity + 1)) - 1
    reach, steps = 1, []
    for length in sorted(x for x, n in counts.items() if n and x <= capacity):
        steps.append((length, reach))
        left, copies = min(counts[length], capacity // length), 1
        while left:  # 1, 2, 4, ... copies reach every number up to the count
            take = min(copies, left)
            reach |= (reach << (length * take)) & mask
            left -= take
            copies *= 2
        if reach >> capacity & 1:
            break
    rest, out = reach.bit_length() - 1, {}
    for length, before in reversed(steps):
        k = min(counts[length], rest // length)
        while not before >> (rest - k * length) & 1:
            k -= 1
        if k:
            out[length] = k
            rest -= k * length
    return out


def plan_windows(counts: dict[int, int], window: int = WINDOW) -> list[tuple[dict[int, int], int]]:
    """[(pattern, times)] that use up the histogram exactly."""
    left, plan = {x: n for x, n in counts.items() if n}, []
    while left:
        top = max(left)
        left[top] -= 1
        pattern = fullest(left, window - top)
        left[top] += 1
        pattern[top] = pattern.get(top, 0) + 1
        times = min(left[x] // k for x, k in pattern.items())
        plan.append((pattern, times))
        for x, k in pattern.items():
            left[x] -= k * times
            if not left[x]:
                del left[x]
    return plan


def _slots(counts: dict[int, int], window: int) -> list[tuple]:
    """(length, from_rank, to_rank, copies, sequence, offset): pieces of this
    length with these ranks lie, ``copies`` to a window, in the windows from
    ``sequence`` on."""
    full = counts.pop(window, 0)
    out = [(window, 0, full, 1, 0, 0)] if full else []
    used: dict[int, int] = {}
    sequence = full
    for pattern, times in plan_windows(counts, window):
        offset = 0
        for length in sorted(pattern, reverse=True):
            k, at = pattern[length], used.get(length, 0)
            out.append((length, at, at + k * times, k, sequence, offset))
            used[length] = at + k * times
            offset += k * length
        sequence += times
    return out


def _pieces(path: str, window: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin(__name__)
        part = TaskContext.get().partitionId()
        seen = np.zeros(window + 1, np.int64)
        known, end = id_cache(path), np.array([END_ID], "<u4").tobytes()
        for b in batches:
            ids, texts = b.column("id"), [t or "" for t in b.column("text").to_pylist()]
            for at in range(0, len(texts), 1000):
                parts = [chunks(t) for t in texts[at:at + 1000]]
                value = known.__getitem__
                heads = library(path).encode_batch([p[0] for p in parts], add_special_tokens=False)
                rows, start, length, crc, tokens, rank, raw = [], [], [], [], [], [], []
                for k, p in enumerate(parts):
                    doc = b"".join([np.array(heads[k].ids, "<u4").tobytes(), *map(value, p[1:]), end])
                    n = len(doc) // 4
                    for s in range(0, n, window):
                        piece = doc[4 * s:4 * (s + window)]
                        m = len(piece) // 4
                        rows.append(at + k)
                        start.append(s)
                        length.append(m)
                        crc.append(zlib.crc32(piece))
                        tokens.append(n)
                        rank.append(int(seen[m]))
                        seen[m] += 1
                        if with_ids:
                            raw.append(np.frombuffer(piece, "<u4").astype(np.int32))
                cols = {"id": ids.take(pa.array(rows, pa.int64())), "start": pa.array(start, pa.int64()),
                        "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()),
                        "doc_tokens": pa.array(tokens, pa.int64()), "part": pa.array([part] * len(rows), pa.int32()),
                        "rank": pa.array(rank, pa.int64())}
                if with_ids:
                    cols["ids"] = pa.array(raw, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))
    return run


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
         with_ids: bool = False) -> DataFrame:
    """One row per piece: (id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, and the token ids if ``with_ids``).

    A document is the token ids of its whole text and then id 0. Sequences
    are numbered from 0 and hold at most ``window`` ids; offsets within a
    sequence are gapless. Null text counts as empty (id 0 alone); repeated
    rows are packed each; an empty table gives no piece; other columns are
    ignored. To the driver goes the histogram of piece lengths: at most
    ``window`` rows.
    """
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text"))
    pieces = write_through(rows.mapInArrow(
        _pieces(path, window, with_ids),
        f"id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, part int, rank long"
        + ", ids array<int>" * with_ids), "pieces")

    by_part = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = by_part.select("part", "length", F.coalesce(before, F.lit(0)).alias("base"))
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = spark.createDataFrame(
        _slots(counts, window), "slot_length long, from_rank long, to_rank long, copies long, sequence long, first_offset long")

    at = pieces.join(base, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("base"))
    # bounded by the window alone: a few entries for each pattern, and every pattern uses up a length
    at = at.join(F.broadcast(slots), (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("from_rank"))
                 & (F.col("rank") < F.col("to_rank")))
    nth = F.col("rank") - F.col("from_rank")
    return at.select(
        "id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("sequence") + F.expr("(rank - from_rank) div copies")).alias("sequence_id"),
        (F.col("first_offset") + F.pmod(nth, F.col("copies")) * F.col("length")).alias("offset"),
        *(["ids"] if with_ids else []))
