"""SimHash near-duplicates with pigeonring filtering.

A 64-bit fingerprint is cut into five segments that form a ring. If two
fingerprints differ in at most t bits, some chain of consecutive segments
starts at which every prefix of l segments differs in at most l * t / 5 bits
(the pigeonring principle). For t = 4 the budgets are 0, 1, 2, 3 and 4: the
first segment is equal and the first two differ in one bit at most. So each
distinct fingerprint is filed, for every start, under its first segment and
each form of the second with one bit masked; only fingerprints that share such
a key are compared: first the longer prefixes of the chain, then the full
distance. Each key yields the edges of a spanning forest of its links, never
all pairs, and the links are joined to components by star contraction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.operators.joins import heavy_keys, salted_join
from marketlens.session import write_through

from .common import FILE, ROW, map_texts, quoted, with_row_id

SHINGLE = 4
MAX_BITS = 4
SEGMENTS = 5
BLOCK = 1024  # rows of a block when a large bucket is compared block by block

_BITS = [64 // SEGMENTS + (i < 64 % SEGMENTS) for i in range(SEGMENTS)]
_SHIFT = [sum(_BITS[:i]) for i in range(SEGMENTS)]


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Bit i is 1 if set in over half of the shingles' XXH64 (seed 42); 0 for
    a text without a word (or null)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    k = min(shingle, len(words))
    starts, stops = (ends - size)[:len(words) - k + 1].tolist(), ends[k - 1:].tolist()
    counts, done, digest = np.zeros(64, np.int64), 0, xxhash.xxh64_intdigest
    for at in range(0, len(starts), 1 << 16):  # bounded memory for very long texts
        h = np.fromiter((digest(whole[a:b], 42) for a, b in zip(starts[at:at + (1 << 16)], stops[at:at + (1 << 16)])), np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        done += len(h)
    return int(np.packbits(2 * counts > done, bitorder="little").view(np.uint64)[0])


def _fingerprints(shingle: int):
    def compute(texts: list) -> dict:
        return {"fp": pa.array(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))}
    return compute


def budgets(max_bits: int) -> list[int]:
    """Bits that the first l segments of a chain may differ in, l = 1..5."""
    return [l * max_bits // SEGMENTS for l in range(1, SEGMENTS + 1)]


def _segment(fps: np.ndarray, i: int) -> np.ndarray:
    i %= SEGMENTS
    return (fps >> np.uint64(_SHIFT[i])) & np.uint64((1 << _BITS[i]) - 1)


def _file_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, fp): for every start, the first segment and the second with
    one bit masked. Two fingerprints share a key of start i exactly if the
    chain from i keeps the budgets 0 and 1 of its first two segments."""
    for b in batches:
        fps = b.column("fp").to_numpy().view(np.uint64)
        for i in range(SEGMENTS):
            first, second = _segment(fps, i), _segment(fps, i + 1)
            for bit in range(_BITS[(i + 1) % SEGMENTS]):
                key = (((np.uint64(i) << np.uint64(4) | np.uint64(bit)) << np.uint64(13) | first) << np.uint64(13)
                       | (second & ~np.uint64(1 << bit)))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(fps.view(np.int64))], names=["bucket", "fp"])


def _linked(a: np.ndarray, b: np.ndarray, start: int, allowed: list[int]) -> np.ndarray:
    """Whether a and b, which share a key of ``start``, keep the budgets of the
    longer prefixes of the chain; the last one is the full distance."""
    diff = a ^ b
    ok = np.ones(diff.shape, bool)
    total = np.zeros(diff.shape, np.uint8)
    for l in range(SEGMENTS):
        total = total + np.bitwise_count(_segment(diff, start + l))
        if l >= 1:
            ok &= total <= allowed[l]
    return ok


def _roots(parent: np.ndarray, at: np.ndarray) -> np.ndarray:
    while True:
        up = parent[at]
        if (up == at).all():
            return at
        at = up


def _forest(members: np.ndarray, start: int, allowed: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Edges (row, root) of the components that the links among the members of
    one bucket form: fewer edges than members. Blocks whose rows are all joined
    already are not compared again, so a dense group costs about one comparison
    of each block with an earlier one."""
    n = len(members)
    parent = np.arange(n)
    for y in range(0, n, BLOCK):
        ys = np.arange(y, min(y + BLOCK, n))
        for x in [y, *range(0, y, BLOCK)]:
            xs = np.arange(x, min(x + BLOCK, n))
            both = np.concatenate([_roots(parent, xs), _roots(parent, ys)])
            if (both == both[0]).all():
                continue
            link = _linked(members[xs][:, None], members[ys][None, :], start, allowed)
            while True:
                rx, ry = _roots(parent, xs), _roots(parent, ys)
                low = np.where(link, rx[:, None], n).min(axis=0)
                low = np.minimum(low, ry)
                change = False
                for r, m in set(zip(ry.tolist(), low.tolist())):
                    r, m = int(_roots(parent, np.array([r]))[0]), int(_roots(parent, np.array([m]))[0])
                    if r != m:
                        parent[max(r, m)] = min(r, m)
                        change = True
                if not change:
                    rx, ry = _roots(parent, xs), _roots(parent, ys)
                    high = np.where(link, rx[:, None], -1).max(axis=0)
                    if ((high < 0) | (high == ry)).all():
                        break
                    for r, m in set(zip(ry.tolist(), high.tolist())):
                        if m >= 0:
                            r, m = int(_roots(parent, np.array([r]))[0]), int(_roots(parent, np.array([m]))[0])
                            parent[max(r, m)] = min(r, m)
    root = _roots(parent, np.arange(n))
    child = np.flatnonzero(root != np.arange(n))
    return child, root[child]


def _bucket_links(max_bits: int):
    allowed = budgets(max_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.zeros(0, np.int64), np.zeros(0, np.int64)]

        def links(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
            cut = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
            size = np.diff(cut)
            starts = (keys >> 30).astype(np.int64)  # bits 30 and up: the start of the chain
            a, b = [], []
            two = cut[:-1][size == 2]
            for i in range(SEGMENTS):
                at = two[starts[two] == i]
                ok = _linked(fps[at].view(np.uint64), fps[at + 1].view(np.uint64), i, allowed)
                a.append(fps[at[ok]])
                b.append(fps[at[ok] + 1])
            for at, n in zip(cut[:-1][size > 2].tolist(), size[size > 2].tolist()):
                m = fps[at:at + n]
                p, q = _forest(m.view(np.uint64), int(starts[at]), allowed)
                a.append(m[p])
                b.append(m[q])
            x, y = np.concatenate(a), np.concatenate(b)
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y))], names=["u", "v"])

        for b in batches:
            keys = np.concatenate([held[0], b.column("bucket").to_numpy()])
            fps = np.concatenate([held[1], b.column("fp").to_numpy()])
            last = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            if last:
                yield from links(keys[:last], fps[:last])
            held = [keys[last:], fps[last:]]
        if len(held[0]):
            yield from links(*held)

    return run


def links_of(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links (u > v) that join all distinct fingerprints (column fp) within
    ``max_bits`` (at most 9: a chain must begin with one equal segment) as the
    full set of links does."""
    if budgets(max_bits)[0] != 0 or budgets(max_bits)[1] > 1:
        raise ValueError("max_bits must leave budgets 0 and at most 1 to the first two segments")
    keys = fps.select("fp").mapInArrow(_file_keys, "bucket long, fp long")
    return (keys.repartition("bucket").sortWithinPartitions("bucket", "fp")
            .mapInArrow(_bucket_links(max_bits), "u long, v long").distinct())


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node of its component, for all nodes of
    ``links`` (u > v), by alternating large-star and small-star contraction.
    Each step is partial minima and joins, and is written, so that neither
    the lineage nor a lost executor's work grows with the steps. The links of a
    hub, a node with a large share of all links, are dealt over all tasks. No
    link gives no row; repeated links count once. Nodes are not null."""
    edges, before = write_through(links, "links"), None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = salted_join(both.where("v > u"), low, ["u"], hot=heavy_keys(both, ["u"]))
        large = write_through(large.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct(), "links")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = salted_join(large, low, ["u"])
        small = (joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low.select("u", F.col("m").alias("v"))).where("u > v").distinct())
        edges = write_through(small, "links")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            break
        before = state
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("label"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(roots)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                max_bits: int = MAX_BITS) -> DataFrame:
    """One row per row of ``docs``: (FILE, ROW, id, fp, label, component_id).

    ``fp`` is the fingerprint as a signed long; ``component_id`` the smallest
    id among all documents reachable over links of at most ``max_bits`` bits
    (null ids do not count; null if all are null). Null text and texts without
    a word have fingerprint zero, linked like any other. Rows of equal
    fingerprint enter the search as one; ``label`` is one fingerprint of the
    component. An empty table gives an empty result;
    other columns are ignored.
    """
    rows = with_row_id(docs).select(FILE, ROW, quoted(id_col).alias("id"), quoted(text_col).alias("text"))
    id_type = docs.schema[id_col].dataType.simpleString()
    prints = write_through(map_texts(rows, [FILE, ROW, "id"], _fingerprints(shingle),
                                     f"{FILE} long, {ROW} long, id {id_type}, fp long"), "fingerprints")
    nodes = write_through(prints.groupBy("fp").agg(F.min("id").alias("low")), "nodes")
    label = components(links_of(nodes, max_bits)).withColumnRenamed("node", "fp")
    named = nodes.join(label, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    named = write_through(named, "labels")
    lowest = named.groupBy("label").agg(F.min("low").alias("component_id"))
    class_of = named.join(lowest, "label").select("fp", "label", "component_id")
    return prints.join(class_of, "fp").select(FILE, ROW, "id", "fp", "label", "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each group
    the row whose id is the component's (of rows that repeat that id, or of a
    group without ids, the first in file order)."""
    rows = with_row_id(docs)
    groups = near_groups(rows, id_col, text_col, **how)
    first = (groups.where(F.col("id").eqNullSafe(F.col("component_id")))
             .groupBy("label").agg(F.min(F.struct(FILE, ROW)).alias("at")).select(F.col(f"at.{FILE}").alias(FILE), F.col(f"at.{ROW}").alias(ROW)))
    return rows.join(first.hint("shuffle_hash"), [FILE, ROW], "left_semi").select(*[quoted(c) for c in docs.columns])
