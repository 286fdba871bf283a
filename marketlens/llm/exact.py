"""Exact deduplication by a tree merge of sorted digest runs.

Every partition sorts the digests of its own texts into a run, one row per
digest. The runs are then merged in rounds: with P = 2^b leaves and the P
digest ranges named by the first b bits, round r moves each row to the leaf
that differs from its present one only in the r-th group of address bits,
which are replaced by those of the digest's range. A round therefore exchanges
runs among ``fan_in`` leaves (``fan_in = 2`` is the plain binomial exchange),
and there are at least two.

Runs travel as blocks of sorted rows. A receiver takes the blocks by their
first digest and merges them by a heap over their cursors, so no row is sorted
again and only the blocks that overlap are open. Rows of equal digest become
one, after a second hash and the length of their texts are found equal: the row
that stays so far, with the number of copies. After the last round every digest
lies in its own range, merged from all leaves. A group of copies, of whatever
size, enters the exchange as one row per leaf.

The result returns down the tree: merged rows join the first runs (one row per
leaf and digest), and those join the documents of the leaf.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from marketlens.session import write_through

from .common import FILE, ROW, quoted, with_row_id

WHITE = r"[\x20\x09-\x0D]+"
BLOCK = 4096  # rows of a block
# places in a row of a run
DIGEST, NORM, CHECK, CODE_POINTS, ID, FILE_AT, ROW_AT, COPIES = range(8)


def _schema(id_type: T.DataType, *before: T.StructField) -> T.StructType:
    kinds = {"digest": T.BinaryType(), "n_norm": T.IntegerType(), "check": T.LongType(), "n_cp": T.IntegerType(), "id": id_type,
             "file": T.LongType(), "row": T.LongType(), "copies": T.LongType()}
    return T.StructType([*before, *[T.StructField(c, t) for c, t in kinds.items()]])


def _run_order() -> list:
    """Equal digests together, the row that stays first."""
    return [F.col("digest"), F.desc("n_cp"), F.asc_nulls_last("id"), F.col("file"), F.col("row")]


def _place(r: tuple) -> tuple:
    """Order of rows: by digest, the one that stays first."""
    return r[DIGEST], -r[CODE_POINTS], r[ID] is None, r[ID] if r[ID] is not None else 0, r[FILE_AT], r[ROW_AT]


def combined(rows: Iterable[tuple]) -> Iterator[tuple]:
    """One row per digest of rows in order: the first, with the copies of all.
    Equal digests of texts with another second hash or length are an error."""
    held = None
    for r in rows:
        if held is not None and held[DIGEST] == r[DIGEST]:
            if held[CHECK] != r[CHECK] or held[NORM] != r[NORM]:
                raise ValueError("equal digests of different texts")
            held = (*held[:COPIES], held[COPIES] + r[COPIES])
            continue
        if held is not None:
            yield held
        held = r
    if held is not None:
        yield held


def merged_rows(blocks: Iterable[tuple[bytes, bytes]]) -> Iterator[tuple]:
    """The rows of sorted blocks (first digest, rows), which come in order of
    their first digest, as one sorted sequence: a heap over the open blocks."""
    heap, n = [], 0
    blocks = iter(blocks)
    block = next(blocks, None)
    while heap or block is not None:
        while block is not None and (not heap or block[0] <= heap[0][0][DIGEST]):
            cursor = iter(zip(*(c.to_pylist() for c in pa.ipc.open_stream(block[1]).read_all().columns)))
            r = next(cursor)
            heapq.heappush(heap, (_place(r), n, r, cursor))
            n, block = n + 1, next(blocks, None)
        _, k, r, cursor = heap[0]
        yield r
        r = next(cursor, None)
        if r is None:
            heapq.heappop(heap)
        else:
            heapq.heapreplace(heap, (_place(r), k, r, cursor))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _blocks(runs: Iterable[tuple[int, Iterable[tuple]]], bits: int, mask: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """(target, first, rows): every run (leaf, sorted rows) parted by the leaf
    it goes to in a round, in blocks."""

    def block(target: int, rows: list[tuple]) -> pa.RecordBatch:
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, schema) as w:
            w.write_batch(_batch(rows, schema))
        return pa.RecordBatch.from_arrays([pa.array([target], pa.int32()), pa.array([rows[0][DIGEST]], pa.binary()),
                                           pa.array([out.getvalue().to_pybytes()], pa.binary())], names=["leaf", "first", "rows"])

    for leaf, rows in runs:
        held: dict[int, list[tuple]] = {}
        for r in rows:
            home = int.from_bytes(r[DIGEST][:4], "big") >> (32 - bits)
            mine = held.setdefault(leaf & ~mask | home & mask, [])
            mine.append(r)
            if len(mine) == BLOCK:
                yield block(leaf & ~mask | home & mask, mine)
                mine.clear()
        for target, mine in held.items():
            if mine:
                yield block(target, mine)


def _sorted_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """The runs in a stream of rows with their leaf: a run ends where the leaf
    changes or the digest falls. Long runs come in pieces, runs themselves."""
    leaf, rows = None, []
    for b in batches:
        for x, *r in zip(*(c.to_pylist() for c in b.columns)):
            if rows and (x != leaf or r[DIGEST] < rows[-1][DIGEST] or len(rows) >= 16 * BLOCK):
                yield leaf, rows
                rows = []
            leaf = x
            rows.append(tuple(r))
    if rows:
        yield leaf, rows


def _first_runs(schema: pa.Schema):
    """Rows sorted by leaf and digest to one row per leaf and digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        rows = ((leaf, r) for b in batches for leaf, *r in zip(*(c.to_pylist() for c in b.columns)))
        for leaf, mine in itertools.groupby(rows, key=lambda x: x[0]):
            for r in combined(tuple(r) for _, r in mine):
                held.append((leaf, *r))
                if len(held) == BLOCK:
                    yield _batch(held, schema)
                    held = []
        if held:
            yield _batch(held, schema)

    return run


def _send(bits: int, mask: int, schema: pa.Schema):
    return lambda batches: _blocks(_sorted_runs(batches), bits, mask, schema)


def _merge(bits: int, mask: int | None, schema: pa.Schema):
    """Merge the blocks that came to a leaf; part the run again for the next
    round, or return its rows after the last one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaf = []

        def came() -> Iterator[tuple[bytes, bytes]]:
            for b in batches:
                for x, first, rows in zip(*(c.to_pylist() for c in b.columns)):
                    leaf[:] = [x]
                    yield first, rows

        rows = combined(merged_rows(came()))
        first = next(rows, None)
        if first is None:
            return
        rows = itertools.chain([first], rows)
        if mask is not None:
            yield from _blocks([(leaf[0], rows)], bits, mask, schema)
            return
        while part := list(itertools.islice(rows, BLOCK)):
            yield _batch(part, schema)

    return run


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 4) -> DataFrame:
    """One row per row of ``docs``: (FILE, ROW, id, keep_id, group_size, kept,
    text_sha256).

    Texts are equal when identical without the characters of
    ``[\\x20\\x09-\\x0D]``; null text counts as empty. The row with the most code
    points stays, then the smallest id (a null id last), then, for repeated
    rows of one id, the first in file order: exactly one row of a group has
    ``kept``. An empty table gives an empty result; other columns of ``docs``
    are ignored.
    """
    spark = docs.sparkSession
    want = max(4, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bits = (want - 1).bit_length()
    leaves, step = 1 << bits, max(1, min((fan_in - 1).bit_length(), (bits + 1) // 2))
    id_type = docs.schema[id_col].dataType
    run_rows, leaf_rows = _schema(id_type), _schema(id_type, T.StructField("leaf", T.IntegerType()))
    arrow, leaf_arrow = to_arrow_schema(run_rows), to_arrow_schema(leaf_rows)

    norm = F.regexp_replace(F.coalesce(quoted(text_col), F.lit("")), WHITE, "")
    rows = with_row_id(docs).select(
        quoted(id_col).alias("id"), F.col(FILE).alias("file"), F.col(ROW).alias("row"),
        norm.alias("norm"), F.length(F.coalesce(quoted(text_col), F.lit(""))).alias("n_cp"))
    digests = write_through(rows.select(
        F.pmod(F.spark_partition_id(), F.lit(leaves)).alias("leaf"),
        F.unhex(F.sha2(F.col("norm"), 256)).alias("digest"), F.length("norm").alias("n_norm"), F.xxhash64("norm").alias("check"),
        "n_cp", "id", "file", "row"), "digests")

    first = (digests.withColumn("copies", F.lit(1).cast("long"))
             .sortWithinPartitions(F.col("leaf"), *_run_order()).mapInArrow(_first_runs(leaf_arrow), leaf_rows))
    first = write_through(first, "runs")
    masks = [((1 << min(step, bits - low)) - 1) << low for low in range(0, bits, step)]
    blocks = "leaf int, first binary, rows binary"
    runs = first.mapInArrow(_send(bits, masks[0], arrow), blocks)
    for after in [*masks[1:], None]:
        runs = (runs.repartitionById(leaves, F.col("leaf")).sortWithinPartitions("first")
                .mapInArrow(_merge(bits, after, arrow), run_rows if after is None else blocks))
    merged = runs.select("digest", F.col("id").alias("keep_id"), F.col("file").alias("keep_file"),
                         F.col("row").alias("keep_row"), F.col("copies").alias("group_size"))
    # down again: to the first runs of every leaf, then to the leaf's documents
    told = first.select("leaf", "digest").distinct().join(merged, "digest")
    return digests.join(told, ["leaf", "digest"]).select(
        F.col("file").alias(FILE), F.col("row").alias(ROW), "id", "keep_id", "group_size",
        ((F.col("file") == F.col("keep_file")) & (F.col("row") == F.col("keep_row"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    rows = with_row_id(docs)
    kept = exact_groups(rows, id_col, text_col).where("kept").select(FILE, ROW)
    return rows.join(kept.hint("shuffle_hash"), [FILE, ROW], "left_semi").select(*[quoted(c) for c in docs.columns])
