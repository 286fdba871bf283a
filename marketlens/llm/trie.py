"""Prefix trie of conversations, with subtree totals by depth bands.

A node is a distinct sequence of first turns; its key is a digest of that
sequence, and the conversations that begin with it are its members.

Keys. The digests of at most ``BAND`` consecutive turns are joined per
conversation; the blocks of a band, one digest each, form a shorter sequence
that is treated the same way, and the key of a prefix is made of the key of the
bands before it and of its turns in the last band. A conversation of any length
so takes logarithmically many rounds, and no group holds more than ``BAND``
turns of it.

Totals. Bands are cut at depths that are multiples of ``BAND``. Every node
explodes to its ancestors within its own band, which gives each node the total
of its subtree inside the band. The band roots form a trie of their own, whose
totals are completed by the same rollup one level up; the completed total of a
band root is then handed to its ancestors in the band above it, again an
explosion of at most ``BAND`` rows. All sums are partial aggregates, so a node
that is an ancestor of everything is no hot key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.operators.joins import heavy_groups, salted_join
from marketlens.operators.windows import numbered
from marketlens.session import write_through

from .common import FILE, ROW, quoted, with_row_id
from .lines import WORD

BAND = 4
GROUP = 20  # conversations that share the opening turns of their first one
OPENINGS = 4
CHUNK = 1 << 16  # ids joined in one piece before the digest is taken
ROOT = bytes(32)


def _sha(x: Column) -> Column:
    return F.unhex(F.sha2(x, 256))


def turn_rows(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
              text_col: str = "text") -> DataFrame:
    """One row per row of ``turns``: (conv, pos, digest, words), the turns of a
    conversation numbered from 1 by turn (null first). Null role or text is
    empty; of rows with one turn number, those with the smaller digest of role
    and text come first, so ties and repeated rows have one order and are all
    kept. A null id is a conversation of its own. Texts are read where they
    lie and do not move."""
    role, text = (F.coalesce(quoted(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = with_row_id(turns).select(
        quoted(id_col).alias("conv"), quoted(turn_col).alias("turn"),
        _sha(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)).alias("digest"),
        F.size(F.regexp_extract_all(text, F.lit(WORD + "+"), F.lit(0))).cast("long").alias("words"), FILE, ROW)
    return numbered(rows, "conv", ["turn", "digest", FILE, ROW], "pos").select("conv", "pos", "digest", "words")


def spliced(rows: DataFrame, group: int = GROUP, openings: int = OPENINGS) -> DataFrame:
    """Every conversation rebuilt: with h = crc32(id) % ``openings``, the
    first h turns of conversation id - id % ``group`` (fewer if it is shorter,
    none if it is absent), then its own turns after its first h. Returns (conv,
    pos, digest, words, last), and (conv, 0, null, 0, last) for every
    conversation: ``last`` marks where it ends. A null id has h = 0. Ids are
    integers. A borrowed turn meets at most ``group`` conversations."""
    rows = write_through(rows, "turns")
    convs = write_through(rows.groupBy("conv").agg(F.count("*").alias("n")), "conversations")
    h = F.coalesce(F.crc32(F.col("conv").cast("string").cast("binary")) % openings, F.lit(0))
    convs = convs.withColumn("h", h).withColumn("donor", F.col("conv") - F.col("conv") % group)
    given = F.least(F.col("h"), F.coalesce("donor_n", F.lit(0)))
    plan = convs.join(convs.select(F.col("conv").alias("donor"), F.col("n").alias("donor_n")), "donor", "left").select(
        "conv", "donor", "n", "h", given.alias("given"))
    plan = write_through(plan.withColumn("length", F.col("given") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "splices")
    starts = plan.select("conv", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("binary").alias("digest"),
                         F.lit(0).cast("long").alias("words"), (F.col("length") == 0).alias("last"))
    heads = rows.where(F.col("pos") < openings).withColumnRenamed("conv", "donor")
    borrowed = plan.select("donor", F.col("conv").alias("to"), "given", "length").join(heads, "donor").where("pos <= given").select(
        F.col("to").alias("conv"), "pos", "digest", "words", (F.col("pos") == F.col("length")).alias("last"))
    # the null id is spliced with nothing, and would not meet its own row in a join
    known = plan.where("conv is not null")
    own = salted_join(rows.where("conv is not null"), known.select("conv", "h", "given", "length"), ["conv"],
                      hot=heavy_groups(known, ["conv"], "n")).where("pos > h")
    at = F.col("given") + F.col("pos") - F.col("h")
    own = own.select("conv", at.alias("pos"), "digest", "words", (at == F.col("length")).alias("last"))
    no_id = rows.where("conv is null").crossJoin(F.broadcast(plan.where("conv is null").select("length"))).select(
        "conv", "pos", "digest", "words", (F.col("pos") == F.col("length")).alias("last"))
    return starts.unionByName(borrowed).unionByName(own).unionByName(no_id)


def _prefix_keys(seq: DataFrame) -> DataFrame:
    """(conv, pos, key) for a sequence (conv, pos from 1, digest)."""
    band = F.floor((F.col("pos") - 1) / BAND)
    bands = seq.groupBy("conv", band.alias("band")).agg(F.sort_array(F.collect_list(F.struct("pos", "digest"))).alias("t"))
    prefix = F.transform("t", lambda x, i: F.struct(x["pos"].alias("pos"), _sha(F.aggregate(
        F.slice("t", 1, i + 1), F.lit(b""), lambda a, y: F.concat(a, y["digest"]))).alias("inside")))
    bands = write_through(bands.select("conv", "band", prefix.alias("t")), "bands")
    key = _sha(F.concat(F.col("base"), F.col("x.inside"))).alias("key")
    if not bands.agg(F.max("band")).first()[0]:
        return bands.withColumn("base", F.lit(ROOT)).select("conv", "base", F.explode("t").alias("x")).select("conv", "x.pos", key)
    blocks = bands.where(F.size("t") == BAND).select("conv", (F.col("band") + 1).alias("pos"), F.get("t", F.lit(BAND - 1))["inside"].alias("digest"))
    base = _prefix_keys(blocks).select(F.col("conv").alias("of"), F.col("pos").alias("band"), F.col("key").alias("base"))
    j = bands.join(base, (bands["band"] == base["band"]) & bands["conv"].eqNullSafe(base["of"]), "left")
    return j.select("conv", F.coalesce("base", F.lit(ROOT)).alias("base"), F.explode("t").alias("x")).select("conv", "x.pos", key)


def _ancestors(rows: DataFrame) -> DataFrame:
    """(conv, depth, key, up) for the rows (conv, depth, key) below depth 0:
    ``up`` holds the keys above, from the band root down to the parent. A band
    root has those of the band that ends with it."""
    depth = F.col("depth")
    both = F.when((depth > 0) & (depth % BAND == 0), F.array(F.floor(depth / BAND) - 1, F.floor(depth / BAND))).otherwise(
        F.array(F.floor(depth / BAND)))
    path = rows.withColumn("band", F.explode(both)).groupBy("conv", "band").agg(
        F.sort_array(F.collect_list(F.struct("depth", "key"))).alias("p"))
    steps = F.transform("p", lambda x, i: F.struct(x["depth"].alias("depth"), x["key"].alias("key"),
                                                   F.transform(F.slice("p", 1, i), lambda y: y["key"]).alias("up")))
    return path.select("conv", F.inline(F.filter(steps, lambda s: F.size(s["up"]) > 0)))


def _rollup(rows: DataFrame, nodes: DataFrame, cols: list[str]) -> DataFrame:
    """(key, cols): the sums of ``cols`` over every subtree. ``rows`` are
    (conv, depth, key), ``nodes`` (key, conv, cols) with one member each."""
    one = nodes.select("key", F.col("conv").alias("of"))
    up = _ancestors(rows)
    up = write_through(up.join(one, (up["key"] == one["key"]) & up["conv"].eqNullSafe(one["of"])).select(
        up["key"], "depth", "up"), "ancestors")
    sums = [F.sum(c).alias(c) for c in cols]
    inner = up.where(F.col("depth") % BAND != 0).join(nodes.select("key", *cols), "key")
    inside = nodes.select("key", *cols).unionByName(inner.select(F.explode("up").alias("key"), *cols)).groupBy("key").agg(*sums)
    if (up.agg(F.max("depth")).first()[0] or 0) < BAND:
        return inside
    inside = write_through(inside, "band-totals")
    roots = rows.where(F.col("depth") % BAND == 0).select("conv", (F.col("depth") / BAND).cast("long").alias("depth"), "key")
    cuts = up.where(F.col("depth") % BAND == 0)
    starts = cuts.select("key").union(rows.where("depth = 0").select("key")).distinct()
    complete = write_through(_rollup(roots, nodes.select("key", "conv").join(starts, "key", "left_semi").join(inside, "key"), cols), "band-roots")
    handed = cuts.join(complete, "key").select(F.explode("up").alias("key"), *cols)
    return inside.unionByName(handed).groupBy("key").agg(*sums)


def _join_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, conv) to (key, first, ids): at most CHUNK decimal
    ids of one key, comma-joined."""
    key, first, held = None, None, []

    def emit() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([first], pa.decimal128(38, 0)),
                                           pa.array([",".join(held)], pa.string())], names=["key", "first", "ids"])

    for b in batches:
        for k, at, s in zip(b.column("key").to_pylist(), b.column("at").to_pylist(), b.column("conv").to_pylist()):
            if k != key or len(held) >= CHUNK:
                if held:
                    yield emit()
                key, first, held = k, at, []
            held.append(s)
    if held:
        yield emit()


def _digest_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks sorted by (key, first) to (key, sha): the digest runs over the chunks as they pass."""
    key, sha = None, None

    def emit() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([sha.hexdigest()], pa.string())], names=["key", "sha"])

    for b in batches:
        for k, ids in zip(b.column("key").to_pylist(), b.column("ids").to_pylist()):
            if k != key:
                if sha is not None:
                    yield emit()
                key, sha = k, hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(ids.encode())
    if sha is not None:
        yield emit()


def ends_digests(ends: DataFrame) -> DataFrame:
    """(key, sha) from (key, conv): SHA-256 of the decimal ids per key,
    numerically ascending (a null id first, as an empty string), comma-joined.
    The ids of one key are joined in ranges, by many tasks; only the digest
    itself, which is sequential by nature, passes over the joined chunks of a
    key in one task, chunk by chunk."""
    rows = ends.select("key", F.col("conv").cast("decimal(38,0)").alias("at"), F.coalesce(F.col("conv").cast("string"), F.lit("")).alias("conv"))
    chunks = (rows.repartitionByRange("key", "at").sortWithinPartitions("key", "at")
              .mapInArrow(_join_runs, "key binary, first decimal(38,0), ids string"))
    return chunks.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_digest_runs, "key binary, sha string")


def prefix_trie(seq: DataFrame) -> DataFrame:
    """One row per node of the trie of the sequences ``seq`` (conv, pos,
    digest, words, last; pos 0 once per conversation): (conv_id, depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    ``conv_id`` is the smallest member (null if only a null id is one),
    ``n_leaves`` and ``saved_tokens`` (members but one, times the words of the
    node's last turn) are summed over the node's subtree; ``ends_sha256`` is
    the digest of the ids of the conversations that end at the node. Without a
    conversation there is no node."""
    seq = write_through(seq, "sequences")
    keys = _prefix_keys(seq.where("pos > 0").select("conv", "pos", "digest"))
    keyed = seq.join(keys.select(F.col("conv").alias("of"), F.col("pos").alias("at"), "key"),
                     F.col("conv").eqNullSafe(F.col("of")) & (F.col("pos") == F.col("at")), "left")
    rows = write_through(keyed.select("conv", F.col("pos").alias("depth"), F.coalesce("key", F.lit(ROOT)).alias("key"), "words", "last"), "prefixes")
    nodes = write_through(rows.groupBy("key", "depth").agg(
        F.count("*").alias("n_convs"), F.min("conv").alias("conv"), F.max("words").alias("words")), "nodes")
    # the parent of a node, from the path of its smallest member
    place, member = rows.select("conv", "depth", "key"), nodes.select("key", F.col("conv").alias("of"))
    up = _ancestors(place)
    parents = write_through(up.join(member, (up["key"] == member["key"]) & up["conv"].eqNullSafe(member["of"])).select(
        up["key"], F.element_at("up", -1).alias("parent")), "parents")
    children = write_through(parents.groupBy("parent").agg(F.count("*").alias("n_children")), "children")
    values = nodes.join(children.withColumnRenamed("parent", "key"), "key", "left").select(
        "key", "conv", F.coalesce("n_children", F.lit(0)).alias("n_children"),
        F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
    values = write_through(values, "values")
    totals = _rollup(place, values.drop("n_children"), ["n_leaves", "saved_tokens"])
    named = salted_join(parents, nodes.select(F.col("key").alias("parent"), F.col("conv").alias("parent_conv_id")), ["parent"],
                        hot=heavy_groups(children, ["parent"], "n_children"))
    out = (nodes.join(values.select("key", "n_children"), "key").join(totals, "key")
           .join(named.select("key", "parent_conv_id"), "key", "left")
           .join(ends_digests(rows.where("last").select("key", "conv")), "key", "left"))
    return out.select(F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                      F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
