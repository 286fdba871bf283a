"""The prefix trie against a brute-force version."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketlens.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, conv int, pos string, digest string, key int, last string, words int, `a.b` int"
EXTRA = (7, "p", "d", 3, "l", 5, 9)


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text))


def rebuilt(rows, splice=True):
    convs = {}
    for c, turn, role, text in rows:
        role, text = role or "", text or ""
        d = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
        convs.setdefault(c, []).append((turn is not None, turn or 0, d, role, text))
    plain = {c: [(x[3], x[4]) for x in sorted(t)] for c, t in convs.items()}
    if not splice:
        return plain
    out = {}
    for c, t in plain.items():
        h = 0 if c is None else zlib.crc32(str(c).encode()) % 4
        donor = [] if c is None else plain.get(c - c % 20, [])
        out[c] = donor[:h] + t[h:]
    return out


def brute(rows, splice=True):
    convs = rebuilt(rows, splice)
    members = {}
    for c, t in convs.items():
        for d in range(len(t) + 1):
            members.setdefault(tuple(t[:d]), []).append(c)

    def low(ids):
        return min((c for c in ids if c is not None), default=None)

    kids = {}
    for n in members:
        if n:
            kids.setdefault(n[:-1], []).append(n)
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for n, ids in members.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += n not in kids
            saved[n[:d]] += (len(ids) - 1) * (words(n[-1][1]) if n else 0)
    out = []
    for n, ids in members.items():
        ends = sorted((c for c in ids if len(convs[c]) == len(n)), key=lambda c: (c is not None, c or 0))
        text = ",".join("" if c is None else str(c) for c in ends)
        out.append((low(ids), len(n), low(members[n[:-1]]) if n else None, len(ids), len(kids.get(n, [])), leaves[n], saved[n],
                    hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def run(df):
    return sorted((tuple(r) for r in trie.prefix_trie(trie.spliced(trie.turn_rows(df))).collect()), key=repr)


def table(spark, rows):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA).repartition(3)


def test_odd_rows(spark):
    r = np.random.default_rng(5)
    rows = []
    for c in range(45):
        for t in range(int(r.integers(1, 7))):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", f"w{r.integers(0, 2)} x"))
    rows += [(20, None, None, None), (20, None, "user", "a b"), (61, 1, "user", "same"), (61, 1, "user", "same"), (61, 1, "user", None),
             (None, 1, "user", "no id"), (None, None, None, "no id"), (2 ** 50, 3, "", "x" * 30000), (1, 99, "user", "w0 " * 20000)]
    # ids 62..79 whose donor 60 is absent, one turn each: some are turnless after the splice
    rows += [(c, 1, "user", "only") for c in range(62, 80)]
    assert any(not t for t in rebuilt(rows).values())
    assert run(table(spark, rows)) == brute(rows)


def test_deep_conversations_take_few_rounds(spark, monkeypatch):
    rows = [(c, t, "r", f"{t} {(t * c) // (70 + c)}") for c in (40, 41, 42, 43) for t in range(90)]
    calls = []
    real = trie._rollup
    monkeypatch.setattr(trie, "_rollup", lambda *a: calls.append(1) or real(*a))
    assert run(table(spark, rows)) == brute(rows)
    assert len(calls) == 4  # 4 ** 4 > 90


def test_one_conversation_many_copies(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", 16)
    rows = [(c, t, "user", f"hello {t}") for c in range(0, 4000, 20) for t in range(3)]
    got = run(table(spark, rows))
    assert got == brute(rows) and len(got) == 4 and got[0][3] == 200


def test_empty_and_single(spark):
    assert run(table(spark, [(1, 1, "u", "x")]).limit(0)) == []
    assert run(table(spark, [(5, 1, None, None)])) == brute([(5, 1, None, None)])
    assert run(table(spark, [(None, None, None, None)])) == brute([(None, None, None, None)])


def test_keys_tell_apart_what_joins_alike(spark):
    """Role and text are framed, and turns are: no two sequences share a key."""
    rows = [(0, 1, "ab", "c"), (20, 1, "a", "bc"), (40, 1, "", "abc"), (60, 1, "a", ""), (60, 2, "b", "c"), (80, 1, "a", "1:bc")]
    got = trie.prefix_trie(trie.spliced(trie.turn_rows(table(spark, rows))))
    assert got.where("depth = 1").count() == 5


@pytest.mark.parametrize("n", [1, 4, 5, 16, 17])
def test_prefix_keys_are_equal_for_equal_prefixes_only(spark, n):
    seq = spark.range(n * 2).select((F.col("id") % 2).alias("conv"), (F.floor(F.col("id") / 2) + 1).alias("pos"),
                                    F.unhex(F.sha2(F.floor(F.col("id") / 2).cast("string"), 256)).alias("digest"))
    keys = trie._prefix_keys(seq).collect()
    by_pos = {}
    for r in keys:
        by_pos.setdefault(r["pos"], set()).add(bytes(r["key"]))
    assert sorted(by_pos) == list(range(1, n + 1)) and all(len(k) == 1 for k in by_pos.values())
    assert len(set.union(*by_pos.values())) == n
