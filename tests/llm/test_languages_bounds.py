"""Language ID beyond its bounds: many labels, a hot id, unlearned languages,
clashing names."""

import numpy as np
from pyspark.sql import functions as F

from marketlens.llm import langid

SCRIPTS = [range(0x61, 0x7b), range(0x430, 0x450), range(0x3b1, 0x3ca), range(0x4e00, 0x4e80), range(0x5d0, 0x5eb)]


def texts(k, n, words=40):
    """Texts of the invented language ``k``: its own syllables of one script."""
    r = np.random.default_rng(k)
    letters = [chr(c) for c in SCRIPTS[k % len(SCRIPTS)]]
    syllables = ["".join(r.choice(letters, 3)) for _ in range(12)]
    s = np.random.default_rng(1000 + k)
    return [" ".join("".join(s.choice(syllables, 2)) for _ in range(words)) for _ in range(n)]


def table(spark, rows, extra="", more=()):
    return spark.createDataFrame([(*r, "s", 1, *more) for r in rows], "doc_id long, text string, lang string, source string, n_chars long" + extra)


def test_a_hundred_languages_of_several_scripts(spark, monkeypatch):
    monkeypatch.setattr(langid, "MODEL_CELLS", 3_000_000)
    rows = [(i, t, f"l{k:03d}") for i, (k, t) in enumerate((k, t) for k in range(100) for t in texts(k, 12))]
    df = table(spark, rows)
    trees = langid.fit_languages(df)
    assert len(trees.langs) == 100 and trees.cost.size <= 3_000_000
    out = langid.languages(df).where("held_out").join(df.select(F.col("doc_id").alias("id"), "lang"), "id")
    assert out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.9


def test_labels_beyond_the_bound_are_pooled(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 3)
    rows = [(i, t, f"l{k}") for i, (k, t) in enumerate((k, t) for k, n in ((0, 40), (1, 30), (2, 25), (3, 20), (4, 15)) for t in texts(k, n))]
    df = table(spark, rows)
    trees = langid.fit_languages(df)
    assert trees.langs == ["l0", "l1", "l2"]
    got = {r["id"]: r["lang_pred"] for r in langid.languages(df).collect()}
    assert all(got[i] == (lang if lang in ("l0", "l1") else "l2") for i, _, lang in rows)


def test_an_id_or_a_text_that_repeats_is_bounded_on_spark(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_TOTAL", 20)
    df = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("aaa bbb ccc").alias("text"), F.lit("xx").alias("lang"))
    assert len(langid.sample_texts(df, "doc_id", "text", "lang")["xx"]) == 20


def test_unlearned_languages_go(spark):
    rows = [(i, t, "known") for i, t in enumerate(texts(0, 60, 120))] + [(500 + i, t, None) for i, t in enumerate(texts(5, 20, 120) + texts(1, 20, 120))]
    rows += [(900, texts(5, 1, 10)[0], None)]  # too short to tell
    left = {r["doc_id"] for r in langid.drop_unknown(table(spark, rows)).collect()}
    assert left == {*range(60), 900}


def test_columns_of_any_name_and_type(spark):
    rows = [(i, t, "known") for i, t in enumerate(texts(0, 30))]
    wide = ", ".join(f"`f {i}`: int" for i in range(40))
    df = table(spark, rows, f", score string, lang_pred int, bits_per_byte int, s struct<{wide}>, m map<string, array<int>>",
               ("x", 1, 2, tuple(range(40)), {"a": [1]}))
    assert sorted(langid.drop_unknown(df).collect(), key=str) == sorted(df.collect(), key=str)
