"""The long opening-hours text is read once and stays where it is read."""

import pytest
from pyspark.sql import functions as F

from marketlens.operators.clean import dedupe_keep_first
from marketlens.plans import catering, profiles
from marketlens.sources import standins as S
from marketlens.sources.tables import Tables

DOCUMENTS = [(1, "The ANd", "en", "src1", 10), (1, "the and", "de", "src1", 10), (2, None, "en", "src2", None),
             (3, "other", None, "src0", 2000), (None, "the and", "en", None, 7), (None, "the and", "en", None, 7),
             (149552, "ANOTHER land", "fr", "src1", 30000), (20, "x", "en", "src3", 5), (21, "the AND", "en", "src3", 6000)]
LABELS = [(1, 1, 0), (1, 0, 1), (3, 1, 1), (None, 1, 0), (21, None, 0)]


@pytest.fixture
def tables(spark, tmp_path):
    spark.createDataFrame(DOCUMENTS, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def rows(df):
    return sorted(repr(tuple(r)) for r in df.collect())


def above_the_join(df):
    return df._jdf.queryExecution().optimizedPlan().toString().partition("Join ")[0]


def test_venues_are_cleaned_beside_the_text(spark, tables, monkeypatch):
    written, real = [], catering.write_through
    monkeypatch.setattr(catering, "write_through", lambda df, tag: written.append(df) or real(df, tag))
    got = catering.build_venues_clean(spark, tables)
    assert len(written) == 1 and "text#" not in above_the_join(written[0]) and "hours#" not in above_the_join(written[0])
    assert not any("documents.parquet" in f for f in got.inputFiles())
    # the same, cleaned after the join
    m = S.venues_merged(Tables(spark, tables))
    m = m.withColumns({"chain": F.col("chain").cast("boolean"), "seats": F.col("seats").cast("bigint"),
                       "hours": F.lower(F.coalesce("hours", F.lit("unknown"))), "price": F.lower(F.coalesce("price", F.lit("unknown"))),
                       **{c: F.lower(c) for c in ("name", "category", "address", "district")}})
    m = m.withColumns({"is_24_7": F.col("hours").contains("the") & F.col("hours").contains("and"),
                       "hours_exact": F.col("hours") == "the and"}).drop("hours")
    assert got.columns == m.columns and rows(got) == rows(dedupe_keep_first(m, ["name", "address"], ["id"]))
    assert got.count() == 5 and got.where("is_24_7").count() == 2


def test_nulls_of_venues_are_counted_beside_the_text(spark, tables):
    merged = S.venues_merged(Tables(spark, tables))
    profile, totals = profiles.null_profile_venues(spark, tables), profiles.null_totals_venues(spark, tables)
    for got in (profile, totals):
        assert "text#" not in above_the_join(got)
    assert rows(profile.select("column", "n_null")) == rows(profiles.null_profile(merged).select("column", "n_null"))
    assert rows(totals) == rows(profiles.null_totals(merged))
