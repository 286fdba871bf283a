"""Sources S1-S5: declared-schema CSV, dirty ';' CSV, compressed CSV, row count."""

import gzip
import os
import tempfile

from pyspark.sql import functions as F

from marketlens.operators.clean import normalize_headers, to_number
from marketlens.sources.files import read_csv, read_dirty_csv, row_count


def _write(path, text, gz=False):
    if gz:
        with gzip.open(path, "wt", encoding="utf-8") as fh:
            fh.write(text)
    else:
        with open(path, "w", encoding="utf-8") as fh:
            fh.write(text)


def test_csv_with_schema_and_compressed_timestamp(spark):
    d = tempfile.mkdtemp(prefix="ml-src-")
    p = os.path.join(d, "events.csv.gz")
    _write(p, "user_id,event_dt,event_name\nu1,2020-12-07 21:52:10,purchase\nu2,bad,login\n", gz=True)
    df = read_csv(spark, p, "user_id string, event_dt timestamp, event_name string",
                  timestamp_format="yyyy-MM-dd HH:mm:ss")
    got = sorted((r.user_id, r.event_dt is None) for r in df.collect())
    assert got == [("u1", False), ("u2", True)]
    assert row_count(df).collect()[0].n_rows == 2


def test_dirty_semicolon_csv(spark):
    d = tempfile.mkdtemp(prefix="ml-src-")
    p = os.path.join(d, "investments.csv")
    _write(p, " Name ; Funding_Total_USD \nA;1,000,000\nB; - \n")
    df = normalize_headers(read_dirty_csv(spark, p, [" Name ", " Funding_Total_USD "]))
    assert df.columns == ["name", "funding_total_usd"]
    vals = sorted((r.name, r.v) for r in df.select(
        "name", to_number(F.trim(F.replace("funding_total_usd", F.lit(","), F.lit(""))), "double").alias("v")).collect())
    assert vals == [("A", 1000000.0), ("B", None)]
