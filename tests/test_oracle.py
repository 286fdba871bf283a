"""Every registered query against its DuckDB oracle SQL on sf0.001 (the
driver runs the same comparison at sf0.01)."""

import os
import sys

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(ROOT, "tools"))

from check_oracle import rows_of  # noqa: E402

from marketlens.plans.registry import all_oracle_sql as oracle_sql  # noqa: E402
from marketlens.plans.registry import all_queries as queries  # noqa: E402
from marketlens.sources.tables import TABLE_NAMES  # noqa: E402

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLE_NAMES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    s_cols, s_rows = rows_of(queries()[name](spark, SF).toPandas())
    d_cols, d_rows = rows_of(con.execute(oracle_sql()[name]).fetchdf())
    assert s_cols == d_cols
    assert len(s_rows) == len(d_rows)
    assert s_rows == d_rows


@pytest.mark.parametrize("name", ["funding_clean", "dau", "retention_monthly", "listing_seasonality",
                                  "sessions_daily", "tickets_clean"])
def test_results_do_not_depend_on_session_time_zone(spark, con, name):
    import marketlens.session as session
    session._SHARED.clear()
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        s_cols, s_rows = rows_of(queries()[name](spark, SF).toPandas())
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        session._SHARED.clear()
    d_cols, d_rows = rows_of(con.execute(oracle_sql()[name]).fetchdf())
    assert s_cols == d_cols and s_rows == d_rows
