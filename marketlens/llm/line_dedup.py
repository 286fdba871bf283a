"""Line deduplication by site-relative frequency.

Per host, the pages that hold a line are counted and divided by the host's
pages; lines beyond the boilerplate ratio are dropped from every page of the
host. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.operators.joins import heavy_groups, salted_join
from marketlens.session import write_through

from .common import FILE, ROW, quoted, with_row_id
from .lines import n_marked_lines, normal_lines, without_lines

MAX_RATIO = 0.05
MIN_PAGES = 5  # on a host of few pages every line has a high ratio


def boilerplate_lines(docs: DataFrame, text_col: str = "text", host_col: str = "source",
                      max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(FILE, ROW, dropped_hashes) of the rows that hold a boilerplate line.

    A line counts once per page, normalised to lower case and single spaces.
    It is boilerplate when at least ``min_pages`` pages and more than
    ``max_ratio`` of the pages of its host hold it. Null text has no lines but
    its row is a page of its host; a null host is the host named by the empty
    string. Copies are pages of their own, as the ratio says: a group of copies
    over the ratio loses its lines in every copy.
    """
    rows = with_row_id(docs).select(
        FILE, ROW, F.coalesce(quoted(host_col).cast("string"), F.lit("")).alias("host"),
        F.array_distinct(F.transform(normal_lines(F.coalesce(quoted(text_col), F.lit(""))), lambda x: F.xxhash64(x))).alias("hs"))
    rows = write_through(rows, "lines")
    held = rows.select(FILE, ROW, "host", F.explode("hs").alias("h"))
    pages = rows.groupBy("host").agg(F.count("*").alias("host_pages"))
    per_line = held.groupBy("host", "h").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)
    boiler = write_through(per_line.join(pages, "host").where(F.col("pages") > max_ratio * F.col("host_pages")).select("host", "h", "pages"), "boilerplate")
    hot = heavy_groups(boiler, ["host", "h"], "pages")  # a line that a third of all pages hold
    return salted_join(held, boiler.drop("pages"), ["host", "h"], hot=hot).groupBy(FILE, ROW).agg(F.collect_set("h").alias("dropped_hashes"))


def drop_boilerplate(docs: DataFrame, text_col: str = "text", host_col: str = "source", **limits) -> DataFrame:
    """``docs`` with its columns, boilerplate lines gone from the text, plus
    ``lines_dropped`` (long). Null text stays null; repeated rows are each a
    page; an empty table stays empty; a column of the caller's named
    ``lines_dropped`` is replaced."""
    rows = with_row_id(docs)
    found = boilerplate_lines(rows, text_col, host_col, **limits).select(FILE, ROW, F.col("dropped_hashes").alias("__llm_dropped"))
    out = rows.join(found.hint("shuffle_hash"), [FILE, ROW], "left")
    out = out.withColumn("__llm_clean", F.when(F.col("__llm_dropped").isNull(), quoted(text_col))
                         .otherwise(without_lines(quoted(text_col), F.col("__llm_dropped"))))
    gone = F.when(F.col("__llm_dropped").isNull(), 0).otherwise(n_marked_lines(quoted(text_col), F.col("__llm_dropped")))
    cols = [F.col("__llm_clean").alias(c) if c == text_col else quoted(c) for c in docs.columns if c != "lines_dropped"]
    return out.select(*cols, gone.cast("long").alias("lines_dropped"))
