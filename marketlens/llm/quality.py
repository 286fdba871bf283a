"""Quality rules: base counts of a text, and cross-document line frequency.

A line is hashed in normalised form, and per host the distinct documents that
hold it are counted; texts that are equal without white space and case are one
document. A line above the limits stays in the first document that holds it, in
one fixed order of the documents of all hosts, and is removed from the others;
a document that is depleted by that is rejected. So a group of near copies,
however edited, keeps one member whole, while pages that consist of a common
frame lose it, all but one. DataFrame functions only, and no text moves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.operators.joins import heavy_groups, salted_join
from marketlens.session import write_through

from .common import FILE, ROW, quoted, with_row_id
from .lines import WHITE, WORD, normal_lines, without_lines

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MAX_DOCS = 30  # a line in at most so many documents of a host is never removed
MAX_SHARE = 0.001  # nor one in at most this share of the host's documents
REMOVED, CLEAN = "__llm_removed", "__llm_clean"
MIN_LEFT = 0.3  # a document keeps at least this share of its words


def _window_hashes(words: Column, n: Column) -> Column:
    """Hash of every 5-word window (null if there is none)."""
    return F.when(n >= WINDOW, F.transform(
        F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[words[i + k] for k in range(WINDOW)])))


def _covered(ordered: Column) -> Column:
    """Positions, ascending, of the repeated windows among (hash, position) in order of hash."""
    last = F.size(ordered) - 1
    return F.sort_array(F.filter(F.transform(F.sequence(F.lit(0), last), lambda k: F.when(
        ((k > 0) & (F.get(ordered, k - 1)["h"] == ordered[k]["h"]))
        | ((k < last) & (F.get(ordered, k + 1)["h"] == ordered[k]["h"])), ordered[k]["i"])), lambda x: x.isNotNull()))


def _span(at: Column) -> Column:
    """Words covered by windows at these positions."""
    steps = F.transform(at, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - x, F.lit(WINDOW))))
    return F.aggregate(steps, F.lit(0), lambda a, x: a + x)


def base_counts(rows: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long)
    to a frame with a non-null column ``__text``."""
    text = F.col("__text")
    df = rows.withColumn("__w", F.regexp_extract_all(text, F.lit(WORD + "+"), F.lit(0)))
    df = df.withColumn("__n", F.size("__w"))
    df = df.withColumn("__wh", _window_hashes(F.col("__w"), F.col("__n")))
    df = df.withColumn("__ordered", F.when(
        F.size(F.array_distinct("__wh")) < F.size("__wh"),
        F.sort_array(F.transform(F.col("__wh"), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    df = df.withColumn("__at", F.when(F.col("__ordered").isNotNull(), _covered(F.col("__ordered"))))
    worded = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    df = df.withColumn("__worded", worded)
    return df.select(
        *[c for c in rows.columns],
        F.col("__n").cast("long").alias("n_words"),
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("__worded") - F.size(F.array_distinct("__worded"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.when(F.col("__at").isNotNull(), _span(F.col("__at"))), F.lit(0)).cast("long").alias("n_repeat_words"))


def text_key(text: Column) -> Column:
    """60 bits of a digest of the text without white space and case: the same
    for texts that count as one document, and their fixed order."""
    return F.conv(F.substring(F.md5(F.lower(F.regexp_replace(text, WHITE, "")).cast("binary")), 1, 15), 16, 10).cast("long")


def quality_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
                     max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE, min_left: float = MIN_LEFT) -> DataFrame:
    """One row per row of ``docs``: (FILE, ROW, id, the base counts,
    base_failed, kept, words_left, removed_lines).

    Null text has no words and fails the base rule; a null host is the host
    named by the empty string. A line is over the limits when more than
    ``max_docs`` different documents of its host hold it, and more than
    ``max_share`` of them. It stays where the document with the smallest
    ``text_key`` of those holders stands (in all its copies) and is removed
    from the rest. ``removed_lines`` holds the hashes of the document's
    removed lines (null: none). Repeated rows get the same verdict; an empty
    table gives an empty result; other columns are ignored, but names that
    begin with ``__llm_`` are the operator's.
    """
    docs = with_row_id(docs)
    rows = docs.select(
        FILE, ROW, quoted(id_col).alias("id"), F.coalesce(quoted(host_col).cast("string"), F.lit("")).alias("host"),
        F.coalesce(quoted(text_col), F.lit("")).alias("__text"))
    prof = base_counts(rows)
    lines = F.transform(normal_lines(F.col("__text")), lambda x: F.struct(
        F.xxhash64(x).alias("h"), F.size(F.split(x, " ", -1)).alias("w")))
    prof = write_through(prof.withColumn("lines", lines).withColumn("text_key", text_key(F.col("__text"))).drop("__text"), "profile")

    held = prof.select(FILE, ROW, "host", "text_key", F.inline("lines"))
    # one row per document and line, then one per line: a line that every page has is combined before it moves
    per_line = held.groupBy("host", "h", "text_key").agg(F.count("*").alias("n")).groupBy("host", "h").agg(
        F.count("*").alias("n_docs"), F.sum("n").alias("n_rows"), F.min("text_key").alias("first")).where(F.col("n_docs") > max_docs)
    hosts = prof.select("host", "text_key").distinct().groupBy("host").agg(F.count("*").alias("host_docs"))
    above = write_through(per_line.join(hosts, "host").where(F.col("n_docs") > max_share * F.col("host_docs"))
                          .select("host", "h", "first", "n_rows"), "frequent")
    hot = heavy_groups(above, ["host", "h"], "n_rows")
    lost = (salted_join(held, above.drop("n_rows"), ["host", "h"], hot=hot).where("text_key != first").groupBy(FILE, ROW)
            .agg(F.sum("w").alias("lost"), F.collect_set("h").alias("removed_lines")))
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    left = F.col("n_words") - F.coalesce("lost", F.lit(0))
    return (prof.drop("lines", "text_key", "host").join(lost, [FILE, ROW], "left")
            .withColumn("words_left", left).withColumn("base_failed", base_failed)
            .withColumn("kept", ~F.col("base_failed") & (F.col("words_left") >= min_left * F.col("n_words")))
            .drop("lost"))


def apply_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
                  chars_col: str = "n_chars", **limits) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns; lines above
    the limits are gone from the text (and from ``chars_col``, if there is one).
    Null, empty and repeated rows as in ``quality_verdicts``; names of columns
    that begin with ``__llm_`` are the operator's."""
    rows = with_row_id(docs)
    verdict = (quality_verdicts(rows, id_col, text_col, host_col, **limits).where("kept")
               .select(FILE, ROW, F.col("removed_lines").alias(REMOVED)))
    out = rows.join(verdict.hint("shuffle_hash"), [FILE, ROW])
    out = out.withColumn(CLEAN, F.when(F.col(REMOVED).isNull(), quoted(text_col))
                         .otherwise(without_lines(quoted(text_col), F.col(REMOVED))))
    cols = [F.col(CLEAN).alias(c) if c == text_col
            else F.when(F.col(REMOVED).isNull(), quoted(c)).otherwise(
                F.length(CLEAN).cast(docs.schema[c].dataType)).alias(c) if c == chars_col else quoted(c)
            for c in docs.columns]
    return out.select(*cols)
