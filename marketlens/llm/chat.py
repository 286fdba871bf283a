"""Chat formatting as one relational expression per conversation.

Turn structs are collected and sorted, neighbouring turns of one role are
merged with array functions, and the pieces are concatenated. The loss mask is
a run-length list that alternates control text and content, so it needs no
positions. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted

# The template: one block for each run of turns of a role; SEP stands between
# the merged turns of a block, so that they can be told apart again.
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
TARGET_ROLE = "assistant"


def escape(text: Column) -> Column:
    """``<|`` never occurs in the result: every ``<``, backslashes, ``|`` gets
    one backslash more before the ``|``. ``unescape`` takes it away."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def _escape_role(role: Column) -> Column:
    """A role ends at the line end, so it must not hold one."""
    return F.replace(F.replace(escape(role), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%")))


def format_chats(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text", target: str = TARGET_ROLE) -> DataFrame:
    """One row per conversation: (id, formatted, loss_runs).

    ``loss_runs`` covers ``formatted`` without a gap: (n_chars, loss) by turns
    for control text and for the content of one turn, and at last the closing
    control text; ``loss`` marks the content of turns of the ``target`` role.
    Turns are sorted by turn (null first), then role and text, so ties and
    repeated rows have one order, and repeated rows are all kept. Null text and
    null role count as empty; a null id is a conversation of its own; an empty
    table gives an empty result; other columns are ignored. A conversation is
    one output row, hence one group: its size is bounded by what one string
    can hold.
    """
    rows = turns.select(
        quoted(id_col).alias("id"), quoted(turn_col).alias("turn"),
        _escape_role(F.coalesce(quoted(role_col), F.lit(""))).alias("role"),
        escape(F.coalesce(quoted(text_col), F.lit(""))).alias("text"))
    conv = rows.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    t = F.col("t")
    # a block begins where the role differs from the turn before
    conv = conv.withColumn("begins", F.filter(
        F.sequence(F.lit(0), F.size(t) - 1), lambda i: (i == 0) | (F.get(t, i - 1)["role"] != F.get(t, i)["role"])))
    conv = conv.withColumn("blocks", F.transform(F.col("begins"), lambda s, k: F.struct(
        F.get(t, s)["role"].alias("role"),
        F.transform(F.slice(t, s + 1, F.coalesce(F.get("begins", k + 1), F.size(t)) - s), lambda x: x["text"]).alias("texts"))))
    blocks = F.col("blocks")
    formatted = F.array_join(F.transform(blocks, lambda b: F.concat(
        F.lit(START), b["role"], F.lit("\n"), F.array_join(b["texts"], SEP), F.lit(END + "\n"))), "")

    def run(n: Column, loss: Column) -> Column:
        return F.struct(n.cast("int").alias("n_chars"), loss.alias("loss"))

    runs = F.flatten(F.flatten(F.transform(blocks, lambda b, k: F.transform(b["texts"], lambda x, j: F.array(
        run(F.when(j > 0, F.lit(len(SEP))).otherwise(
            F.when(k > 0, len(END) + 1).otherwise(0) + len(START) + F.length(b["role"]) + 1), F.lit(False)),
        run(F.length(x), b["role"] == target))))))
    closing = F.array(run(F.lit(len(END) + 1), F.lit(False)))
    return conv.select("id", formatted.alias("formatted"), F.concat(runs, closing).alias("loss_runs"))


def read_chats(formatted: DataFrame) -> DataFrame:
    """From (id, formatted, loss_runs) alone: (id, n_turns, turns, loss_text,
    formatted_chars, mask_fits), with ``turns`` an array of (role, text) and
    all text unescaped. ``mask_fits`` tells that the content runs have the
    lengths of the turns and that the runs cover the whole."""
    blocks = F.filter(F.split("formatted", r"<\|im_start\|>", -1), lambda b: b != "")

    def turns_of(b: Column) -> Column:
        role = F.substring_index(b, "\n", 1)
        body = F.substring(b, F.length(role) + 2, F.length(b) - F.length(role) - 1 - len(END) - 1)
        return F.transform(F.split(body, r"<\|im_sep\|>", -1), lambda x: F.struct(role.alias("role"), x.alias("text")))

    df = formatted.withColumn("raw", F.flatten(F.transform(blocks, turns_of)))
    raw, runs = F.col("raw"), F.col("loss_runs")
    marked = F.transform(F.filter(raw, lambda p, i: F.get(runs, 2 * i + 1)["loss"]), lambda p: p["text"])
    fits = (F.forall(F.transform(raw, lambda p, i: F.get(runs, 2 * i + 1)["n_chars"] == F.length(p["text"])), lambda x: x)
            & (F.aggregate(runs, F.lit(0).cast("long"), lambda a, r: a + r["n_chars"]) == F.length("formatted")))
    return df.select(
        "id", F.size(raw).cast("long").alias("n_turns"),
        F.transform(raw, lambda p: F.struct(_unescape_role(p["role"]).alias("role"), unescape(p["text"]).alias("text"))).alias("turns"),
        F.array_join(F.transform(marked, unescape), "").alias("loss_text"),
        F.length("formatted").cast("long").alias("formatted_chars"), fits.alias("mask_fits"))
