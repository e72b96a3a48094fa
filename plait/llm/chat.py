"""Chat formatting: conversations to training strings by relational operations.

Native: Spark expressions only. The rows of a conversation are ordered by (turn, role, text); a row whose role differs from that of
the row before starts a block, and the running sum of starts numbers the blocks. The turns of a block are collected as
structs, sorted and merged by array aggregation, and the sorted blocks of a conversation are concatenated:

    <|turn|>role<|text|>text(<|next|>text)*<|end|>\\n

``<|next|>`` stands between the texts of merged turns, so the rows can be read back. Control strings
start with ``<|``. In a role or text, each ``<`` that is followed by zero or more backslashes and a ``|``
gets one more backslash, and reading takes one away, so no text can forge a marker and every text comes back exactly.

The loss mask is a list of spans (start, length in code points of the string; first_byte, n_bytes in its UTF-8), one for each assistant text
in its escaped form; markers are never under it. Starts are running sums over the rows, and texts are read back by bytes, so
time grows with the rows and the length of a conversation, not with their product.

Defined cases. Null text and null role are empty; a null turn sorts first; rows that are repeated or tie on the turn
all stay, in the order of role and text. Each row of a null conv_id is a conversation of its own, as nothing says that they belong together. A
conversation is one string, so its rows meet in one task by nature. Extra columns are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import let

TURN, TEXT, NEXT, END = "<|turn|>", "<|text|>", "<|next|>", "<|end|>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def format_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans): one row for each conversation of (conv_id, turn, role, text)."""
    alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    rows = rows.select("conv_id", alone.alias("alone"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    by = ["conv_id", "alone"]
    order = W.partitionBy(*by).orderBy(F.asc_nulls_first("turn"), "role", "text")
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    starts = F.coalesce(F.col("role") != F.lag("role").over(order), F.lit(True))
    ends = F.coalesce(F.col("role") != F.lead("role").over(order), F.lit(True))
    rows = rows.withColumns({"starts": starts, "ends": ends, "pos": F.row_number().over(order)})
    rows = rows.withColumns({"name": escape(F.col("role")), "body": escape(F.col("text"))})
    head = F.when(F.col("starts"), F.concat(F.lit(TURN), "name", F.lit(TEXT))).otherwise(NEXT)
    tail = F.when(F.col("ends"), F.lit(END)).otherwise("")
    sizes = {}
    for k, f in (("chars", F.length), ("bytes", F.octet_length)):
        sizes |= {f"{k}_before": f(head).cast("long"), f"{k}_own": f("body").cast("long"), f"{k}_after": f(tail).cast("long")}
    rows = rows.withColumns(sizes)
    first = {f"{k}_first": F.sum(F.col(f"{k}_before") + F.col(f"{k}_own") + F.col(f"{k}_after")).over(upto) - F.col(f"{k}_own") - F.col(f"{k}_after") for k in ("chars", "bytes")}
    rows = rows.withColumns(first | {"block": F.sum(F.col("starts").cast("int")).over(upto)})
    turn = F.struct("pos", "body", F.struct(F.col("chars_first").alias("start"), F.col("chars_own").alias("length"), F.col("bytes_first").alias("first_byte"), F.col("bytes_own").alias("n_bytes")).alias("span"))
    blocks = rows.groupBy(*by, "block", "role", "name").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    merged = F.concat(F.lit(TURN), "name", F.lit(TEXT), F.array_join("turns.body", NEXT), F.lit(END))
    spans = F.when(F.col("role") == "assistant", F.col("turns.span")).otherwise(F.slice("turns.span", F.lit(1), F.lit(0)))
    whole = blocks.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("block", merged.alias("merged"), spans.alias("spans")))).alias("blocks"))
    return whole.select("conv_id", F.array_join("blocks.merged", "").alias("formatted"), F.flatten("blocks.spans").alias("loss_spans"))


def parse(formatted: Column) -> Column:
    """Read the turns back from an output string: array<struct<role, text>>, one for each row formatted."""
    blocks = F.filter(F.split(formatted, r"<\|turn\|>"), lambda b: b != "")

    def of_block(b: Column) -> Column:
        texts = lambda x, role: F.transform(F.split(x[1], r"<\|next\|>"), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))
        halves = F.split(F.regexp_replace(b, r"<\|end\|>\n\z", ""), r"<\|text\|>")
        return let(halves, lambda x: let(unescape(x[0]), lambda role: texts(x, role)))

    return F.flatten(F.transform(blocks, of_block))


def loss_text(formatted: Column, spans: Column) -> Column:
    """What the loss mask covers, unescaped span by span and joined."""
    # The bytes of the string are a variable of the outer function: they are made once, and each span is one copy.
    cut = lambda raw: F.transform(spans, lambda s: unescape(F.substring(raw, (s["first_byte"] + 1).cast("int"), s["n_bytes"].cast("int")).cast("string")))
    return F.array_join(let(formatted.cast("binary"), cut), "")


def format_report(rows: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from the strings."""
    out = format_conversations(rows).select("conv_id", "formatted", "loss_spans", parse(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
