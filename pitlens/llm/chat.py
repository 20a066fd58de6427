"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs and sorted; neighbours of one role form a
block, and a block is written as `<s>` role `<|role|>` text `<|turn|>` text ... `</s>`.
Backslashes and control strings inside roles and texts are escaped, so a block splits
back into the very turns it was made of.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The control strings of the template and of those it must not be confused with.
OPEN, ROLE, TURN, CLOSE = "<s>", "<|role|>", "<|turn|>", "</s>"
_CONTROL = r"(<|\[)(\|role\|>|\|turn\|>|/?s>|/?INST\]|<SYS>>|</SYS>>)"


def escape(text: Column) -> Column:
    """Doubles backslashes and puts one after the first character of every control string."""
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), _CONTROL, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_conversations(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss: one row per conversation.

    Turns go by turn number, then role, then text, so repeated rows and equal numbers have
    one order; a null number comes first, a null role or text counts as empty, and rows with
    a null conv_id are one conversation. `loss` holds (start, length) in code points of
    `formatted`, from 0, of each text of `loss_role`, in order. No rows give no rows; columns
    other than conv_id, turn, role and text are not read.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    sorted_turns = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(
        F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text")))).alias("turns"))
    escaped = sorted_turns.select("conv_id", F.transform("turns", lambda t: F.struct(
        escape(t["role"]).alias("role"), (t["role"] == F.lit(loss_role)).alias("loss"), escape(t["text"]).alias("text"))).alias("turns"))
    empty = F.expr("named_struct('role', '', 'loss', false, 'texts', cast(array() as array<string>))")
    state = F.expr("named_struct('done', cast(array() as array<struct<role:string,loss:boolean,texts:array<string>>>), "
                   "'last', named_struct('role', '', 'loss', false, 'texts', cast(array() as array<string>)))")

    def add(acc: Column, t: Column) -> Column:
        begun = F.size(acc["last"]["texts"]) > 0
        same = begun & (acc["last"]["role"] == t["role"])
        own = F.struct(t["role"].alias("role"), t["loss"].alias("loss"), F.array(t["text"]).alias("texts"))
        longer = F.struct(t["role"].alias("role"), t["loss"].alias("loss"),
                          F.concat(acc["last"]["texts"], F.array(t["text"])).alias("texts"))
        done = F.when(begun & ~same, F.concat(acc["done"], F.array(acc["last"]))).otherwise(acc["done"])
        return F.struct(done.alias("done"), F.when(same, longer).otherwise(own).alias("last"))

    blocks = F.aggregate("turns", state, add, lambda acc: F.concat(acc["done"], F.array(acc["last"])))
    merged = escaped.select("conv_id", blocks.alias("blocks"))
    spans = F.expr("named_struct('at', 0L, 'spans', cast(array() as array<struct<start:bigint,length:bigint>>))")

    def mark(acc: Column, b: Column) -> Column:
        head = acc["at"] + len(OPEN) + F.length(b["role"]) + len(ROLE)
        inner = F.aggregate(b["texts"], F.struct(head.alias("at"), acc["spans"].alias("spans")), lambda a, x: F.struct(
            (a["at"] + F.length(x) + len(TURN)).alias("at"),
            F.when(b["loss"], F.concat(a["spans"], F.array(F.struct(a["at"].alias("start"), F.length(x).cast("long").alias("length")))))
            .otherwise(a["spans"]).alias("spans")))
        return F.struct((inner["at"] - len(TURN) + len(CLOSE)).alias("at"), inner["spans"].alias("spans"))

    write = F.array_join(F.transform("blocks", lambda b: F.concat(
        F.lit(OPEN), b["role"], F.lit(ROLE), F.array_join(b["texts"], TURN), F.lit(CLOSE))), "")
    return merged.select("conv_id", write.alias("formatted"),
                         F.aggregate("blocks", spans, mark, lambda a: a["spans"]).alias("loss"))


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) that `formatted` was made of, in order."""
    blocks = F.filter(F.split(formatted, CLOSE), lambda b: b != "")
    role = lambda b: unescape(F.substring_index(F.substring(b, len(OPEN) + 1, 2**31 - 1), ROLE, 1))
    body = lambda b: F.element_at(F.split(b, r"<\|role\|>"), 2)
    return F.flatten(F.transform(blocks, lambda b: F.transform(
        F.split(body(b), r"<\|turn\|>"), lambda x: F.struct(role(b).alias("role"), unescape(x).alias("text")))))


def read_loss(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(loss, lambda s: unescape(
        F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
