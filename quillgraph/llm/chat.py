"""Chat formatting with a grammar round trip.

A conversation is rendered turn by turn, reparsed by a deterministic parser, and compared with its source. Where they
differ, the conversation's control strings and escape marks are escaped, and the rendering is parsed and compared
again; a conversation that still differed would raise an error. Escaping puts one more backslash between `<` and `|`
(in roles also before backslashes and for line ends), so it undoes itself exactly.

    <|im_start|>role\\n text <|im_end|>\\n

Defined results: a null role or text counts as empty; turns are ordered by turn, then role, then text, a null turn
last; repeated rows are repeated turns; a null conv_id is a conversation of its own; an empty table gives an empty
result; other columns are ignored. A conversation is one output row, so its turns meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import before_each, let

START, END = "<|im_start|>", "<|im_end|>"  # fixed values: the template's control strings


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    # pairs are read from the left, so an escaped backslash before an n stays one
    parts = F.split(unescape(role), r"\\\\")
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def render(turns: Column, escaped: bool) -> Column:
    def one(t: Column) -> Column:
        role, text = (escape_role(t["role"]), escape(t["text"])) if escaped else (t["role"], t["text"])
        return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(f"{END}\n"))

    return F.array_join(F.transform(turns, one), "")


def parse(formatted: Column) -> Column:
    """Turns read back from a rendering: array<struct<role, text, start, length>>, null if it isn't in the grammar.

    start (from 1) and length are the code points of the escaped text within the rendering.
    """
    pieces = F.split(formatted, r"<\|im_start\|>", -1)
    body = F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0)))
    tail = F.lit(f"{END}\n")

    def good(p: Column) -> Column:
        return (F.right(p, F.length(tail)) == tail) & (F.instr(p, "\n") > 0) & (F.size(F.split(p, r"<\|im_end\|>", -1)) == 2) & (F.instr(p, "\n") < F.locate(END, p))

    def turn(p: Column) -> Column:
        cut = F.instr(p, "\n")
        text = F.substring(p, cut + F.lit(1), F.length(p) - F.length(tail) - cut)
        return F.struct(unescape_role(F.substring(p, F.lit(1), cut - 1)).alias("role"), unescape(text).alias("text"), cut.alias("cut"), F.length(text).alias("length"), F.length(p).alias("size"))

    def placed(turns: Column) -> Column:
        # where each piece begins, from the sizes of those before it
        at = before_each(F.transform(turns, lambda t: len(START) + t["size"]), "int", lambda a, b: a + b, F.lit(0))
        spot = lambda t, at: F.struct(t["role"].alias("role"), t["text"].alias("text"), (1 + at + len(START) + t["cut"]).alias("start"), t["length"].alias("length"))
        return F.zip_with(turns, at, spot)

    return F.when((F.element_at(pieces, 1) == "") & F.forall(body, good), let(F.transform(body, turn), placed))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns: array<struct<role, text, start, length>>, escaped: boolean), one row a conversation."""
    rows = conversations.select(
        "conv_id", F.struct(F.col("turn").isNull().alias("late"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t")
    )
    # Rows are gathered once; plain columns then carry each step of the round trip
    convs = rows.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"))

    def same(turns: Column) -> Column:
        return F.coalesce(F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))) == F.col("source"), F.lit(False))

    convs = convs.withColumn("raw", render(F.col("source"), False)).withColumn("read", parse(F.col("raw"))).withColumn("escaped", ~same(F.col("read")))
    convs = convs.withColumn("formatted", F.when(F.col("escaped"), render(F.col("source"), True)).otherwise(F.col("raw")))
    convs = convs.withColumn("turns", F.when(F.col("escaped"), parse(F.col("formatted"))).otherwise(F.col("read")))
    checked = F.when(same(F.col("turns")), F.col("turns")).otherwise(F.raise_error(F.lit("a conversation does not survive its round trip")).cast("array<struct<role:string,text:string,start:int,length:int>>"))
    return convs.select("conv_id", "formatted", checked.alias("turns"), "escaped")


def loss_spans(turns: Column) -> Column:
    """array<struct<start, length>>: the loss mask, over the texts of assistant turns."""
    return F.transform(F.filter(turns, lambda t: t["role"] == "assistant"), lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length")))


def digests(conversations: DataFrame) -> DataFrame:
    """What is read back from each conversation's rendering, and the text under its loss mask."""
    out = format_conversations(conversations).withColumn("mask", loss_spans(F.col("turns")))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("mask", lambda m: unescape(F.substring(F.col("formatted"), m["start"], m["length"]))), "")
    out = out.withColumn("loss", loss)
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
