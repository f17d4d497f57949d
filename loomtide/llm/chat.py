"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it are
its context, and its reply alone is trained on. Turns after the last reply
make one more example, without a trained part, so that no turn is lost.

A turn is written as ``<|role|>text<|end|>``. In roles and texts ``&``, ``<``
and ``>`` are escaped as in HTML, so a text can never hold a control string,
and what was escaped can be read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE, END = "<|", "|>", "<|end|>"
ASSISTANT = "assistant"
_ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"))


def escape(text: Column) -> Column:
    for plain, safe in _ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for plain, safe in reversed(_ESCAPES):
        text = F.replace(text, F.lit(safe), F.lit(plain))
    return text


def examples(turns: DataFrame) -> DataFrame:
    """conversations -> conv_id, example, text, loss_start, loss_end, last.

    example counts from 1 in the order of turns; text holds the context and
    the reply; the code points from loss_start up to loss_end are trained on.
    last marks a conversation's longest example. Turns are ordered by turn,
    role and text, nulls first, so repeated rows are repeated turns; a null
    role or text is empty, a null conv_id is a conversation of its own, and an
    empty table gives no rows. Other columns are not read.
    """
    own = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    rows = (
        turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))
        .select("conv_id", "turn", "role", "text", escape(F.col("text")).alias("safe"))
        .withColumn("block", F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(CLOSE), F.col("safe"), F.lit(END)))
        .select(
            "conv_id", F.row_number().over(own).alias("n"), "block", (F.col("role") == ASSISTANT).alias("reply"), F.char_length("safe").alias("size"),
            F.sum(F.char_length("block")).over(own.rowsBetween(Window.unboundedPreceding, 0)).alias("end"),
        )
    )
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("n", "block", "reply", "size", "end"))).alias("turns"))
    last = F.element_at("turns", -1)
    targets = F.filter("turns", lambda t: t["reply"] | (t["n"] == last["n"]))
    one = whole.select(
        "conv_id", F.array_join(F.transform("turns", lambda t: t["block"]), "").alias("formatted"),
        F.size("turns").alias("n_turns"), F.posexplode(F.transform(targets, lambda t: F.struct(t["n"].alias("n"), t["reply"].alias("reply"), t["size"].alias("size"), t["end"].alias("end")))).alias("k", "t"),
    )
    stop = F.when(F.col("t.reply"), F.col("t.end") - len(END)).otherwise(F.col("t.end"))
    return one.select(
        "conv_id", (F.col("k") + 1).alias("example"), F.substring("formatted", F.lit(1), F.col("t.end").cast("int")).alias("text"),
        (stop - F.when(F.col("t.reply"), F.col("t.size")).otherwise(0)).alias("loss_start"), stop.alias("loss_end"), (F.col("t.n") == F.col("n_turns")).alias("last"),
    )


def read_turns(text: Column) -> Column:
    """The turns of an example's text, as an array of (role, text)."""
    blocks = F.filter(F.split(text, r"<\|end\|>", -1), lambda b: b != "")

    def turn(b: Column) -> Column:
        # A role can't hold ">", so the first "|>" ends it.
        at = F.locate(CLOSE, b)
        return F.struct(
            unescape(F.substring(b, F.lit(len(OPEN) + 1), at - len(OPEN) - 1)).alias("role"),
            unescape(F.substring(b, at + len(CLOSE), F.char_length(b))).alias("text"),
        )

    return F.transform(blocks, turn)


def digest(made: DataFrame) -> DataFrame:
    """What can be read back from the examples of each conversation."""
    loss = unescape(F.substring("text", (F.col("loss_start") + 1).cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int")))
    read = made.select("conv_id", "example", loss.alias("loss"), F.char_length("text").alias("chars"), F.when(F.col("last"), F.col("text")).alias("whole"))
    per = read.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("example", "loss"))).alias("losses"), F.sum("chars").alias("formatted_chars"), F.max("whole").alias("whole")
    )
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    all_loss = F.array_join(F.transform("losses", lambda x: x["loss"]), "")
    return (
        per.select("conv_id", read_turns(F.col("whole")).alias("turns"), all_loss.alias("loss"), "formatted_chars")
        .select(
            "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"),
            F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), F.col("formatted_chars").cast("long").alias("formatted_chars"),
        )
    )
