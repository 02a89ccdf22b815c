"""Chat formatting with Spark expressions only.

Template: adjacent turns of one role form a block, ``<role>`` text ``<next/>`` text ... ``</turn>`` newline.
In roles and texts ``&``, ``<`` and ``>`` are written ``&amp;``, ``&lt;`` and ``&gt;``, so no text can hold a
control string and every text is read back exactly. The loss mask is a list of (start, length) code point
ranges over the formatted string, one for each assistant text.

Defined cases: null text or role -> empty; equal turn numbers are ordered by role, then text; repeated rows are
repeated turns; rows without conv_id form one conversation of their own; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

END = "</turn>\n"
NEXT = "<next/>"


def escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&gt;"), F.lit(">")), F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_mask (array of start, length; start from 0)."""
    rows = turns.select("conv_id", F.struct("turn", F.coalesce(escape(F.col("role")), F.lit("")).alias("role"), F.coalesce(escape(F.col("text")), F.lit("")).alias("text")).alias("t"))
    told = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    size = F.size("t")
    role = lambda i: F.try_element_at("t", i + 1)["role"]
    piece = F.transform("t", lambda x, i: F.struct(
        F.when((i > 0) & (role(i - 1) == x["role"]), F.lit(NEXT)).otherwise(F.concat(F.lit("<"), x["role"], F.lit(">"))).alias("head"),
        x["text"].alias("text"),
        F.when((i + 1 < size) & (role(i + 1) == x["role"]), F.lit("")).otherwise(F.lit(END)).alias("tail"),
        (x["role"] == F.lit("assistant")).alias("learn"),
    ))
    told = told.select("conv_id", piece.alias("p"))
    width = F.transform("p", lambda x: (F.length(x["head"]) + F.length(x["text"]) + F.length(x["tail"])).cast("long"))
    # running sums over array slices of 256, then over the slices, so that long conversations stay near-linear
    blocks = F.transform(F.sequence(F.lit(0), (F.greatest(F.size(width), F.lit(1)) - 1).cast("int"), F.lit(256)), lambda s: F.aggregate(F.slice(width, s + 1, F.lit(256)), F.lit(0).cast("long"), lambda a, x: a + x))
    told = told.select("conv_id", "p", width.alias("w"), blocks.alias("b"))
    before = F.aggregate("b", F.array(F.lit(0).cast("long")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    told = told.select("conv_id", "p", "w", before.alias("b"))
    start = lambda i: F.element_at("b", (F.floor(i / 256) + 1).cast("int")) + F.aggregate(F.slice("w", (F.floor(i / 256) * 256 + 1).cast("int"), (i % 256).cast("int")), F.lit(0).cast("long"), lambda a, x: a + x)
    spans = F.transform("p", lambda x, i: F.when(x["learn"], F.struct((start(i) + F.length(x["head"])).alias("start"), F.length(x["text"]).cast("long").alias("length"))))
    return told.select(
        "conv_id",
        F.array_join(F.transform("p", lambda x: F.concat(x["head"], x["text"], x["tail"])), "").alias("formatted"),
        F.filter(spans, lambda x: x.isNotNull()).alias("loss_mask"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns in a formatted string: array of (role, text)."""
    blocks = F.filter(F.split(formatted, END, -1), lambda b: b != "")
    return F.flatten(F.transform(blocks, lambda b: F.transform(
        F.split(F.substring(b, F.instr(b, ">") + 1, F.length(b)), NEXT, -1),
        lambda t: F.struct(unescape(F.substring(b, F.lit(2), F.instr(b, ">") - 2)).alias("role"), unescape(t).alias("text")),
    )))


def loss_text(formatted: Column, mask: Column) -> Column:
    return F.array_join(F.transform(mask, lambda m: unescape(F.substring(formatted, (m["start"] + 1).cast("int"), m["length"].cast("int")))), "")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import table

    hard = "\\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    out = format_conversations(turns).withColumn("turns", read_turns(F.col("formatted"))).withColumn("loss", loss_text(F.col("formatted"), F.col("loss_mask")))
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
