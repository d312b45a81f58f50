"""Chat formatting: typed content parts flattened into one text with placeholders, attachments and a loss mask.

A turn holds parts: text, image, audio, document. The visitor goes through them in order: a text is escaped (and set off
from a text right before it), any other part leaves a placeholder and an attachment (reference, kind, expanded tokens). The template marks turns;
strings that could be taken for control strings are escaped inside texts and roles by a backslash after their first
character, which is taken back when reading.

Nulls: null text, role, and parts are empty; a null conv_id is a conversation of its own. Turns are ordered by turn
(nulls first), then role, then text, so that ties and repeated rows have a fixed order and are all kept. An empty table
gives no rows. Columns beyond those named are neither read nor in the way. A conversation is one output text, so its
rows meet in one row; texts of any length are whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

TURN, SAYS, END, NEXT = "<|turn|>", "<|says|>", "<|end|>\n", "<|next|>"
KINDS = ("image", "audio", "document")
#: Expanded tokens: an image by squares of so many pixels, audio by the second, documents by the page.
PATCH, PER_SECOND, PER_PAGE = 28, 25, 600
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
#: What follows the first character of a control string; fixed values.
_REST = r"(?=\||/?s>|/?INST\]|</?SYS>>)"
_ESCAPE, _UNESCAPE = rf"([<\[])(\\*){_REST}", rf"([<\[])\\(\\*){_REST}"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPE, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _UNESCAPE, "$1$2")


def text_part(text: Column) -> Column:
    """A turn's parts where all it has is a text."""
    none = F.lit(None)
    return F.array(F.struct(
        F.lit("text").alias("type"), text.cast("string").alias("text"), none.cast("string").alias("ref"),
        none.cast("int").alias("width"), none.cast("int").alias("height"), none.cast("double").alias("seconds"),
        none.cast("int").alias("pages"),
    ))


def _tokens(part: Column) -> Column:
    side = lambda name: F.ceil(F.coalesce(part[name], F.lit(0)) / PATCH)
    return (
        F.when(part["type"] == "image", side("width") * side("height"))
        .when(part["type"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * PER_SECOND))
        .when(part["type"] == "document", F.coalesce(part["pages"], F.lit(0)) * PER_PAGE)
        .otherwise(0).cast("long")
    )


def _visit(part: Column) -> Column:
    """A part as it is written: placeholder or escaped text; other types, and null, write nothing."""
    return F.when(part["type"].isin(*KINDS), F.concat(F.lit("<|"), part["type"], F.lit("|>"))).when(
        part["type"] == "text", escape(F.coalesce(part["text"], F.lit("")))
    ).otherwise("")


def format_chats(turns: DataFrame) -> DataFrame:
    """One row per conversation from conv_id, turn, role, parts (array of ``PART``).

    ``formatted``; ``attachments`` in the order of their placeholders; ``loss_spans``: start (from 0) and length of every
    assistant text in code points; ``expanded_tokens``: sum over the attachments.
    """
    rows = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("parts", F.array().cast(f"array<{PART}>")).alias("parts"),
    )
    follows = lambda p, i: (p["type"] == "text") & (F.get("parts", i - 1)["type"] == "text")
    rows = rows.withColumn("written", F.transform("parts", _visit)).withColumn(
        "mark", F.transform("parts", lambda p, i: F.when(follows(p, i), NEXT).otherwise(""))
    ).withColumn(
        "head", F.concat(F.lit(TURN), escape(F.col("role")), F.lit(SAYS))
    )
    rows = rows.withColumn("cells", F.zip_with("mark", "written", lambda m, w: F.concat(m, w)))
    piece = F.concat("head", F.array_join("cells", ""), F.lit(END))
    rows = rows.withColumn("piece", piece).withColumn("content", F.array_join(F.transform("parts", lambda p: F.coalesce(
        p["text"], F.lit(""))), ""))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "content", "piece")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("seq", F.row_number().over(order)).withColumn(
        "start", F.coalesce(F.sum(F.char_length("piece")).over(before), F.lit(0)) + F.char_length("head")
    )
    start = lambda i: F.aggregate(
        F.slice("cells", F.lit(1), i), F.col("start"), lambda at, w: at + F.char_length(w)
    ) + F.char_length(F.get("mark", i))
    spans = F.filter(
        F.transform("written", lambda w, i: F.struct(
            start(i).alias("start"), F.char_length(w).cast("long").alias("length"), F.get("parts", i)["type"].alias("type")
        )), lambda s: (s["type"] == "text") & (s["length"] > 0),
    )
    spans = F.when(F.col("role") == "assistant", F.transform(
        spans, lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length"))
    )).otherwise(
        F.array().cast("array<struct<start:bigint,length:bigint>>")
    )
    files = F.transform(F.filter("parts", lambda p: p["type"].isin(*KINDS)), lambda p: F.struct(
        p["type"].alias("kind"), p["ref"].alias("ref"), _tokens(p).alias("tokens")
    ))
    rows = rows.select("conv_id", "seq", "piece", spans.alias("spans"), files.alias("files"))
    whole = rows.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("seq", "piece", "spans", "files"))).alias("turns")
    )
    sum_tokens = F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"])
    return whole.select(
        "conv_id", F.array_join(F.col("turns.piece"), "").alias("formatted"),
        F.flatten("turns.files").alias("attachments"), F.flatten("turns.spans").alias("loss_spans"),
    ).withColumn("expanded_tokens", sum_tokens)


def read_back(chats: DataFrame) -> DataFrame:
    """Roles, texts and the text under the loss mask, read from ``formatted`` and ``loss_spans`` alone."""
    turn = r"(?s)<\|turn\|>(.*?)<\|says\|>(.*?)<\|end\|>\n"
    marks = r"<\|(?:image|audio|document|next)\|>"
    plain = lambda t: F.array_join(F.transform(F.split(t, marks), unescape), "")
    under = F.transform("loss_spans", lambda s: unescape(
        F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))
    ))
    return chats.select(
        "conv_id", "formatted",
        F.transform(F.regexp_extract_all("formatted", F.lit(turn), F.lit(1)), unescape).alias("roles"),
        F.transform(F.regexp_extract_all("formatted", F.lit(turn), F.lit(2)), plain).alias("texts"),
        F.array_join(under, "").alias("loss_text"),
    )
