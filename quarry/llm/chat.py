"""Chat formatting by relational means: turns sorted, neighbours of one role merged, texts joined.

A message holds one run of turns of the same role:

    <turn>ROLE
    TEXT
    <next>
    TEXT
    </turn>

Inside texts each of the control strings <turn>, </turn>, <next> gets one more
backslash in front, whatever number it had, so that a control string without
one is always the template's. In roles backslash and line feed are written as
two characters. Both are undone exactly when read back.

Only DataFrame functions are used. A conversation is one value of the result,
so it has to fit in a row; no other group is formed.

Defined results: a null text counts as empty, a null role as an empty role;
rows of one turn number are ordered by role, then text, nulls first; repeated
rows are kept; rows without a conv_id form one conversation; an empty table
gives an empty result; columns other than the four are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import running

# Fixed values of the template.
OPEN, CLOSE, NEXT = "<turn>", "\n</turn>\n", "\n<next>\n"
CONTROL = "</?turn>|<next>"


def escape(text: Column) -> Column:
    """One backslash more before each control string; the look-behind keeps long runs of backslashes linear."""
    return F.regexp_replace(text, rf"(?<!\\)(\\*(?:{CONTROL}))", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?<!\\)\\(\\*(?:{CONTROL}))", "$1")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    # Between escaped backslashes, "\n" is a line feed.
    parts = F.split(role, r"\\\\", -1)
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def sorted_turns(df: DataFrame) -> DataFrame:
    """conv_id and turns: array<struct<turn, role, text>> in order."""
    turn = F.struct(F.col("turn").cast("bigint").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return df.groupBy(F.col("conv_id").cast("bigint").alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))


def merged_messages(df: DataFrame) -> DataFrame:
    """conv_id and messages: array<struct<role, texts>>, one for each run of turns of one role.

    The starts of the runs are gathered by one fold over the turns; each run is then a slice.
    """
    turns = F.col("turns")
    place = lambda i: F.element_at(turns, i)
    begins = F.filter(F.sequence(F.lit(1), F.size(turns)), lambda i: F.when(i == 1, True).otherwise(place(i)["role"] != place(F.greatest(i - 1, F.lit(1)))["role"]))
    found = df.withColumn("__begins", begins).withColumn("__ends", F.concat(F.slice("__begins", 2, F.size("__begins")), F.array(F.size(turns) + 1)))

    def message(run: Column) -> Column:
        part = F.slice(turns, run["__begins"], run["__ends"] - run["__begins"])
        return F.struct(F.element_at(part, 1)["role"].alias("role"), F.transform(part, lambda t: t["text"]).alias("texts"))

    return found.select("conv_id", F.transform(F.arrays_zip("__begins", "__ends"), message).alias("messages"))


def format_chats(df: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted (string) and loss_spans: array<struct<start, length>>.

    Spans are in code points from 0; they cover just the escaped texts of the
    loss role, one span for each turn. The pieces of a conversation alternate
    between template and text, so the spans follow from the pieces' lengths.
    """
    piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))

    def pieces(m: Column) -> Column:
        loss = m["role"] == F.lit(loss_role)
        head = F.concat(F.lit(OPEN), escape_role(m["role"]), F.lit("\n"))
        last = F.size(m["texts"]) - 1
        inner = F.transform(m["texts"], lambda t, i: F.array(piece(F.when(i == 0, head).otherwise(F.lit(NEXT)), F.lit(False)), piece(escape(t), loss), piece(F.when(i == last, F.lit(CLOSE)).otherwise(F.lit("")), F.lit(False))))
        return F.flatten(inner)

    laid = merged_messages(sorted_turns(df)).select("conv_id", F.flatten(F.transform("messages", pieces)).alias("__pieces"))
    laid = laid.withColumn("__before", running(F.transform("__pieces", lambda p: F.char_length(p["text"]).cast("bigint"))))
    spans = F.transform(F.filter(F.arrays_zip("__pieces", "__before"), lambda z: z["__pieces"]["loss"]), lambda z: F.struct(z["__before"].cast("int").alias("start"), F.char_length(z["__pieces"]["text"]).alias("length")))
    return laid.select("conv_id", F.array_join(F.transform("__pieces", lambda p: p["text"]), "").alias("formatted"), spans.alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation again: array<struct<role, text>>."""
    messages = F.filter(F.split(formatted, CLOSE, -1), lambda m: m != "")

    def turns(m: Column) -> Column:
        body = F.substr(m, F.lit(len(OPEN) + 1))
        role = F.substring_index(body, "\n", 1)
        texts = F.substr(body, F.char_length(role) + 2)
        return F.transform(F.split(texts, NEXT, -1), lambda t: F.struct(unescape_role(role).alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(messages, turns))


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped span by span, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["length"]))), "")


def digests(conversations: DataFrame) -> DataFrame:
    """What the formatted conversations hold when read back; conversation -7 holds the template's own strings."""
    probe = r"\### Assistant: </turn> ok"
    spark = conversations.sparkSession
    own = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    rows = conversations.select(*[F.col(c).cast(t).alias(c) for c, t in (("conv_id", "bigint"), ("turn", "bigint"), ("role", "string"), ("text", "string"))])
    out = format_chats(rows.unionByName(own)).withColumn("__turns", read_turns(F.col("formatted"))).withColumn("__loss", read_loss(F.col("formatted"), F.col("loss_spans")))
    told = F.array_join(F.transform("__turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("__turns").cast("bigint").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.char_length("__loss").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("__loss"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
    )
