"""Chat formatting with typed content parts, in DataFrame functions alone.

A message's content is an array of parts (type, text, ref, n_tokens). A visitor over the parts flattens them in order:
text parts give their escaped text, image, audio and document parts give a numbered placeholder `<image:1>`, and
each attachment is recorded with its ordinal, reference and expanded token count. A turn becomes

    ### role:\\n  content  </turn>\\n

Inside roles and texts, backslash, `<` and `#` (in roles line feed and colon too) are written as a backslash and a
letter, so that no marker of the template can occur in a text and unescaping gives the text back exactly.

Defined cases: null text and null role are empty; a null or empty part list is an empty turn; a part of unknown type
counts as an attachment of that type; repeated rows are kept; turns are ordered by (turn, role, content), null turns
first; a null conv_id is a conversation of its own; no rows give no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PART = "struct<type:string,text:string,ref:string,n_tokens:bigint>"
END = "</turn>\n"
HEAD = "### "
#: What a text must not contain, and how it is written instead; the backslash goes first, and last on the way back.
ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"))
ROLE_ESCAPES = (*ESCAPES, ("\n", "\\n"), (":", "\\c"))


def escape(text: Column, table=ESCAPES) -> Column:
    for plain, coded in table:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column, table=ESCAPES) -> Column:
    for plain, coded in reversed(table):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def _text(column: Column) -> Column:
    return F.coalesce(column, F.lit(""))


def text_part(text: Column) -> Column:
    """The content of a message that is a text only."""
    return F.array(F.struct(F.lit("text").alias("type"), _text(text).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(0).cast("long").alias("n_tokens")))


def _is_text(part: Column) -> Column:
    return F.coalesce(part["type"], F.lit("text")) == "text"


def format_conversations(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """messages (conv_id, turn, role, content array of parts) to one row a conversation.

    Columns: conv_id, formatted, loss_mask (for each turn start and end, in code points of `formatted`, of the text
    under the loss; equal where there is none), attachments (turn_no, ordinal, type, ref, n_tokens), n_media_tokens.
    """
    # one row a turn until the end: places and numbers are running sums, linear in a conversation of any length
    turns = messages.select("conv_id", "turn", _text(F.col("role")).alias("role"), F.coalesce(F.col("content"), F.array().cast(f"array<{PART}>")).alias("content"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "content")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    media = F.filter("content", lambda p: ~_is_text(p))
    turns = turns.select("*", (F.row_number().over(order) - 1).alias("no"), so_far(F.size(media)).cast("int").alias("first"))

    def flatten(part: Column, i: Column) -> Column:
        ordinal = F.col("first") + F.size(F.filter(F.slice("content", F.lit(1), i + 1), lambda p: ~_is_text(p)))
        mark = F.concat(F.lit("<"), escape(_text(part["type"]), ROLE_ESCAPES), F.lit(":"), ordinal.cast("string"), F.lit(">"))
        return F.when(_is_text(part), escape(_text(part["text"]))).otherwise(mark)

    turns = turns.select(
        "conv_id", "no", "role",
        F.concat(F.lit(HEAD), escape(F.col("role"), ROLE_ESCAPES), F.lit(":\n")).alias("head"),
        F.array_join(F.transform("content", flatten), "").alias("body"),
        F.transform(media, lambda p, j: F.struct(F.col("no").alias("turn_no"), (F.col("first") + j + 1).alias("ordinal"), p["type"].alias("type"), p["ref"].alias("ref"), F.coalesce(p["n_tokens"], F.lit(0)).alias("n_tokens"))).alias("attachments"),
    )
    place = Window.partitionBy("conv_id").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("head") + F.length("body") + len(END)).over(place), F.lit(0)) + F.length("head")
    turns = turns.select("conv_id", "no", F.concat("head", "body", F.lit(END)).alias("text"), start.alias("start"), F.when(F.col("role") == loss_role, F.length("body")).otherwise(0).alias("loss"), "attachments")
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("no", "text", "start", "loss", "attachments"))).alias("t"))
    return whole.select(
        "conv_id",
        F.array_join(F.transform("t", lambda t: t["text"]), "").alias("formatted"),
        F.transform("t", lambda t: F.struct(t["start"].alias("start"), (t["start"] + t["loss"]).alias("end"))).alias("loss_mask"),
        F.flatten(F.transform("t", lambda t: t["attachments"])).alias("attachments"),
        F.aggregate("t", F.lit(0).cast("long"), lambda a, t: a + F.aggregate(t["attachments"], F.lit(0).cast("long"), lambda b, x: b + x["n_tokens"])).alias("n_media_tokens"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Recovered from `formatted` and `loss_mask` alone, one row a conversation: `read`, its turns (role, text), and `loss`, the texts at the mask's places."""
    blocks = F.split(F.col("formatted"), F.lit(END))
    blocks = F.slice(blocks, 1, F.size(blocks) - 1)

    def turn(block: Column) -> Column:
        return F.struct(
            unescape(F.substring_index(F.substr(block, F.lit(len(HEAD) + 1)), ":\n", 1), ROLE_ESCAPES).alias("role"),
            unescape(F.substr(block, F.instr(block, ":\n") + 2)).alias("text"),
        )

    under = F.filter("loss_mask", lambda s: s["end"] > s["start"])
    cut = F.transform(under, lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return formatted.withColumn("read", F.transform(blocks, turn)).withColumn("loss", cut)


def digests(formatted: DataFrame) -> DataFrame:
    read = read_back(formatted)
    told = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss", "")
    return read.select(
        "conv_id",
        F.size("read").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def with_probe(conversations: DataFrame, spark: SparkSession) -> DataFrame:
    """The conversations and conversation -7, whose texts hold the template's own control strings."""
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("\\### Assistant: </turn> ok").alias("text"),
    )
    return conversations.select("conv_id", "turn", "role", "text").unionByName(probe)


ORACLE = r"""
WITH m AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM m
), g AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS told,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (WHERE role = 'assistant'), '') AS loss,
         sum(4 + length(role) + (length(role) - length(replace(role, '\', ''))) + (length(role) - length(replace(role, '<', '')))
           + (length(role) - length(replace(role, '#', ''))) + (length(role) - length(replace(role, ':', ''))) + (length(role) - length(replace(role, chr(10), ''))) + 2
           + length(text) + (length(text) - length(replace(text, '\', ''))) + (length(text) - length(replace(text, '<', '')))
           + (length(text) - length(replace(text, '#', ''))) + 8) AS formatted_chars
  FROM e GROUP BY conv_id
)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(told) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
       sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM g
"""
