"""Chat formatting over typed content parts, in Spark's own expressions.

A turn has parts of kind text, image, audio or document; a document holds parts of the other kinds. The visitor walks each
turn's parts in order and flattens them to pieces: text is escaped, any other part becomes a numbered placeholder
(``<image 1>``, ``<audio 2>``, ``<document 3>`` ... ``</document>``) and a record of its reference and of the number of
tokens it stands for once expanded. Numbers run through a conversation. A conversation is written as segments (text, under the
loss or not) whose concatenation is the formatted text: ``<turn role>``, line end, pieces, ``</turn>``, line end. The text
parts of the assistant's turns are under the loss.

Escapes make the template's marks unambiguous and are undone by two replacements: ``\\`` becomes ``\\s``, and the ``<`` of
anything that looks like a mark becomes ``\\l``; in roles ``>`` also becomes ``\\g``.

Defined results: null text and role count as empty, null kind is text, any other kind is ``file``; a null reference stays
null and null sizes count as the least (one tile, no audio, one page). Turns are ordered by turn (null first), then by role and
parts, so repeated rows stay and ties are stable. Rows without conv_id are one conversation with a null conv_id. A conversation
is one value of the output, as its digest demands; windows over its turns spill. Empty tables give empty results; extra columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, table

LEAF = "kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int"
#: Type of the parts in a document, and of a turn's parts.
INNER = f"array<struct<{LEAF}>>"
PARTS = f"array<struct<{LEAF},parts:{INNER}>>"
KINDS = ("image", "audio", "document")
#: What an attachment expands to: an image tile has so many pixels a side, audio so many tokens a second, a page so many tokens.
TILE_PIXELS, AUDIO_RATE, PAGE_TOKENS = 28, 12.5, 256
MARKS = r"<(?=/?(?:turn|image|audio|document|file)\b)"
PLACEHOLDER = r"<(?:image|audio|document|file) \d+>|</document>"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\s")), MARKS, r"\\l")


def unescape(text: Column) -> Column:
    """The reverse of escape(); the backslash comes last, since every one in escaped text is followed by a letter of its own."""
    return F.replace(F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\g"), F.lit(">")), F.lit("\\s"), F.lit("\\"))


def _kind(part: Column) -> Column:
    kind = F.coalesce(part["kind"], F.lit("text"))
    return F.when(kind.isin("text", *KINDS), kind).otherwise("file")


def expanded_tokens(part: Column) -> Column:
    """Tokens that an attachment's placeholder stands for."""
    tiles = lambda side: F.greatest(F.ceil(F.coalesce(side, F.lit(1)) / TILE_PIXELS), F.lit(1))
    return (F.when(_kind(part) == "image", tiles(part["width"]) * tiles(part["height"])).when(_kind(part) == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * AUDIO_RATE))
            .when(_kind(part) == "document", F.greatest(F.coalesce(part["pages"], F.lit(1)), F.lit(1)) * PAGE_TOKENS).otherwise(0)).cast("long")


def visited(parts: Column) -> Column:
    """The visitor: parts, and parts in parts, as a flat array of pieces (kind, text, ref, tokens) in reading order. An
    attachment's text is null until it is numbered; ``end`` closes a document that holds parts."""
    def piece(kind, text, ref, tokens):
        return F.struct(kind.alias("kind"), text.alias("text"), ref.alias("ref"), tokens.alias("tokens"))

    def leaf(p):
        is_text = _kind(p) == "text"
        return piece(_kind(p), F.when(is_text, escape(p["text"])), F.when(~is_text, p["ref"]), F.when(is_text, F.lit(0).cast("long")).otherwise(expanded_tokens(p)))

    end = piece(F.lit("end"), F.lit("</document>"), F.lit(None).cast("string"), F.lit(0).cast("long"))
    inside = lambda p: F.coalesce(p["parts"], F.array().cast(INNER))
    nested = lambda p: (_kind(p) == "document") & (F.size(inside(p)) > 0)
    return F.flatten(F.transform(F.coalesce(parts, F.array().cast(PARTS)), lambda p: F.when(nested(p), F.concat(F.array(leaf(p)), F.transform(inside(p), leaf), F.array(end))).otherwise(F.array(leaf(p)))))


def text_part(text: Column) -> Column:
    """A turn's parts when it is plain text."""
    null = [F.lit(None).cast(field.split(":")[1]).alias(field.split(":")[0]) for field in LEAF.split(",")[2:]]
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), *null, F.lit(None).cast(INNER).alias("parts")))


def format_chats(turns: DataFrame) -> DataFrame:
    """One row per conversation of ``turns(conv_id, turn, role, parts)``: conv_id, segments (text, loss), attachments (number,
    turn, kind, ref, tokens) and expanded_tokens. Written in one shuffle by conversation."""
    n = F.size(F.filter(visited(F.col("parts")), lambda p: ~p["kind"].isin("text", "end")))
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.col("parts").cast(PARTS).alias("parts")).withColumn("n", n)
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "parts")
    rows = (rows.withColumns({"place": F.row_number().over(order), "before": F.coalesce(F.sum("n").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))})
            .select("conv_id", "place", "before", "role", visited(F.col("parts")).alias("pieces")))
    # A piece's number is its place among the attachments of its turn, after those of the turns before.
    starts = F.transform("pieces", lambda p, i: F.when(p["kind"].isin("text", "end"), F.lit(None)).otherwise(i))
    at = F.filter(starts, lambda i: i.isNotNull())
    number = lambda i: (F.col("before") + F.array_position(at, i)).cast("int")
    named = F.transform("pieces", lambda p, i: F.struct(F.when(p["text"].isNotNull(), p["text"]).otherwise(F.concat(F.lit("<"), p["kind"], F.lit(" "), number(i).cast("string"), F.lit(">"))).alias("text"),
                                                        ((F.col("role") == LOSS_ROLE) & (p["kind"] == "text")).alias("loss")))
    plain = lambda text: F.array(F.struct(text.alias("text"), F.lit(False).alias("loss")))
    head = F.concat(F.lit("<turn "), F.replace(escape(F.col("role")), F.lit(">"), F.lit("\\g")), F.lit(">\n"))
    records = F.transform(at, lambda i: F.struct(number(i).alias("number"), F.col("place").alias("turn"), F.element_at("pieces", i + 1)["kind"].alias("kind"), F.element_at("pieces", i + 1)["ref"].alias("ref"), F.element_at("pieces", i + 1)["tokens"].alias("tokens")))
    rows = rows.select("conv_id", "place", F.concat(plain(head), named, plain(F.lit("</turn>\n"))).alias("segments"), records.alias("attachments"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", "segments", "attachments"))).alias("t"))
    return whole.select("conv_id", F.flatten(F.transform("t", lambda t: t["segments"])).alias("segments"), F.flatten(F.transform("t", lambda t: t["attachments"])).alias("attachments")) \
        .withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda s, a: s + a["tokens"]))


def formatted(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def read_chats(chats: DataFrame) -> DataFrame:
    """conv_id, turns (role, text, attachments), loss_text, formatted_chars read back from format_chats(): turns are parsed
    from the formatted text, where ``text`` is that of the text parts and ``attachments`` are the placeholders' numbers."""
    parts = F.split(F.col("formatted"), "</turn>\n", -1)
    body = lambda t: F.substr(t, F.instr(t, ">\n") + 2)
    turn = lambda t: F.struct(unescape(F.substr(F.substring_index(t, ">\n", 1), F.lit(7))).alias("role"), unescape(F.regexp_replace(body(t), PLACEHOLDER, "")).alias("text"),
                              F.transform(F.regexp_extract_all(body(t), F.lit(r"<(?:image|audio|document|file) (\d+)>"), F.lit(1)), lambda n: n.cast("int")).alias("attachments"))
    return chats.withColumn("formatted", formatted(F.col("segments"))).select(
        "conv_id", F.transform(F.slice(parts, 1, F.size(parts) - 1), turn).alias("turns"),
        F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "").alias("loss_text"), F.length("formatted").cast("long").alias("formatted_chars"))


def digests(back: DataFrame) -> DataFrame:
    """What a reader of the output can check: number and digest of the turns, length and digest of the text under the loss."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
                       F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")


#: What both turns of the planted conversation say: marks of this and of other templates.
PLANTED_ID, PLANTED = -7, r"\### Assistant: </turn> ok"


def op12(spark, sf_dir: str) -> DataFrame:
    planted = spark.range(2).select(F.lit(PLANTED_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PLANTED).alias("text"))
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(planted)
    return digests(read_chats(materialize(format_chats(turns.withColumn("parts", text_part(F.col("text")))))))


_MARKED = "regexp_replace(replace({0}, '\\', '\\s'), '<(/?(turn|image|audio|document|file)\\b)', '\\\\l\\1', 'g')"
SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT {PLANTED_ID}, i, r, '{PLANTED}' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, r)),
g AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
      coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
      CAST(sum(length({_MARKED.format('text')}) + length(replace({_MARKED.format('role')}, '>', '\\g')) + 16) AS BIGINT) AS formatted_chars FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
"""
