"""Chat formatting of typed content parts, with loss spans, attachment references and a way back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from textquarry.llm.common import n_words

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
ATTACHMENTS = ("image", "audio", "document")
PARTS = "array<struct<kind string, text string, ref string, width int, height int, seconds double, pages int>>"
# Tokens a placeholder stands for: image patches of 28 x 28 pixels, 25 steps a second of audio, 256 a document page.
PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25, 256
# Where a control string of this or a neighbouring template could begin: one more backslash is put behind the bracket.
_CONTROL = r"(?=\||/?s>|/?INST\])"
_ESCAPE = rf"([<\[])(\\*){_CONTROL}"
_UNESCAPE = rf"([<\[])\\(\\*){_CONTROL}"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPE, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _UNESCAPE, "$1$2")


def text_part(text: Column) -> Column:
    """A message of plain text as its only part; null is the empty text."""
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"),
                            F.lit(None).alias("ref"), F.lit(None).alias("width"), F.lit(None).alias("height"),
                            F.lit(None).alias("seconds"), F.lit(None).alias("pages"))).cast(PARTS)


def part_tokens(part: Column, text_tokens: Callable[[Column], Column] = n_words) -> Column:
    """Tokens of a part once its placeholder is expanded; a part without measures counts as one."""
    def steps(x: Column) -> Column:
        return F.coalesce(F.ceil(x), F.lit(1)).cast("long")

    return (F.when(part["kind"] == "image", steps(part["width"] / PATCH) * steps(part["height"] / PATCH))
            .when(part["kind"] == "audio", steps(part["seconds"] * AUDIO_RATE))
            .when(part["kind"] == "document", steps(part["pages"] * PAGE_TOKENS))
            .otherwise(text_tokens(part["text"])))


def _visit(part: Column) -> Column:
    """A part as its place in the output: escaped text, or a placeholder."""
    return F.when(part["kind"].isin(*ATTACHMENTS), F.concat(F.lit("<|"), part["kind"], F.lit("|>"))).otherwise(
        escape(F.coalesce(part["text"], F.lit(""))))


def format_chats(messages: DataFrame, trained_role: str = "assistant",
                 text_tokens: Callable[[Column], Column] = n_words) -> DataFrame:
    """One row per conversation.

    Input: conv_id, turn, role, parts (``PARTS``); more columns are left aside. Returns conv_id, n_turns, ``formatted``,
    ``turn_starts`` (code points), ``loss_spans`` (turn number from 0, start, length: the text parts of ``trained_role``),
    ``attachments`` (turn number, kind, ref, tokens; the k-th belongs to the k-th placeholder) and ``expanded_tokens``.

    Parts of other kinds count as text. Null role, text and parts are empty; a null conv_id is a conversation of its own;
    equal turn numbers are ordered by role and output. Messages are formatted before the shuffle; one conversation is one
    string and so meets in one task at the end, as the output asks for.
    """
    role = F.coalesce("role", F.lit(""))
    parts = F.coalesce("parts", F.array().cast(PARTS))
    each = messages.select("conv_id", "turn", role.alias("role"), F.transform(parts, lambda p: F.struct(
        p["kind"].alias("kind"), p["ref"].alias("ref"), part_tokens(p, text_tokens).alias("tokens"),
        F.coalesce(p["kind"].isin(*ATTACHMENTS), F.lit(False)).alias("attached"), _visit(p).alias("piece"))).alias("pieces"))
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(SAYS))
    each = each.withColumn("head", head).withColumn(
        "segment", F.concat("head", F.array_join(F.transform("pieces", lambda p: p["piece"]), ""), F.lit(END)))
    spans = F.aggregate("pieces", F.struct(F.char_length("head").cast("long").alias("at"),
                                           F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans")),
                        lambda acc, p: F.struct(
        (acc["at"] + F.char_length(p["piece"])).alias("at"),
        F.when(p["attached"], acc["spans"]).otherwise(F.concat(acc["spans"], F.array(F.struct(
            acc["at"].alias("start"), F.char_length(p["piece"]).cast("long").alias("length"))))).alias("spans")))["spans"]
    each = each.select(
        "conv_id", "turn", "role", "segment", F.char_length("segment").cast("long").alias("chars"),
        F.when(F.col("role") == trained_role, spans).otherwise(
            F.array().cast("array<struct<start:bigint,length:bigint>>")).alias("spans"),
        F.transform(F.filter("pieces", lambda p: p["attached"]),
                    lambda p: F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), p["tokens"].alias("tokens"))).alias("attached"),
        F.aggregate("pieces", F.lit(0).cast("long"), lambda n, p: n + p["tokens"]).alias("tokens"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "segment")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    each = (each.withColumn("no", (F.row_number().over(order) - 1).cast("int"))
            .withColumn("at", F.coalesce(F.sum("chars").over(before), F.lit(0))))
    turns = F.sort_array(F.collect_list(F.struct("no", "at", "segment", "spans", "attached", "tokens")))
    return each.groupBy("conv_id").agg(turns.alias("t")).select(
        "conv_id", F.size("t").cast("long").alias("n_turns"),
        F.array_join(F.transform("t", lambda x: x["segment"]), "").alias("formatted"),
        F.transform("t", lambda x: x["at"]).alias("turn_starts"),
        F.flatten(F.transform("t", lambda x: F.transform(x["spans"], lambda s: F.struct(
            x["no"].alias("no"), (x["at"] + s["start"]).alias("start"), s["length"].alias("length"))))).alias("loss_spans"),
        F.flatten(F.transform("t", lambda x: F.transform(x["attached"], lambda a: F.struct(
            x["no"].alias("no"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens"))))).alias("attachments"),
        F.aggregate("t", F.lit(0).cast("long"), lambda n, x: n + x["tokens"]).alias("expanded_tokens"))


def _segments(formatted: Column) -> Column:
    return F.filter(F.split(formatted, r"(?=<\|turn\|>)"), lambda s: s != "")


def read_turns(formatted: Column) -> Column:
    """Role and text of every turn, from the formatted string alone; placeholders are left out of the text."""
    def turn(segment: Column) -> Column:
        halves = F.split(segment, r"<\|says\|>", 2)
        text = F.regexp_replace(F.element_at(halves, 2), rf"<\|(?:end|{'|'.join(ATTACHMENTS)})\|>", "")
        return F.struct(unescape(F.regexp_replace(F.element_at(halves, 1), r"^<\|turn\|>", "")).alias("role"),
                        unescape(text).alias("text"))

    return F.transform(_segments(formatted), turn)


def read_loss(formatted: Column, turn_starts: Column, loss_spans: Column) -> Column:
    """The texts under the loss mask, cut out of the formatted string and unescaped."""
    segments = _segments(formatted)
    return F.transform(loss_spans, lambda s: unescape(F.substring(
        F.get(segments, s["no"]), (s["start"] - F.get(turn_starts, s["no"]) + 1).cast("int"), s["length"].cast("int"))))
