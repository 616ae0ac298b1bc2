"""Chat formatting: typed content parts flattened into one marked string for each conversation.

A message is ``<|im_start|>role\\nbody<|im_end|>\\n``. Control strings inside texts are escaped
reversibly: every ``<``, backslashes, ``|`` gets one backslash more, so an escaped text never holds
``<|``. Roles also have ``%`` and newlines percent-coded. Image, audio and document parts become
ordered placeholders; their references and expanded token counts are recorded beside the string.

Edge cases: a null text is empty, a null role is the empty role, a null or unknown part kind is
flattened as an empty text, an empty table gives no conversation, ties in ``turn`` are ordered by
role and then message, repeated rows stay repeated, a very long text is escaped in its own row before
its conversation is put together, columns of other names are not read. The whole string of a conversation is one row
by definition: it is put together from messages that were formatted beforehand, row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
#: Tokens that one unit of a part expands to: an image tile, a second of audio, a document page.
EXPANSION = {"image": 256, "audio": 25, "document": 512}


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def text_parts(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role and the text as the only part of each turn."""
    part = F.struct(F.lit("text").alias("kind"), F.coalesce("text", F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(0).alias("units"))
    return turns.select("conv_id", "turn", "role", F.array(part).alias("parts"))


def _visit(part: Column) -> Column:
    """What a part becomes inside its message."""
    shown = escape(F.coalesce(part["text"], F.lit("")))
    for kind in EXPANSION:
        shown = F.when(part["kind"] == kind, F.lit(f"<|{kind}|>")).otherwise(shown)
    return shown


def _expanded(part: Column) -> Column:
    tokens = F.lit(0)
    for kind, each in EXPANSION.items():
        tokens = F.when(part["kind"] == kind, F.coalesce(part["units"], F.lit(1)) * each).otherwise(tokens)
    return tokens.cast("bigint")


def format_conversations(turns: DataFrame, learn_from: str = "assistant") -> DataFrame:
    """One row for each conv_id: formatted, loss_mask (message, start, end: code points within a message), attachments.

    turns: conv_id, turn, role, parts: array of struct(kind, text, ref, units).
    """
    parts = F.coalesce("parts", F.array().cast("array<struct<kind:string,text:string,ref:string,units:int>>"))
    messages = (
        turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), parts.alias("parts"))
        .withColumn("body", F.array_join(F.transform("parts", _visit), ""))
        .withColumn("head", F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n")))
        .select(
            "conv_id",
            F.struct(
                "turn",
                "role",
                F.concat("head", "body", F.lit(END)).alias("message"),
                F.when(F.col("role") == learn_from, F.length("head")).alias("start"),
                F.length(F.concat("head", "body")).alias("end"),
                F.transform(
                    F.filter("parts", lambda p: p["kind"].isin(list(EXPANSION))),
                    lambda p: F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), _expanded(p).alias("tokens")),
                ).alias("attached"),
            ).alias("m"),
        )
    )
    return (
        messages.groupBy("conv_id")
        .agg(F.sort_array(F.collect_list("m")).alias("m"))
        .select(
            "conv_id",
            F.size("m").cast("bigint").alias("n_messages"),
            F.array_join(F.transform("m", lambda x: x["message"]), "").alias("formatted"),
            F.filter(
                F.transform("m", lambda x, i: F.struct(i.alias("message"), x["start"].alias("start"), x["end"].alias("end"))),
                lambda x: x["start"].isNotNull(),
            ).alias("loss_mask"),
            F.flatten(F.transform("m", lambda x, i: F.transform(x["attached"], lambda a: F.struct(i.alias("message"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens"))))).alias("attachments"),
        )
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role, text), learned (the texts under the mask), formatted_chars, from the formatted string alone."""
    piece = lambda p: F.concat(F.lit(START), p)  # noqa: E731  as the mask counts it
    return (
        formatted.withColumn("_pieces", F.slice(F.split("formatted", r"<\|im_start\|>"), 2, F.length("formatted") + 1))
        .withColumn(
            "turns",
            F.transform(
                "_pieces",
                lambda p: F.struct(
                    unescape_role(F.substring_index(p, "\n", 1)).alias("role"),
                    unescape(p.substr(F.length(F.substring_index(p, "\n", 1)) + 2, F.length(p) - F.length(F.substring_index(p, "\n", 1)) - 1 - len(END))).alias("text"),
                ),
            ),
        )
        .withColumn("learned", F.transform("loss_mask", lambda s: unescape(piece(F.get(F.col("_pieces"), s["message"])).substr(s["start"] + 1, s["end"] - s["start"]))))
        .select("conv_id", "turns", "learned", F.length("formatted").cast("bigint").alias("formatted_chars"))
    )


def digests(turns: DataFrame) -> DataFrame:
    """What is read back from the formatted conversations: counts and digests for each conv_id."""
    back = read_back(format_conversations(text_parts(turns)))
    learned = F.array_join("learned", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(learned).cast("bigint").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        "formatted_chars",
    )
