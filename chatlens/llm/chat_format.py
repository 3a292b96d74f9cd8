r"""Chat formatting: typed content parts into one training text, and back.

A turn is a role and an ordered list of parts.  A part is a text, or an
attachment (image, audio, document) that becomes one placeholder; its reference
and the number of tokens it stands for are recorded beside the text.

All control strings start with '<|'.  Inside roles and texts each '<|' becomes
'<\|', and each '<\|', '<\\|' ... gets one more backslash.  Texts side by side are
joined first, as a control string may be dealt over them.  So no text can hold a
control string, and the change can be undone.  Placeholders have a prefix that
no other control string has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
LOSS_ROLE = "assistant"
#: Tokens that one attachment stands for where its part does not say.
EXPANDED_TOKENS = {"image": 576, "audio": 1500, "document": 2048}
#: Placeholders by kind; any other kind has the last.
PLACEHOLDERS = {kind: f"<|part:{kind}|>" for kind in ("image", "audio", "document")}
OTHER_PLACEHOLDER = "<|part:other|>"
PART = "struct<kind:string,text:string,ref:string,tokens:bigint>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _split_at(text: Column, marker: str) -> Column:
    return F.split(text, marker.replace("|", r"\|"), -1)


def text_part(text: Column) -> Column:
    """A text as the only part of its turn; null is an empty text."""
    return F.array(
        F.struct(
            F.lit("text").alias("kind"),
            F.coalesce(text, F.lit("")).alias("text"),
            F.lit(None).cast("string").alias("ref"),
            F.lit(None).cast("bigint").alias("tokens"),
        )
    )


def _kind(part: Column) -> Column:
    return F.coalesce(part["kind"], F.lit("document"))


def _body(parts: Column) -> Column:
    """The parts as they stand in the text: runs of texts joined and escaped, anything else as the placeholder of its kind."""
    start = F.struct(F.lit("").alias("done"), F.lit("").alias("open"))
    known = F.create_map(*[F.lit(x) for pair in PLACEHOLDERS.items() for x in pair])

    def visit(so_far: Column, part: Column) -> Column:
        placeholder = F.coalesce(F.try_element_at(known, _kind(part)), F.lit(OTHER_PLACEHOLDER))
        joined = F.concat(so_far["open"], F.coalesce(part["text"], F.lit("")))
        closed = F.concat(so_far["done"], escape(so_far["open"]), placeholder)
        return F.when(_kind(part) == "text", F.struct(so_far["done"].alias("done"), joined.alias("open"))).otherwise(
            F.struct(closed.alias("done"), F.lit("").alias("open"))
        )

    return F.aggregate(parts, start, visit, lambda end: F.concat(end["done"], escape(end["open"])))


def _attachment(part: Column) -> Column:
    usual = F.create_map(*[F.lit(x) for pair in EXPANDED_TOKENS.items() for x in pair])
    tokens = F.coalesce(part["tokens"], usual[_kind(part)].cast("bigint"), F.lit(0).cast("bigint"))
    return F.struct(_kind(part).alias("kind"), part["ref"].alias("ref"), tokens.alias("tokens"))


def format_chats(turns: DataFrame) -> DataFrame:
    """One row per conversation from rows (conv_id, turn, role, parts).

    Gives conv_id, formatted, n_turns, attachments (kind, ref, tokens; in the
    order of their placeholders) and loss_mask, one (skip, take) per turn:
    after the end of the turn before, so many code points bear no loss, and so
    many after them do; the rest of the turn is its end marker.

    Turns are ordered by turn, role and parts, nulls first, so ties have one
    order; repeated rows stay turns of their own.  Rows without a conv_id are
    one conversation.  A null role is an empty one, null parts are none, a null
    kind is a document; kinds not in PLACEHOLDERS share one placeholder, and
    their attachments have the kind as given.  Other columns are left out; an
    empty table gives none.

    A conversation is one text, so its turns meet in one row; nothing else does.
    """
    pieces = turns.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("parts", F.expr(f"CAST(array() AS array<{PART}>)")).alias("parts"),
    ).select(
        "*",
        F.concat(F.lit(TURN), escape(F.col("role")), F.lit(BODY)).alias("head"),
        _body(F.col("parts")).alias("body"),
    )
    whole = pieces.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "parts", "head", "body"))).alias("turns")
    )
    return whole.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "").alias("formatted"),
        F.size("turns").cast("bigint").alias("n_turns"),
        F.transform(F.filter(F.flatten("turns.parts"), lambda p: _kind(p) != "text"), _attachment).alias("attachments"),
        F.transform(
            "turns",
            lambda t: F.struct(
                F.length(t["head"]).alias("skip"),
                F.when(t["role"] == LOSS_ROLE, F.length(t["body"])).otherwise(0).alias("take"),
            ),
        ).alias("loss_mask"),
    )


def read_chats(formatted: DataFrame) -> DataFrame:
    """Reads formatted texts back: conv_id, turns (role, text) and loss_texts, both unescaped and in order.

    Placeholders stay in the texts as they are; they have no backslash, which
    no escaped text can lack.  Of broken texts what follows the last end marker
    is left out, and a turn without a body marker is all role, with an empty text.
    """
    # The last piece is what follows the last end marker: nothing.
    pieces = formatted.select("*", _split_at(F.col("formatted"), END).alias("split_turns")).select(
        "*", F.slice("split_turns", 1, F.size("split_turns") - 1).alias("pieces")
    )

    def parsed(piece: Column) -> Column:
        halves = _split_at(F.substr(piece, F.lit(len(TURN) + 1)), BODY)
        return F.struct(unescape(halves[0]).alias("role"), unescape(F.coalesce(F.get(halves, F.lit(1)), F.lit(""))).alias("text"))

    masked = F.filter(F.arrays_zip("pieces", "loss_mask"), lambda x: x["loss_mask"]["take"] > 0)
    under = F.transform(
        masked, lambda x: unescape(F.substr(x["pieces"], x["loss_mask"]["skip"] + 1, x["loss_mask"]["take"]))
    )
    return pieces.select("conv_id", "formatted", F.transform("pieces", parsed).alias("turns"), under.alias("loss_texts"))
