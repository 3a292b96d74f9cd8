"""Text messages, tokens, token usage and word tables.

Stop word and emoji tables hold each word once, as their keys declare.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlens.functions import text as words
from chatlens.sources.dimensions import BARE_CONTRACTIONS, CONTRACTIONS

WORD_CLOUD_SIZE = 500
LONGEST_FAVOURITE = 10


def is_text_message() -> Column:
    return F.col("is_text") & ~F.col("has_no_text")


def n_characters() -> Column:
    return F.length("text")


def n_tokens() -> Column:
    return words.word_count(F.col("text"))


def message_user_text(message_user: DataFrame) -> DataFrame:
    """Text messages with their length in characters and words."""
    return message_user.where(is_text_message()).select(
        "message_id",
        "chat_identifier",
        "contact_name",
        "ts",
        "dt",
        "text",
        n_characters().alias("n_characters"),
        n_tokens().alias("n_tokens"),
        "service",
        "is_from_me",
        "is_group_chat",
        "is_threaded_reply",
        "thread_original_message_id",
    )


def normalised_text(message_user: DataFrame) -> DataFrame:
    """(message_id, text) of text messages, ready to be split on spaces."""
    return message_user.where(is_text_message()).select(
        "message_id", words.normalise_text(F.col("text")).alias("text")
    )


def message_tokens_unnest(message_user: DataFrame, stopwords: DataFrame) -> DataFrame:
    """(message_id, ordinal_position, token, is_stopword), one row per token."""
    exploded = message_user.where(is_text_message()).select(
        "message_id", F.posexplode(words.tokens(F.col("text"))).alias("position", "token")
    )
    stops = stopwords.select("stopword")
    return exploded.join(stops, F.lower("token") == F.col("stopword"), "left").select(
        "message_id",
        (F.col("position") + 1).alias("ordinal_position"),
        "token",
        F.when(F.col("stopword").isNotNull(), 1).otherwise(0).alias("is_stopword"),
    )


def message_tokens(message_user: DataFrame) -> DataFrame:
    """(message_id, tokens) with marks set off only at the end of a word."""
    return message_user.where(is_text_message()).select(
        "message_id", words.marked_tokens(F.col("text")).alias("tokens")
    )


def message_emoji_map(message_user: DataFrame, emoji: DataFrame) -> DataFrame:
    """(message_id, has_emoji) of each row: does any token equal an emoji.

    Messages without tokens are false.  The emoji come as one array, and the
    last characters of all of them as one pattern, so a message is judged
    inside its row, and its tokens are looked at only if such a character occurs.
    """
    last = F.array_sort(F.collect_set(F.ascii(F.substring("emoji", -1, 1))))
    pattern = emoji.agg(F.when(F.count("emoji") > 0, words.one_of(last)).otherwise("(?!)")).scalar()
    known = emoji.agg(F.collect_set("emoji")).scalar()
    likely = is_text_message() & (F.regexp_instr("text", pattern) > 0)
    found = F.when(likely, F.arrays_overlap(words.tokens(F.col("text")), known))
    return message_user.select("message_id", F.coalesce(found, F.lit(False)).alias("has_emoji"))


def token_dictionary(
    tokens: DataFrame, stopwords: DataFrame, emoji: DataFrame, existing: DataFrame | None = None
) -> DataFrame:
    """(token, length, is_english_stopword, is_punct, is_emoji) of every
    lower-cased token that the existing dictionary does not hold."""
    distinct = tokens.select(F.lower("token").alias("token")).distinct()
    if existing is not None:
        distinct = distinct.join(existing.select(F.lower("token").alias("token")), "token", "left_anti")
    stops = stopwords.select(F.col("stopword").alias("token")).withColumn("stop", F.lit(True))
    known = emoji.select(F.col("emoji").alias("token")).withColumn("picture", F.lit(True))
    return (
        distinct.join(stops, "token", "left")
        .join(known, "token", "left")
        .select(
            "token",
            F.length("token").alias("length"),
            F.col("stop").isNotNull().alias("is_english_stopword"),
            words.is_punctuation(F.col("token")).alias("is_punct"),
            F.col("picture").isNotNull().alias("is_emoji"),
        )
    )


def contact_token_usage_daily_from_who(message_user_text: DataFrame) -> DataFrame:
    """Messages that hold a token, by contact, day, side and token.

    Repeats within a message are removed inside its row, so counting rows
    counts messages and nothing but partial counts is shuffled.
    """
    held = message_user_text.select(
        "contact_name", "dt", "is_from_me", F.explode(F.array_distinct(words.tokens(F.col("text")))).alias("token")
    )
    return (
        held.groupBy("contact_name", "dt", "is_from_me", "token")
        .agg(F.count(F.lit(1)).alias("usages"))
        .select("contact_name", "dt", "is_from_me", "token", F.length("token").alias("length"), "usages")
    )


def _sum_usages(usage: DataFrame, *keys: str) -> DataFrame:
    return usage.groupBy(*keys, "token", "length").agg(F.sum("usages").alias("usages"))


def contact_token_usage_daily(usage: DataFrame) -> DataFrame:
    """Usages by contact, day and token."""
    return _sum_usages(usage, "contact_name", "dt")


def contact_token_usage_from_who(usage: DataFrame) -> DataFrame:
    """Usages by contact, side and token; named contacts only."""
    return _sum_usages(usage.where(F.col("contact_name").isNotNull()), "contact_name", "is_from_me")


def contact_token_usage(usage: DataFrame) -> DataFrame:
    """Usages by contact and token, the unnamed contact included."""
    return _sum_usages(usage, "contact_name")


def _without(df: DataFrame, stopwords: DataFrame, contractions: tuple[str, ...]) -> DataFrame:
    """Rows whose token is neither a stop word nor one of the contractions."""
    stops = stopwords.select(F.col("stopword").alias("token"))
    return df.where(~F.col("token").isin(*contractions)).join(stops, "token", "left_anti")


def one_side(df: DataFrame, from_me: bool | None) -> DataFrame:
    """Rows of one side, or all rows for None."""
    return df if from_me is None else df.where(F.col("is_from_me") == F.lit(from_me))


def one_contact(df: DataFrame, contact: str | None) -> DataFrame:
    """Rows of one contact, or all rows for None."""
    return df if contact is None else df.where(F.col("contact_name") == F.lit(contact))


def word_frequency(
    usage_from_who: DataFrame,
    stopwords: DataFrame,
    contact: str | None = None,
    from_me: bool | None = True,
    limit: int | None = None,
) -> DataFrame:
    """(token, usages), most used first: all words, or the ``limit`` that a word cloud shows."""
    chosen = one_side(one_contact(usage_from_who, contact), from_me)
    counted = (
        chosen.select(words.bare_word(F.col("token")).alias("token"), "usages")
        .where(F.col("token") != "")
        .groupBy("token")
        .agg(F.sum("usages").alias("usages"))
    )
    ordered = _without(counted, stopwords, BARE_CONTRACTIONS).orderBy(F.desc("usages"), "token")
    return ordered if limit is None else ordered.limit(limit)


def favourite_words_by_length(
    usage_from_who: DataFrame, stopwords: DataFrame, contact: str, longest: int = LONGEST_FAVOURITE
) -> DataFrame:
    """(is_from_me, length, token, usages): the most used word of each length."""
    lowered = (
        one_contact(usage_from_who, contact)
        .where(F.col("is_from_me").isNotNull())
        .groupBy("is_from_me", F.lower("token").alias("token"))
        .agg(F.sum("usages").alias("usages"))
        .where(~F.col("token").rlike("^[0-9]+$") & (F.length("token") <= longest))
    )
    kept = _without(lowered, stopwords, CONTRACTIONS).withColumn("length", F.length("token"))
    return _most_used(kept, "is_from_me", "length")


def contact_top_token_usage_by_length(usage_from_who: DataFrame) -> DataFrame:
    """(contact_name, is_from_me, token, token_length, n_token_uses): the most
    used token of each length, contact and side."""
    return _most_used(usage_from_who, "contact_name", "is_from_me", "length").select(
        "contact_name",
        "is_from_me",
        "token",
        F.col("length").alias("token_length"),
        F.col("usages").alias("n_token_uses"),
    )


def _most_used(usage: DataFrame, *keys: str) -> DataFrame:
    """The token with most usages per key; equal usages are decided by the
    token.  An aggregate, so a key with many tokens is combined before the
    shuffle."""
    best = F.min(F.struct((-F.col("usages")).alias("minus_usages"), "token"))
    return (
        usage.groupBy(*keys)
        .agg(best.alias("best"))
        .select(*keys, "best.token", (-F.col("best.minus_usages")).alias("usages"))
    )
