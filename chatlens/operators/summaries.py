"""Daily facts and the summaries rolled up from them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatlens.operators.tokens import is_text_message, n_characters, n_tokens
from chatlens.schemas import COUNT_MEASURES, EMOTE_MEASURES, MEASURES, TEXT_MEASURES

TOP_CONTACTS = 100


def _measure_conditions() -> dict[str, Column]:
    """What each counted measure counts."""
    labelled = F.col("message_special_type").isNotNull()
    return {
        "messages": F.lit(True),
        "text_messages": F.col("is_text"),
        "group_chat_messages": F.col("is_group_chat"),
        "group_chat_text_messages": F.col("is_text") & F.col("is_group_chat"),
        "imessages": F.col("service") == "iMessage",
        "sms": F.col("service") == "SMS",
        "emotes": F.col("is_emote"),
        **{measure: F.col("message_special_type") == label for measure, label in EMOTE_MEASURES.items()},
        "urls": F.col("is_url"),
        "app_for_imessage": labelled & ~F.col("is_emote"),
        "thread_origins": F.col("is_thread_origin"),
        "threaded_replies": F.col("is_threaded_reply"),
        "messages_containing_attachment": F.col("has_attachment"),
        "messages_attachment_only": F.col("is_attachment"),
        "messages_containing_attachment_image": F.col("has_attachment_image"),
        "messages_image_attachment_only": F.col("is_attachment_image"),
    }


def daily_facts(message_user: DataFrame) -> DataFrame:
    """All measures by day, contact and side, with the first and latest ts.

    One pass and one shuffle over the messages; every summary below rolls this
    up, so it is the table worth writing out.
    """
    conditions = _measure_conditions()
    return message_user.groupBy("dt", "contact_name", "is_from_me").agg(
        *(F.count_if(conditions[measure]).alias(measure) for measure in COUNT_MEASURES),
        F.sum(F.when(is_text_message(), n_tokens())).alias("tokens"),
        F.sum(F.when(is_text_message(), n_characters())).alias("characters"),
        F.min("ts").alias("first_message_ts"),
        F.max("ts").alias("latest_message_ts"),
    )


def _where_known(column: str, *keys: str) -> Column:
    """The column, but null where a key is null (the tables attach these
    columns by an equality join, which null keys never pass)."""
    known = F.lit(True)
    for key in keys:
        known = known & F.col(key).isNotNull()
    return F.when(known, F.col(column)).alias(column)


def daily_summary_contact_from_who(facts: DataFrame) -> DataFrame:
    """Measures by day, contact and side."""
    return _with_known_text(facts).select("dt", "contact_name", "is_from_me", *MEASURES)


def _sum_measures() -> list[Column]:
    return [F.sum(measure).alias(measure) for measure in MEASURES]


def daily_summary_contact(daily: DataFrame) -> DataFrame:
    """Measures by day and contact, from daily_summary_contact_from_who."""
    return daily.groupBy("dt", "contact_name").agg(*_sum_measures())


def daily_summary_from_who(daily: DataFrame) -> DataFrame:
    """Measures by day and side."""
    return daily.groupBy("dt", "is_from_me").agg(*_sum_measures())


def daily_summary(daily: DataFrame) -> DataFrame:
    """Measures by day."""
    return daily.groupBy("dt").agg(*_sum_measures())


def summary(daily: DataFrame) -> DataFrame:
    """Measures over everything, one row."""
    return daily.agg(*_sum_measures())


def summary_from_who(daily: DataFrame) -> DataFrame:
    """Measures by side."""
    return daily.groupBy("is_from_me").agg(*_sum_measures())


def rollup_summary(daily: DataFrame) -> DataFrame:
    """The five roll-ups in one pass; ``level`` names the grouping.

    Levels: day_contact, day_side, day, side and total.
    """
    day, contact, side = F.col("dt"), F.col("contact_name"), F.col("is_from_me")
    level = (
        F.when(F.grouping_id() == 1, "day_contact")
        .when(F.grouping_id() == 2, "day_side")
        .when(F.grouping_id() == 3, "day")
        .when(F.grouping_id() == 6, "side")
        .otherwise("total")
    )
    sets = [[day, contact], [day, side], [day], [side], []]
    return daily.groupingSets(sets, day, contact, side).agg(level.alias("level"), *_sum_measures())


def _lifetime(facts: DataFrame, *keys: str) -> DataFrame:
    """Measures, active days and first/latest day and time per key.

    Summing by day first leaves one row per key and day, so the number of days
    is a plain count and no distinct count has to be shuffled.
    """
    totals = _sum_measures()
    first = F.min("first_message_ts").alias("first_message_ts")
    latest = F.max("latest_message_ts").alias("latest_message_ts")
    by_day = facts.groupBy(*keys, "dt").agg(*totals, first, latest) if "is_from_me" not in keys else facts
    return by_day.groupBy(*keys).agg(
        *totals,
        F.count("dt").alias("dates_messaged"),
        F.min("dt").alias("first_message_dt"),
        F.max("dt").alias("latest_message_dt"),
        first,
        latest,
    )


def _with_known_text(facts: DataFrame) -> DataFrame:
    """Facts whose text measures are null where the day, contact or side is."""
    keys = ("dt", "contact_name", "is_from_me")
    return facts.withColumns({measure: _where_known(measure, *keys) for measure in TEXT_MEASURES})


def _summary_by(facts: DataFrame, *keys: str) -> DataFrame:
    """Lifetime summary; first and latest ts are null where a key is null."""
    lifetime = _lifetime(_with_known_text(facts), *keys)
    ts_columns = ("first_message_ts", "latest_message_ts")
    return lifetime.withColumns({column: _where_known(column, *keys) for column in ts_columns})


def summary_contact(facts: DataFrame) -> DataFrame:
    """Measures, active days, first and latest day and time by contact."""
    return _summary_by(facts, "contact_name")


def summary_contact_from_who(facts: DataFrame) -> DataFrame:
    """Measures, active days, first and latest day and time by contact and side."""
    return _summary_by(facts, "contact_name", "is_from_me")


def contact_stats(facts: DataFrame, as_of: dt.date) -> DataFrame:
    """Lifetime statistics by contact and side, with day differences to
    ``as_of`` and between the first and the latest message."""
    lifetime = _lifetime(facts, "contact_name", "is_from_me")
    return lifetime.select(
        "contact_name",
        "is_from_me",
        "messages",
        "characters",
        "tokens",
        "imessages",
        "sms",
        F.col("text_messages").alias("messages_containing_text"),
        "emotes",
        "urls",
        "thread_origins",
        "threaded_replies",
        "messages_containing_attachment",
        "messages_attachment_only",
        "messages_containing_attachment_image",
        "messages_image_attachment_only",
        "first_message_dt",
        "latest_message_dt",
        F.datediff(F.lit(as_of), "latest_message_dt").alias("days_since_latest_message"),
        F.datediff("latest_message_dt", "first_message_dt").alias("lifetime_days"),
        F.col("dates_messaged").alias("active_days"),
    )


def contact_daily_message_volume(message_user: DataFrame) -> DataFrame:
    """Text messages by contact, day and side, with the rank of the row within
    its contact.

    The window runs over the aggregate: a contact has at most three rows a day.
    """
    volume = (
        message_user.where(F.col("is_text") & F.col("contact_name").isNotNull())
        .groupBy("contact_name", "dt", "is_from_me")
        .agg(
            F.count("message_id").alias("n_total_messages"),
            F.count_if("is_text").alias("n_text_messages"),
            F.count_if("is_emote").alias("n_emote"),
            F.count_if("is_url").alias("n_url"),
            F.sum(F.when(is_text_message(), n_characters())).alias("n_text_characters"),
            F.sum(F.when(is_text_message(), n_tokens())).alias("n_text_words"),
        )
    )
    busiest = Window.partitionBy("contact_name").orderBy(F.desc("n_total_messages"), "dt", "is_from_me")
    return volume.withColumn("day_rank_by_n_messages_partition_by_contact", F.row_number().over(busiest))


def message_count_top_contacts(message_user: DataFrame, limit: int = TOP_CONTACTS) -> DataFrame:
    """(contact_name, n_messages): the contacts with most messages."""
    return (
        message_user.where(F.col("contact_name").isNotNull())
        .groupBy("contact_name")
        .agg(F.count("message_id").alias("n_messages"))
        .orderBy(F.desc("n_messages"), "contact_name")
        .limit(limit)
    )


def contact_group_chat_map(message_user: DataFrame) -> DataFrame:
    """Distinct (contact_name, is_group_chat) of named contacts."""
    return message_user.where(F.col("contact_name").isNotNull()).select("contact_name", "is_group_chat").distinct()
