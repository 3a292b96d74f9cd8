"""The message table: one cleaned, labelled row per message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlens.functions.text import REPLACEMENT_CHARACTER, clean_text
from chatlens.schemas import EMOTE_LABELS, MESSAGE_USER_COLUMNS

# --- fixed values: epoch of message dates -----------------------------------
NANOSECONDS = 1_000_000_000
EPOCH_2001 = 978_307_200  # 2001-01-01 in Unix seconds


def message_ts(date: Column) -> Column:
    """Nanoseconds since 2001-01-01 as a timestamp of whole seconds."""
    whole_seconds = F.call_function("div", date, F.lit(NANOSECONDS))
    return F.timestamp_seconds(whole_seconds + F.lit(EPOCH_2001))


def three_valued(flag: Column) -> Column:
    """1 and 0 as a boolean, everything else as null."""
    return F.when(flag == 1, True).when(flag == 0, False)


def surely(condition: Column) -> Column:
    """The condition with unknown read as false."""
    return F.coalesce(condition, F.lit(False))


def special_type(kind: Column, bundle: Column, text: Column, attached: Column, detected: Column) -> Column:
    """Label of a message that is not plain text; the first rule that fits wins.

    Matches ignore case, but for the names of the two games and '(null)'.
    """
    bundle, words = F.lower(bundle), F.lower(text)
    in_app, notice = kind.isin(2, 3), kind == 3
    # --- fixed values: the rules, in order ----------------------------------
    rules = [
        (bundle.endswith("peerpaymentmessagesextension"), "apple_cash"),
        ((kind == 2) & bundle.contains("imessagepoll"), "poll"),
        (in_app & bundle.contains("gamepigeon"), "game_pigeon"),
        (in_app & bundle.contains("messages.business.extension"), "business_extension"),
        (
            notice & words.rlike(r"(earned an achievement|completed a workout|closed all three activity rings)\.\z"),
            "activity",
        ),
        (notice & words.like("requested % with apple pay."), "apple_cash"),
        (notice & words.rlike("poll|voted"), "poll"),
        (notice & text.isin("Cup Pong", "8 Ball"), "game_pigeon"),
        (notice & (text == "(null)"), "null_message"),
        ((kind == 1000) & (attached == 1) & (detected == 1), "sticker"),
        *((kind == code, label) for code, label in EMOTE_LABELS.items()),
    ]
    (condition, label), *others = rules
    labelled = F.when(condition, label)
    for condition, label in others:
        labelled = labelled.when(condition, label)
    return labelled


def latest_chat(chat_message_join: DataFrame) -> DataFrame:
    """(message_id, chat_id): the newest chat of each message; equal dates are
    decided by the lower chat id."""
    newest = F.max(F.struct("message_date", (-F.col("chat_id")).alias("minus_chat_id")))
    return (
        chat_message_join.groupBy("message_id")
        .agg(newest.alias("newest"))
        .select("message_id", (-F.col("newest.minus_chat_id")).alias("chat_id"))
    )


def chat_directory(chat: DataFrame, contacts_user: DataFrame) -> DataFrame:
    """(chat_id, chat_identifier, contact_name) of every chat."""
    names = contacts_user.select("chat_identifier", "contact_name")
    return chat.select(F.col("ROWID").alias("chat_id"), "chat_identifier").join(names, "chat_identifier", "left")


def thread_origins(message: DataFrame) -> DataFrame:
    """(message_id) of messages that some message replies to.

    Only ids and guids are shuffled.  The last distinct leaves the ids spread
    by message_id, which the join with the messages needs anyway.
    """
    replied = message.select(F.col("thread_originator_guid").alias("guid")).where("guid IS NOT NULL").distinct()
    origins = message.select(F.col("ROWID").alias("message_id"), "guid")
    return origins.join(replied, "guid", "left_semi").select("message_id").distinct()


def message_user(
    message: DataFrame, chat: DataFrame, chat_message_join: DataFrame, contacts_user: DataFrame, replies: DataFrame | None = None
) -> DataFrame:
    """One row per message that lies in a chat, in MESSAGE_USER_COLUMNS order.

    Chat and contact are attached to the narrow (message_id, chat_id) pairs
    first, so the wide message rows cross the network once, by message_id.
    ``message`` may be some messages only; ``replies`` then holds all of them.
    """
    placed = latest_chat(chat_message_join).join(chat_directory(chat, contacts_user), "chat_id").drop("chat_id")
    origins = thread_origins(message if replies is None else replies).withColumn("is_origin", F.lit(True))

    kind = F.col("associated_message_type")
    cleaned = message.select(
        F.col("ROWID").alias("message_id"),
        message_ts(F.col("date")).alias("ts"),
        # A generator's output: filters on what is made from the words stop
        # here, and do not bring the whole cleaning along.
        F.inline(F.array(F.struct(clean_text(F.col("text")).alias("words")))),
        "associated_message_type",
        "balloon_bundle_id",
        "service",
        three_valued(F.col("is_from_me")).alias("is_from_me"),
        F.col("thread_originator_guid").isNotNull().alias("is_threaded_reply"),
        "cache_has_attachments",
        "was_data_detected",
    )

    # A URL shows in the first six characters, so only those are lower-cased.
    starts_url = F.lower(F.substring("words", 1, 6)).rlike("^https?:")
    labelled = cleaned.select(
        "message_id",
        "ts",
        "words",
        "service",
        "is_from_me",
        "associated_message_type",
        "is_threaded_reply",
        surely(kind.isin(*EMOTE_LABELS)).alias("is_emote"),
        special_type(
            kind, F.col("balloon_bundle_id"), F.col("words"), F.col("cache_has_attachments"), F.col("was_data_detected")
        ).alias("message_special_type"),
        surely(starts_url).alias("is_url"),
        F.coalesce(F.length("words") == 0, F.lit(True)).alias("has_no_text"),
        surely(F.col("cache_has_attachments") == 1).alias("attached"),
    )

    flagged = (
        labelled.withColumn(
            "is_text",
            ~F.col("is_emote") & ~F.col("is_url") & F.col("message_special_type").isNull() & ~F.col("has_no_text"),
        )
        .withColumn("has_attachment", F.col("attached") & ~F.col("is_emote"))
        .withColumn(
            "has_attachment_image",
            F.col("has_attachment") & ~F.col("is_url") & F.col("message_special_type").isNull(),
        )
        .withColumn("is_attachment", F.col("has_attachment") & ~F.col("is_url") & ~F.col("is_text"))
        .withColumn("is_attachment_image", F.col("has_attachment_image") & ~F.col("is_text"))
        .withColumn("dt", F.to_date("ts"))
        .withColumn(
            "text",
            F.when(
                ~F.col("has_no_text")
                & ~F.col("is_emote")
                & ~F.col("is_url")
                & (F.col("words") != REPLACEMENT_CHARACTER),
                F.col("words"),
            ),
        )
    )

    return (
        flagged.join(placed, "message_id")
        .join(origins, "message_id", "left")
        .withColumn("is_group_chat", surely(F.lower("chat_identifier").startswith("chat")))
        .withColumn("is_thread_origin", surely(F.col("is_origin")))
        .withColumn("thread_original_message_id", F.when(F.col("is_origin"), F.col("message_id")))
        .select(*MESSAGE_USER_COLUMNS)
    )
