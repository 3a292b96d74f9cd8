"""Fixed schemas, measure names and labels shared by all operators."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: names of the catalogued source tables -------------------
SOURCE_TABLES = (
    "_SqliteDatabaseProperties",
    "attachment",
    "chat",
    "chat_handle_join",
    "chat_message_join",
    "deleted_messages",
    "handle",
    "kvtable",
    "message",
    "message_attachment_join",
    "message_processing_task",
    "sqlite_sequence",
    "sqlite_stat1",
    "sync_deleted_attachments",
    "sync_deleted_chats",
    "sync_deleted_messages",
)


_TYPES = {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType()}


def _struct(spec: str) -> T.StructType:
    """'name type, ...' as a schema; needs no running session."""
    columns = (column.split() for column in spec.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in columns])


# Only the columns some operator reads; the Parquet scan prunes the rest.
SOURCE_SCHEMAS = {
    "message": _struct(
        "ROWID long, guid string, date long, text string, associated_message_type int, "
        "balloon_bundle_id string, service string, is_from_me int, "
        "thread_originator_guid string, cache_has_attachments int, "
        "was_data_detected int, cache_roomnames string, group_title string"
    ),
    "chat": _struct("ROWID long, chat_identifier string"),
    "chat_message_join": _struct("chat_id long, message_id long, message_date long"),
}

STATIC_SCHEMAS = {
    "contacts": _struct("contact_name string, chat_identifier string, identifier_type string"),
    "contacts_manual": _struct("chat_identifier string, contact_name string"),
    "contacts_ignored": _struct("chat_identifier string, notes string"),
}

DIMENSION_SCHEMAS = {
    "emoji_text_map": _struct("emoji string, plain_text string"),
    "stopwords": _struct("stopword string"),
}

ADDRESS_BOOK_SCHEMAS = {
    "person": _struct("Z_PK long, ZFIRSTNAME string, ZLASTNAME string"),
    "phone": _struct("ZOWNER long, ZFULLNUMBER string"),
    "email": _struct("ZOWNER long, ZADDRESS string"),
}

MESSAGE_USER_COLUMNS = (
    "message_id",
    "chat_identifier",
    "contact_name",
    "ts",
    "dt",
    "text",
    "service",
    "is_from_me",
    "is_group_chat",
    "is_text",
    "has_no_text",
    "is_emote",
    "message_special_type",
    "associated_message_type",
    "is_url",
    "is_thread_origin",
    "is_threaded_reply",
    "thread_original_message_id",
    "has_attachment",
    "is_attachment",
    "has_attachment_image",
    "is_attachment_image",
)

# --- fixed values: message type codes and labels ---------------------------
EMOTE_LABELS = {
    2000: "emote_love",
    2001: "emote_like",
    2002: "emote_dislike",
    2003: "emote_laugh",
    2004: "emote_emphasis",
    2005: "emote_question",
    3000: "emote_remove_heart",
    3001: "emote_remove_like",
    3002: "emote_remove_dislike",
    3003: "emote_remove_laugh",
    3004: "emote_remove_emphasis",
    3005: "emote_remove_question",
}


def tapback_label(emote: str) -> str:
    """Display label of an emote: 'emote_remove_heart' -> 'Remove Heart'."""
    return emote.removeprefix("emote_").replace("_", " ").title()


TAPBACK_LABELS = {emote: tapback_label(emote) for emote in sorted(EMOTE_LABELS.values())}

# --- fixed values: names of the daily measures -----------------------------
# The measure of 'emote_remove_heart' is called emotes_remove_love.
EMOTE_MEASURES = {
    "emotes_love": "emote_love",
    "emotes_likes": "emote_like",
    "emotes_dislikes": "emote_dislike",
    "emotes_laugh": "emote_laugh",
    "emotes_emphasis": "emote_emphasis",
    "emotes_question": "emote_question",
    "emotes_remove_love": "emote_remove_heart",
    "emotes_remove_like": "emote_remove_like",
    "emotes_remove_dislike": "emote_remove_dislike",
    "emotes_remove_laugh": "emote_remove_laugh",
    "emotes_remove_emphasis": "emote_remove_emphasis",
    "emotes_remove_question": "emote_remove_question",
}

COUNT_MEASURES = (
    "messages",
    "text_messages",
    "group_chat_messages",
    "group_chat_text_messages",
    "imessages",
    "sms",
    "emotes",
    *EMOTE_MEASURES,
    "urls",
    "app_for_imessage",
    "thread_origins",
    "threaded_replies",
    "messages_containing_attachment",
    "messages_attachment_only",
    "messages_containing_attachment_image",
    "messages_image_attachment_only",
)

TEXT_MEASURES = ("tokens", "characters")

MEASURES = COUNT_MEASURES + TEXT_MEASURES

# --- fixed values: measures behind the message-type choices ----------------
# "Attachment" counts image-only messages on the overall page and any
# attachment-only message on the page of one contact.
OVERALL_TYPES = {
    "Text": "text_messages",
    "Emote": "emotes",
    "Attachment": "messages_image_attachment_only",
    "URL": "urls",
    "App for iMessage": "app_for_imessage",
}
CONTACT_TYPES = {**OVERALL_TYPES, "Attachment": "messages_attachment_only"}
