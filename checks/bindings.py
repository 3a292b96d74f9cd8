"""Message logs derived from the given tables.

The texts below are plain SQL that Spark and DuckDB read alike, so both sides
start from the same rows.  ``conversations`` becomes a full set of raw tables
in which every kind of message occurs; ``events`` and ``documents`` become
larger message tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from chatlens.schemas import MESSAGE_USER_COLUMNS

GIVEN_TABLES = ("conversations", "documents", "events", "customer", "nation")

# Emoji of every kind that the messages hold, and what looks like one: a star,
# and two letters that name no region.
PLANTED_EMOJI = ("👍", "👍🏽", "1\ufe0f\u20e3", "👨\u200d👩\u200d👧", "🏴\U000e0067\U000e0062\U000e0065\U000e006e\U000e0067\U000e007f", "🇫🇷")
NO_EMOJI = ("★", "🇦🇦")

# One row per turn with its ids and the case it plays.  Some conversations lie
# up to three years back.
TURNS = """
SELECT conv_id, turn, role, text AS own_text,
       conv_id * 100 + turn AS rid,
       (conv_id * 31 + turn * 17) % 40 AS k,
       (725760000 + conv_id * 21600 + turn * 60 - CASE WHEN conv_id % 4 = 1 THEN conv_id % 37 * 2246400 ELSE 0 END) * 1000000000 + 123456789 AS sent
FROM conversations
"""

MESSAGE = """
SELECT rid AS ROWID,
       'g' || rid AS guid,
       sent AS date,
       CASE k
         WHEN 0 THEN CASE WHEN conv_id % 2 = 0 THEN 'HTTPS://example.com/' ELSE 'http://example.com/' END || rid
         WHEN 1 THEN ''
         WHEN 2 THEN NULL
         WHEN 3 THEN '�'
         WHEN 4 THEN 'Reacted to “' || own_text || '”'
         WHEN 5 THEN 'Removed a reaction from “' || own_text || '”'
         WHEN 6 THEN CASE WHEN conv_id % 2 = 0 THEN 'Cup Pong' ELSE '8 Ball' END
         WHEN 10 THEN '￼'
         WHEN 12 THEN 'cup pong'
         WHEN 13 THEN own_text || ' {EMOJI_TEXT} ok'
         WHEN 14 THEN '‘It''s’ fine, she''d said “yes”?! 3.14 ' || own_text || ' end?!'
         WHEN 15 THEN '  ￼' || own_text || chr(13) || chr(10) || 'next line  with  gaps '
         WHEN 17 THEN CASE conv_id % 3 WHEN 0 THEN 'Sam EARNED an achievement.'
                                       WHEN 1 THEN 'Sam completed a workout.'
                                       ELSE 'Sam closed all three activity rings.' END
         WHEN 18 THEN CASE WHEN conv_id % 2 = 0 THEN 'Sam voted for tea' ELSE 'New Poll: tea' END
         WHEN 19 THEN 'requested $5 with Apple Pay.'
         WHEN 20 THEN '(null)'
         WHEN 21 THEN 'The THE the I''ll don''t 42 ' || own_text
         ELSE own_text
       END AS text,
       CAST(CASE
         WHEN k = 4 THEN 2000 + conv_id % 6
         WHEN k = 5 THEN 3000 + conv_id % 6
         WHEN k IN (6, 12, 17, 18, 19, 20) THEN 3
         WHEN k IN (7, 16) THEN 2
         WHEN k = 9 THEN 1000
         WHEN k = 22 THEN 3
         WHEN k = 23 THEN NULL
         ELSE 0
       END AS INT) AS associated_message_type,
       CASE k
         WHEN 7 THEN 'com.apple.messages.MSMessageExtensionBalloonPlugin:0000000000:com.gamerdelights.GamePigeon.ext'
         WHEN 8 THEN 'com.apple.messages.MSMessageExtensionBalloonPlugin:0000000000:com.apple.PassbookUIService.PeerPaymentMessagesExtension'
         WHEN 16 THEN 'com.example.iMessagePoll.ext'
         WHEN 22 THEN 'com.apple.Messages.Business.Extension'
         ELSE NULL
       END AS balloon_bundle_id,
       CASE WHEN conv_id % 5 = 0 THEN 'SMS' ELSE 'iMessage' END AS service,
       CAST(CASE role WHEN 'user' THEN 1 WHEN 'assistant' THEN 0 ELSE NULL END AS INT) AS is_from_me,
       CASE WHEN turn % 3 = 2 THEN 'g' || (conv_id * 100) ELSE NULL END AS thread_originator_guid,
       CAST(CASE WHEN k IN (0, 4, 9, 10, 11) THEN 1 WHEN k = 24 THEN NULL ELSE 0 END AS INT) AS cache_has_attachments,
       CAST(CASE WHEN k = 9 THEN 1 ELSE 0 END AS INT) AS was_data_detected,
       CASE WHEN conv_id % 4 = 0 THEN 'chat' || conv_id ELSE NULL END AS cache_roomnames,
       CASE WHEN conv_id % 8 = 0 AND turn IN (0, 3) THEN 'Group ' || conv_id || '-' || turn ELSE NULL END AS group_title
FROM turns
""".replace("{EMOJI_TEXT}", " ".join(PLANTED_EMOJI + NO_EMOJI))

CONVERSATION_IDS = "SELECT DISTINCT conv_id FROM conversations"

CHAT = """
SELECT conv_id AS ROWID,
       CASE WHEN conv_id % 4 = 0 THEN 'chat' || conv_id
            ELSE '+1415555' || substring('0000' || conv_id, length('0000' || conv_id) - 3, 4) END AS chat_identifier
FROM conversation_ids
"""

# A second, older chat for every turn 1; one turn in some chats lies in none.
CHAT_MESSAGE_JOIN = """
SELECT conv_id AS chat_id, rid AS message_id, sent AS message_date
FROM turns WHERE NOT (conv_id % 11 = 5 AND turn = 2)
UNION ALL
SELECT conv_id - 1 AS chat_id, rid AS message_id, sent - 1 AS message_date
FROM turns WHERE turn = 1 AND conv_id > 0
"""

CONTACTS = """
SELECT 'Contact ' || (ROWID % 20) AS contact_name, chat_identifier, 'phone' AS identifier_type
FROM chat WHERE ROWID % 4 <> 0 AND ROWID % 7 <> 0
"""

CONTACTS_MANUAL = """
SELECT chat_identifier, 'Manual ' || ROWID AS contact_name
FROM chat WHERE ROWID % 14 = 7 OR ROWID % 30 = 1 OR ROWID % 40 = 0
"""

CONTACTS_IGNORED = """
SELECT chat_identifier, 'not a person' AS notes FROM chat WHERE ROWID % 21 = 0
"""

PERSON = """
SELECT c_custkey AS Z_PK,
       CASE WHEN c_custkey % 9 = 4 THEN NULL WHEN c_custkey % 50 = 7 THEN 'Error' ELSE n_name END AS ZFIRSTNAME,
       CASE WHEN c_custkey % 50 = 7 OR c_custkey % 45 = 4 THEN NULL ELSE c_name END AS ZLASTNAME,
       c_custkey % 2 AS book
FROM customer JOIN nation ON c_nationkey = n_nationkey
"""

LINE_NUMBER = "substring('0000' || (c_custkey % 10000), length('0000' || (c_custkey % 10000)) - 3, 4)"

PHONE = f"""
SELECT c_custkey AS ZOWNER,
       CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE '(415) 555-' || {LINE_NUMBER} END AS ZFULLNUMBER
FROM customer
UNION ALL
SELECT c_custkey AS ZOWNER,
       CASE c_custkey % 4 WHEN 0 THEN '+1 628 555 ' || {LINE_NUMBER}
                          WHEN 1 THEN '1628555' || {LINE_NUMBER}
                          WHEN 2 THEN '+44 20 7946 ' || {LINE_NUMBER}
                          ELSE '555-' || {LINE_NUMBER} END AS ZFULLNUMBER
FROM customer WHERE c_custkey % 3 = 0
"""

EMAIL = """
SELECT c_custkey AS ZOWNER,
       CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE 'c' || c_custkey || '@example.com' END AS ZADDRESS
FROM customer WHERE c_custkey % 13 <> 1
UNION ALL
SELECT c_custkey AS ZOWNER, 'work' || c_custkey || '@example.org' AS ZADDRESS
FROM customer WHERE c_custkey % 6 = 1
"""

# Every tenth person stands in both books.
BOOK_PEOPLE = {
    0: "SELECT Z_PK, ZFIRSTNAME, ZLASTNAME FROM person WHERE book = 0 OR Z_PK % 10 = 1",
    1: "SELECT Z_PK, ZFIRSTNAME, ZLASTNAME FROM person WHERE book = 1 OR Z_PK % 10 = 0",
}

EVENTS_MESSAGE_USER = """
WITH e AS (
  SELECT event_id, ts, user_id, event_type, event_id % 6 AS six, event_id % 17 AS k,
         CASE WHEN event_type = 'click' THEN TRUE ELSE FALSE END AS is_emote,
         CASE WHEN event_type = 'signup' AND event_id % 17 = 3 THEN TRUE ELSE FALSE END AS is_url,
         CASE WHEN event_type = 'error' THEN TRUE ELSE FALSE END AS is_app,
         CASE WHEN event_type = 'purchase' AND event_id % 17 < 9 THEN TRUE ELSE FALSE END AS has_no_text,
         event_type || ' ' || props || ', user ' || user_id || '''s event!' AS words
  FROM events
), f AS (
  SELECT e.*, NOT is_emote AND NOT is_url AND NOT is_app AND NOT has_no_text AS is_text,
         CASE WHEN NOT is_emote AND (event_type = 'purchase' OR k = 5) THEN TRUE ELSE FALSE END AS has_attachment,
         CASE WHEN is_emote AND k < 11 THEN
                CASE six WHEN 0 THEN 'emote_love' WHEN 1 THEN 'emote_like' WHEN 2 THEN 'emote_dislike'
                         WHEN 3 THEN 'emote_laugh' WHEN 4 THEN 'emote_emphasis' ELSE 'emote_question' END
              WHEN is_emote THEN
                CASE six WHEN 0 THEN 'emote_remove_heart' WHEN 1 THEN 'emote_remove_like'
                         WHEN 2 THEN 'emote_remove_dislike' WHEN 3 THEN 'emote_remove_laugh'
                         WHEN 4 THEN 'emote_remove_emphasis' ELSE 'emote_remove_question' END
              WHEN is_app THEN 'game_pigeon'
              ELSE NULL END AS message_special_type
  FROM e
)
SELECT event_id AS message_id,
       CASE WHEN user_id % 10 = 3 THEN 'chat' || user_id ELSE 'user' || user_id END AS chat_identifier,
       CASE WHEN user_id % 10 = 7 THEN NULL ELSE 'User ' || user_id END AS contact_name,
       ts,
       CAST(ts AS DATE) AS dt,
       CASE WHEN is_emote OR is_url OR has_no_text THEN NULL ELSE words END AS text,
       CASE WHEN user_id % 4 = 0 THEN 'SMS' ELSE 'iMessage' END AS service,
       CASE WHEN event_id % 50 = 49 THEN NULL ELSE event_id % 2 = 0 END AS is_from_me,
       user_id % 10 = 3 AS is_group_chat,
       is_text, has_no_text, is_emote, message_special_type,
       CAST(CASE WHEN is_emote AND k < 11 THEN 2000 + six WHEN is_emote THEN 3000 + six
                 WHEN is_app OR k = 16 THEN 3 ELSE 0 END AS INT) AS associated_message_type,
       is_url,
       k = 2 AS is_thread_origin,
       k = 4 AS is_threaded_reply,
       CASE WHEN k = 2 THEN event_id ELSE NULL END AS thread_original_message_id,
       has_attachment,
       has_attachment AND NOT is_url AND NOT is_text AS is_attachment,
       has_attachment AND NOT is_url AND message_special_type IS NULL AS has_attachment_image,
       has_attachment AND NOT is_url AND message_special_type IS NULL AND NOT is_text AS is_attachment_image
FROM f
"""

DOCUMENTS_MESSAGE_USER = """
WITH d AS (
  SELECT doc_id, source, lang,
         trim(BOTH ' ' FROM replace(replace(replace(text, '￼', ''), chr(13), ' '), chr(10), ' ')) AS words,
         DATE '2024-01-01' + CAST(doc_id % 90 AS INT) AS day
  FROM documents
)
SELECT doc_id AS message_id,
       source AS chat_identifier,
       CASE WHEN source = 'src3' THEN NULL ELSE source END AS contact_name,
       CAST(day AS TIMESTAMP) AS ts,
       day AS dt,
       CASE WHEN words = '' THEN NULL ELSE words END AS text,
       'iMessage' AS service,
       CASE WHEN doc_id % 25 = 24 THEN NULL ELSE doc_id % 2 = 0 END AS is_from_me,
       FALSE AS is_group_chat,
       coalesce(words <> '', FALSE) AS is_text,
       coalesce(words = '', TRUE) AS has_no_text,
       FALSE AS is_emote,
       CAST(NULL AS VARCHAR(10)) AS message_special_type,
       CAST(0 AS INT) AS associated_message_type,
       FALSE AS is_url, FALSE AS is_thread_origin, FALSE AS is_threaded_reply,
       CAST(NULL AS BIGINT) AS thread_original_message_id,
       FALSE AS has_attachment, FALSE AS is_attachment, FALSE AS has_attachment_image, FALSE AS is_attachment_image
FROM d
"""


FLAGS = (
    "is_from_me", "is_text", "is_url", "is_group_chat", "is_emote",
    "has_no_text", "has_attachment", "is_attachment", "has_attachment_image", "is_attachment_image",
)
_blanked = {flag: f"CASE WHEN message_id % 23 = {k} THEN NULL ELSE {flag} END AS {flag}" for k, flag in enumerate(FLAGS)}
_columns = ", ".join(_blanked.get(name, name) for name in MESSAGE_USER_COLUMNS)

# The message table with what its checks look for: nulls in every flag, and messages that stand there twice.
UNSOUND_MESSAGE_USER = f"""
SELECT {_columns} FROM message_user
UNION ALL SELECT {", ".join(MESSAGE_USER_COLUMNS)} FROM message_user WHERE message_id % 9 = 4
"""


class Bound:
    """The shared SQL read by Spark over the tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str, partitions: int | None = None):
        self.spark = spark
        self.folder = folder
        self.partitions = partitions

    def given(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return df.repartition(self.partitions) if self.partitions and name == "documents" else df

    def sql(self, text: str, **tables: DataFrame) -> DataFrame:
        """Run a shared text; the names after FROM and JOIN are given tables
        or the frames passed here."""
        frames = {name: self.given(name) for name in GIVEN_TABLES if re.search(rf"(FROM|JOIN) {name}\b", text)}
        frames |= tables
        for name in frames:
            text = re.sub(rf"(FROM|JOIN) {name}\b", rf"\1 {{{name}}}", text)
        return self.spark.sql(text, **frames)

    def raw_tables(self) -> dict[str, DataFrame]:
        turns = self.sql(TURNS)
        chat = self.sql(CHAT, conversation_ids=self.sql(CONVERSATION_IDS))
        return {
            "message": self.sql(MESSAGE, turns=turns),
            "chat": chat,
            "chat_message_join": self.sql(CHAT_MESSAGE_JOIN, turns=turns),
            "contacts": self.sql(CONTACTS, chat=chat),
            "contacts_manual": self.sql(CONTACTS_MANUAL, chat=chat),
            "contacts_ignored": self.sql(CONTACTS_IGNORED, chat=chat),
        }

    def address_books(self) -> list[dict[str, DataFrame]]:
        person, phone, email = self.sql(PERSON), self.sql(PHONE), self.sql(EMAIL)
        return [
            {"person": self.sql(people, person=person), "phone": phone, "email": email}
            for people in BOOK_PEOPLE.values()
        ]
