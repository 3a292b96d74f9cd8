"""The same questions in plain SQL, as named steps that build on each other.

Steps are written from the meaning of the tables (windows, joins, FILTER), not
from the Spark plans, so that the two sides check each other.
"""

from __future__ import annotations

import re

from chatlens.schemas import COUNT_MEASURES, EMOTE_LABELS, EMOTE_MEASURES, MEASURES, TAPBACK_LABELS
from chatlens.sources.dimensions import STOPWORDS
from checks import bindings


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values(words) -> str:
    return ", ".join(quoted(word) for word in words)


def _sum(column: str) -> str:
    return f"CAST(sum({column}) AS BIGINT)"


SUMS = ", ".join(f"{_sum(m)} AS {m}" for m in MEASURES)

CONDITIONS = {
    "messages": "TRUE",
    "text_messages": "is_text",
    "group_chat_messages": "is_group_chat",
    "group_chat_text_messages": "is_text AND is_group_chat",
    "imessages": "service = 'iMessage'",
    "sms": "service = 'SMS'",
    "emotes": "is_emote",
    **{measure: f"message_special_type = '{label}'" for measure, label in EMOTE_MEASURES.items()},
    "urls": "is_url",
    "app_for_imessage": "message_special_type IS NOT NULL AND NOT is_emote",
    "thread_origins": "is_thread_origin",
    "threaded_replies": "is_threaded_reply",
    "messages_containing_attachment": "has_attachment",
    "messages_attachment_only": "is_attachment",
    "messages_containing_attachment_image": "has_attachment_image",
    "messages_image_attachment_only": "is_attachment_image",
}
#: What a text counts where all keys of its day are known.
SIZED = "is_text AND NOT has_no_text AND dt IS NOT NULL AND contact_name IS NOT NULL AND is_from_me IS NOT NULL"
SIZES = f"""CAST(sum(len(string_split(text, ' '))) FILTER (WHERE {SIZED}) AS BIGINT) AS tokens,
            CAST(sum(length(text)) FILTER (WHERE {SIZED}) AS BIGINT) AS characters"""
COUNTS = ", ".join(f"count(*) FILTER (WHERE {CONDITIONS[m]}) AS {m}" for m in COUNT_MEASURES)


EMOTE_CASES = " ".join(f"WHEN {code} THEN '{label}'" for code, label in EMOTE_LABELS.items())

# Steps shared by all bindings; message_user differs.
STEPS = {
    "turns": bindings.TURNS,
    "message": bindings.MESSAGE,
    "conversation_ids": bindings.CONVERSATION_IDS,
    "chat": bindings.CHAT,
    "chat_message_join": bindings.CHAT_MESSAGE_JOIN,
    "contacts": bindings.CONTACTS,
    "contacts_manual": bindings.CONTACTS_MANUAL,
    "contacts_ignored": bindings.CONTACTS_IGNORED,
    "person": bindings.PERSON,
    "phone": bindings.PHONE,
    "email": bindings.EMAIL,
    "stopwords": f"SELECT unnest([{values(STOPWORDS)}]) AS stopword",
    "emoji_list": f"SELECT unnest([{values(bindings.PLANTED_EMOJI)}]) AS emoji",
    "contact_group_names": """
        SELECT cache_roomnames AS chat_identifier, group_title AS group_name
        FROM message WHERE cache_roomnames IS NOT NULL AND group_title IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY cache_roomnames ORDER BY message.date DESC, group_title) = 1""",
    "definitions": """
        SELECT DISTINCT chat_identifier, contact_name, priority, source
        FROM (SELECT 'contact_group_names' AS source, chat_identifier, group_name AS contact_name FROM contact_group_names
              UNION ALL BY NAME SELECT 'contacts_manual' AS source, chat_identifier, contact_name FROM contacts_manual
              UNION ALL BY NAME SELECT 'contacts' AS source, chat_identifier, contact_name FROM contacts)
        JOIN (VALUES ('contact_group_names', 1), ('contacts_manual', 2), ('contacts', 3)) ranks(source, priority) USING (source)""",
    "contacts_user": """
        SELECT chat_identifier, contact_name, source FROM definitions
        QUALIFY row_number() OVER (PARTITION BY chat_identifier ORDER BY priority, contact_name) = 1""",
    "latest_chat": """
        SELECT message_id, chat_id FROM chat_message_join
        QUALIFY row_number() OVER (PARTITION BY message_id ORDER BY message_date DESC, chat_id) = 1""",
    "thread_origins": """
        SELECT message.ROWID AS message_id FROM message
        WHERE guid IN (SELECT thread_originator_guid FROM message WHERE thread_originator_guid IS NOT NULL)""",
    "cleaned": """
        SELECT message.ROWID AS message_id,
               make_timestamp((message.date // 1000000000 + 978307200) * 1000000) AS ts,
               trim(replace(replace(replace(text, '￼', ''), chr(13), ' '), chr(10), ' '), ' ') AS words,
               associated_message_type AS kind, balloon_bundle_id AS bundle, service,
               CASE is_from_me WHEN 1 THEN TRUE WHEN 0 THEN FALSE END AS is_from_me,
               thread_originator_guid IS NOT NULL AS is_threaded_reply,
               cache_has_attachments, was_data_detected
        FROM message""",
    # The rules of labels, in order.
    "labelled": f"""
        SELECT cleaned.*,
               coalesce(kind BETWEEN 2000 AND 2005 OR kind BETWEEN 3000 AND 3005, FALSE) AS is_emote,
               coalesce(regexp_matches(words, '^https?:', 'i'), FALSE) AS is_url,
               coalesce(words, '') = '' AS has_no_text,
               CASE
                 WHEN bundle ILIKE '%PeerPaymentMessagesExtension' THEN 'apple_cash'
                 WHEN kind = 2 AND bundle ILIKE '%imessagepoll%' THEN 'poll'
                 WHEN kind IN (2, 3) AND bundle ILIKE '%gamepigeon%' THEN 'game_pigeon'
                 WHEN kind IN (2, 3) AND bundle ILIKE '%messages.business.extension%' THEN 'business_extension'
                 WHEN kind = 3 AND regexp_matches(words, '(earned an achievement|completed a workout|closed all three activity rings)\\.$', 'i') THEN 'activity'
                 WHEN kind = 3 AND words ILIKE 'requested % with apple pay.' THEN 'apple_cash'
                 WHEN kind = 3 AND regexp_matches(words, 'poll|voted', 'i') THEN 'poll'
                 WHEN kind = 3 AND words IN ('Cup Pong', '8 Ball') THEN 'game_pigeon'
                 WHEN kind = 3 AND words = '(null)' THEN 'null_message'
                 WHEN kind = 1000 AND cache_has_attachments = 1 AND was_data_detected = 1 THEN 'sticker'
                 ELSE CASE kind {EMOTE_CASES} END
               END AS message_special_type
        FROM cleaned""",
    "unsound": bindings.UNSOUND_MESSAGE_USER,
    "message_user": """
        WITH typed AS (
          SELECT labelled.*, NOT (is_emote OR is_url OR has_no_text) AND message_special_type IS NULL AS is_text,
                 coalesce(cache_has_attachments = 1, FALSE) AND NOT is_emote AS has_attachment
          FROM labelled
        )
        SELECT t.message_id, chat.chat_identifier, u.contact_name, t.ts, CAST(t.ts AS DATE) AS dt,
               CASE WHEN has_no_text OR is_emote OR is_url OR words = '�' THEN NULL ELSE words END AS text,
               service, is_from_me, coalesce(chat.chat_identifier ILIKE 'chat%', FALSE) AS is_group_chat,
               is_text, has_no_text, is_emote, message_special_type, kind AS associated_message_type, is_url,
               o.message_id IS NOT NULL AS is_thread_origin, is_threaded_reply,
               o.message_id AS thread_original_message_id, has_attachment,
               has_attachment AND NOT is_url AND NOT is_text AS is_attachment,
               has_attachment AND NOT is_url AND message_special_type IS NULL AS has_attachment_image,
               has_attachment AND NOT is_url AND message_special_type IS NULL AND NOT is_text AS is_attachment_image
        FROM typed t
        JOIN latest_chat l ON l.message_id = t.message_id
        JOIN chat ON chat.ROWID = l.chat_id
        LEFT JOIN contacts_user u ON u.chat_identifier = chat.chat_identifier
        LEFT JOIN thread_origins o ON o.message_id = t.message_id""",
    "message_user_text": """
        SELECT message_id, chat_identifier, contact_name, ts, dt, text,
               CAST(length(text) AS INT) AS n_characters, CAST(len(string_split(text, ' ')) AS INT) AS n_tokens,
               service, is_from_me, is_group_chat, is_threaded_reply, thread_original_message_id
        FROM message_user WHERE is_text AND NOT has_no_text""",
    "normalised": """
        SELECT message_id,
               regexp_replace(
                 replace(replace(translate(text, '‘’“”', '''''""'), '''s', ' ''s'), '''d', ' ''d'),
                 '([.,!?])', ' \\1 ', 'g') AS text
        FROM message_user_text""",
    "token_rows": """
        SELECT message_id, CAST(unnest(range(1, len(l) + 1)) AS INT) AS ordinal_position, unnest(l) AS token
        FROM (SELECT message_id, list_filter(string_split(text, ' '), lambda x: x <> '') AS l FROM normalised)""",
    "usage": """
        SELECT m.contact_name, m.dt, m.is_from_me, t.token, CAST(length(t.token) AS INT) AS length,
               count(DISTINCT m.message_id) AS usages
        FROM message_user_text m JOIN token_rows t ON m.message_id = t.message_id
        GROUP BY m.contact_name, m.dt, m.is_from_me, t.token""",
    "usage_from_who": f"""
        SELECT contact_name, is_from_me, token, length, {_sum('usages')} AS usages
        FROM usage WHERE contact_name IS NOT NULL GROUP BY ALL""",
    "daily": f"""
        WITH m AS (SELECT dt, contact_name, is_from_me, {COUNTS} FROM message_user GROUP BY dt, contact_name, is_from_me),
             t AS (SELECT dt, contact_name, is_from_me, {_sum('n_tokens')} AS tokens, {_sum('n_characters')} AS characters
                   FROM message_user_text GROUP BY dt, contact_name, is_from_me)
        SELECT m.*, t.tokens, t.characters
        FROM m LEFT JOIN t ON m.dt = t.dt AND m.contact_name = t.contact_name AND m.is_from_me = t.is_from_me""",
    "daily_contact": f"SELECT dt, contact_name, {SUMS} FROM daily GROUP BY dt, contact_name",
    "daily_from_who": f"SELECT dt, is_from_me, {SUMS} FROM daily GROUP BY dt, is_from_me",
    "daily_total": f"SELECT dt, {SUMS} FROM daily GROUP BY dt",
    "group_map": "SELECT DISTINCT contact_name, is_group_chat FROM message_user WHERE contact_name IS NOT NULL",
}

for _name, _members in {"daily_total": "overall", "daily_contact": "contact", "daily_from_who": "overall"}.items():
    _third = "messages_attachment_only" if _members == "contact" else "messages_image_attachment_only"
    STEPS[f"{_name}_shown"] = (
        f"SELECT *, CAST(coalesce(text_messages, 0) + coalesce(emotes, 0) + coalesce({_third}, 0) + coalesce(urls, 0)"
        f" + coalesce(app_for_imessage, 0) AS BIGINT) AS display_message_count FROM {_name}"
    )

MESSAGE_USER_OF = {
    "conversations": STEPS["message_user"],
    "events": bindings.EVENTS_MESSAGE_USER,
    "documents": bindings.DOCUMENTS_MESSAGE_USER,
}


def statement(select: str, binding: str = "conversations") -> str:
    """The select preceded by every step it needs, in order."""
    steps = STEPS | {"message_user": MESSAGE_USER_OF[binding]}
    needed: list[str] = []

    def add(text: str) -> None:
        for name in steps:
            if re.search(rf"(FROM|JOIN|,) {name}\b", text) and name not in needed:
                add(steps[name])
                if name not in needed:
                    needed.append(name)

    add(select)
    if not needed:
        return select
    if select.lstrip().startswith("WITH"):
        select = f"SELECT * FROM ({select})"
    return "WITH " + ",\n".join(f"{name} AS ({steps[name]})" for name in needed) + "\n" + select


# --- SQL fragments used by several questions -------------------------------------


def period(column: str, granularity: str) -> str:
    if granularity == "Day":
        return column
    if granularity == "Week":
        return f"CAST({column} + CAST((7 - dayofweek({column})) % 7 AS INT) AS DATE)"
    return f"CAST(date_trunc('{granularity.lower()}', {column}) AS DATE)"


def resampled(source: str, granularity: str, columns) -> str:
    """A filled series: every period from the first to the last."""
    step = {"Week": "INTERVAL 7 DAY", "Month": "INTERVAL 1 MONTH", "Year": "INTERVAL 1 YEAR"}[granularity]
    sums = ", ".join(f"{_sum(c)} AS {c}" for c in columns)
    filled = ", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in columns)
    return f"""
        (WITH p AS (SELECT {period('dt', granularity)} AS dt, {sums} FROM {source} GROUP BY 1),
              calendar AS (SELECT CAST(unnest(generate_series(CAST(min(dt) AS TIMESTAMP), CAST(max(dt) AS TIMESTAMP), {step})) AS DATE) AS dt FROM p)
         SELECT calendar.dt, {filled} FROM calendar LEFT JOIN p ON calendar.dt = p.dt)"""


def resampled_by(source: str, granularity: str, keys, columns) -> str:
    sums = ", ".join(f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}" for c in columns)
    known = " AND ".join(f"{key} IS NOT NULL" for key in keys)
    names = ", ".join(keys)
    return f"(SELECT {names}, {period('dt', granularity)} AS dt, {sums} FROM {source} WHERE {known} GROUP BY ALL)"


def favourites(n: int | None, group_chats: bool = False, measure: str = "display_message_count", source: str = "daily_contact_shown") -> str:
    """The n contacts with most messages, or all, and their rank."""
    return f"""
        (SELECT s.contact_name, {_sum(measure)} AS {measure},
                CAST(row_number() OVER (ORDER BY sum({measure}) DESC, s.contact_name) AS INT) AS rank
         FROM {source} s JOIN group_map g ON s.contact_name = g.contact_name
         WHERE {'g.is_group_chat' if group_chats else 'NOT g.is_group_chat'}
         GROUP BY s.contact_name
         {'HAVING sum(sms) > 0' if measure == 'sms' else ''}
         ORDER BY sum({measure}) DESC, s.contact_name {f'LIMIT {n}' if n else ''})"""


TAPBACK_VALUES = ", ".join(f"({quoted(emote)}, {quoted(label)})" for emote, label in TAPBACK_LABELS.items())
