"""Every registered query: how Spark answers it and the SQL that checks it."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlens.functions import phones
from chatlens.functions.periods import RELATIVE_RANGES, relative_range
from chatlens.operators import contacts, insights, messages, quality, stems, summaries, tokens
from chatlens.operators.display import for_display
from chatlens.plans.tables import TableSet, register_views
from chatlens.schemas import CONTACT_TYPES, MEASURES, OVERALL_TYPES, STATIC_SCHEMAS
from chatlens.sources.dimensions import BARE_CONTRACTIONS, CONTRACTIONS
from chatlens.sources.sinks import dataset_view, new_rows
from chatlens.sources.tables import check_columns
from checks import bindings, oracles
from checks.oracles import SUMS, _sum, favourites, period, resampled, resampled_by, statement, values

AS_OF = dt.date(2024, 3, 31)
START, STOP = dt.date(2024, 1, 5), dt.date(2024, 1, 20)
RANGE_SQL = f"dt BETWEEN DATE '{START}' AND DATE '{STOP}'"
SHOWN = "display_message_count"
ALL_COLUMNS = (*MEASURES, SHOWN)

CONTACT_OF = {"conversations": "Contact 18", "events": "User 8", "documents": "src1"}


class Tables:
    """All tables of one binding, built on first use."""

    def __init__(self, spark: SparkSession, folder: str, binding: str, partitions: int | None = None):
        self.spark, self.binding = spark, binding
        self.bound = bindings.Bound(spark, folder, partitions)
        self.contact = CONTACT_OF[binding]

    @cached_property
    def raw(self) -> dict[str, DataFrame]:
        return self.bound.raw_tables()

    @cached_property
    def books(self) -> list[dict[str, DataFrame]]:
        return self.bound.address_books()

    @cached_property
    def book(self) -> DataFrame:
        return contacts.all_address_books([contacts.address_book(**book) for book in self.books])

    @cached_property
    def all(self) -> TableSet:
        if self.binding == "conversations":
            given = self.raw
        else:
            text = bindings.EVENTS_MESSAGE_USER if self.binding == "events" else bindings.DOCUMENTS_MESSAGE_USER
            given = {"message_user": self.bound.sql(text)}
        return TableSet(self.spark, given, AS_OF)

    def __getitem__(self, name: str) -> DataFrame:
        return self.all[name]

    def shown(self, name: str) -> DataFrame:
        """A daily table with its display count."""
        types = CONTACT_TYPES if name == "daily_summary_contact" else OVERALL_TYPES
        return insights.select_all_types(self[name], types)


@dataclass(frozen=True)
class Query:
    answer: Callable[[Tables], DataFrame]
    check: str | Callable[[str], str]
    needs: tuple[str, ...] = ("conversations",)

    def sql(self, binding: str) -> str:
        text = self.check if isinstance(self.check, str) else self.check(CONTACT_OF[binding])
        return statement(text, binding)


CHATS = ("conversations",)
SUMMARIES = ("conversations", "events")
TEXTS = ("conversations", "documents")
EVERYWHERE = ("conversations", "events", "documents")

QUERIES: dict[str, Query] = {}


def register(name: str, check: str | Callable[[str], str], needs: tuple[str, ...] = CHATS):
    """Register the decorated function as the answer to a named query."""

    def keep(answer: Callable[[Tables], DataFrame]):
        QUERIES[name] = Query(answer, check, needs)
        return answer

    return keep


def table(name: str, check: str | Callable[[str], str], needs: tuple[str, ...] = CHATS) -> None:
    """Register a table of the plan under its own name."""
    register(name, check, needs)(lambda t: t[name])


# --- contacts ----------------------------------------------------------------------

BOOK_SQL = """
    people AS (SELECT Z_PK, coalesce(ZFIRSTNAME, '') AS first_name, coalesce(ZLASTNAME, '') AS last_name
               FROM ({people}) WHERE coalesce(ZFIRSTNAME, '') || coalesce(ZLASTNAME, '') <> ''),
    emails AS (SELECT first_name, last_name, string_agg(v, ';' ORDER BY v) AS email
               FROM (SELECT p.*, coalesce(ZADDRESS, '') AS v FROM people p JOIN email e ON p.Z_PK = e.ZOWNER)
               GROUP BY first_name, last_name),
    phones AS (SELECT first_name, last_name, string_agg(v, ';' ORDER BY v) AS phone_number
               FROM (SELECT p.*, coalesce(ZFULLNUMBER, '') AS v FROM people p JOIN phone e ON p.Z_PK = e.ZOWNER)
               GROUP BY first_name, last_name)"""


def book_sql(number: int, select: str) -> str:
    return f"WITH {BOOK_SQL.format(people=bindings.BOOK_PEOPLE[number])} {select}"


COMPACT = """SELECT coalesce(e.first_name, p.first_name) AS first_name, coalesce(e.last_name, p.last_name) AS last_name,
                    email, phone_number
             FROM emails e FULL JOIN phones p ON e.first_name = p.first_name AND e.last_name = p.last_name"""
ALL_BOOKS = f"SELECT * FROM ({book_sql(0, COMPACT)}) UNION SELECT * FROM ({book_sql(1, COMPACT)})"
NAMED = f"SELECT trim(first_name || ' ' || last_name, ' ') AS contact_name, email, phone_number FROM ({ALL_BOOKS})"
NUMBERS = f"""
    SELECT contact_name, number FROM (SELECT contact_name, unnest(string_split(phone_number, ';')) AS number FROM ({NAMED}))
    WHERE number <> ''"""
SPELLINGS = f"""
    SELECT DISTINCT contact_name, number, unnest(CASE
             WHEN len(us) = 10 THEN ['+1' || us, '(' || us[1:3] || ') ' || us[4:6] || '-' || us[7:10],
                                     '+1 ' || us[1:3] || '-' || us[4:6] || '-' || us[7:10]]
             WHEN number LIKE '+%' THEN ['+' || digits, number]
             ELSE [number] END) AS spelling
    FROM (SELECT contact_name, number, regexp_replace(number, '[^0-9]', '', 'g') AS digits,
                 CASE WHEN len(regexp_replace(number, '[^0-9]', '', 'g')) = 11
                      THEN regexp_replace(number, '[^0-9]', '', 'g')[2:11]
                      ELSE regexp_replace(number, '[^0-9]', '', 'g') END AS us
          FROM ({NUMBERS}))"""


def both_books(select: str) -> str:
    """The select over either book, with the book's number."""
    return " UNION ALL ".join(f"SELECT {number} AS book, * FROM ({book_sql(number, select)})" for number in bindings.BOOK_PEOPLE)


def of_both_books(t: Tables, of_one: Callable[[dict[str, DataFrame]], DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, (of_one(book).select(F.lit(number).alias("book"), "*") for number, book in enumerate(t.books)))


@register("address_book_emails", both_books("SELECT first_name, last_name, email FROM emails"))
def _(t):
    return of_both_books(t, lambda book: contacts.person_emails(book["person"], book["email"]))


@register("address_book_phones", both_books("SELECT first_name, last_name, phone_number FROM phones"))
def _(t):
    return of_both_books(t, lambda book: contacts.person_phones(book["person"], book["phone"]))


@register("address_book", both_books(COMPACT))
def _(t):
    return of_both_books(t, lambda book: contacts.address_book(**book))


@register("all_address_books", ALL_BOOKS)
def _(t):
    return t.book


@register(
    "address_book_split_emails",
    f"""SELECT contact_name, part FROM (SELECT contact_name, unnest(string_split(email, ';')) AS part FROM ({NAMED}))
        WHERE part <> ''""",
)
def _(t):
    return t.book.select(contacts.full_name().alias("contact_name"), F.explode(contacts.split_values("email")).alias("part"))


@register("phone_spellings", f"SELECT number, spelling FROM (SELECT DISTINCT number, spelling FROM ({SPELLINGS}))")
def _(t):
    numbers = t.book.select(F.explode(contacts.split_values("phone_number")).alias("number"))
    return numbers.select("number", F.explode(contacts.phone_spellings(F.col("number"))).alias("spelling")).distinct()


# Numbers of a British address book: 0 leads to a number at home, 00 or + abroad.
@register(
    "phone_spellings_abroad",
    f"""SELECT DISTINCT number, code, e164 FROM (
          SELECT number, whole, '+' || whole AS e164,
                 CASE WHEN whole[1] IN ('1', '7') THEN whole[1] WHEN whole[1:2] IN ({values(phones.TWO_DIGITS)}) THEN whole[1:2] ELSE whole[1:3] END AS code
          FROM (SELECT number, CASE WHEN number LIKE '+%' THEN digits WHEN digits LIKE '00%' THEN substr(digits, 3)
                                    WHEN digits LIKE '0%' THEN '44' || substr(digits, 2) ELSE '44' || digits END AS whole
                FROM (SELECT number, regexp_replace(number, '[^0-9]', '', 'g') AS digits FROM ({NUMBERS}))))
        WHERE length(whole) BETWEEN 8 AND 15 AND whole[1] <> '0' AND (whole[1] <> '1' OR length(whole) = 11)""",
)
def _(t):
    numbers = t.book.select(F.explode(contacts.split_values("phone_number")).alias("number"))
    whole = phones.international_digits(F.col("number"), "44")
    found = numbers.withColumn("whole", whole).where("whole IS NOT NULL").distinct()
    return found.select("number", phones.calling_code(F.col("whole")).alias("code"), F.concat(F.lit("+"), "whole").alias("e164"))


@register(
    "contact_map",
    f"""SELECT contact_name, spelling AS chat_identifier, 'phone' AS identifier_type FROM ({SPELLINGS}) WHERE contact_name <> 'Error'
        UNION
        SELECT contact_name, part, 'email' FROM (SELECT contact_name, unnest(string_split(email, ';')) AS part FROM ({NAMED}))
        WHERE part <> '' AND contact_name <> 'Error'""",
)
def _(t):
    return contacts.contact_map(contacts.all_address_books([contacts.identifiers(**book) for book in t.books]))


@register(
    "identifiers",
    both_books(
        """SELECT first_name, last_name, kind AS identifier_type, coalesce(held, '') AS value
           FROM people JOIN (SELECT ZOWNER, 'email' AS kind, ZADDRESS AS held FROM email
                             UNION ALL SELECT ZOWNER, 'phone', ZFULLNUMBER FROM phone) ON Z_PK = ZOWNER"""
    ),
)
def _(t):
    return of_both_books(t, lambda book: contacts.identifiers(**book))


@register(
    "contact_load_counts",
    f"""SELECT count(DISTINCT (first_name, last_name)) AS n_names,
               count(*) FILTER (WHERE trim(first_name || ' ' || last_name, ' ') <> 'Error') AS n_kept,
               count(*) FILTER (WHERE trim(first_name || ' ' || last_name, ' ') = 'Error') AS n_ignored
        FROM ({ALL_BOOKS})""",
)
def _(t):
    return contacts.contact_load_counts(t.book)


table("contact_group_names", "SELECT * FROM contact_group_names")
table("contacts_user", "SELECT * FROM contacts_user")


# --- messages ----------------------------------------------------------------------

table("message_user", "SELECT * FROM message_user")


@register("latest_chat", "SELECT message_id, chat_id FROM latest_chat")
def _(t):
    return messages.latest_chat(t.raw["chat_message_join"])


@register("thread_origins", "SELECT message_id FROM thread_origins")
def _(t):
    return messages.thread_origins(t.raw["message"])


@register(
    "chat_directory",
    """SELECT chat.ROWID AS chat_id, chat.chat_identifier, contact_name
       FROM chat LEFT JOIN contacts_user ON chat.chat_identifier = contacts_user.chat_identifier""",
)
def _(t):
    return messages.chat_directory(t.raw["chat"], t["contacts_user"])


# --- text and tokens ---------------------------------------------------------------

TOKENS_SQL = """
    SELECT message_id, ordinal_position, token, CASE WHEN s.stopword IS NULL THEN 0 ELSE 1 END AS is_stopword
    FROM token_rows LEFT JOIN stopwords s ON lower(token) = s.stopword"""

table("message_user_text", "SELECT * FROM message_user_text", EVERYWHERE)
table("message_tokens_unnest", TOKENS_SQL, EVERYWHERE)


@register("normalised_text", "SELECT message_id, text FROM normalised", TEXTS)
def _(t):
    return tokens.normalised_text(t["message_user"])


# Each piece between blanks without its last marks, these marks, and the ends of words set off.
MARKED_SQL = r"""
    SELECT message_id, list_filter(flatten(list_transform(string_split(straight, ' '), lambda piece:
             string_split_regex(replace(replace(rtrim(piece, '?.!,'), '''s', ' ''s'), '''d', ' ''d')
                                || ' ' || substr(piece, length(rtrim(piece, '?.!,')) + 1), '\s+'))), lambda word: word <> '') AS tokens
    FROM (SELECT message_id, translate(text, '‘’“”', '''''""') AS straight FROM message_user_text)"""


@register(
    "message_tokens",
    f"""SELECT message_id, CAST(unnest(range(1, len(tokens) + 1)) AS INT) AS ordinal_position, unnest(tokens) AS token
        FROM ({MARKED_SQL})""",
    TEXTS,
)
def _(t):
    exploded = t["message_tokens"].select("message_id", F.posexplode("tokens").alias("position", "token"))
    return exploded.select("message_id", (F.col("position") + 1).alias("ordinal_position"), "token")


table(
    "message_emoji_map",
    """SELECT m.message_id, coalesce(bool_or(e.emoji IS NOT NULL), FALSE) AS has_emoji
       FROM message_user m LEFT JOIN token_rows r ON m.message_id = r.message_id
       LEFT JOIN emoji_list e ON r.token = e.emoji GROUP BY m.message_id""",
    EVERYWHERE,
)

DICTIONARY_SQL = """
    SELECT d.token, CAST(length(d.token) AS INT) AS length,
           d.token IN (SELECT stopword FROM stopwords) AS is_english_stopword,
           contains('!"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~’‘“”``', d.token) AS is_punct,
           d.token IN (SELECT emoji FROM emoji_list) AS is_emoji
    FROM (SELECT DISTINCT lower(token) AS token FROM token_rows) d""".replace("\\\\", "\\")


@register("token_dictionary", DICTIONARY_SQL, TEXTS)
def _(t):
    return tokens.token_dictionary(t["message_tokens_unnest"], t["stopwords"], t["emoji_text_map"])


@register(
    "token_dictionary_new",
    DICTIONARY_SQL
    + " WHERE d.token NOT IN (SELECT lower(r.token) FROM token_rows r JOIN message_user m"
    " ON r.message_id = m.message_id WHERE m.is_from_me)",
    TEXTS,
)
def _(t):
    sent = t["message_user"].where("is_from_me")
    known = tokens.message_tokens_unnest(sent, t["stopwords"])
    return tokens.token_dictionary(t["message_tokens_unnest"], t["stopwords"], t["emoji_text_map"], existing=known)


def _words_sql(where: str, limit: str = "LIMIT 500") -> str:
    return rf"""
        WITH bare AS (SELECT regexp_replace(lower(token), '[^\p{{L}}\p{{N}}_\s]+', '', 'g') AS token, usages
                      FROM usage_from_who WHERE {where})
        SELECT token, {_sum('usages')} AS usages FROM bare
        WHERE token NOT IN ('', 's', 'd', {values(BARE_CONTRACTIONS)}) AND token NOT IN (SELECT stopword FROM stopwords)
        GROUP BY token ORDER BY usages DESC, token {limit}"""


@register("word_frequency", _words_sql("is_from_me"), TEXTS)
def _(t):
    return tokens.word_frequency(t["contact_token_usage_from_who"], t["stopwords"], limit=tokens.WORD_CLOUD_SIZE)


@register("word_frequency_all", _words_sql("is_from_me", ""), TEXTS)
def _(t):
    return tokens.word_frequency(t["contact_token_usage_from_who"], t["stopwords"])


@register("word_frequency_contact", lambda c: _words_sql(f"contact_name = '{c}' AND NOT is_from_me"), TEXTS)
def _(t):
    usage = t["contact_token_usage_from_who"]
    return tokens.word_frequency(usage, t["stopwords"], t.contact, from_me=False, limit=tokens.WORD_CLOUD_SIZE)


@register(
    "favourite_words_by_length",
    lambda c: f"""
        WITH low AS (SELECT is_from_me, lower(token) AS token, {_sum('usages')} AS usages FROM usage_from_who
                     WHERE contact_name = '{c}' AND is_from_me IS NOT NULL GROUP BY 1, 2)
        SELECT is_from_me, CAST(length(token) AS INT) AS length, token, usages FROM low
        WHERE token NOT IN (SELECT stopword FROM stopwords) AND token NOT IN ({values(CONTRACTIONS)})
          AND NOT regexp_full_match(token, '[0-9]+') AND length(token) <= 10
        QUALIFY row_number() OVER (PARTITION BY is_from_me, length(token) ORDER BY usages DESC, token) = 1""",
    TEXTS,
)
def _(t):
    return tokens.favourite_words_by_length(t["contact_token_usage_from_who"], t["stopwords"], t.contact)


table(
    "contact_top_token_usage_by_length",
    """SELECT contact_name, is_from_me, token, length AS token_length, usages AS n_token_uses FROM usage_from_who
       QUALIFY row_number() OVER (PARTITION BY contact_name, is_from_me, length ORDER BY usages DESC, token) = 1""",
    TEXTS,
)
table("contact_token_usage_daily_from_who", "SELECT * FROM usage", EVERYWHERE)
table(
    "contact_token_usage_daily",
    f"SELECT contact_name, dt, token, length, {_sum('usages')} AS usages FROM usage GROUP BY ALL",
    TEXTS,
)
table("contact_token_usage_from_who", "SELECT * FROM usage_from_who", TEXTS)
table(
    "contact_token_usage", f"SELECT contact_name, token, length, {_sum('usages')} AS usages FROM usage GROUP BY ALL", TEXTS
)


# --- summaries ---------------------------------------------------------------------

table("daily_summary_contact_from_who", "SELECT * FROM daily", EVERYWHERE)
table("daily_summary_contact", "SELECT * FROM daily_contact", SUMMARIES)
table("daily_summary_from_who", "SELECT * FROM daily_from_who", SUMMARIES)
table("daily_summary", "SELECT * FROM daily_total", SUMMARIES)
table("summary", f"SELECT {SUMS} FROM daily", SUMMARIES)
table("summary_from_who", f"SELECT is_from_me, {SUMS} FROM daily GROUP BY is_from_me", SUMMARIES)


def _lifetime_sql(*keys: str) -> str:
    names, known = ", ".join(keys), " AND ".join(f"{key} IS NOT NULL" for key in keys)
    return f"""
        SELECT {names}, {oracles.COUNTS}, {oracles.SIZES},
               count(DISTINCT dt) AS dates_messaged, min(dt) AS first_message_dt, max(dt) AS latest_message_dt,
               min(ts) FILTER (WHERE {known}) AS first_message_ts, max(ts) FILTER (WHERE {known}) AS latest_message_ts
        FROM message_user GROUP BY {names}"""


table("summary_contact", _lifetime_sql("contact_name"), EVERYWHERE)
table("summary_contact_from_who", _lifetime_sql("contact_name", "is_from_me"), SUMMARIES)


@register(
    "rollup_summary",
    f"""SELECT * FROM (
          SELECT 'day_contact' AS level, dt, contact_name, NULL AS is_from_me, {SUMS} FROM daily GROUP BY dt, contact_name
          UNION ALL SELECT 'day_side', dt, NULL, is_from_me, {SUMS} FROM daily GROUP BY dt, is_from_me
          UNION ALL SELECT 'day', dt, NULL, NULL, {SUMS} FROM daily GROUP BY dt
          UNION ALL SELECT 'side', NULL, NULL, is_from_me, {SUMS} FROM daily GROUP BY is_from_me
          UNION ALL SELECT 'total', NULL, NULL, NULL, {SUMS} FROM daily)""",
    SUMMARIES,
)
def _(t):
    return summaries.rollup_summary(t["daily_summary_contact_from_who"])


COUNTED = {
    "messages": "TRUE",
    "imessages": "service = 'iMessage'",
    "sms": "service = 'SMS'",
    "messages_containing_text": "is_text",
    "emotes": "is_emote",
    "urls": "is_url",
    "thread_origins": "is_thread_origin",
    "threaded_replies": "is_threaded_reply",
    "messages_containing_attachment": "has_attachment",
    "messages_attachment_only": "is_attachment",
    "messages_containing_attachment_image": "has_attachment_image",
    "messages_image_attachment_only": "is_attachment_image",
}
LETTERS = "CAST(sum(length(text)) FILTER (WHERE is_text AND NOT has_no_text) AS BIGINT)"
WORDS = "CAST(sum(len(string_split(text, ' '))) FILTER (WHERE is_text AND NOT has_no_text) AS BIGINT)"
table(
    "contact_stats",
    f"""SELECT contact_name, is_from_me, {", ".join(f"CAST(count_if({rule}) AS BIGINT) AS {name}" for name, rule in COUNTED.items())},
               {LETTERS} AS characters, {WORDS} AS tokens, first_message_dt, latest_message_dt,
               CAST(DATE '{AS_OF}' - latest_message_dt AS INT) AS days_since_latest_message,
               CAST(latest_message_dt - first_message_dt AS INT) AS lifetime_days, active_days
        FROM message_user
        JOIN (SELECT contact_name AS whose, is_from_me AS side, min(dt) AS first_message_dt, max(dt) AS latest_message_dt,
                     len(list_distinct(list(dt))) AS active_days FROM message_user GROUP BY ALL) spans
          ON contact_name IS NOT DISTINCT FROM whose AND is_from_me IS NOT DISTINCT FROM side
        GROUP BY contact_name, is_from_me, first_message_dt, latest_message_dt, active_days""",
    EVERYWHERE,
)
DIFFERENT = "CAST(coalesce(len(list_distinct(list(message_id) FILTER (WHERE {})) ), 0) AS BIGINT)"
table(
    "contact_daily_message_volume",
    f"""WITH days AS (
          SELECT contact_name, dt, is_from_me, {DIFFERENT.format("TRUE")} AS n_total_messages,
                 {DIFFERENT.format("is_text")} AS n_text_messages, {DIFFERENT.format("is_emote")} AS n_emote,
                 {DIFFERENT.format("is_url")} AS n_url, {LETTERS} AS n_text_characters, {WORDS} AS n_text_words
          FROM message_user WHERE contact_name IS NOT NULL AND is_text GROUP BY ALL)
        SELECT days.*, CAST(count(*) OVER busier AS INT) AS day_rank_by_n_messages_partition_by_contact FROM days
        WINDOW busier AS (PARTITION BY contact_name ORDER BY n_total_messages DESC, dt, is_from_me NULLS FIRST
                          ROWS UNBOUNDED PRECEDING)""",
    EVERYWHERE,
)
table(
    "message_count_top_contacts",
    """SELECT contact_name, count(DISTINCT message_id) AS n_messages FROM message_user WHERE contact_name IS NOT NULL
       GROUP BY contact_name ORDER BY n_messages DESC, contact_name LIMIT 100""",
    EVERYWHERE,
)
table("contact_group_chat_map", "SELECT contact_name, is_group_chat FROM group_map", SUMMARIES)


# --- quality -----------------------------------------------------------------------

DUPLICATES_SQL = """
    SELECT chat_identifier, contact_name, priority, source FROM definitions
    WHERE chat_identifier IN (SELECT chat_identifier FROM definitions GROUP BY chat_identifier HAVING count(*) > 1)"""
SPECIAL_SQL = """
    SELECT associated_message_type, CAST(NULL AS VARCHAR) AS mapped_message_special_type_in_message_user,
           count(message_id) AS n_messages
    FROM message_user WHERE message_special_type IS NULL AND associated_message_type <> 0 GROUP BY associated_message_type"""
MISSING_SQL = """
    WITH newest AS (
      SELECT chat_identifier, dt, text FROM message_user
      WHERE contact_name IS NULL AND is_text {ignored}
      QUALIFY row_number() OVER (PARTITION BY chat_identifier ORDER BY dt DESC, message_id DESC) <= 3)
    SELECT n.chat_identifier, n.dt, n.text, c.total_messages FROM newest n
    JOIN (SELECT chat_identifier, count(*) FILTER (WHERE is_text) AS total_messages FROM message_user GROUP BY chat_identifier) c
      ON n.chat_identifier = c.chat_identifier WHERE c.total_messages > {more_than}"""
NOT_IGNORED = "AND chat_identifier NOT IN (SELECT chat_identifier FROM contacts_ignored)"
NULLS_SQL = "SELECT * FROM message_user WHERE " + " OR ".join(f"{flag} IS NULL" for flag in bindings.FLAGS)
REPEATED_SQL = """
    SELECT message_id, count(*) AS n_records FROM message_user GROUP BY message_id HAVING count(*) > 1"""


def _unsound(t: Tables) -> TableSet:
    """The tables with the message table that its checks find fault with."""
    return t.all.with_tables(message_user=t.bound.sql(bindings.UNSOUND_MESSAGE_USER, message_user=t["message_user"]))


def _of_unsound(sql: str) -> str:
    return sql.replace("FROM message_user", "FROM unsound")


table("qc_duplicate_chat_identifier_defs", DUPLICATES_SQL)
register("qc_duplicate_message_id", _of_unsound(REPEATED_SQL), SUMMARIES)(lambda t: _unsound(t)["qc_duplicate_message_id"])
table("qc_message_special_types", SPECIAL_SQL, SUMMARIES)
register("qc_null_flags", _of_unsound(NULLS_SQL), SUMMARIES)(lambda t: _unsound(t)["qc_null_flags"])


@register("qc_missing_contact_names", MISSING_SQL.format(ignored=NOT_IGNORED, more_than=3))
def _(t):
    return quality.missing_contact_names(t["message_user"], t["contacts_ignored"], more_than=3)


@register("qc_missing_contact_names_default", MISSING_SQL.format(ignored="", more_than=10), ("events",))
def _(t):
    return t["qc_missing_contact_names"]


@register("qc_repeated_links", "SELECT message_id, count(*) AS n_records FROM chat_message_join GROUP BY message_id HAVING count(*) > 1")
def _(t):
    return quality.duplicate_message_ids(t.raw["chat_message_join"])


def _report_sql(checks: dict[str, str]) -> str:
    counted = " UNION ALL ".join(f"SELECT '{name}' AS check_name, count(*) AS n_rows FROM ({sql})" for name, sql in checks.items())
    return f"SELECT check_name, n_rows, n_rows > 0 AS failed FROM ({counted})"


CHECKS_SQL = {
    "qc_duplicate_chat_identifier_defs": DUPLICATES_SQL,
    "qc_duplicate_message_id": REPEATED_SQL,
    "qc_message_special_types": SPECIAL_SQL,
    "qc_missing_contact_names": MISSING_SQL.format(ignored=NOT_IGNORED, more_than=3),
    "qc_null_flags": NULLS_SQL,
}


def _report(t: Tables) -> DataFrame:
    return quality.run_quality_control(t.all, more_than=3)


register("run_quality_control", _report_sql(CHECKS_SQL))(_report)


@register("run_quality_control_of_unsound", _report_sql({name: _of_unsound(sql) for name, sql in CHECKS_SQL.items()}))
def _(t):
    return quality.run_quality_control(_unsound(t), more_than=3)


@register("failing_checks", f"SELECT count(*) AS n_failed FROM ({_report_sql(CHECKS_SQL)}) WHERE failed")
def _(t):
    return quality.failing_checks(_report(t))


@register(
    "identifier_conflicts",
    f"""SELECT chat_identifier, string_agg('name: "' || contact_name || '" (source: "' || source || '")', ' | '
                                           ORDER BY priority, contact_name) AS conflict
        FROM ({DUPLICATES_SQL}) GROUP BY chat_identifier""",
)
def _(t):
    return quality.identifier_conflicts(t["qc_duplicate_chat_identifier_defs"])


@register(
    "measure_sums_disagree",
    """SELECT dt, messages AS messages_truth,
              text_messages + emotes + messages_attachment_only + urls + app_for_imessage AS messages_challenger
       FROM daily_total WHERE messages <> messages_challenger""",
    SUMMARIES,
)
def _(t):
    return quality.measure_sums_disagree(t["daily_summary"])


# --- insights: spans, names, ranges -------------------------------------------------


@register(
    "overall_span",
    "SELECT min(dt) AS first_message_dt, max(dt) AS latest_message_dt, max(ts) AS latest_message_ts FROM message_user",
    SUMMARIES,
)
def _(t):
    return insights.overall_span(t["message_user"])


@register(
    "contact_span",
    lambda c: f"""SELECT min(dt) AS first_message_dt, max(dt) AS latest_message_dt, max(ts) AS latest_message_ts
                  FROM message_user WHERE contact_name = '{c}'""",
    SUMMARIES,
)
def _(t):
    return insights.contact_span(t["summary_contact"], t.contact)


@register(
    "contact_names",
    """SELECT DISTINCT coalesce(contact_name, chat_identifier) AS contact_name FROM message_user
       WHERE coalesce(contact_name, chat_identifier) IS NOT NULL""",
    SUMMARIES,
)
def _(t):
    return insights.contact_names(t["message_user"])


@register(
    "contact_names_without_group_chats",
    "SELECT DISTINCT contact_name FROM message_user WHERE contact_name IS NOT NULL AND NOT is_group_chat",
    SUMMARIES,
)
def _(t):
    return insights.contact_names_without_group_chats(t["message_user"])


@register("daily_in_range", f"SELECT * FROM daily_total WHERE {RANGE_SQL}", SUMMARIES)
def _(t):
    return insights.in_range(t["daily_summary"], START, STOP)


@register("daily_contact_in_range", lambda c: f"SELECT * FROM daily WHERE {RANGE_SQL} AND contact_name = '{c}'", SUMMARIES)
def _(t):
    return insights.in_range(t["daily_summary_contact_from_who"], START, STOP, t.contact)


RANGE_DAY = dt.date(2024, 1, 24)
FIRST_DAY = dt.date(2024, 1, 1)
RANGE_STARTS = {
    "Today": "DATE '2024-01-24'",
    "This week": "CAST(date_trunc('week', DATE '2024-01-24') AS DATE) - 1",
    "This month": "CAST(date_trunc('month', DATE '2024-01-24') AS DATE)",
    "This year": "CAST(date_trunc('year', DATE '2024-01-24') AS DATE)",
    "Last 60 days": "DATE '2024-01-24' - 60",
    "Last 90 days": "DATE '2024-01-24' - 90",
    "Last 6 months": "DATE '2024-01-24' - 180",
    "Last 12 months": "DATE '2024-01-24' - 365",
    "All time": "DATE '2024-01-01'",
}


@register(
    "messages_by_relative_range",
    " UNION ALL ".join(
        f"SELECT '{name}' AS range_name, {start} AS start_dt, coalesce({_sum('messages')}, 0) AS messages"
        f" FROM daily_total WHERE dt BETWEEN {start} AND DATE '2024-01-24'"
        for name, start in RANGE_STARTS.items()
    ),
    SUMMARIES,
)
def _(t):
    ranges = {name: relative_range(name, RANGE_DAY, FIRST_DAY) for name in RELATIVE_RANGES}
    totals = t["daily_summary"].agg(
        *(F.sum(F.when(F.col("dt").between(*map(F.lit, days)), F.col("messages"))).alias(name) for name, days in ranges.items())
    )
    rows = (
        F.struct(
            F.lit(name).alias("range_name"),
            F.lit(start).alias("start_dt"),
            F.coalesce(F.col(f"`{name}`"), F.lit(0)).alias("messages"),
        )
        for name, (start, _) in ranges.items()
    )
    return totals.select(F.inline(F.array(*rows)))


@register("display_count", "SELECT * FROM daily_total_shown", SUMMARIES)
def _(t):
    return t.shown("daily_summary")


@register(
    "display_count_two_types",
    "SELECT dt, contact_name, CAST(text_messages + messages_attachment_only AS BIGINT) AS display_message_count FROM daily_contact",
    SUMMARIES,
)
def _(t):
    chosen = insights.select_message_types(t["daily_summary_contact"], ["Text", "Attachment"], CONTACT_TYPES)
    return chosen.select("dt", "contact_name", SHOWN)


# --- insights: periods ----------------------------------------------------------------


def _register_periods() -> None:
    for granularity in ("Week", "Month", "Year"):
        name = granularity.lower()
        register(
            f"resample_{name}", f"SELECT * FROM {resampled('daily_total_shown', granularity, ALL_COLUMNS)}", SUMMARIES
        )(lambda t, g=granularity: insights.resample(t.shown("daily_summary"), g))
        register(
            f"resample_contact_from_who_{name}",
            f"SELECT * FROM {resampled_by('daily', granularity, ['contact_name', 'is_from_me'], MEASURES)}",
            SUMMARIES,
        )(lambda t, g=granularity: insights.resample_by(t["daily_summary_contact_from_who"], g, ["contact_name", "is_from_me"]))
    register("resample_day", "SELECT * FROM daily_total_shown", SUMMARIES)(
        lambda t: insights.resample(t.shown("daily_summary"), "Day")
    )


_register_periods()

WEEK_BY_SIDE = resampled_by("daily_from_who_shown", "Week", ["is_from_me"], ALL_COLUMNS)


@register("resample_from_who", f"SELECT * FROM {WEEK_BY_SIDE}", SUMMARIES)
def _(t):
    return insights.resample_by(t.shown("daily_summary_from_who"), "Week", ["is_from_me"])


@register(
    "resample_gaps",
    lambda c: f"""SELECT * FROM {resampled(f"(SELECT * FROM daily_contact WHERE contact_name = '{c}')", 'Week', MEASURES)}""",
    SUMMARIES,
)
def _(t):
    one = tokens.one_contact(t["daily_summary_contact"], t.contact).drop("contact_name")
    return insights.resample(one, "Week")


@register(
    "shifted_periods",
    f"""SELECT CAST(dt + INTERVAL 1 MONTH AS DATE) AS dt, {SHOWN} FROM {resampled('daily_total_shown', 'Month', [SHOWN])}""",
    SUMMARIES,
)
def _(t):
    return insights.resample(t.shown("daily_summary").select("dt", SHOWN), "Month", shift=True)


# --- insights: volumes and words --------------------------------------------------------


def _sides_sql(measure: str, source: str) -> str:
    return f"""
        WITH s AS (SELECT {_sum(measure)} AS total,
                          CAST(sum({measure}) FILTER (WHERE is_from_me) AS BIGINT) AS from_me,
                          CAST(sum({measure}) FILTER (WHERE NOT is_from_me) AS BIGINT) AS from_them FROM {source})
        SELECT *, CAST(from_me AS DOUBLE) / nullif(total, 0) AS from_me_share,
               CAST(from_them AS DOUBLE) / nullif(total, 0) AS from_them_share FROM s"""


@register("sent_received_messages", _sides_sql(SHOWN, "daily_from_who_shown"), SUMMARIES)
def _(t):
    return insights.sent_received(t.shown("daily_summary_from_who"))


@register("sent_received_words", _sides_sql("tokens", "daily_from_who"), SUMMARIES)
def _(t):
    return insights.sent_received(t["daily_summary_from_who"], "tokens")


@register(
    "sent_received_words_contact",
    lambda c: _sides_sql("tokens", f"(SELECT * FROM daily WHERE contact_name = '{c}')"),
    SUMMARIES,
)
def _(t):
    return insights.sent_received(tokens.one_contact(t["summary_contact_from_who"], t.contact), "tokens")


@register("message_volume", f"SELECT * FROM {resampled('daily_total_shown', 'Week', [SHOWN])}", SUMMARIES)
def _(t):
    return insights.message_volume(t.shown("daily_summary"), "Week")


WEEKDAYS_SQL = f"""
    SELECT dayname(dt) AS weekday, CAST(sum({SHOWN}) AS DOUBLE) / count({SHOWN}) AS average_messages
    FROM daily_total_shown GROUP BY 1"""


@register("weekday_volume", WEEKDAYS_SQL, SUMMARIES)
def _(t):
    return insights.weekday_volume(t.shown("daily_summary"))


@register("busiest_weekday", f"SELECT * FROM ({WEEKDAYS_SQL}) ORDER BY average_messages DESC, weekday LIMIT 1", SUMMARIES)
def _(t):
    return insights.busiest_weekday(t.shown("daily_summary"))


@register(
    "contact_share",
    lambda c: f"""
        WITH one AS (SELECT dt, {SHOWN} AS messages_contact
                     FROM {resampled(f"(SELECT * FROM daily_contact_shown WHERE contact_name = '{c}')", 'Week', [SHOWN])}),
             everyone AS (SELECT {period('dt', 'Week')} AS dt, {_sum(SHOWN)} AS messages_all_contacts
                          FROM daily_contact_shown WHERE contact_name IS NOT NULL GROUP BY 1)
        SELECT one.dt, messages_contact, messages_all_contacts,
               CAST(messages_contact AS DOUBLE) / nullif(messages_all_contacts, 0) AS rate
        FROM one JOIN everyone ON one.dt = everyone.dt""",
    SUMMARIES,
)
def _(t):
    return insights.contact_share(t.shown("daily_summary_contact"), t.contact, "Week")


AVERAGES_SQL = """
    SELECT is_from_me, CAST(sum(tokens) AS DOUBLE) / nullif(sum(text_messages), 0) AS words_per_message,
           CAST(sum(characters) AS DOUBLE) / nullif(sum(text_messages), 0) AS characters_per_message
    FROM {source} WHERE is_from_me IS NOT NULL GROUP BY is_from_me"""


@register("average_length", AVERAGES_SQL.format(source="daily_from_who"), SUMMARIES)
def _(t):
    return insights.average_length(t["daily_summary_from_who"])


@register(
    "average_length_contact",
    lambda c: AVERAGES_SQL.format(source=f"(SELECT * FROM daily WHERE contact_name = '{c}')"),
    SUMMARIES,
)
def _(t):
    return insights.average_length(tokens.one_contact(t["daily_summary_contact_from_who"], t.contact))


# --- insights: special messages ---------------------------------------------------------


def _kinds_sql(kinds: dict[str, str], where: str = "TRUE") -> str:
    return " UNION ALL ".join(
        f"SELECT is_from_me, dt, '{label}' AS kind, {measure} AS count FROM {WEEK_BY_SIDE} WHERE {where}"
        for measure, label in kinds.items()
    )


def _register_kinds() -> None:
    kinds = {"threads": insights.THREAD_KINDS, "apps": insights.APP_KINDS, "images": insights.IMAGE_KINDS}

    def by_week(t: Tables) -> DataFrame:
        return insights.resample_by(t.shown("daily_summary_from_who"), "Week", ["is_from_me"])

    for name, labels in kinds.items():
        register(f"{name}_by_period", _kinds_sql(labels), SUMMARIES)(
            lambda t, k=labels: insights.by_kind(by_week(t), k)
        )
        register(f"{name}_by_period_from_me", _kinds_sql(labels, "is_from_me"), SUMMARIES)(
            lambda t, k=labels: insights.by_kind(by_week(t), k, from_me_only=True)
        )
        register(
            f"{name}_highest_period",
            f"""SELECT max(total) AS max_count FROM (
                  SELECT is_from_me, dt, {_sum('count')} AS total FROM ({_kinds_sql(labels)}) GROUP BY ALL)""",
            SUMMARIES,
        )(lambda t, k=labels: insights.highest_period(insights.by_kind(by_week(t), k)))


_register_kinds()


def _tapbacks_sql(where: str) -> str:
    return f"""
        WITH labels AS (SELECT * FROM (VALUES {oracles.TAPBACK_VALUES}) v(emote, tapback)),
             sides AS (SELECT unnest([TRUE, FALSE]) AS is_from_me),
             used AS (SELECT is_from_me, message_special_type AS emote, count(*) AS n FROM message_user
                      WHERE is_emote AND {where} GROUP BY ALL)
        SELECT s.is_from_me, l.tapback, coalesce(u.n, 0) AS count
        FROM sides s CROSS JOIN labels l LEFT JOIN used u ON u.is_from_me = s.is_from_me AND u.emote = l.emote"""


@register("tapbacks", _tapbacks_sql("TRUE"), SUMMARIES)
def _(t):
    return insights.tapbacks(t["message_user"])


@register("tapbacks_contact", lambda c: _tapbacks_sql(f"contact_name = '{c}'"), SUMMARIES)
def _(t):
    return insights.tapbacks(t["message_user"], t.contact)


@register(
    "service_totals",
    f"""SELECT 'iMessage' AS medium, {_sum('imessages')} AS count FROM daily
        UNION ALL SELECT 'SMS', {_sum('sms')} FROM daily""",
    SUMMARIES,
)
def _(t):
    return insights.service_totals(t["summary"])


# --- insights: people ---------------------------------------------------------------------


def _ranking(name: str, n: int | None) -> None:
    sms = {"measure": "sms", "source": "daily_contact"}

    @register(f"sms_ranking{name}", f"SELECT * FROM {favourites(n, **sms)}", SUMMARIES)
    def _(t):
        return insights.sms_ranking(t["summary_contact_from_who"], n=n)

    @register(f"favourite_contacts{name}", f"SELECT * FROM {favourites(n)}", SUMMARIES)
    def _(t):
        return insights.favourite_contacts(t.shown("daily_summary_contact"), n=n)

    @register(f"favourite_group_chats{name}", f"SELECT * FROM {favourites(n, group_chats=True)}", SUMMARIES)
    def _(t):
        return insights.favourite_group_chats(t.shown("daily_summary_contact"), n=n)


_ranking("", 20)
_ranking("_all", None)


SERIES = resampled_by("daily_contact_shown", "Week", ["contact_name"], [SHOWN])


CUMULATIVE_SQL = f"""
    SELECT contact_name, dt, CAST(sum({SHOWN}) OVER (PARTITION BY contact_name ORDER BY dt
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS {SHOWN}
    FROM {SERIES} WHERE contact_name IN (SELECT contact_name FROM {favourites(10)})"""


@register("cumulative_volume", CUMULATIVE_SQL, SUMMARIES)
def _(t):
    return insights.cumulative_volume(t.shown("daily_summary_contact"), 10, "Week")


@register("cumulative_volume_of_given", CUMULATIVE_SQL, SUMMARIES)
def _(t):
    daily = t.shown("daily_summary_contact")
    best = insights.favourite_contacts(daily, t["contact_group_chat_map"], 10)
    return insights.cumulative_volume(daily, best, "Week")


@register(
    "volume_grid",
    f"""SELECT * FROM (
          SELECT contact_name, dt, {SHOWN}, max({SHOWN}) OVER (PARTITION BY contact_name) AS own_max,
                 max({SHOWN}) OVER () AS common_max FROM {SERIES})
        WHERE contact_name IN (SELECT contact_name FROM {favourites(9)})""",
    SUMMARIES,
)
def _(t):
    daily = t.shown("daily_summary_contact")
    best = insights.favourite_contacts(daily, t["contact_group_chat_map"], 9)
    return insights.volume_grid(daily, best, "Week")


# --- insights: one contact ----------------------------------------------------------------


@register(
    "active_days",
    lambda c: f"""
        SELECT o.active_days, a.total_active_days,
               round(CAST(o.active_days AS DOUBLE) / nullif(a.total_active_days, 0) * 100, 1) AS active_days_percent
        FROM (SELECT count(DISTINCT dt) AS active_days FROM daily_contact_shown
              WHERE contact_name = '{c}' AND {SHOWN} > 0 AND {RANGE_SQL}) o,
             (SELECT count(DISTINCT dt) AS total_active_days FROM message_user WHERE {RANGE_SQL}) a""",
    SUMMARIES,
)
def _(t):
    return insights.active_days(t.shown("daily_summary_contact"), t["message_user"], t.contact, START, STOP)


@register(
    "busiest_days",
    lambda c: f"""
        SELECT dt, {SHOWN}, CAST(row_number() OVER (ORDER BY {SHOWN} DESC, dt) AS INT) AS rank FROM daily_contact_shown
        WHERE contact_name = '{c}' ORDER BY {SHOWN} DESC, dt LIMIT 10""",
    SUMMARIES,
)
def _(t):
    return insights.busiest_days(tokens.one_contact(t.shown("daily_summary_contact"), t.contact))


@register(
    "side_by_side",
    lambda c: "SELECT dt, "
    + ", ".join(f"max({m}) FILTER (WHERE is_from_me) AS {m}_from_me" for m in MEASURES)
    + ", "
    + ", ".join(f"max({m}) FILTER (WHERE NOT is_from_me) AS {m}_from_them" for m in MEASURES)
    + f" FROM daily WHERE contact_name = '{c}' GROUP BY dt",
    SUMMARIES,
)
def _(t):
    return insights.side_by_side(t["daily_summary_contact_from_who"], t.contact)


@register(
    "chat_history",
    lambda c: f"""
        WITH newest AS (SELECT ts, text, is_from_me FROM message_user
                        WHERE is_text AND NOT has_no_text AND is_from_me IS NOT NULL AND contact_name = '{c}' AND {RANGE_SQL}
                        ORDER BY ts DESC, message_id DESC LIMIT 20)
        SELECT strftime(ts, '%b %-d ''%y at %I:%M:%S ') || lower(strftime(ts, '%p')) AS time,
               CASE WHEN is_from_me THEN '' ELSE coalesce(text, '') END AS them,
               CASE WHEN is_from_me THEN coalesce(text, '') ELSE '' END AS me FROM newest""",
    SUMMARIES,
)
def _(t):
    return insights.chat_history(t["message_user"], t.contact, START, STOP, 20)


# --- sources and sinks, as far as they are frames --------------------------------------------


@register("dataset_for_dashboard", "SELECT * FROM message_user_text", SUMMARIES)
def _(t):
    return dataset_view(t["message_user_text"])


@register(
    "new_rows",
    """SELECT nullif(r.token, ',') AS token, m.is_group_chat
       FROM token_rows r JOIN message_user m ON r.message_id = m.message_id
       EXCEPT
       SELECT nullif(r.token, '.'), m.is_group_chat
       FROM token_rows r JOIN message_user m ON r.message_id = m.message_id WHERE m.is_from_me""",
    TEXTS,
)
def _(t):
    # Repeated keys in plenty, and null ones on both sides.
    # Messages are spread by their id before they are split, so that their tokens meet the kinds where they are.
    kinds = t["message_user"].select("message_id", "is_group_chat", "is_from_me")
    spread = t.all.with_tables(message_user=t["message_user"].repartition("message_id"))
    held = spread["message_tokens_unnest"].join(kinds.hint("shuffle_hash"), "message_id")

    def keys(rows, missing):
        return rows.select(F.nullif("token", F.lit(missing)).alias("token"), "is_group_chat")

    return new_rows(keys(held, ","), keys(held.where("is_from_me"), "."), ["token", "is_group_chat"])


@register("checked_columns", "SELECT chat_identifier, contact_name FROM contacts_manual")
def _(t):
    return check_columns(t["contacts_manual"], STATIC_SCHEMAS["contacts_manual"], "contacts_manual")


@register("required_rows", f"SELECT * FROM daily_from_who WHERE {RANGE_SQL}", SUMMARIES)
def _(t):
    return quality.with_required_rows(insights.in_range(t["daily_summary_from_who"], START, STOP), "the chosen range")


@register("contacts_user_in_order", "SELECT * FROM contacts_user ORDER BY contact_name")
def _(t):
    return for_display("contacts_user", t["contacts_user"])


# --- SQL over registered views -------------------------------------------------------------


@register(
    "views_in_sql",
    f"""SELECT contact_name, {_sum('messages')} AS messages, {_sum('tokens')} AS words FROM daily_contact
        WHERE contact_name IS NOT NULL GROUP BY contact_name""",
    SUMMARIES,
)
def _(t):
    needed = ("daily_summary_contact",)
    register_views({name: t[name] for name in needed})
    return t.spark.sql(
        """SELECT contact_name, sum(messages) AS messages, sum(tokens) AS words FROM daily_summary_contact_vw
           WHERE contact_name IS NOT NULL GROUP BY contact_name"""
    )


# --- what the driver sees ------------------------------------------------------------------


def registered() -> dict[str, tuple[str, Query]]:
    """Query name -> (binding, query); conversations keep the plain name."""
    names = {}
    for name, query in QUERIES.items():
        for binding in query.needs:
            plain = binding == "conversations" or len(query.needs) == 1
            names[name if plain else f"{name}_{binding}"] = (binding, query)
    return names


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def runner(binding: str, query: Query):
        return lambda spark, folder: query.answer(Tables(spark, folder, binding))

    return {name: runner(*entry) for name, entry in registered().items()}


def oracle_statements() -> dict[str, str]:
    return {name: query.sql(binding) for name, (binding, query) in registered().items()}
