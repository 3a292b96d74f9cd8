"""All derived tables from a set of sources, lazily or written out."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame, Observation, SparkSession

from chatlens.operators import contacts, messages, quality, summaries, tokens
from chatlens.schemas import SOURCE_TABLES, STATIC_SCHEMAS
from chatlens.sources.commits import TableStore
from chatlens.sources.dimensions import emoji_dim, stopword_dim
from chatlens.sources.tables import empty_table


# One line per table; a new derived table is one function and one line here.
BUILDERS: dict[str, Callable[[TableSet], DataFrame]] = {
    **{name: lambda t, schema=schema: empty_table(t.spark, schema) for name, schema in STATIC_SCHEMAS.items()},
    "stopwords": lambda t: stopword_dim(t.spark),
    "emoji_text_map": lambda t: emoji_dim(t.spark),
    "contact_group_names": lambda t: contacts.contact_group_names(t["message"]),
    "contacts_user": lambda t: contacts.contacts_user(t["contact_group_names"], t["contacts_manual"], t["contacts"]),
    "message_user": lambda t: messages.message_user(
        t["message"], t["chat"], t["chat_message_join"], t["contacts_user"]
    ),
    "message_user_text": lambda t: tokens.message_user_text(t["message_user"]),
    "message_tokens_unnest": lambda t: tokens.message_tokens_unnest(t["message_user"], t["stopwords"]),
    "message_tokens": lambda t: tokens.message_tokens(t["message_user"]),
    "message_emoji_map": lambda t: tokens.message_emoji_map(t["message_user"], t["emoji_text_map"]),
    "daily_facts": lambda t: summaries.daily_facts(t["message_user"]),
    "daily_summary_contact_from_who": lambda t: summaries.daily_summary_contact_from_who(t["daily_facts"]),
    "daily_summary_contact": lambda t: summaries.daily_summary_contact(t["daily_summary_contact_from_who"]),
    "daily_summary_from_who": lambda t: summaries.daily_summary_from_who(t["daily_summary_contact_from_who"]),
    "daily_summary": lambda t: summaries.daily_summary(t["daily_summary_contact_from_who"]),
    "summary": lambda t: summaries.summary(t["daily_summary_contact_from_who"]),
    "summary_from_who": lambda t: summaries.summary_from_who(t["daily_summary_contact_from_who"]),
    "summary_contact": lambda t: summaries.summary_contact(t["daily_facts"]),
    "summary_contact_from_who": lambda t: summaries.summary_contact_from_who(t["daily_facts"]),
    "contact_stats": lambda t: summaries.contact_stats(t["daily_facts"], t.as_of),
    "contact_daily_message_volume": lambda t: summaries.contact_daily_message_volume(t["message_user"]),
    "message_count_top_contacts": lambda t: summaries.message_count_top_contacts(t["message_user"]),
    "contact_group_chat_map": lambda t: summaries.contact_group_chat_map(t["message_user"]),
    "contact_token_usage_daily_from_who": lambda t: tokens.contact_token_usage_daily_from_who(t["message_user_text"]),
    "contact_token_usage_daily": lambda t: tokens.contact_token_usage_daily(t["contact_token_usage_daily_from_who"]),
    "contact_token_usage_from_who": lambda t: tokens.contact_token_usage_from_who(
        t["contact_token_usage_daily_from_who"]
    ),
    "contact_token_usage": lambda t: tokens.contact_token_usage(t["contact_token_usage_daily_from_who"]),
    "contact_top_token_usage_by_length": lambda t: tokens.contact_top_token_usage_by_length(
        t["contact_token_usage_from_who"]
    ),
    "qc_duplicate_chat_identifier_defs": lambda t: quality.duplicate_identifier_definitions(
        t["contact_group_names"], t["contacts_manual"], t["contacts"]
    ),
    "qc_duplicate_message_id": lambda t: quality.duplicate_message_ids(t["message_user"]),
    "qc_message_special_types": lambda t: quality.unmapped_special_types(t["message_user"]),
    "qc_missing_contact_names": lambda t: quality.missing_contact_names(t["message_user"], t["contacts_ignored"]),
    "qc_null_flags": lambda t: quality.null_flags(t["message_user"]),
}


class TableSet(Mapping):
    """Every table by name, planned on first use; nothing runs until read.

    ``given`` holds message, chat and chat_message_join, and optionally
    contacts, contacts_manual, contacts_ignored, stopwords, emoji_text_map.
    A given table replaces the derived one of the same name.
    """

    def __init__(self, spark: SparkSession, given: Mapping[str, DataFrame], as_of: dt.date | None = None):
        self.spark = spark
        self.as_of = as_of or dt.date.today()
        self._given = dict(given)
        self._tables = dict(given)

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = BUILDERS[name](self)
        return self._tables[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._given | BUILDERS)

    def __len__(self) -> int:
        return len(self._given | BUILDERS)

    def with_tables(self, **written: DataFrame) -> TableSet:
        """The same sources with some tables already written."""
        return TableSet(self.spark, self._given | written, self.as_of)


# Written by refresh_tables, in this order: all other tables are views of them.
# Written dimensions let Spark see their size and broadcast them.
WRITTEN_TABLES = {
    **dict.fromkeys((*STATIC_SCHEMAS, "stopwords", "emoji_text_map")),
    "contact_group_names": None,
    "contacts_user": None,
    "message_user": "dt",
    "daily_facts": None,
    "contact_token_usage_daily_from_who": None,
}
# Of these a batch of messages changes some days only.
DAILY_TABLES = ("message_user", "daily_facts", "contact_token_usage_daily_from_who")


def refresh_tables(tables: TableSet, out: str, observation: Observation | None = None) -> TableSet:
    """Write the tables that others are built on as one commit; return a set that reads them.

    ``out`` is a folder every executor can reach, kept as a TableStore.
    message_user is split by day, so date ranges prune files; the daily facts
    and the daily token usage are each written once and rolled up by all that
    follows.  Readers see all tables of the commit before, or all of this one.
    An observation counts two quality checks while message_user is written.
    """
    change = TableStore(tables.spark, out).refresh()
    written: dict[str, DataFrame] = {}
    for name, partition_by in WRITTEN_TABLES.items():
        df = tables.with_tables(**written)[name]
        if name == "message_user" and observation:
            df = quality.observed(df, observation)
        written[name] = change.write(name, df, partition_by)
    change.commit()
    return tables.with_tables(**written)


def committed_tables(
    spark: SparkSession, out: str, given: Mapping[str, DataFrame] | None = None, as_of: dt.date | None = None, number: int | None = None
) -> TableSet:
    """All tables as of one commit of refresh_tables, the newest by default; sources may be given, too."""
    return TableSet(spark, {**(given or {}), **TableStore(spark, out).tables(number)}, as_of)


# --- fixed values: how SQL users know the tables -----------------------------
# These keep their plain name; every other derived table is also a ..._vw view.
PLAIN_NAMES = (
    *SOURCE_TABLES,
    *STATIC_SCHEMAS,
    "stopwords",
    "emoji_text_map",
    "contact_group_names",
    "contacts_user",
    "message_user",
    "message_tokens",
    *quality.CHECKS,
)


def register_views(tables: Mapping[str, DataFrame]) -> None:
    """Expose every table under its name, and views under name_vw, to Spark SQL."""
    for name in tables:
        tables[name].createOrReplaceTempView(name)
        if name not in PLAIN_NAMES:
            tables[name].createOrReplaceTempView(f"{name}_vw")
