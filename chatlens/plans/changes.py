"""Carrying a batch of new messages through the written tables, day by day."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlens.operators import messages
from chatlens.plans.tables import DAILY_TABLES, TableSet, WRITTEN_TABLES
from chatlens.sources.commits import Commit, TableStore, on_days

#: Nanoseconds of a day, by which the range of raw dates is widened for time zones.
DAY_NANOSECONDS = 86_400 * messages.NANOSECONDS


def renamed_chats(before: DataFrame, now: DataFrame) -> DataFrame:
    """(chat_identifier) of chats whose contact differs between two contacts_user tables."""
    names = before.select("chat_identifier", F.col("contact_name").alias("old_name"), F.lit(True).alias("was"))
    both = now.withColumn("is", F.lit(True)).join(names, "chat_identifier", "full_outer")
    same = F.col("contact_name").eqNullSafe(F.col("old_name")) & F.col("was").eqNullSafe(F.col("is"))
    return both.where(~same).select("chat_identifier")


def touched_days(before: Mapping[str, DataFrame], tables: TableSet, arrived: DataFrame) -> list[str | None]:
    """Days (ISO dates, None for no date) on which a row of message_user may differ from the written one.

    ``arrived`` holds the message_id of messages that are new, changed or newly
    placed in a chat.  Touched are their days, as they were and as they are,
    those of messages they reply to, and those of chats with another name now.
    """
    ids = arrived.select("message_id").distinct()
    sent = tables["message"].select(
        F.col("ROWID").alias("message_id"), "guid", "thread_originator_guid", F.to_date(messages.message_ts(F.col("date"))).alias("dt")
    )
    fresh = sent.join(ids, "message_id", "left_semi")
    replied = fresh.select(F.col("thread_originator_guid").alias("guid")).where("guid IS NOT NULL").distinct()
    written = before["message_user"]
    renamed = renamed_chats(before["contacts_user"], tables["contacts_user"])
    days = [
        fresh.select("dt"),
        written.select("message_id", "dt").join(ids, "message_id", "left_semi").select("dt"),
        sent.join(replied, "guid", "left_semi").select("dt"),
        written.select("chat_identifier", "dt").join(renamed, "chat_identifier", "left_semi").select("dt"),
    ]
    found = reduce(DataFrame.unionAll, days).distinct().collect()  # a row for each day at most
    return sorted((str(row.dt) if row.dt else None for row in found), key=lambda day: day or "")


def messages_of(tables: TableSet, days: list[str | None]) -> DataFrame:
    """Raw messages of some days; all but days without a date also by ranges of the raw date, which reach the scan."""
    date = F.col("date")
    dated = [day for day in days if day is not None]
    wanted = on_days(F.to_date(messages.message_ts(date)), days)
    if dated and len(dated) == len(days):
        first, last = (
            (F.unix_timestamp(F.to_timestamp(F.lit(f"{day} 00:00:00"))) - messages.EPOCH_2001) * messages.NANOSECONDS for day in (min(dated), max(dated))
        )
        wanted &= (date >= first - DAY_NANOSECONDS) & (date < last + 2 * DAY_NANOSECONDS)
    return tables["message"].where(wanted)


def refresh_days(store: TableStore, tables: TableSet, arrived: DataFrame) -> Commit:
    """Commits the written tables as they are after ``arrived`` (message_id), rewriting only the days that it touches.

    ``tables`` are the sources as of now.  The result equals a full refresh.
    The tables of names are written whole; message_user, the daily facts and
    the daily token usage only on the touched days, made of messages of these
    days and the narrow columns that tell replies and chats.
    """
    change = store.refresh()
    before = {name: store.read(change.base, name) for name in change.base.tables}
    names = {name: change.write(name, tables[name]) for name in WRITTEN_TABLES if name not in DAILY_TABLES}
    current = tables.with_tables(**names)
    days = touched_days(before, current, arrived)
    if days:
        rows = messages.message_user(
            messages_of(current, days), current["chat"], current["chat_message_join"], current["contacts_user"], current["message"]
        )
        rewritten: dict[str, DataFrame] = {}
        for name in DAILY_TABLES:
            df = rows if name == "message_user" else current.with_tables(**rewritten)[name]
            rewritten[name] = change.write_days(name, df, days)
    return change.commit()
