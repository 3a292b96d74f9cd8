"""Dashboard questions answered from the summaries.

Rows without a contact or a side are left out wherever rows are grouped by it.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatlens.functions.periods import next_period, period_of, period_step
from chatlens.operators.tokens import is_text_message, one_contact
from chatlens.schemas import CONTACT_TYPES, MEASURES, OVERALL_TYPES, TAPBACK_LABELS

DISPLAY_COUNT = "display_message_count"
BUSIEST_DAYS = 10


# --- spans, pick lists and filters -------------------------------------------


def overall_span(message_user: DataFrame) -> DataFrame:
    """One row: first day, latest day and latest time of all messages."""
    return message_user.agg(
        F.min("dt").alias("first_message_dt"),
        F.max("dt").alias("latest_message_dt"),
        F.max("ts").alias("latest_message_ts"),
    )


def contact_span(summary_contact: DataFrame, contact: str) -> DataFrame:
    """One row: first day, latest day and latest time of a contact."""
    return one_contact(summary_contact, contact).select("first_message_dt", "latest_message_dt", "latest_message_ts")


def contact_names(message_user: DataFrame) -> DataFrame:
    """Sorted names to choose from: the contact, else the chat identifier."""
    name = F.coalesce("contact_name", "chat_identifier").alias("contact_name")
    return message_user.select(name).where("contact_name IS NOT NULL").distinct().orderBy("contact_name")


def contact_names_without_group_chats(message_user: DataFrame) -> DataFrame:
    """Sorted names of contacts met outside group chats."""
    alone = ~F.col("is_group_chat") & F.col("contact_name").isNotNull()
    return message_user.where(alone).select("contact_name").distinct().orderBy("contact_name")


def in_range(df: DataFrame, start: dt.date, stop: dt.date, contact: str | None = None) -> DataFrame:
    """Rows from ``start`` to ``stop``, both included, of one contact or all."""
    return one_contact(df, contact).where(F.col("dt").between(F.lit(start), F.lit(stop)))


def select_message_types(df: DataFrame, types: Iterable[str], measures: dict[str, str] = OVERALL_TYPES) -> DataFrame:
    """The frame with the sum of the chosen message types as display count.

    ``measures`` is OVERALL_TYPES or CONTACT_TYPES.
    """
    chosen = [F.coalesce(measures[kind], F.lit(0)) for kind in types]
    return df.withColumn(DISPLAY_COUNT, reduce(lambda a, b: a + b, chosen, F.lit(0).cast("long")))


def select_all_types(df: DataFrame, measures: dict[str, str] = OVERALL_TYPES) -> DataFrame:
    return select_message_types(df, measures, measures)


# --- resampling ----------------------------------------------------------------


def _measures_of(df: DataFrame) -> list[str]:
    return [column for column in df.columns if column in MEASURES or column == DISPLAY_COUNT]


def _period_sums(df: DataFrame, granularity: str, keys: Sequence[str] = ()) -> DataFrame:
    sums = [F.coalesce(F.sum(measure), F.lit(0)).alias(measure) for measure in _measures_of(df)]
    return df.groupBy(*keys, period_of(F.col("dt"), granularity).alias("dt")).agg(*sums)


def _shifted(df: DataFrame, granularity: str, shift: bool) -> DataFrame:
    return df.withColumn("dt", next_period(F.col("dt"), granularity)) if shift else df


def resample(daily: DataFrame, granularity: str, shift: bool = False) -> DataFrame:
    """A daily series by week, month or year, empty periods filled with 0.

    Days are returned as they are.  ``shift`` moves every label on by one
    period.
    """
    if granularity == "Day":
        return _shifted(daily, granularity, shift)
    sums = _period_sums(daily.where(F.col("dt").isNotNull()), granularity)
    # Each period is repeated up to the next one that has rows; the repeats
    # count 0.  The window sees one row per period: as long as the calendar,
    # not as the data.
    following = F.lead("dt").over(Window.orderBy("dt"))
    empty_after = F.sequence("dt", F.coalesce(following, F.col("dt")), period_step(granularity))
    until_next = F.when(following.isNull(), empty_after).otherwise(F.slice(empty_after, 1, F.size(empty_after) - 1))
    measures = _measures_of(sums)
    repeated = sums.withColumn("periods", until_next).select(
        F.posexplode("periods").alias("position", "period"), *measures
    )
    filled = repeated.select(
        F.col("period").alias("dt"),
        *(F.when(F.col("position") == 0, F.col(measure)).otherwise(0).alias(measure) for measure in measures),
    )
    return _shifted(filled, granularity, shift)


def resample_by(daily: DataFrame, granularity: str, keys: Sequence[str], shift: bool = False) -> DataFrame:
    """A daily series by period within each group; only periods that occur."""
    known = daily.dropna(subset=list(keys))
    return _shifted(_period_sums(known, granularity, keys), granularity, shift)


# --- volumes and words ----------------------------------------------------------


def sent_received(daily_from_who: DataFrame, measure: str = DISPLAY_COUNT) -> DataFrame:
    """One row: total, sent and received, and both shares of the total.

    ``measure`` is a message count, or 'tokens' for words.
    """
    sent = F.sum(F.when(F.col("is_from_me"), F.col(measure)))
    received = F.sum(F.when(~F.col("is_from_me"), F.col(measure)))
    return daily_from_who.agg(
        F.sum(measure).alias("total"), sent.alias("from_me"), received.alias("from_them")
    ).withColumns(
        {
            "from_me_share": F.try_divide("from_me", "total"),
            "from_them_share": F.try_divide("from_them", "total"),
        }
    )


def message_volume(daily: DataFrame, granularity: str, shift: bool = False) -> DataFrame:
    """(dt, display_message_count) by period, in order."""
    return resample(daily.select("dt", DISPLAY_COUNT), granularity, shift).orderBy("dt")


def weekday_volume(daily: DataFrame) -> DataFrame:
    """(weekday, average) of the display count over active days."""
    weekday = F.date_format("dt", "EEEE").alias("weekday")
    return daily.groupBy(weekday).agg(F.avg(DISPLAY_COUNT).alias("average_messages"))


def busiest_weekday(daily: DataFrame) -> DataFrame:
    """The weekday with the highest average; equal ones by name."""
    return weekday_volume(daily).orderBy(F.desc("average_messages"), "weekday").limit(1)


def contact_share(daily_contact: DataFrame, contact: str, granularity: str) -> DataFrame:
    """Share of a contact in all contacts' messages by period.

    Periods run from the contact's first to its last one, as far as anyone
    wrote in them.  Both sums come from one pass; the window that finds the
    contact's span sees one row per period.
    """
    own = F.col("contact_name") == F.lit(contact)
    everyone = Window.partitionBy()
    by_period = (
        daily_contact.where(F.col("contact_name").isNotNull() & F.col("dt").isNotNull())
        .groupBy(period_of(F.col("dt"), granularity).alias("dt"))
        .agg(
            F.coalesce(F.sum(F.when(own, F.col(DISPLAY_COUNT))), F.lit(0)).alias("messages_contact"),
            F.sum(DISPLAY_COUNT).alias("messages_all_contacts"),
            F.count_if(own).alias("own_days"),
        )
    )
    own_period = F.when(F.col("own_days") > 0, F.col("dt"))
    return (
        by_period.withColumns({"first": F.min(own_period).over(everyone), "last": F.max(own_period).over(everyone)})
        .where(F.col("dt").between(F.col("first"), F.col("last")))
        .select(
            "dt",
            "messages_contact",
            "messages_all_contacts",
            F.try_divide("messages_contact", "messages_all_contacts").alias("rate"),
        )
    )


def average_length(daily_from_who: DataFrame) -> DataFrame:
    """(is_from_me, words, characters per text message)."""
    return (
        daily_from_who.where(F.col("is_from_me").isNotNull())
        .groupBy("is_from_me")
        .agg(
            F.try_divide(F.sum("tokens"), F.sum("text_messages")).alias("words_per_message"),
            F.try_divide(F.sum("characters"), F.sum("text_messages")).alias("characters_per_message"),
        )
    )


# --- special messages -----------------------------------------------------------

# --- fixed values: labels of the kinds of messages ----------------------------
THREAD_KINDS = {"thread_origins": "Origins", "threaded_replies": "Replies"}
APP_KINDS = {"app_for_imessage": "Apps"}
IMAGE_KINDS = {
    "messages_containing_attachment_image": "Messages with Attachments",
    "messages_image_attachment_only": "Attachments Only",
}
MEDIUM_KINDS = {"imessages": "iMessage", "sms": "SMS"}


def _long_form(df: DataFrame, ids: Sequence[str], kinds: dict[str, str], kind: str, count: str) -> DataFrame:
    """One row per id and kind, measure names replaced by their labels."""
    pairs = F.array(*(F.struct(F.lit(label).alias(kind), F.col(name).alias(count)) for name, label in kinds.items()))
    return df.select(*ids, F.inline(pairs))


def by_kind(
    resampled_from_who: DataFrame, kinds: dict[str, str], from_me_only: bool = False
) -> DataFrame:
    """(is_from_me, dt, kind, count) of threads, apps or image attachments.

    ``resampled_from_who`` is resample_by(..., ['is_from_me']); ``kinds`` is
    THREAD_KINDS, APP_KINDS or IMAGE_KINDS.
    """
    sides = F.col("is_from_me") if from_me_only else F.col("is_from_me").isNotNull()
    return _long_form(resampled_from_who.where(sides), ["is_from_me", "dt"], kinds, "kind", "count")


def highest_period(long_form: DataFrame) -> DataFrame:
    """One row: the highest total of one side in one period, for a common axis."""
    totals = long_form.groupBy("is_from_me", "dt").agg(F.sum("count").alias("total"))
    return totals.agg(F.max("total").alias("max_count"))


def tapbacks(message_user: DataFrame, contact: str | None = None) -> DataFrame:
    """(is_from_me, tapback, count), zero for labels a side never used.

    The zero rows are added before the sum, so no join is needed.
    """
    label = F.col("message_special_type")
    names = F.create_map(*(F.lit(part) for pair in TAPBACK_LABELS.items() for part in pair))
    used = (
        one_contact(message_user, contact)
        .where(F.col("is_emote") & F.col("is_from_me").isNotNull() & label.isNotNull())
        .groupBy("is_from_me", label.alias("emote"))
        .agg(F.count("message_id").alias("count"))
        .select("is_from_me", F.coalesce(F.try_element_at(names, F.col("emote")), F.col("emote")).alias("tapback"), "count")
    )
    zeros = message_user.sparkSession.range(1).select(
        F.explode(F.array(F.lit(True), F.lit(False))).alias("is_from_me")
    )
    zeros = zeros.select(
        "is_from_me",
        F.explode(F.array(*(F.lit(name) for name in TAPBACK_LABELS.values()))).alias("tapback"),
        F.lit(0).cast("long").alias("count"),
    )
    return used.unionByName(zeros).groupBy("is_from_me", "tapback").agg(F.sum("count").alias("count"))


def service_totals(summary: DataFrame) -> DataFrame:
    """(medium, count): iMessage and SMS totals."""
    return _long_form(summary, [], MEDIUM_KINDS, "medium", "count")


# --- people ---------------------------------------------------------------------


def _ranked(totals: DataFrame, measure: str, n: int | None) -> DataFrame:
    """The n highest rows with their rank, or all rows.

    A complete rank is a sort by ranges: the place of a row in its range plus
    the rows of the ranges before, of which there are as many as shuffle
    partitions.  The window of a top n sees only those n rows.
    """
    order = [F.desc(measure), F.asc("contact_name")]
    if n is not None:
        highest = totals.orderBy(*order).limit(n)
        return highest.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    ranges = int(totals.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The id of a row is its range, shifted by 33 bits, and its place there.
    placed = (
        totals.repartitionByRange(ranges, *order)
        .sortWithinPartitions(*order)
        .withColumn("place", F.monotonically_increasing_id())
        .withColumn("range", F.shiftright("place", 33))
    )
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    starts = starts.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    rank = F.col("start") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.join(F.broadcast(starts), "range").select("contact_name", measure, rank.cast("int").alias("rank"))


def _is_kind(group_chats: bool) -> Column:
    """Whether the summed messages of a contact are, in part, of group chats, or of others."""
    return F.col("group_chat_messages") > 0 if group_chats else F.col("messages") > F.col("group_chat_messages")


def _contact_totals(df: DataFrame, measure: str, group_chat_map: DataFrame | None, group_chats: bool) -> DataFrame:
    """(contact_name, measure) of contacts of one kind, which the measures tell unless a map of kinds is given."""
    sums = {name: F.sum(name).alias(name) for name in (measure, *([] if group_chat_map else ["messages", "group_chat_messages"]))}
    totals = df.dropna(subset=["contact_name"]).groupBy("contact_name").agg(*sums.values())
    if group_chat_map is None:
        return totals.where(_is_kind(group_chats)).select("contact_name", measure)
    kind = group_chat_map.where(F.col("is_group_chat") == F.lit(group_chats)).select("contact_name")
    return totals.join(kind, "contact_name", "left_semi")


def sms_ranking(summary_contact_from_who: DataFrame, group_chat_map: DataFrame | None = None, n: int | None = None) -> DataFrame:
    """(contact_name, sms, rank): who still sends SMS, group chats aside; the first n or all."""
    totals = _contact_totals(summary_contact_from_who, "sms", group_chat_map, group_chats=False)
    return _ranked(totals.where(F.col("sms") > 0), "sms", n)


def favourite_contacts(daily_contact: DataFrame, group_chat_map: DataFrame | None = None, n: int | None = None) -> DataFrame:
    """(contact_name, display_message_count, rank), group chats aside; the first n or all.

    Without a map of kinds, these are told from the given days.
    """
    return _ranked(_contact_totals(daily_contact, DISPLAY_COUNT, group_chat_map, group_chats=False), DISPLAY_COUNT, n)


def favourite_group_chats(daily_contact: DataFrame, group_chat_map: DataFrame | None = None, n: int | None = None) -> DataFrame:
    """(contact_name, display_message_count, rank) of group chats; the first n or all."""
    return _ranked(_contact_totals(daily_contact, DISPLAY_COUNT, group_chat_map, group_chats=True), DISPLAY_COUNT, n)


def _favourite_series(daily_contact: DataFrame, n: int, granularity: str) -> DataFrame:
    """(contact_name, dt, display_message_count) of the n favourite contacts, from one pass over the days.

    A contact's periods, no more than the calendar has, travel as one row to
    the choice of the n.
    """
    days = daily_contact.select("contact_name", "dt", DISPLAY_COUNT, "messages", "group_chat_messages")
    series = _period_sums(days.dropna(subset=["contact_name"]), granularity, ["contact_name"])
    whole = series.groupBy("contact_name").agg(
        F.sum(DISPLAY_COUNT).alias("total"),
        F.sum("messages").alias("messages"),
        F.sum("group_chat_messages").alias("group_chat_messages"),
        F.collect_list(F.struct("dt", DISPLAY_COUNT)).alias("periods"),
    )
    best = whole.where(_is_kind(group_chats=False)).orderBy(F.desc("total"), F.asc("contact_name")).limit(n)
    return best.select("contact_name", F.inline("periods"))


def _contact_series(daily_contact: DataFrame, granularity: str, shift: bool) -> DataFrame:
    return resample_by(daily_contact.select("contact_name", "dt", DISPLAY_COUNT), granularity, ["contact_name"], shift)


def cumulative_volume(
    daily_contact: DataFrame, favourites: DataFrame | int, granularity: str, shift: bool = False
) -> DataFrame:
    """(contact_name, dt, display_message_count) running totals of the given favourites, or of the first so many.

    Favourites are picked before the window, which then sees one row per
    contact and period.
    """
    if isinstance(favourites, int):
        series = _shifted(_favourite_series(daily_contact, favourites, granularity), granularity, shift)
    else:
        chosen = daily_contact.join(favourites.select("contact_name"), "contact_name", "left_semi")
        series = _contact_series(chosen, granularity, shift)
    so_far = Window.partitionBy("contact_name").orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    return series.withColumn(DISPLAY_COUNT, F.sum(DISPLAY_COUNT).over(so_far))


def volume_grid(
    daily_contact: DataFrame, favourites: DataFrame, granularity: str, shift: bool = False
) -> DataFrame:
    """(contact_name, dt, display_message_count, own_max, common_max) of
    favourites; the common maximum is over all contacts."""
    series = _contact_series(daily_contact, granularity, shift)
    own_max = F.max(DISPLAY_COUNT).over(Window.partitionBy("contact_name"))
    return (
        series.join(favourites.select("contact_name"), "contact_name", "left_semi")
        .withColumn("own_max", own_max)
        .withColumn("common_max", series.agg(F.max(DISPLAY_COUNT)).scalar())
    )


# --- one contact ------------------------------------------------------------------


def active_days(daily_contact: DataFrame, message_user: DataFrame, contact: str, start: dt.date, stop: dt.date) -> DataFrame:
    """One row: days with messages of the contact, of anyone, and the percent."""
    own = in_range(daily_contact, start, stop, contact).agg(
        F.count_distinct(F.when(F.col(DISPLAY_COUNT) > 0, F.col("dt"))).alias("active_days")
    )
    anyone = in_range(message_user, start, stop).agg(F.count_distinct("dt")).scalar()
    percent = F.try_divide("active_days", "total_active_days") * 100
    return own.withColumn("total_active_days", anyone).withColumn("active_days_percent", F.round(percent, 1))


def busiest_days(daily: DataFrame, n: int = BUSIEST_DAYS) -> DataFrame:
    """(dt, display_message_count, rank) of the days with most messages."""
    highest = daily.select("dt", DISPLAY_COUNT).orderBy(F.desc(DISPLAY_COUNT), "dt").limit(n)
    return highest.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(DISPLAY_COUNT), "dt")))


def side_by_side(daily_contact_from_who: DataFrame, contact: str) -> DataFrame:
    """One row per day with <measure>_from_me and <measure>_from_them."""

    def side(measure: str, from_me: bool) -> Column:
        return F.max(F.when(F.col("is_from_me") == F.lit(from_me), F.col(measure)))

    rows = one_contact(daily_contact_from_who, contact)
    return rows.groupBy("dt").agg(
        *(side(measure, True).alias(f"{measure}_from_me") for measure in _measures_of(rows)),
        *(side(measure, False).alias(f"{measure}_from_them") for measure in _measures_of(rows)),
    )


def chat_history(message_user: DataFrame, contact: str, start: dt.date, stop: dt.date, n: int) -> DataFrame:
    """(time, them, me): the n newest text messages with a contact."""
    clock = F.lower(F.date_format("ts", "MMM d ''yy 'at' hh:mm:ss a"))
    time = F.concat(F.upper(F.substring(clock, 1, 1)), F.substr(clock, F.lit(2)))
    shown = in_range(message_user.where(is_text_message() & F.col("is_from_me").isNotNull()), start, stop, contact)
    newest = shown.select("message_id", "ts", "text", "is_from_me").orderBy(F.desc("ts"), F.desc("message_id")).limit(n)
    return newest.select(
        time.alias("time"),
        F.coalesce(F.when(~F.col("is_from_me"), F.col("text")), F.lit("")).alias("them"),
        F.coalesce(F.when(F.col("is_from_me"), F.col("text")), F.lit("")).alias("me"),
    )
