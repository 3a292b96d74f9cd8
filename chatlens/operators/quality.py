"""Checks that a user should look at before trusting the tables."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from chatlens.operators.contacts import contact_definitions
from chatlens.schemas import CONTACT_TYPES

NEWEST_SHOWN = 3
MORE_THAN_MESSAGES = 10

FLAGS = (
    "is_from_me",
    "is_text",
    "is_url",
    "is_group_chat",
    "is_emote",
    "has_no_text",
    "has_attachment",
    "is_attachment",
    "has_attachment_image",
    "is_attachment_image",
)


def duplicate_identifier_definitions(group_names: DataFrame, manual: DataFrame, contacts: DataFrame) -> DataFrame:
    """All definitions of identifiers that are defined more than once."""
    definitions = contact_definitions(group_names, manual, contacts).distinct()
    repeated = definitions.groupBy("chat_identifier").count().where("count > 1")
    return definitions.join(repeated, "chat_identifier", "left_semi")


def duplicate_message_ids(message_user: DataFrame) -> DataFrame:
    """(message_id, n_records) of ids that occur more than once."""
    return message_user.groupBy("message_id").agg(F.count(F.lit(1)).alias("n_records")).where("n_records > 1")


def unmapped_special_types(message_user: DataFrame) -> DataFrame:
    """Message types without a label, with their number of messages."""
    return (
        message_user.where(F.col("message_special_type").isNull() & (F.col("associated_message_type") != 0))
        .groupBy(
            "associated_message_type",
            F.col("message_special_type").alias("mapped_message_special_type_in_message_user"),
        )
        .agg(F.count("message_id").alias("n_messages"))
    )


def missing_contact_names(
    message_user: DataFrame,
    ignored: DataFrame,
    newest: int = NEWEST_SHOWN,
    more_than: int = MORE_THAN_MESSAGES,
) -> DataFrame:
    """The newest text messages of unnamed chats that are worth naming.

    The rank filter is pushed into the window, so each task keeps at most
    ``newest`` rows of a chat before the shuffle.
    """
    busy = (
        message_user.groupBy("chat_identifier")
        .agg(F.count_if("is_text").alias("total_messages"))
        .where(F.col("total_messages") > more_than)
    )
    by_recency = Window.partitionBy("chat_identifier").orderBy(F.desc("dt"), F.desc("message_id"))
    unnamed = (
        message_user.where(F.col("contact_name").isNull() & F.col("is_text"))
        .join(ignored.select("chat_identifier"), "chat_identifier", "left_anti")
        .select("chat_identifier", "dt", "text", F.row_number().over(by_recency).alias("recency"))
        .where(F.col("recency") <= newest)
    )
    return unnamed.join(busy, "chat_identifier").select("chat_identifier", "dt", "text", "total_messages")


def null_flags(message_user: DataFrame) -> DataFrame:
    """Messages with an unknown flag."""
    return message_user.where(_any_flag_unknown())


CHECKS = (
    "qc_duplicate_chat_identifier_defs",
    "qc_duplicate_message_id",
    "qc_message_special_types",
    "qc_missing_contact_names",
    "qc_null_flags",
)


def _unlabelled_type() -> Column:
    """The type of a message that should have a label and has none."""
    return F.when(F.col("message_special_type").isNull() & (F.col("associated_message_type") != 0), F.col("associated_message_type"))


def _any_flag_unknown() -> Column:
    return reduce(lambda a, b: a | b, (F.col(flag).isNull() for flag in FLAGS))


def observed(message_user: DataFrame, observation: Observation) -> DataFrame:
    """message_user, counting two checks in passing: give observation.get to run_quality_control once it is written."""
    return message_user.observe(
        observation,
        F.count_if(_any_flag_unknown()).alias("qc_null_flags"),
        F.size(F.collect_set(_unlabelled_type())).cast("bigint").alias("qc_message_special_types"),
    )


def run_quality_control(
    tables: Mapping[str, DataFrame],
    newest: int = NEWEST_SHOWN,
    more_than: int = MORE_THAN_MESSAGES,
    counted: Mapping[str, int] | None = None,
) -> DataFrame:
    """(check_name, n_rows, failed), one row per check: how many rows its table has.

    message_user is read once: its narrow columns are grouped by message, by
    chat and by type side by side, and all but the groups of messages are
    combined before the shuffle.  ``counted`` are row counts known already.
    """
    counted = dict(counted or {})
    narrow = tables["message_user"].select(
        "message_id",
        "chat_identifier",
        _unlabelled_type().alias("kind"),
        F.col("is_text").alias("is_text"),
        (F.col("is_text") & F.col("contact_name").isNull()).alias("unnamed"),
        _any_flag_unknown().alias("unknown"),
    )
    keys = ("message_id", "chat_identifier", "kind")
    groups = narrow.groupingSets([["message_id"], ["chat_identifier"], ["kind"]], *keys).agg(
        F.grouping_id().alias("by"),
        F.count(F.lit(1)).alias("n"),
        F.count_if("is_text").alias("texts"),
        F.count_if("unnamed").alias("unnamed"),
        F.count_if("unknown").alias("unknown"),
    )
    # A bit is set for each key that a group is not by.
    of_message, of_chat, of_kind = (F.col("by") == code for code in (0b011, 0b101, 0b110))
    chat = F.when(of_chat, F.col("chat_identifier"))
    # Only chats stay apart; all messages and types come down to one row.
    reduced = groups.groupBy(chat.alias("chat_identifier")).agg(
        F.count_if(of_message & (F.col("n") > 1)).alias("qc_duplicate_message_id"),
        F.count_if(of_kind & F.col("kind").isNotNull()).alias("qc_message_special_types"),
        F.sum(F.when(of_kind, F.col("unknown"))).alias("qc_null_flags"),
        F.sum(F.when(of_chat, F.col("texts"))).alias("texts"),
        F.sum(F.when(of_chat, F.col("unnamed"))).alias("unnamed"),
    )
    ignored = tables["contacts_ignored"].select("chat_identifier").distinct().withColumn("ignored", F.lit(True))
    named = reduced.join(ignored, "chat_identifier", "left")
    shown = F.col("chat_identifier").isNotNull() & F.col("ignored").isNull() & (F.col("texts") > more_than)
    named = named.withColumn("qc_missing_contact_names", F.when(shown, F.least("unnamed", F.lit(newest))).otherwise(0))
    total = named.agg(*(F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in CHECKS[1:]))
    conflicts = tables[CHECKS[0]].agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(CHECKS[0]).alias("check_name"), "n_rows")
    rest = [
        F.struct(F.lit(name).alias("check_name"), (F.lit(counted[name]) if name in counted else F.col(name)).cast("bigint").alias("n_rows"))
        for name in CHECKS[1:]
    ]
    report = conflicts.unionByName(total.select(F.inline(F.array(*rest))))
    return report.withColumn("failed", F.col("n_rows") > 0)


def failing_checks(report: DataFrame) -> DataFrame:
    """One row: how many checks found something."""
    return report.agg(F.count_if("failed").alias("n_failed"))


def identifier_conflicts(duplicates: DataFrame) -> DataFrame:
    """(chat_identifier, conflict): each identifier's names and sources in a line."""
    # --- fixed value: the wording of a conflict ---
    mapping = F.format_string('name: "%s" (source: "%s")', "contact_name", "source")
    ordered = F.array_sort(F.collect_list(F.struct("priority", mapping.alias("mapping"))))
    return duplicates.groupBy("chat_identifier").agg(
        F.array_join(F.transform(ordered, lambda item: item["mapping"]), " | ").alias("conflict")
    )


def measure_sums_disagree(daily: DataFrame, measures: tuple[str, ...] = tuple(CONTACT_TYPES.values())) -> DataFrame:
    """Days whose messages differ from the sum over the message types."""
    challenger = reduce(lambda a, b: a + b, (F.coalesce(measure, F.lit(0)) for measure in measures))
    return daily.select("dt", F.col("messages").alias("messages_truth"), challenger.alias("messages_challenger")).where(
        "messages_truth != messages_challenger"
    )


def with_required_rows(df: DataFrame, what: str) -> DataFrame:
    """The frame's rows; reading them is an error if there are none.

    Nothing runs before it is read: the check is a branch of the plan that
    looks for one row, and adds none.
    """
    missing = F.raise_error(F.lit(f"no rows in {what}")).cast("boolean")
    found = df.limit(1).agg(F.count(F.lit(1)).alias("found")).where(F.when(F.col("found") == 0, missing).otherwise(False))
    return df.unionByName(found.select(*(F.lit(None).cast(field.dataType).alias(field.name) for field in df.schema.fields)))


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """The frame itself, or at once an error if it has no rows; with_required_rows() runs nothing yet."""
    if df.isEmpty():
        raise ValueError(f"no rows in {what}")
    return df
