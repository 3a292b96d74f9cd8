"""Orders in which tables are shown; stored tables are left unsorted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DISPLAY_ORDERS = {
    "contact_daily_message_volume": ("contact_name", "dt", "is_from_me"),
    "contact_map": ("contact_name",),
    "contact_stats": ("contact_name", "is_from_me"),
    "contact_token_usage_daily_from_who": ("contact_name", "dt", "is_from_me", "token"),
    "contact_top_token_usage_by_length": ("contact_name", "is_from_me", "token_length"),
    "contacts_user": ("contact_name",),
    "message_user": ("message_id desc",),
    "qc_duplicate_chat_identifier_defs": ("chat_identifier", "priority"),
    "qc_message_special_types": ("n_messages desc",),
    "qc_missing_contact_names": ("total_messages desc", "chat_identifier"),
    "qc_null_flags": ("message_id desc",),
    "token_dictionary": ("token",),
}


def for_display(name: str, df: DataFrame) -> DataFrame:
    """The table in its display order: nulls first ascending, last descending.

    Sort what is shown (after filters or a limit), not what is stored.
    """
    if name not in DISPLAY_ORDERS:
        return df
    order = []
    for key in DISPLAY_ORDERS[name]:
        column, _, direction = key.partition(" ")
        order.append(F.desc_nulls_last(column) if direction else F.asc_nulls_first(column))
    return df.orderBy(*order)
