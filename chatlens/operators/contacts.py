"""Contact map from address books and user-kept tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlens.functions.phones import US, phone_spellings

PERSON_KEYS = ["first_name", "last_name"]
IGNORED_NAMES = ("Error",)
SEPARATOR = ";"

# Which definition of an identifier wins: the lowest number.
CONTACT_PRIORITY = {"contact_group_names": 1, "contacts_manual": 2, "contacts": 3}


def people(person: DataFrame) -> DataFrame:
    """(owner, first_name, last_name) with '' for a missing name part."""
    return person.select(
        F.col("Z_PK").alias("owner"),
        F.coalesce("ZFIRSTNAME", F.lit("")).alias("first_name"),
        F.coalesce("ZLASTNAME", F.lit("")).alias("last_name"),
    )


def _owned(person: DataFrame, details: DataFrame, column: str, name: str) -> DataFrame:
    """Names joined with one kind of detail; a missing detail becomes ''.

    People without any name are left out: they are no contact, and all of them
    would meet under one key.
    """
    owned = details.select(F.col("ZOWNER").alias("owner"), F.coalesce(column, F.lit("")).alias(name))
    return people(person).where(full_name() != "").join(owned, "owner").drop("owner")


def identifiers(person: DataFrame, email: DataFrame, phone: DataFrame) -> DataFrame:
    """(first_name, last_name, identifier_type, value), one row per detail."""
    phones = _owned(person, phone, "ZFULLNUMBER", "value").withColumn("identifier_type", F.lit("phone"))
    emails = _owned(person, email, "ZADDRESS", "value").withColumn("identifier_type", F.lit("email"))
    return phones.unionByName(emails)


def person_emails(person: DataFrame, email: DataFrame) -> DataFrame:
    """(first_name, last_name, email) with all addresses of a name joined by ';'."""
    return _join_values(_owned(person, email, "ZADDRESS", "email"), "email")


def person_phones(person: DataFrame, phone: DataFrame) -> DataFrame:
    """(first_name, last_name, phone_number) with all numbers joined by ';'."""
    return _join_values(_owned(person, phone, "ZFULLNUMBER", "phone_number"), "phone_number")


def _join_values(rows: DataFrame, name: str) -> DataFrame:
    # One row per name is what this report is; the contact map below is built
    # from the single details and never gathers a name's details in one place.
    values = F.array_sort(F.collect_list(name))
    return rows.groupBy(*PERSON_KEYS).agg(F.array_join(values, SEPARATOR).alias(name))


def address_book(person: DataFrame, email: DataFrame, phone: DataFrame) -> DataFrame:
    """(first_name, last_name, email, phone_number), one row per name of a book."""
    return person_emails(person, email).join(person_phones(person, phone), PERSON_KEYS, "full_outer")


def all_address_books(books: Sequence[DataFrame]) -> DataFrame:
    """Distinct rows of all address books, in either form."""
    return reduce(DataFrame.unionByName, books).distinct()


def split_values(values: str | Column) -> Column:
    """The parts of a ';' list without empty ones; null has no parts."""
    return F.array_remove(F.split(values, SEPARATOR), "")


def full_name() -> Column:
    return F.trim(F.concat_ws(" ", "first_name", "last_name"))


def contact_map(identifiers: DataFrame, ignored_names: Sequence[str] = IGNORED_NAMES, home: str = US) -> DataFrame:
    """(contact_name, chat_identifier, identifier_type), distinct.

    Every phone number appears in each of its spellings; ``home`` is the
    calling code of the country that numbers without one belong to.
    """
    details = identifiers.select(
        full_name().alias("contact_name"), "identifier_type", F.explode(split_values("value")).alias("detail")
    ).where((F.col("contact_name") != "") & ~F.col("contact_name").isin(*ignored_names))
    spellings = F.when(F.col("identifier_type") == "phone", phone_spellings(F.col("detail"), home)).otherwise(
        F.array("detail")
    )
    return details.select("contact_name", F.explode(spellings).alias("chat_identifier"), "identifier_type").distinct()


def contact_load_counts(book: DataFrame, ignored_names: Sequence[str] = IGNORED_NAMES) -> DataFrame:
    """One row: distinct names, rows kept and rows ignored."""
    ignored = full_name().isin(*ignored_names)
    return book.agg(
        F.count_distinct("first_name", "last_name").alias("n_names"),
        F.count_if(~ignored).alias("n_kept"),
        F.count_if(ignored).alias("n_ignored"),
    )


def contact_group_names(message: DataFrame) -> DataFrame:
    """(chat_identifier, group_name): the latest title of each room.

    An aggregate instead of a window: a busy room is combined before the
    shuffle.  Equal dates are decided by the title.
    """
    latest_first = F.struct(
        F.coalesce(-F.col("date"), F.lit(2**63 - 1)).alias("age"), F.col("group_title").alias("title")
    )
    return (
        message.where(F.col("cache_roomnames").isNotNull() & F.col("group_title").isNotNull())
        .groupBy(F.col("cache_roomnames").alias("chat_identifier"))
        .agg(F.min(latest_first).getField("title").alias("group_name"))
    )


def contact_definitions(group_names: DataFrame, manual: DataFrame, contacts: DataFrame) -> DataFrame:
    """(chat_identifier, contact_name, priority, source) of all three sources."""

    def defined(df: DataFrame, name: str, source: str) -> DataFrame:
        return df.select(
            "chat_identifier",
            F.col(name).alias("contact_name"),
            F.lit(CONTACT_PRIORITY[source]).alias("priority"),
            F.lit(source).alias("source"),
        )

    return (
        defined(group_names, "group_name", "contact_group_names")
        .unionByName(defined(manual, "contact_name", "contacts_manual"))
        .unionByName(defined(contacts, "contact_name", "contacts"))
        .where("contact_name IS NULL OR trim(contact_name) <> ''")
    )


def contacts_user(group_names: DataFrame, manual: DataFrame, contacts: DataFrame) -> DataFrame:
    """(chat_identifier, contact_name, source): the best definition of each
    identifier, by priority and then by name."""
    best = F.min(F.struct("priority", "contact_name", "source"))
    return (
        contact_definitions(group_names, manual, contacts)
        .groupBy("chat_identifier")
        .agg(best.alias("best"))
        .select("chat_identifier", "best.contact_name", "best.source")
    )
