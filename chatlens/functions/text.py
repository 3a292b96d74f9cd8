"""Text cleaning and token expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: characters the text rules name --------------------------
OBJECT_REPLACEMENT = "￼"  # stands where an attachment sits in the text
REPLACEMENT_CHARACTER = "�"
CURLY_QUOTES = "‘’“”"
STRAIGHT_QUOTES = "''\"\""
SPLIT_SUFFIXES = ("'s", "'d")
SPACED_MARKS = (".", ",", "!", "?")
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" + "’‘“”``"


def replace_all(text: Column, pairs: Iterable[tuple[str, str]]) -> Column:
    """Each pair replaced in turn; byte searches, faster than translate or a
    regular expression."""
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def clean_text(text: Column) -> Column:
    """Drop the attachment mark, turn line breaks into spaces, trim spaces."""
    return F.trim(replace_all(text, ((OBJECT_REPLACEMENT, ""), ("\r", " "), ("\n", " "))))


def straight_quotes(text: Column) -> Column:
    return replace_all(text, zip(CURLY_QUOTES, STRAIGHT_QUOTES))


def split_suffixes(text: Column) -> Column:
    """Set 's and 'd off from the word before them."""
    return replace_all(text, ((suffix, " " + suffix) for suffix in SPLIT_SUFFIXES))


def normalise_text(text: Column) -> Column:
    """Straight quotes, split suffixes, and spaces around . , ! and ?"""
    return replace_all(split_suffixes(straight_quotes(text)), ((mark, f" {mark} ") for mark in SPACED_MARKS))


def tokens(text: Column) -> Column:
    """Array of tokens: the normalised text split on spaces, without blanks.

    array_remove keeps the expression inside generated code, which a lambda
    filter would not.
    """
    return F.array_remove(F.split(normalise_text(text), " "), "")


def marked_tokens(text: Column) -> Column:
    """Array of tokens where only runs of ? . ! , before a space or the end
    are set off, so that '3.14' stays whole."""
    spaced = F.regexp_replace(straight_quotes(text), r"([?.!,]+)( |\z)", " $1 ")
    collapsed = F.regexp_replace(split_suffixes(spaced), r"\s+", " ")
    return F.array_remove(F.split(F.trim(collapsed), " "), "")


def space_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def word_count(text: Column) -> Column:
    """Spaces plus one; runs of spaces count every space, as the tables expect."""
    return space_count(text) + F.lit(1)


def bare_word(token: Column) -> Column:
    """Lower-cased token without marks; a lone s or d becomes empty."""
    word = F.regexp_replace(F.lower(token), r"[^\p{L}\p{N}_\s]+", "")
    return F.when(word.isin("s", "d"), F.lit("")).otherwise(word)


def one_of(points: Column) -> Column:
    """Pattern of one character, given the code points as a sorted array without repeats.

    Neighbours become ranges, as each part of the class is tried in turn, and
    what lies outside all of them fails at the first part, the span.
    """
    mark = lambda point: F.concat(F.lit(r"\x{"), F.hex(point), F.lit("}"))
    span = lambda low, high: F.concat(mark(low), F.lit("-"), mark(high))
    lows = F.filter(points, lambda point, i: F.coalesce(F.get(points, i - 1) + 1 != point, F.lit(True)))
    highs = F.filter(points, lambda point, i: F.coalesce(F.get(points, i + 1) - 1 != point, F.lit(True)))
    parts = F.array_join(F.zip_with(lows, highs, span), "")
    return F.concat(F.lit("["), span(F.array_min(points), F.array_max(points)), F.lit("&&["), parts, F.lit("]]"))


def is_punctuation(token: Column) -> Column:
    """True if the token occurs as it stands in the list of marks."""
    return F.instr(F.lit(PUNCTUATION), token) > 0
