"""Golden rows of the text, phone and calendar expressions."""

import datetime as dt
import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chatlens.functions import periods, phones, text
from chatlens.operators import tokens
from chatlens.sources import dimensions


def evaluate(spark, expression, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expression(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    ("value", "expected"),
    [
        ("It's fine, ok?!", ["It", "'s", "fine", ",", "ok", "?", "!"]),
        ("  a  b ", ["a", "b"]),
        ("Pi is 3.14...", ["Pi", "is", "3", ".", "14", ".", ".", "."]),
        ("‘hey’ she'd said “yes”", ["'hey'", "she", "'d", "said", '"yes"']),
        ("👍 👍🏽 x", ["👍", "👍🏽", "x"]),
        ("''sup 's", ["'", "'sup", "'s"]),
        ("tab\there", ["tab\there"]),
        ("", []),
        (None, None),
    ],
)
def test_tokens(spark, value, expected):
    assert evaluate(spark, text.tokens, value) == expected


def split_by_hand(value):
    """The token rules once more, one character at a time."""
    for curly, straight in zip("‘’“”", "''\"\""):
        value = value.replace(curly, straight)
    value = value.replace("'s", " 's").replace("'d", " 'd")
    spaced = "".join(f" {c} " if c in ".,!?" else c for c in value)
    found, word = [], ""
    for char in spaced + " ":
        if char != " ":
            word += char
        elif word:
            found.append(word)
            word = ""
    return found


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab '’sd.,!?“\t👍", max_size=30), min_size=1, max_size=40))
def test_tokens_against_hand_split(spark, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    found = {row.i: row.t for row in rows.select("i", text.tokens(F.col("v")).alias("t")).collect()}
    assert found == {i: split_by_hand(v) for i, v in enumerate(values)}


@pytest.mark.parametrize(
    ("value", "expected"),
    [
        ("ok?! 3.14 b, end.", ["ok", "?!", "3.14", "b", ",", "end", "."]),
        ("she’s  here", ["she", "'s", "here"]),
        ("", []),
        ("...", ["..."]),
    ],
)
def test_marked_tokens(spark, value, expected):
    assert evaluate(spark, text.marked_tokens, value) == expected


@pytest.mark.parametrize(
    ("value", "expected"),
    [("￼", ""), (" a\r\nb ", "a  b"), ("\t x", "\t x"), ("�", "�"), (None, None)],
)
def test_clean_text(spark, value, expected):
    assert evaluate(spark, text.clean_text, value) == expected


@pytest.mark.parametrize(("value", "expected"), [("a b", 2), ("a  b", 3), ("a", 1), ("", 1)])
def test_word_count_counts_every_space(spark, value, expected):
    assert evaluate(spark, text.word_count, value) == expected


@pytest.mark.parametrize(
    ("value", "expected"), [("Don't!", "dont"), ("'S", ""), ("d", ""), ("Été_1", "été_1"), ("👍", "")]
)
def test_bare_word(spark, value, expected):
    assert evaluate(spark, text.bare_word, value) == expected


@pytest.mark.parametrize(("value", "expected"), [(".", True), ("``", True), ("()", True), ("a", False), (".a", False)])
def test_is_punctuation(spark, value, expected):
    assert evaluate(spark, text.is_punctuation, value) is expected


US = ["+14155552671", "(415) 555-2671", "+1 415-555-2671"]


@pytest.mark.parametrize(
    ("value", "expected"),
    [
        ("(415) 555-2671", US),
        ("+1 415 555 2671", US),
        ("4155552671", US),
        ("1-415-555-2671", US),
        ("+44 20 7946 0958", ["+442079460958", "+44 20 7946 0958"]),
        ("911", ["911"]),
        ("011 44 20 7946 0958", ["+442079460958", "011 44 20 7946 0958"]),
        ("+44 (0)20 7946 0958", ["+442079460958", "+44 (0)20 7946 0958"]),
        ("+12345", ["+12345"]),
        ("", [""]),
    ],
)
def test_phone_spellings(spark, value, expected):
    assert evaluate(spark, phones.phone_spellings, value) == expected


@pytest.mark.parametrize(
    ("home", "value", "expected"),
    [
        ("44", "020 7946 0958", ["+442079460958", "020 7946 0958"]),
        ("44", "00353 1 234 5678", ["+35312345678", "00353 1 234 5678"]),
        ("44", "+1 415 555 2671", US),
        ("44", "999", ["999"]),
        ("39", "06 1234 5678", ["+390612345678", "06 1234 5678"]),
        ("49", "0301234567890123", ["0301234567890123"]),
    ],
)
def test_phones_of_other_countries(spark, home, value, expected):
    assert evaluate(spark, lambda number: phones.phone_spellings(number, home), value) == expected


@pytest.mark.parametrize(("digits", "code"), [("14155552671", "1"), ("79261234567", "7"), ("442079460958", "44"), ("35312345678", "353")])
def test_calling_codes(spark, digits, code):
    assert evaluate(spark, phones.calling_code, digits) == code


@pytest.mark.parametrize(
    ("day", "granularity", "expected"),
    [
        (dt.date(2024, 1, 6), "Week", dt.date(2024, 1, 7)),
        (dt.date(2024, 1, 7), "Week", dt.date(2024, 1, 7)),
        (dt.date(2024, 1, 8), "Week", dt.date(2024, 1, 14)),
        (dt.date(2024, 2, 29), "Month", dt.date(2024, 2, 1)),
        (dt.date(2024, 2, 29), "Year", dt.date(2024, 1, 1)),
        (dt.date(2024, 2, 29), "Day", dt.date(2024, 2, 29)),
    ],
)
def test_period_of(spark, day, granularity, expected):
    assert evaluate(spark, lambda c: periods.period_of(c, granularity), day, "date") == expected


@pytest.mark.parametrize(
    ("granularity", "expected"),
    [("Day", (2024, 2, 1)), ("Week", (2024, 2, 7)), ("Month", (2024, 2, 29)), ("Year", (2025, 1, 31))],
)
def test_next_period(spark, granularity, expected):
    day = dt.date(2024, 1, 31)
    assert evaluate(spark, lambda c: periods.next_period(c, granularity), day, "date") == dt.date(*expected)


def test_relative_ranges():
    wednesday = dt.date(2024, 1, 24)
    first = dt.date(2020, 5, 5)
    starts = {name: periods.relative_range(name, wednesday, first)[0] for name in periods.RELATIVE_RANGES}
    assert starts == {
        "Today": wednesday,
        "This week": dt.date(2024, 1, 21),
        "This month": dt.date(2024, 1, 1),
        "This year": dt.date(2024, 1, 1),
        "Last 60 days": dt.date(2023, 11, 25),
        "Last 90 days": dt.date(2023, 10, 26),
        "Last 6 months": dt.date(2023, 7, 28),
        "Last 12 months": dt.date(2023, 1, 24),
        "All time": first,
    }
    sunday = dt.date(2024, 1, 28)
    assert periods.relative_range("This week", sunday)[0] == dt.date(2024, 1, 21)
    with pytest.raises(ValueError):
        periods.relative_range("Last century", sunday)


@pytest.mark.parametrize(
    ("chars", "parts"),
    [("a", 1), ("abc", 1), ("acd", 2), (")]^&-[\\", 4), ("\xa9\xae", 2), ("👍👎🏻🏼🏽\U000e007f⃣", 4)],
)
def test_one_of_is_a_span_of_few_ranges(spark, chars, parts):
    points = F.lit(sorted(map(ord, chars)))
    pattern = spark.range(1).select(text.one_of(points)).first()[0]
    assert pattern.count("-") == 1 + parts
    near = sorted({chr(ord(c) + step) for c in chars for step in (-2, -1, 0, 1, 2)} | set("az09 é中"))
    seen = spark.createDataFrame([(c,) for c in near], "c string").where(F.regexp_instr("c", F.lit(pattern)) > 0)
    assert {row.c for row in seen.collect()} == set(chars)


def test_long_texts_are_searched_for_emoji_in_moments(spark):
    emoji = dimensions.emoji_dim(spark)
    words = spark.range(40).select(F.repeat(F.lit("lorem ipsum é 中文 "), 10_000).alias("text"), F.col("id").alias("message_id"))
    texts = words.withColumn("text", F.when(F.col("message_id") == 7, F.concat("text", F.lit(" 👍"))).otherwise(F.col("text")))
    texts = texts.select("message_id", "text", F.lit(True).alias("is_text"), F.lit(False).alias("has_no_text"))
    start = time.monotonic()
    found = [row.message_id for row in tokens.message_emoji_map(texts, emoji).where("has_emoji").collect()]
    assert found == [7] and time.monotonic() - start < 20
