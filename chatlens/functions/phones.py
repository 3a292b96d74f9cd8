"""Spellings of a phone number that message logs may hold."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

US = "1"
# --- fixed values: calling codes of one and two digits; all others have three ---
ONE_DIGIT = ("1", "7")
TWO_DIGITS = (
    "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49",
    "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66",
    "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98",
)
#: Countries whose numbers keep their leading 0 abroad.
KEEPS_ZERO = ("39",)
#: Digits of a whole number, calling code included.
LEAST_DIGITS, MOST_DIGITS = 8, 15


def calling_code(digits: Column) -> Column:
    """The country's calling code at the start of an international number: the longest that fits."""
    one, two = F.substring(digits, 1, 1), F.substring(digits, 1, 2)
    return F.when(one.isin(*ONE_DIGIT), one).when(two.isin(*TWO_DIGITS), two).otherwise(F.substring(digits, 1, 3))


def international_digits(number: Column, home: str = US) -> Column:
    """Digits of a number from its calling code on; null if it is too short, too long, or does not say so.

    A plus sign, 00, or from the US 011 leads to a calling code; a 0 in
    brackets is for calls inside a country.  Any other number is one of the
    home country: there a leading 0 is not dialled from abroad, and a US
    number may have a 1 before its ten digits.
    """
    plain = F.regexp_replace(F.trim(number), r"\(0\)", "")
    digits = F.regexp_replace(plain, "[^0-9]", "")
    exit_code = "011" if home == US else "00"
    if home == US:
        national = F.when(F.length(digits) == 10, F.concat(F.lit(US), digits)).when(
            (F.length(digits) == 11) & digits.startswith(US), digits
        )
    else:
        rest = digits if home in KEEPS_ZERO else F.regexp_replace(digits, "^0", "")
        national = F.concat(F.lit(home), rest)
    whole = (
        F.when(plain.startswith("+"), digits)
        .when(digits.startswith(exit_code), F.substr(digits, F.lit(len(exit_code) + 1)))
        .otherwise(national)
    )
    # No calling code begins with 0, and a US number has eleven digits.
    fits = F.length(whole).between(LEAST_DIGITS, MOST_DIGITS) & ~whole.startswith("0")
    return F.when(fits & (~whole.startswith(US) | (F.length(whole) == 11)), whole)


def phone_spellings(number: Column, home: str = US) -> Column:
    """Distinct spellings of a number, first seen first.

    A US number gives its E.164, national and international form.  Any other
    number is kept as written, with its E.164 form before it where it has a
    calling code or ``home`` is the code of another country.
    """
    digits = F.regexp_replace(number, "[^0-9]", "")
    whole = international_digits(number, home)
    local = F.when(whole.startswith(US), F.substring(whole, 2, 10))
    area, exchange, line = (F.substring(local, start, size) for start, size in ((1, 3), (4, 3), (7, 4)))
    us_forms = F.array(
        F.concat(F.lit("+1"), local),
        F.concat(F.lit("("), area, F.lit(") "), exchange, F.lit("-"), line),
        F.concat(F.lit("+1 "), area, F.lit("-"), exchange, F.lit("-"), line),
    )
    # What has a plus sign but no plausible length is still written with its digits alone.
    other = F.coalesce(whole, F.when(F.trim(number).startswith("+"), digits))
    other_forms = F.when(other.isNotNull(), F.array(F.concat(F.lit("+"), other), number)).otherwise(F.array(number))
    return F.array_distinct(F.when(local.isNotNull(), us_forms).otherwise(other_forms))
