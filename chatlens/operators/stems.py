"""Stems of English words by the steps that M. F. Porter published in 1980, as column expressions.

A word's letters are sorted into vowels and consonants once for each step; a
stem's measure, the number of times that vowels are followed by consonants, is
then a count of matches.  Meant for distinct words, which a dictionary has.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: endings and what takes their place, by the step's published order ---
PLURALS = (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", ""))
DOUBLE_ENDINGS = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"),
    ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"),
    ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"),
    ("iviti", "ive"), ("biliti", "ble"),
)
SIMPLE_ENDINGS = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
LAST_ENDINGS = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize",
)
#: Words of fewer letters are their own stems.
LEAST_LETTERS = 3


def letter_kinds(word: Column) -> Column:
    """v for each vowel of a word and c for each other character; y is a vowel behind a consonant."""
    def sorted_in(so_far: Column, letter: Column) -> Column:
        kind = F.when(letter.isin("a", "e", "i", "o", "u"), "v").when((letter == "y") & so_far.endswith("c"), "v").otherwise("c")
        return F.concat(so_far, kind)

    letters = F.filter(F.split(word, ""), lambda letter: letter != "")
    return F.aggregate(letters, F.lit(""), sorted_in)


def _measure(kinds: Column) -> Column:
    return F.regexp_count(kinds, F.lit("v+c+"))


def _has_vowel(kinds: Column) -> Column:
    return F.instr(kinds, "v") > 0


def _ends_short(word: Column, kinds: Column) -> Column:
    """Consonant, vowel, consonant at the end, the last none of w, x and y."""
    return kinds.endswith("cvc") & ~F.substring(word, -1, 1).isin("w", "x", "y")


def _ends_double(word: Column, kinds: Column) -> Column:
    last = F.substring(word, -1, 1)
    return kinds.endswith("cc") & (F.substring(word, -2, 1) == last)


def _cut(column: Column, size: int) -> Column:
    return F.substr(column, F.lit(1), F.length(column) - size)


def _longest_ending(word: Column, kinds: Column, endings, fits: Callable[[Column, Column, str], Column]) -> Column:
    """The word with its longest listed ending replaced, if what is left fits."""
    (first, *others) = sorted(endings, key=lambda pair: -len(pair[0]))

    def replaced(ending: str, new: str) -> Column:
        rest, rest_kinds = _cut(word, len(ending)), _cut(kinds, len(ending))
        return F.when(fits(rest, rest_kinds, ending), F.concat(rest, F.lit(new))).otherwise(word)

    out = F.when(word.endswith(first[0]), replaced(*first))
    for ending, new in others:
        out = out.when(word.endswith(ending), replaced(ending, new))
    return out.otherwise(word)


def _past(word: Column, kinds: Column, _: Column) -> Column:
    """-eed, -ed and -ing."""

    def without(ending: str) -> Column:
        return F.when(_has_vowel(_cut(kinds, len(ending))), _cut(word, len(ending))).otherwise(word)

    eed = F.when(_measure(_cut(kinds, 3)) > 0, _cut(word, 1)).otherwise(word)
    return F.when(word.endswith("eed"), eed).when(word.endswith("ed"), without("ed")).when(word.endswith("ing"), without("ing")).otherwise(word)


def _mended(word: Column, kinds: Column, before: Column) -> Column:
    """An e where -ed or -ing took one, one letter where it doubled it."""
    last, lost = F.substring(word, -1, 1), F.length(before) - F.length(word)
    mended = (
        F.when(word.endswith("at") | word.endswith("bl") | word.endswith("iz"), F.concat(word, F.lit("e")))
        .when(_ends_double(word, kinds) & ~last.isin("l", "s", "z"), _cut(word, 1))
        .when((_measure(kinds) == 1) & _ends_short(word, kinds), F.concat(word, F.lit("e")))
        .otherwise(word)
    )
    taken = (before.endswith("ed") & (lost == 2)) | (before.endswith("ing") & (lost == 3))
    return F.when(taken, mended).otherwise(word)


def _ion_fits(rest: Column, ending: str) -> Column:
    return rest.endswith("s") | rest.endswith("t") if ending == "ion" else F.lit(True)


#: Each takes the word, its kinds, and the word before the step before.
STEPS: tuple[Callable[[Column, Column, Column], Column], ...] = (
    lambda word, kinds, _: _longest_ending(word, kinds, PLURALS, lambda rest, rest_kinds, ending: F.lit(True)),
    _past,
    _mended,
    lambda word, kinds, _: F.when(word.endswith("y") & _has_vowel(_cut(kinds, 1)), F.concat(_cut(word, 1), F.lit("i"))).otherwise(word),
    lambda word, kinds, _: _longest_ending(word, kinds, DOUBLE_ENDINGS, lambda rest, rest_kinds, ending: _measure(rest_kinds) > 0),
    lambda word, kinds, _: _longest_ending(word, kinds, SIMPLE_ENDINGS, lambda rest, rest_kinds, ending: _measure(rest_kinds) > 0),
    lambda word, kinds, _: _longest_ending(
        word,
        kinds,
        [(ending, "") for ending in LAST_ENDINGS],
        lambda rest, rest_kinds, ending: (_measure(rest_kinds) > 1) & _ion_fits(rest, ending),
    ),
    lambda word, kinds, _: F.when(
        word.endswith("e")
        & ((_measure(_cut(kinds, 1)) > 1) | ((_measure(_cut(kinds, 1)) == 1) & ~_ends_short(_cut(word, 1), _cut(kinds, 1)))),
        _cut(word, 1),
    ).otherwise(word),
    lambda word, kinds, _: F.when((_measure(kinds) > 1) & _ends_double(word, kinds) & word.endswith("l"), _cut(word, 1)).otherwise(word),
)


def with_stem(df: DataFrame, token: str = "token", name: str = "stem") -> DataFrame:
    """Adds the stem of a lower-cased word; null stays null, words of one or two letters stay as they are."""
    out = df.withColumns({"__word": F.col(token), "__before": F.col(token)})
    for step in STEPS:
        # Kinds are a column of their own, so that a step's many uses of them don't make them anew.
        out = out.withColumn("__kinds", letter_kinds(F.col("__word")))
        done = step(F.col("__word"), F.col("__kinds"), F.col("__before"))
        out = out.withColumns({"__word": done, "__before": F.col("__word")})
    stem = F.when(F.length(token) < LEAST_LETTERS, F.col(token)).otherwise(F.col("__word"))
    return out.withColumn(name, stem).drop("__word", "__before", "__kinds")
