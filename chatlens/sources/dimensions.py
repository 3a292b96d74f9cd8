"""Packaged word lists and the emoji table.

Both are built from literals, so Spark knows their size and no file has to
exist on the executors.  A caller may pass a table of their own to every
operator that takes one; Spark then decides from its size how to join it.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlens.schemas import DIMENSION_SCHEMAS
from chatlens.sources.tables import check_columns

# --- fixed values: English stop words (the widely published list) ------------
STOPWORDS = tuple(
    """
    i me my myself we our ours ourselves you you're you've you'll you'd your
    yours yourself yourselves he him his himself she she's her hers herself it
    it's its itself they them their theirs themselves what which who whom this
    that that'll these those am is are was were be been being have has had
    having do does did doing a an the and but if or because as until while of
    at by for with about against between into through during before after
    above below to from up down in out on off over under again further then
    once here there when where why how all any both each few more most other
    some such no nor not only own same so than too very s t can will just don
    don't should should've now d ll m o re ve y ain aren aren't couldn couldn't
    didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't
    ma mightn mightn't mustn mustn't needn needn't shan shan't shouldn
    shouldn't wasn wasn't weren weren't won won't wouldn wouldn't
    """.split()
)

# --- fixed values: contractions dropped from word tables ----------------------
CONTRACTIONS = ("i'm", "i'd", "i've", "i'll", "'s")
BARE_CONTRACTIONS = tuple(word.replace("'", "") for word in CONTRACTIONS)

# The emoji that Unicode recommends for general interchange, and the mark that
# asks for the picture and is often left out.
EMOJI_PROPERTY = "[:RGI_Emoji:]"
EMOJI_PRESENTATION = "\ufe0f"
JOINER = "\u200d"


def _plain(*parts: str) -> str:
    return ":" + "_".join(parts).lower().replace(" ", "_").replace("-", "_") + ":"


def _character_name(char: str) -> str:
    name = unicodedata.name(char, f"u{ord(char):x}")
    return name.removeprefix("EMOJI MODIFIER ").removeprefix("REGIONAL INDICATOR SYMBOL LETTER ").removeprefix("TAG ")


def _emoji_rows(spark: SparkSession) -> Iterator[tuple[str, str]]:
    """(emoji, name), also of the form without presentation marks where that is no plain ASCII character.

    The sequences come from the Unicode data that Spark itself ships; names are
    those of the characters.
    """
    jvm = spark._jvm
    found = jvm.com.ibm.icu.text.UnicodeSet(EMOJI_PROPERTY)
    seen = set()
    for sequence in jvm.java.lang.String.join("\n", found).split("\n"):
        shown = [c for c in sequence if c not in (EMOJI_PRESENTATION, JOINER)]
        flag = all("REGIONAL INDICATOR" in unicodedata.name(c, "") for c in shown)
        name = _plain(*["flag"] * flag, *(_character_name(c) for c in shown))
        for form in (sequence, sequence.replace(EMOJI_PRESENTATION, "")):
            if form not in seen and not form.isascii():
                seen.add(form)
                yield form, name


def _literal_table(spark: SparkSession, columns: dict[str, list[str]]) -> DataFrame:
    """A small table from lists, marked for broadcast: its size is fixed."""
    lists = (F.split(F.lit("\n".join(values)), "\n") for values in columns.values())
    return F.broadcast(spark.range(1).select(F.inline(F.arrays_zip(*lists))).toDF(*columns))


def stopword_dim(spark: SparkSession, source: DataFrame | None = None) -> DataFrame:
    """(stopword): the given table, or the packaged English list."""
    if source is not None:
        return check_columns(source, DIMENSION_SCHEMAS["stopwords"], "stopwords")
    return _literal_table(spark, {"stopword": list(STOPWORDS)})


def emoji_dim(spark: SparkSession, source: DataFrame | None = None) -> DataFrame:
    """(emoji, plain_text), one row per emoji.

    Without a table of the caller's, the rows are Unicode's recommended emoji:
    single characters, keycaps, skin tones, flags and joined sequences.
    """
    if source is not None:
        return check_columns(source, DIMENSION_SCHEMAS["emoji_text_map"], "emoji_text_map")
    pictures, names = zip(*_emoji_rows(spark))
    return _literal_table(spark, {"emoji": list(pictures), "plain_text": list(names)})
