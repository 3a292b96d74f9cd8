"""Stems against the published steps written as a loop over letters, and the examples published with them."""

import pytest

from chatlens.operators import stems, tokens
from checks.queries import Tables

EXAMPLES = {
    "caresses": "caress", "ponies": "poni", "ties": "ti", "caress": "caress", "cats": "cat", "feed": "feed", "agreed": "agre",
    "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing", "conflated": "conflat", "troubled": "troubl",
    "sized": "size", "hopping": "hop", "tanned": "tan", "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail",
    "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "rational": "ration",
    "valenci": "valenc", "digitizer": "digit", "operator": "oper", "feudalism": "feudal", "decisiveness": "decis",
    "hopefulness": "hope", "callousness": "callous", "formaliti": "formal", "sensibiliti": "sensibl", "triplicate": "triplic",
    "formative": "form", "formalize": "formal", "electrical": "electr", "goodness": "good", "revival": "reviv",
    "allowance": "allow", "inference": "infer", "airliner": "airlin", "adjustable": "adjust", "irritant": "irrit",
    "replacement": "replac", "adjustment": "adjust", "dependent": "depend", "adoption": "adopt", "communism": "commun",
    "activate": "activ", "effective": "effect", "bowdlerize": "bowdler", "probate": "probat", "rate": "rate", "cease": "ceas",
    "controll": "control", "roll": "roll", "generalizations": "gener", "oscillators": "oscil", "by": "by", "s": "s", "syzygy": "syzygi",
}


def kinds(word):
    out = ""
    for letter in word:
        out += "v" if letter in "aeiou" or (letter == "y" and out.endswith("c")) else "c"
    return out


def measure(word):
    shape = kinds(word)
    return sum(a + b == "vc" for a, b in zip(shape, shape[1:]))


def double(word):
    return len(word) > 1 and word[-1] == word[-2] and kinds(word)[-2:] == "cc"


def short(word):
    return kinds(word)[-3:] == "cvc" and word[-1] not in "wxy"


def by_ending(word, pairs, fits):
    for ending, new in sorted(pairs, key=lambda pair: -len(pair[0])):
        if word.endswith(ending):
            rest = word[: len(word) - len(ending)]
            return rest + new if fits(rest, ending) else word
    return word


def brute(word):
    if len(word) < 3:
        return word
    word = by_ending(word, stems.PLURALS, lambda rest, _: True)
    if word.endswith("eed"):
        word = word[:-1] if measure(word[:-3]) > 0 else word
    else:
        for ending in ("ed", "ing"):
            rest = word[: len(word) - len(ending)]
            if word.endswith(ending):
                if "v" in kinds(rest):
                    word = rest
                    if word.endswith(("at", "bl", "iz")):
                        word += "e"
                    elif double(word) and word[-1] not in "lsz":
                        word = word[:-1]
                    elif measure(word) == 1 and short(word):
                        word += "e"
                break
    if word.endswith("y") and "v" in kinds(word[:-1]):
        word = word[:-1] + "i"
    word = by_ending(word, stems.DOUBLE_ENDINGS, lambda rest, _: measure(rest) > 0)
    word = by_ending(word, stems.SIMPLE_ENDINGS, lambda rest, _: measure(rest) > 0)
    last = [(ending, "") for ending in stems.LAST_ENDINGS]
    word = by_ending(word, last, lambda rest, ending: measure(rest) > 1 and (ending != "ion" or rest.endswith(("s", "t"))))
    if word.endswith("e"):
        rest = word[:-1]
        if measure(rest) > 1 or (measure(rest) == 1 and not short(rest)):
            word = rest
    if measure(word) > 1 and double(word) and word.endswith("l"):
        word = word[:-1]
    return word


def test_published_examples(spark):
    df = spark.createDataFrame([(w,) for w in EXAMPLES], "token string")
    assert {r.token: r.stem for r in stems.with_stem(df).collect()} == EXAMPLES
    assert {w: brute(w) for w in EXAMPLES} == EXAMPLES


def test_all_tokens_of_the_documents(spark):
    t = Tables(spark, "/root/testdata/sf0.001", "documents")
    words = tokens.token_dictionary(t["message_tokens_unnest"], t["stopwords"], t["emoji_text_map"])
    found = stems.with_stem(words).collect()
    assert found and all(r.stem == brute(r.token) for r in found)
    assert found[0].asDict().keys() == {"token", "length", "is_english_stopword", "is_punct", "is_emoji", "stem"}


@pytest.mark.parametrize("word", ["", None, "yyyyyyyyyyying", "aaa!", "ééés", "👍", "!", "ed", "ing", "sses", "a" * 500 + "ed", "x!ed", "be!ing"])
def test_odd_words(spark, word):
    df = spark.createDataFrame([(word,)], "token string")
    assert stems.with_stem(df).first().stem == (word if word is None else brute(word))
