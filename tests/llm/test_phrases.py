"""Phrase mining against counting every contiguous run of words."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from chatlens.llm import fm_index, phrases


def brute_counts(rows, longest):
    out, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang or "und"] += len(words)
            for size in range(1, longest + 1):
                for at in range(len(words) - size + 1):
                    out[lang or "und"][tuple(words[at : at + size])] += 1
    return out, totals


def brute_collocations(rows, longest, least, top):
    counts, totals = brute_counts(rows, longest)
    out = []
    for lang, f in counts.items():
        often = {g: n for g, n in f.items() if n >= least and len(g) > 1}
        found = []
        for g, a in often.items():
            inside = (h for h in often if len(h) > len(g) and any(h[i : i + len(g)] == g for i in range(len(h))))
            if any(100 * often[h] >= 80 * a for h in inside):
                continue
            score, k = min((2_000_000 * a // (f[g[:k]] + f[g[k:]]), k) for k in range(1, len(g)))
            found.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:top], 1):  # noqa: E741
            out.append((lang, rank, phrase.decode(), -a, l, r, totals[lang], -score))
    return sorted(out)


def random_rows(seed, n=120):
    pick = random.Random(seed)
    words = [*"abcdefg", "Ab", "AB", "é", "x-y", "日本", "(q)", "\u0000"]
    joins = [" "] * 12 + ["\t ", ". ", ",", "\n", "! ", "\x0b", ";"]
    rows = []
    for _ in range(n):
        text = "".join(pick.choice(words) + pick.choice(joins) for _ in range(pick.randint(0, 60)))
        rows.append((pick.choice(["en", "de", None]), text))
    return rows


@pytest.mark.parametrize("depth", [2, 3, 4])
@pytest.mark.parametrize("symbols", [1, 3, 40])
def test_index_has_every_phrase_with_its_count(depth, symbols):
    pick = np.random.default_rng(depth * 100 + symbols)
    sequence = np.concatenate([[0], pick.integers(0, symbols + 1, 700), [0]])
    index = fm_index.BiIndex.build(sequence, depth, symbols)
    level = index.words()
    known = [(int(s),) for s in level.symbol]
    for size in range(2, depth + 1):
        left = size % 2 == 0
        level = index.extended(level.low, level.back, level.count, left)
        known = [(s, *known[p]) if left else (*known[p], s) for p, s in zip(level.parent.tolist(), level.symbol.tolist())]
        runs = Counter(tuple(sequence[i : i + size].tolist()) for i in range(len(sequence) - size + 1))
        assert dict(zip(known, level.count.tolist())) == {g: n for g, n in runs.items() if 0 not in g}


def test_stable_order_with_and_without_room_for_places():
    key = np.array([3, 1, 3, 0, 1], np.int64)
    assert fm_index.stable_order(key, 3).tolist() == fm_index.stable_order(key, 1 << 62).tolist() == [3, 1, 4, 0, 2]


@pytest.mark.parametrize("bound", [400_000, 150, 0])
def test_collocations_of_many_shards(spark, monkeypatch, bound):
    monkeypatch.setattr(phrases, "SHARD", 500)
    monkeypatch.setattr(phrases, "BROADCAST_ROWS", bound)
    rows = random_rows(1)
    documents = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    for least, top in ((4, 1000), (9, 25)):
        found = phrases.collocations(documents, 4, least, top).collect()
        assert sorted(tuple(r) for r in found) == brute_collocations(rows, 4, least, top)


@pytest.mark.parametrize("longest", [2, 3])
def test_counts_of_shorter_phrases(spark, longest):
    rows = random_rows(2, 40)
    found, totals = phrases.phrase_counts(spark.createDataFrame(rows, "lang string, text string"), longest, 3)
    counts, n = brute_counts(rows, longest)
    want = {(lang, " ".join(g)): c for lang, held in counts.items() for g, c in held.items() if c >= 3}
    assert {(r.lang, r.phrase): r.a for r in found.collect()} == want
    assert {r.lang: r.n for r in totals.collect()} == {k: v for k, v in n.items() if v}


def test_phrases_inside_longer_ones_go(spark):
    rows = [("en", "new york city hall. ")] * 5 + [("en", "york city. ")]
    found = phrases.collocations(spark.createDataFrame(rows, "lang string, text string"), 4, 2, 10).collect()
    assert [(r.phrase, r.a, r.l, r.r, r.n, r.score) for r in found] == [("new york city hall", 5, 5, 5, 22, 1_000_000)]


def test_odd_and_no_documents(spark, odd_documents, no_documents):
    assert phrases.collocations(no_documents).count() == 0
    rows = [(r.lang, r.text) for r in odd_documents.collect()]
    found = phrases.collocations(odd_documents.withColumnRenamed("source", "gram2"), 4, 30, 50).collect()
    assert sorted(tuple(r) for r in found) == brute_collocations(rows, 4, 30, 50)
