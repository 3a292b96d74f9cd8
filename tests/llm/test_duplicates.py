"""Suffix deduplication and near duplicates against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from chatlens.llm import near_dups, suffix_dedup
from chatlens.llm.suffix_runs import GRAM, WIDTH, Run, anchors, front_code, merge, sorted_run

SMALL = "/root/testdata/sf0.001"
WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def brute_repeats(rows):
    first = {}
    for i, text in rows:
        held = (text or "").encode()
        for k in range(len(held) - 49):
            if i is not None:
                first[held[k : k + 50]] = min(i, first.get(held[k : k + 50], i))
    for i, text in rows:
        held = (text or "").encode()
        gone = bytearray(len(held))
        for k in range(len(held) - 49):
            if i is not None and first[held[k : k + 50]] < i:
                gone[k : k + 50] = b"\x01" * 50
        kept = bytes(x for x, y in zip(held, gone) if not y)
        yield i, len(held), sum(gone), len(re.findall(b"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()


def found_repeats(frame):
    done = suffix_dedup.remove_repeats(frame)
    return sorted(map(tuple, done.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str)


def rows_of(frame):
    return [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]


def test_repeats_in_documents(spark):
    documents = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert found_repeats(documents) == sorted(brute_repeats(rows_of(documents)), key=str)


def test_repeats_across_chunks_and_random_texts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 3000)
    pick = random.Random(5)
    parts = ["".join(pick.choice("abé \n") for _ in range(pick.randint(20, 120))) for _ in range(30)]
    texts = ["".join(pick.choice(parts) for _ in range(pick.randint(0, 6))) for _ in range(150)]
    texts += ["a" * n for n in (49, 50, 51, 99, 300)] + ["ab" * 60, "ba" * 60]
    ids = list(range(len(texts)))
    pick.shuffle(ids)
    frame = spark.createDataFrame(list(zip(ids, texts)), "doc_id bigint, text string").repartition(5)
    assert found_repeats(frame) == sorted(brute_repeats(list(zip(ids, texts))), key=str)


def test_repeats_of_odd_documents(odd_documents, no_documents):
    done = suffix_dedup.remove_repeats(odd_documents)
    assert set(odd_documents.columns) < set(done.columns)
    assert found_repeats(odd_documents) == sorted(brute_repeats(rows_of(odd_documents)), key=str)
    assert suffix_dedup.remove_repeats(no_documents).count() == 0


def test_whole_characters_stay():
    data = np.frombuffer("aéb".encode(), np.uint8)
    removed = np.array([True, True, False, True])
    assert suffix_dedup._whole_characters(data, removed).tolist() == [True, False, False, True]


def test_every_match_has_a_common_anchor():
    pick = np.random.default_rng(7)
    shared = pick.integers(97, 105, 50).astype(np.uint8)
    for _ in range(30):
        one, two = (pick.integers(97, 105, pick.integers(0, 60)).astype(np.uint8) for _ in range(2))
        places = []
        for front in (one, two):
            data = np.concatenate([front, shared, two])
            at, _ = anchors(data, np.array([0, len(data)]))
            places.append({int(p) - len(front) for p in at if 0 <= p - len(front) <= 50 - GRAM})
        assert places[0] & places[1]


def test_merge_gives_order_and_shared_prefixes():
    pick = np.random.default_rng(1)
    for _ in range(40):
        runs, every = [], []
        for _ in range(pick.integers(1, 7)):
            rows = pick.integers(0, 2, (pick.integers(0, 40), WIDTH)).astype(np.uint8)
            rows[:, 3:70] = 0
            run, _, _ = sorted_run(rows, np.arange(len(rows)))
            runs.append(Run(*(front_code(run) if len(run) else (b"", b"")), []))
            every += [bytes(r) for r in run]
        merged = list(merge(runs))
        assert [m[0] for m in merged] == sorted(every)
        for before, here in zip(merged, merged[1:]):
            known = next((k for k in range(WIDTH) if before[0][k] != here[0][k]), WIDTH)
            assert here[1] == known


def brute_classes(rows):
    """Least id by connected groups of texts with a weighted similarity of 0.8 or more; rows as (id, text)."""
    texts = sorted({t or "" for _, t in rows})
    bags = []
    for text in texts:
        words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text)]
        grams = [tuple(words[k : k + 5]) for k in range(max(len(words) - 4, 1 if words else 0))]
        bags.append(Counter(grams))
    root = list(range(len(texts)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(bags):
        for j in range(i):
            common = sum((a & bags[j]).values())
            if common and common >= 0.8 * (a.total() + bags[j].total() - common):
                root[top(i)] = top(j)
    number = {t: top(k) for k, t in enumerate(texts)}
    least = {}
    for i, text in rows:
        k = number[text or ""]
        least[k] = min((x for x in (least.get(k), i) if x is not None), default=None)
    return sorted(((i, least[number[t or ""]]) for i, t in rows), key=str)


def found_classes(frame):
    return sorted(((r.doc_id, r.class_id) for r in near_dups.near_duplicate_classes(frame).collect()), key=str)


def test_classes_of_documents(spark):
    documents = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert found_classes(documents) == brute_classes(rows_of(documents))


def test_classes_of_odd_documents(odd_documents, no_documents):
    assert found_classes(odd_documents) == brute_classes(rows_of(odd_documents))
    assert near_dups.near_duplicate_classes(no_documents).count() == 0


def test_a_group_held_together_by_chains(spark):
    """Each text is close to the next one only, so no leader knows all of its group."""
    pick = random.Random(2)
    words = [f"w{pick.randrange(10**6)}" for _ in range(400)]
    texts = [" ".join(words[k * 6 : k * 6 + 120]) for k in range(30)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert found_classes(frame) == brute_classes(list(enumerate(texts)))


def template_texts(pick, n, twins, places=9):
    """n texts of one template with words of their own in a few places, so under 0.8 alike, but ``twins`` pairs share one."""
    base = [f"t{k}" for k in range(400)]
    texts = []
    for k in range(n):
        words, own = list(base), [f"o{k}x{j}" for j in range(places)]
        if k % 2 and k < 2 * twins:
            own[0] = kept[0]
        for j, word in enumerate(own):
            words[15 + 30 * j] = word
        kept = own
        texts.append(" ".join(words))
    pick.shuffle(texts)
    return texts


def brute_links(texts):
    """Pairs of texts with a weighted similarity of 0.8 or more, by counting; shingles must not repeat in a text."""
    number, rows = {}, []
    for text in texts:
        words = text.split()
        rows.append([number.setdefault(tuple(words[k : k + 5]), len(number)) for k in range(len(words) - 4)])
        assert len(set(rows[-1])) == len(rows[-1])
    common = np.zeros((len(texts), len(texts)), np.int32)
    holders = [[] for _ in number]
    for i, row in enumerate(rows):
        for shingle in row:
            holders[shingle].append(i)
    for held in holders:
        if len(held) > 1:
            common[np.ix_(held, held)] += 1
    size = np.array([len(r) for r in rows])
    return np.argwhere(np.triu(common >= 0.8 * (size[:, None] + size[None, :] - common), 1))


def linked_classes(texts):
    root = list(range(len(texts)))
    for i, j in brute_links(texts):
        a, b = root[i], root[j]
        root = [min(a, b) if r in (a, b) else r for r in root]
    return [(i, r) for i, r in enumerate(root)]


def test_no_link_is_lost_in_a_crowd_of_like_texts(spark):
    """Pairs at 0.817 among 2,000 texts that are at 0.796 to all others, which signatures cannot tell apart."""
    texts = template_texts(random.Random(8), 2000, 60)
    expected = linked_classes(texts)
    assert len({r for _, r in expected}) == 2000 - 60
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    assert found_classes(frame) == sorted(expected, key=str)


def test_no_link_is_lost_in_blocks(spark, monkeypatch):
    """Places filled from few words: crowds even by the least common shingles, with links at 0.8 and all around it."""
    for name, value in (("FEW", 4), ("BLOCK", 8), ("CLOSEST", 0)):
        monkeypatch.setattr(near_dups, name, value)
    pick = random.Random(4)
    base, texts = [f"t{k}" for k in range(150)], set()
    while len(texts) < 400:
        words = base[: pick.randint(120, 150)]
        for j in range(5):
            words[10 + 20 * j] = f"p{j}x{pick.randrange(12)}"
        texts.add(" ".join(words))
    texts = sorted(texts)
    expected = linked_classes(texts)
    assert 1 < len({r for _, r in expected}) < 400
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    assert found_classes(frame) == sorted(expected, key=str)


def test_a_crowded_bucket_is_dealt_in_parts(spark, monkeypatch):
    """Each member of a bucket without links comes to one part, so a part meets about MET of them."""
    monkeypatch.setattr(near_dups, "MET", 10)
    rows = [(bytes([k]), np.full(near_dups.COORDINATES, 7, "<u2").tobytes()) for k in range(200)]
    nodes = spark.createDataFrame(rows, "key binary, signature binary")
    buckets = nodes.selectExpr("1L AS bucket", "key AS node", "X'00' AS leader", "200L AS n")
    groups = spark.createDataFrame([], "key binary, root binary")
    asked = near_dups._apart(buckets, nodes, groups).collect()
    met = {}
    for r in asked:
        met.setdefault(bytes(r.a), set()).add(bytes(r.b))
        met.setdefault(bytes(r.b), set()).add(bytes(r.a))
    parts, left = [], {k for k, _ in rows}
    while left:
        part, todo = set(), {left.pop()}
        while todo:
            k = todo.pop()
            part.add(k)
            todo |= met.get(k, set()) - part
        left -= part
        parts.append(len(part))
    assert max(parts) <= 40


def test_alike_texts_find_each_other_by_their_prefixes():
    pick = np.random.default_rng(3)
    common = pick.integers(0, 5, near_dups.SLOTS)
    for _ in range(300):
        n, fewer, own = pick.integers(1, 80), pick.integers(0, 12), pick.integers(0, 12)
        one = np.unique(pick.integers(0, 1 << 40, n + fewer).astype(np.uint64))
        other = np.unique(np.append(one[: len(one) - fewer], pick.integers(0, 1 << 40, own).astype(np.uint64)))
        both = len(np.intersect1d(one, other))
        if len(other) and both >= 0.8 * (len(one) + len(other) - both):
            short, long = sorted((one, other), key=len)
            least, first = near_dups.prefix(short, common)
            assert set(least[:first]) & set(near_dups.prefix(long, common)[0])


def test_one_document_of_each_class_stays(odd_documents, no_documents):
    kept = near_dups.drop_near_duplicates(odd_documents)
    assert kept.columns == odd_documents.columns
    classes = near_dups.near_duplicate_classes(odd_documents).select("class_key").distinct().count()
    assert kept.count() == classes
    assert near_dups.drop_near_duplicates(no_documents).count() == 0


def test_darts_agree_as_often_as_weights():
    pick = np.random.default_rng(4)
    common, own = 600, 150
    shared = pick.integers(1, 1 << 62, common).astype(np.uint64)
    sides = [np.concatenate([shared, pick.integers(1, 1 << 62, own).astype(np.uint64)]) for _ in range(2)]
    agreement = []
    for _ in range(20):
        salt = np.uint64(pick.integers(1, 1 << 62))
        signs = [near_dups.dart_signatures(near_dups.mix(s ^ salt), np.zeros(len(s), np.int64), 1)[0] for s in sides]
        agreement.append((signs[0] == signs[1]).mean())
    assert np.mean(agreement) == pytest.approx(common / (common + 2 * own), abs=0.03)
