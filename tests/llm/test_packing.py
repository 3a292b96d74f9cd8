"""Packing against a best fit of one piece at a time, and the ids against the library."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from chatlens.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def one_by_one(lengths, most):
    """Rooms left by best fit, longest first."""
    room = []
    for length in sorted(lengths, reverse=True):
        fits = [r for r in room if r >= length]
        best = min(fits) if fits else most
        if fits:
            room.remove(best)
        room.append(best - length)
    return sorted(room)


@pytest.mark.parametrize("seed", range(12))
def test_plan_is_best_fit(seed):
    pick, most = random.Random(seed), random.Random(seed).choice([1, 7, 64, 100])
    lengths = [pick.randint(1, pick.choice([most, max(1, most // 3)])) for _ in range(pick.randint(0, 400))]
    plan = packing.best_fit(dict(Counter(lengths)), most)
    spans, ranks = defaultdict(list), Counter()
    for length, first, last, sequence, each, offset in plan:
        assert first == ranks[length] and last > first and (last - first) % each == 0
        ranks[length] = last
        for rank in range(first, last):
            spans[sequence + (rank - first) // each].append((offset + (rank - first) % each * length, length))
    assert ranks == Counter(lengths)
    left = []
    for held in spans.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        left.append(most - at)
    assert sorted(left) == one_by_one(lengths, most)
    assert sorted(spans) == list(range(len(spans)))


def test_plan_does_not_grow_with_the_number_of_pieces():
    few = packing.best_fit({k: 3 for k in range(1, 2049)}, 2048)
    many = packing.best_fit({k: 3_000_000_000 for k in range(1, 2049)}, 2048)
    assert len(many) <= 2 * len(few) + 2048


def packed(documents, most):
    pieces = packing.cut_pieces(documents, PATH, most, 0)
    return pieces, packing.place(pieces, most)


def test_pieces_and_places(spark, odd_documents):
    library, most = Tokenizer.from_file(PATH), 16
    pieces, placed = packed(odd_documents, most)
    want = Counter()
    for row in odd_documents.collect():
        ids = library.encode(row.text or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), most):
            own = np.array(ids[k : k + most], "<u4")
            want[(row.doc_id, k // most, k, len(own), zlib.crc32(own.tobytes()))] += 1
    rows = placed.collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for spans in held.values():
        ends = np.cumsum([length for _, length in sorted(spans)])
        assert [offset for offset, _ in sorted(spans)] == [0, *ends[:-1]] and ends[-1] <= most
    assert len(held) == len(one_by_one([r.length for r in rows], most))


def test_sequences_hold_the_ids(spark, odd_documents):
    pieces, placed = packed(odd_documents, 64)
    by_place = {(r.sequence_id, r.offset): r for r in placed.collect()}
    n = 0
    for row in packing.sequences(pieces, placed).collect():
        for doc in row.docs:
            own = bytes(row.ids[4 * doc.offset : 4 * (doc.offset + doc.length)])
            assert zlib.crc32(own) == by_place[(row.sequence_id, doc.offset)].ids_crc32
            n += 1
    assert n == len(by_place)


def test_one_length_over_many_ranges(spark):
    rows = spark.range(5000).selectExpr("id AS doc_id", "'same words' AS text").repartition(7)
    _, placed = packed(rows, 9)
    found = placed.collect()
    per = 9 // found[0].length
    assert Counter(Counter(r.sequence_id for r in found).values()) == Counter({per: 5000 // per} | ({5000 % per: 1} if 5000 % per else {}))


def test_no_documents(spark, no_documents):
    assert packed(no_documents, 2048)[1].count() == 0
