"""The pipeline against a chain of brute-force stages, with a large group of texts that are similar but not equal."""

import hashlib
import random

import numpy as np
import pytest
from test_duplicates import brute_classes
from test_native import brute_hits
from tokenizers import Tokenizer

import corpus_pipeline
from chatlens.llm import near_dups, quality
from chatlens.llm.common import Scratch, written
from chatlens.llm.queries import QUALITY_FOLD, QUALITY_LIMIT, labelled, vocabulary

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The smallest data set and 150 texts of one template, of which some 20 words in 120 differ."""
    place = str(tmp_path_factory.mktemp("data"))
    documents = spark.read.parquet(f"{SMALL}/documents.parquet")
    good = documents.join(labelled(spark, SMALL, "quality", *QUALITY_FOLD).where("label = 1"), "doc_id").orderBy("doc_id").first()
    words, pick = (good.text.split() * 200)[:120], random.Random(9)
    rows = []
    for k in range(150):
        own = list(words)
        for at in pick.sample(range(0, 120, 6), pick.choice([0, 1, 2, 3, 5])):
            own[at] = f"word{pick.randint(0, 9)}"
        rows.append((100_000 + k, " ".join(own)))
    more = spark.createDataFrame(rows, "doc_id bigint, text string")
    for name, _ in documents.dtypes:
        if name not in more.columns:
            more = more.crossJoin(documents.select(name).limit(1))
    documents.unionByName(more.select(documents.columns)).write.parquet(f"{place}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").write.parquet(f"{place}/{name}.parquet")
    return place


def without_repeats(rows):
    """Texts without the 50-byte strings that start in a smaller document; characters of which a byte stays, stay."""
    first = {}
    for i, text in rows:
        held = text.encode()
        for k in range(len(held) - 49):
            first[held[k : k + 50]] = min(i, first.get(held[k : k + 50], i))
    for i, text in rows:
        held, gone = text.encode(), set()
        for k in range(len(held) - 49):
            if first[held[k : k + 50]] < i:
                gone.update(range(k, k + 50))
        out, at = [], 0
        for character in text:
            size = len(character.encode())
            if not gone.issuperset(range(at, at + size)):
                out.append(character)
            at += size
        yield i, "".join(out)


def test_run_equals_brute_force(spark, folder):
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    trees = quality.fit(documents, labelled(spark, folder, "quality", *QUALITY_FOLD))
    scored = quality.score(documents, trees).where(f"score >= {QUALITY_LIMIT}").collect()
    rows = [(r.doc_id, r.text or "") for r in scored]
    assert sum(i >= 100_000 for i, _ in rows) > 100
    classes = dict(brute_classes(rows))
    rows = [(i, text) for i, text in rows if classes[i] == i]
    assert 0 < sum(i >= 100_000 for i, _ in rows) < 150
    rows = list(without_repeats(rows))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    clean = {hit[0] for hit in brute_hits(rows, items) if not hit[2]}
    library, want = Tokenizer.from_file(vocabulary()), []
    for i, text in rows:
        if i in clean:
            ids = library.encode(text, add_special_tokens=False).ids
            decoded = library.decode(ids, skip_special_tokens=False).encode()
            want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded).hexdigest()))
    found = corpus_pipeline.run(spark, folder)
    assert sorted(tuple(r) for r in found.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()) == sorted(want)


def test_stages_leave_the_tables_of_others(spark):
    held = near_dups.near_duplicate_classes(spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f")], "doc_id bigint, text string"))
    corpus_pipeline.near_duplicates_stage(spark, spark.createDataFrame([(1, "x")], "doc_id bigint, text string"), SMALL)
    corpus_pipeline.tokens_stage(spark, spark.createDataFrame([(1, "x")], "doc_id bigint, text string"), SMALL)
    assert held.count() == 2


def test_a_scratch_clears_its_own_tables_only(spark):
    scratch, frame = Scratch(), spark.range(3)
    other = written(frame, "test")
    with scratch:
        mine = written(frame, "test")
        kept = written(frame, "test", scratch=False)
    assert [t.count() for t in (other, mine, kept)] == [3, 3, 3]
    scratch.clear()
    assert other.count() == kept.count() == 3
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist|PATH_NOT_FOUND"):
        spark.read.parquet(mine.written_to).count()
