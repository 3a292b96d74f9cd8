"""Quality and toxicity: held-out accuracy, exact parts against brute force, defined results for odd rows."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chatlens.llm import quality, queries, toxicity
from chatlens.llm.textbytes import text_bytes

SMALL = "/root/testdata/sf0.01"


@pytest.mark.parametrize("query,label,least", [("op1_quality", "quality", 0.95), ("op2_toxicity", "toxic", 0.9)])
def test_held_out_accuracy(spark, query, label, least):
    scored = queries.QUERIES[query](spark, SMALL)
    assert scored.count() == spark.read.parquet(f"{SMALL}/documents.parquet").count()
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    held = scored.where("held_out").join(labels, "doc_id").select(F.avg((F.col("predicted") == F.col(label)).cast("int")))
    assert held.first()[0] >= least


def test_trees_in_arrays_do_what_trees_do():
    pick = np.random.default_rng(0)
    rows = pick.normal(size=(2000, 5))
    labels = ((rows[:, 0] > 0.3) ^ (rows[:, 3] > 0)).astype(float)
    trees = quality.grow(rows, labels)
    assert ((trees.score(rows) > 0.5) == labels).mean() > 0.97

    def walk(row):
        total = trees.base
        for asked, limits, values in zip(trees.asked, trees.limits, trees.values):
            node = 0
            while node < len(asked):
                node = 2 * node + 1 + int(row[asked[node]] > limits[node])
            total += values[node - len(asked)]
        return 1 / (1 + np.exp(-total))

    assert trees.score(rows[:50]) == pytest.approx([walk(r) for r in rows[:50]])


def test_statistics_are_of_one_text_each():
    texts = ["One line.\nOne line.\nTwo", "", "SHOUT!! SHOUT!!", "a a a b", "été 12"]
    together = quality.statistics(*text_bytes(pa.array(texts)))
    apart = [quality.statistics(*text_bytes(pa.array([t])))[0] for t in texts]
    assert together == pytest.approx(np.array(apart))
    at = quality.STATISTICS.index
    assert together[0, at("distinct_lines")] == pytest.approx(2 / 3)
    assert together[3, at("doubled_words")] == pytest.approx(0.5)
    assert not together[1].any()


def test_quality_of_odd_documents(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([(1, 1), (5, 0), (None, 1), (9, None), (2, 0), (2, 1)], "doc_id bigint, label int")
    clashing = odd_documents.withColumn("score", F.lit("x")).withColumn("label", F.lit("y"))
    trees = quality.fit(clashing, labels)
    rows = quality.score(clashing, trees).collect()
    assert len(rows) == odd_documents.count() and all(0 <= r.score <= 1 for r in rows)
    assert quality.score(no_documents, trees).count() == 0
    untaught = quality.fit(no_documents, labels.limit(0))
    assert all(r.score > 0.999 for r in quality.score(odd_documents, untaught).collect())


def test_marginals_are_those_of_all_paths():
    pick = np.random.default_rng(0)
    tagger = toxicity.Tagger(
        pick.normal(size=toxicity.SPACE), pick.normal(size=(2, 2)), 0.3, np.array([0.0, 0.0, 0.0, -0.5])
    )
    firsts = np.array([0, 0, 7, 8, 8, 30, 60])
    found = pick.integers(0, toxicity.SPACE, (60, 4))
    mine = tagger.marginals(found, firsts)
    emission, step = tagger.emission(found), np.exp(tagger.neighbours)
    for a, b in zip(firsts, firsts[1:]):
        if a == b:
            continue
        forward = [np.array([1, emission[a] * np.exp(tagger.first)])]
        for t in range(a + 1, b):
            forward.append((forward[-1] @ step) * [1, emission[t]])
        backward = [np.ones(2)]
        for t in range(b - 1, a, -1):
            backward.insert(0, step @ (np.array([1, emission[t]]) * backward[0]))
        joint = np.array(forward) * np.array(backward)
        assert mine[a:b] == pytest.approx(joint[:, 1] / joint.sum(axis=1))


def test_spans_are_offsets_of_the_offence(spark, odd_documents, no_documents):
    bad = [f"été numéro {i} tu es un vrai idiot ici" for i in range(30)]
    good = [f"été numéro {i} tu es un vrai ami ici" for i in range(30)]
    tagger = toxicity.fit_texts(pa.array(bad + good), np.array([1] * 30 + [0] * 30))
    frame = spark.createDataFrame([(1, bad[3]), (2, good[3]), (3, None)], "doc_id bigint, text string")
    rows = {r.doc_id: r for r in toxicity.tag(frame, tagger).collect()}
    assert [bad[3][s.begin : s.end] for s in rows[1].spans] == ["idiot"]
    assert rows[1].score > 0.5 > rows[2].score and not rows[2].spans and rows[3].score == 0
    clashing = odd_documents.withColumn("score", F.lit("x")).withColumn("spans", F.lit("y"))
    assert toxicity.tag(clashing, tagger).count() == odd_documents.count()
    assert toxicity.tag(no_documents, tagger).count() == 0


def test_fitting_on_odd_labels(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([(14, 1), (1, 0), (None, 1), (9, None), (3, 1)], "doc_id bigint, label int")
    assert toxicity.tag(odd_documents, toxicity.fit(odd_documents, labels)).count() == odd_documents.count()
    untaught = toxicity.fit(no_documents, labels.limit(0))
    assert all(r.score < 0.5 for r in toxicity.tag(odd_documents, untaught).collect())
