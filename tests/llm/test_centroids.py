"""Centroid clustering against numpy."""

import hashlib

import numpy as np
import pytest
from pyspark.errors import PySparkException

from chatlens.llm import centroids

SCHEMA = "vec_id bigint, embedding array<float>, label int, vector string, distance string"


def brute(rows, clusters, rounds, size):
    kept = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v, *_ in rows if v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1])
    centres = [v for _, v in sorted(kept, key=key)[:clusters]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centres))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        centres = [[sum(x) // len(groups[k]) for x in zip(*groups[k])] if k in groups else c for k, c in enumerate(centres)]
    return sorted(((i, near(v)[1], near(v)[0]) for i, v in kept), key=str), centres


def random_rows(n, size, seed=0):
    pick = np.random.default_rng(seed)
    middle = pick.normal(size=(5, size))
    return [(i, (middle[i % 5] + 0.3 * pick.normal(size=size)).tolist(), i, "v", "d") for i in range(n)]


def odd_rows(size):
    good = [0.5] * size
    nan, inf = float("nan"), float("inf")
    odd = [(900, None), (901, []), (902, good[1:]), (903, [*good, 0.5]), (904, [None, *good[1:]]), (905, [nan, *good[1:]]), (906, [-inf, *good[1:]])]
    return [(i, v, None, None, None) for i, v in odd] + [(7, good, None, None, None)] * 3 + [(None, good, 1, "v", "d"), (None, [-0.001] * size, 1, "v", "d")]


@pytest.mark.parametrize("clusters", [1, 4, 500])
def test_same_as_brute_force(spark, clusters):
    rows = random_rows(150, 6) + odd_rows(6)
    found, centres = centroids.cluster(spark.createDataFrame(rows, SCHEMA).repartition(3), clusters, 3, 6)
    want, own = brute(rows, clusters, 3, 6)
    assert centres == own
    assert sorted((tuple(r) for r in found.collect()), key=str) == want


def test_sums_and_digests(spark):
    rows = random_rows(60, 6)
    assigned, centres = centroids.cluster(spark.createDataFrame(rows, SCHEMA), 4, 2, 6)
    found = centroids.described(assigned, centres).collect()
    for row in found:
        assert row.cluster_inertia == sum(r.distance for r in found if r.cluster == row.cluster)
        assert row.inertia == sum(r.distance for r in found)
        assert row.centroid_sha256 == hashlib.sha256(",".join(map(str, centres[row.cluster])).encode()).hexdigest()


def test_empty_clusters_stay(spark):
    rows = [(i, [1.0, 1.0], 0, "", "") for i in range(5)]
    found, centres = centroids.cluster(spark.createDataFrame(rows, SCHEMA), 3, 2, 2)
    assert centres == [[256, 256]] * 3 and {(r.cluster, r.distance) for r in found.collect()} == {(0, 0)}


def test_no_vectors(spark):
    none = spark.createDataFrame(odd_rows(6)[:7], SCHEMA)
    assigned, centres = centroids.cluster(none, 40, 5, 6)
    assert centres == [] and centroids.described(assigned, centres).count() == 0


def test_what_would_overflow_is_an_error(spark):
    rows = spark.createDataFrame([(1, [1e30, 0.0], 0, "", "")], SCHEMA)
    with pytest.raises(PySparkException, match="a component is not under"):
        centroids.cluster(rows, 2, 1, 2)


def test_rounds_run_without_python_workers(spark):
    rows = spark.createDataFrame(random_rows(10, 3), SCHEMA)
    vectors = rows.select("vec_id", centroids.integer_vectors(rows, "embedding", 3, 256.0).alias("vector"))
    plan = vectors.select(centroids.nearest(vectors.vector, [[1, 2, 3], [4, 5, 6]]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
