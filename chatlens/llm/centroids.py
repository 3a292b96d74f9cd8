"""Centroid clustering of integer vectors by Lloyd's rounds, in DataFrame expressions only.

A round is one pass: ``zip_with`` and ``aggregate`` give the distance of a
vector to each centroid of one literal array, ``array_min`` over structs
(distance, number) chooses the nearest, and a sum for each component, combined
before the shuffle, gives the new centroids.  So however many vectors a cluster
has, a task sends one row for it, and the driver sees one row per cluster.
All arithmetic is on integers and exact.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlens.llm.common import written

#: Components of this size or more would overflow the distance, and raise an error.
LARGEST = 1 << 27


def integer_vectors(frame: DataFrame, vector: str, size: int, scale: float) -> Column:
    """floor(scale * x) of every component as an array of long integers; null for vectors that are not kept.

    Kept are those of exactly ``size`` components, none null, NaN or infinite.
    """
    held = F.col(vector)
    finite = F.forall(held, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(held, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("bigint"))
    fits = F.forall(held, lambda x: F.abs(F.lit(scale) * x.cast("double")) < float(LARGEST))
    checked = F.when(fits, whole).otherwise(F.raise_error(F.lit(f"a component is not under {LARGEST}")).cast("array<bigint>"))
    return F.when((F.size(held) == size) & finite, checked)


def nearest(vector: Column, centroids: list[list[int]]) -> Column:
    """The struct (distance, cluster) of the nearest centroid; the lower number wins a tie."""
    zero = F.lit(0).cast("bigint")

    def distance(centroid: Column) -> Column:
        return F.aggregate(F.zip_with(vector, centroid, lambda a, b: a - b), zero, lambda total, d: total + d * d)

    rows = (",".join(f"{x}L" for x in c) for c in centroids)
    placed = F.expr(f"array({','.join(f'array({row})' for row in rows)})")
    return F.array_min(F.transform(placed, lambda c, i: F.struct(distance(c).alias("distance"), i.cast("int").alias("cluster"))))


def first_centroids(vectors: DataFrame, clusters: int, seed: str) -> list[list[int]]:
    """Vectors of the least sha256 of seed:vec_id; rows of one id in the order of their vectors, those without id last."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    least = vectors.orderBy(digest.asc_nulls_last(), "vector").limit(clusters).select("vector").collect()
    return [list(row.vector) for row in least]


def moved(vectors: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Each centroid as the floor of the mean of the vectors nearest to it; one without vectors stays."""
    size = len(centroids[0])
    assigned = vectors.select(nearest(F.col("vector"), centroids)["cluster"].alias("cluster"), "vector")
    sums = [F.sum(F.col("vector")[i]).alias(f"s{i}") for i in range(size)]
    out = list(centroids)
    for row in assigned.groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect():  # a row per cluster
        out[row.cluster] = [row[f"s{i}"] // row.n for i in range(size)]
    return out


def cluster(
    frame: DataFrame, clusters: int, rounds: int, size: int, vector: str = "embedding", scale: float = 256.0, seed: str = "2"
) -> tuple[DataFrame, list[list[int]]]:
    """Rows (vec_id, cluster, distance) of all kept vectors, and the centroids they are nearest to.

    Vectors of another size, null ones, and those with a null, NaN or infinite
    component are left out.  Repeated rows stay and count each time; null ids
    stay.  With fewer vectors than clusters there are as many clusters as
    vectors; an empty table gives no rows and no centroids.  Other columns are
    left out.  A component of LARGEST or more in size, scaled, raises an error,
    as the distance would not fit.
    """
    held = frame.select("vec_id", integer_vectors(frame, vector, size, scale).alias("vector")).where("vector IS NOT NULL")
    vectors = written(held, "vectors")
    centroids = first_centroids(vectors, clusters, seed)
    if not centroids:
        return vectors.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance")), centroids
    for _ in range(rounds):
        centroids = moved(vectors, centroids)
    found = vectors.select("vec_id", nearest(F.col("vector"), centroids).alias("found"))
    return written(found.select("vec_id", "found.cluster", "found.distance"), "clusters"), centroids


def described(assigned: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """Adds cluster_inertia, inertia (distances summed over the cluster and over all) and centroid_sha256."""
    sums = {row.cluster: row.total for row in assigned.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    of = F.col("cluster") + 1
    inertias = F.lit([sums.get(k, 0) for k in range(len(centroids))] or [0]).cast("array<bigint>")
    return assigned.withColumns(
        {
            "cluster_inertia": F.element_at(inertias, of),
            "inertia": F.lit(sum(sums.values())).cast("bigint"),
            "centroid_sha256": F.element_at(F.lit(digests or [""]), of),
        }
    )
