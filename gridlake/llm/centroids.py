"""Clustering of integer vectors around centroids, in column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .shared import stored
from .vectors import kept

CLUSTERS, DIMENSIONS, ROUNDS, SEED = 8, 64, 10, 3


def literal(numbers: list[int]) -> Column:
    return F.expr(f"array({','.join(f'{x}L' for x in numbers)})")


def distance(v: str, centroid: list[int]) -> Column:
    """Squared Euclidean distance of an integer vector to a literal one."""
    squares = F.zip_with(F.col(v), literal(centroid), lambda a, b: (a - b) * (a - b))
    return F.aggregate(squares, F.lit(0).cast("bigint"), lambda s, x: s + x)


def nearest(v: str, centroids: list[list[int]]) -> Column:
    """(distance, cluster) of the nearest centroid; of equally near ones the smaller number."""
    return F.array_min(F.array(*[F.struct(distance(v, c).alias("distance"), F.lit(k).alias("cluster")) for k, c in enumerate(centroids)]))


def moved(rows: DataFrame, centroids: list[list[int]], dimensions: int) -> list[list[int]]:
    """The floors of the clusters' means; a cluster without vectors keeps its centroid. One row a cluster comes to the driver."""
    sums = [F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(dimensions)]
    found = rows.select("v", nearest("v", centroids)["cluster"].alias("cluster")).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *sums)
    out = list(centroids)
    for r in found.collect():
        out[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(dimensions)]
    return out


def cluster_vectors(
    df: DataFrame, id: str = "vec_id", vector: str = "embedding", clusters: int = CLUSTERS, dimensions: int = DIMENSIONS, rounds: int = ROUNDS, seed: int = SEED
) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid) of each vector that has exactly ``dimensions`` finite components.

    Components are integers floor(1024 * x). The first centroids are the vectors with the smallest SHA-256 of ``<seed>:<id>``; each
    round assigns all vectors to their nearest centroid and moves the centroids to the floors of the means. ``distance`` is squared;
    the inertias are its sums over the cluster and over all. Centroids are literals of the plan, so ``clusters`` times ``dimensions``
    stays in the thousands; rounds end early when no centroid moves, as nothing can change then.

    Rows with null vectors, null or non-finite components or another length are dropped. Repeated ids get a row each; of equal ids the
    smaller vector is the earlier centroid, and a null id counts as an empty one. With fewer vectors than ``clusters`` each is a first centroid; no
    vectors, no rows. Extra columns are left out. Only the sums of each cluster and task are shuffled.
    """
    rows = stored(kept(df, id, vector, F.size(F.col(f"`{vector}`")) == dimensions))
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    centroids = [r["v"] for r in rows.select("v", drawn.alias("h")).orderBy("h", "v").limit(clusters).collect()]
    if not centroids:
        centroids = [[0] * dimensions]
    for _ in range(rounds):
        before, centroids = centroids, moved(rows, centroids, dimensions)
        if centroids == before:
            break
    placed = stored(rows.select("id", nearest("v", centroids).alias("at")).select("id", "at.cluster", "at.distance"))
    sums = {r["cluster"]: r["d"] for r in placed.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    of = lambda values: F.element_at(F.array(*values), F.col("cluster") + 1)
    return placed.select(
        F.col("id").alias(id), "cluster", "distance", of([F.lit(sums.get(k, 0)).cast("bigint") for k in range(len(centroids))]).alias("cluster_inertia"),
        F.lit(sum(sums.values())).cast("bigint").alias("inertia"), of([literal(c) for c in centroids]).alias("centroid"))
