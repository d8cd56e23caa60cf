"""Centroid clustering in whole numbers, as JVM expressions.

Vectors become whole-number arrays once and are stored. A round is one scan: ``zip_with``
and ``aggregate`` give the squared distance to each centroid, a literal array in the plan;
``array_min`` of (distance, number) structs chooses the cluster, ties to the smaller
number; one sum per component, added up in each task before the shuffle, gives the next
centroids. Only these sums, one row per cluster, come to the driver. A hot cluster or many
copies of a vector cost nothing extra, as no rows are gathered.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patronlens.llm.common import read, stash

CLUSTERS, ROUNDS, SCALE, DIMENSIONS, SEED = 8, 10, 1024, 64, 3
# with components up to this a squared distance in up to 256 dimensions fits a long
LARGEST = 1 << 26


def whole_vectors(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """vec_id and ``v``, the components floor(scale * x), x as double.

    Kept are vectors with exactly ``dimensions`` components, none null or non-finite. A
    component beyond LARGEST is an error, as its distances would not fit a long.
    """
    x = F.transform("embedding", lambda e: e.cast("double"))
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    kept = vectors.filter((F.size("embedding") == dimensions) & finite)

    def whole(e: Column) -> Column:
        scaled = F.floor(e * scale)
        message = F.lit(f"a component exceeds {LARGEST / scale:g}: distances would not fit a long")
        return F.when(F.abs(e * scale) <= LARGEST, scaled).otherwise(F.raise_error(message).cast("long"))

    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, whole).alias("v"))


def first_centroids(whole: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> list[list[int]]:
    """The vectors whose ``seed:vec_id`` has the smallest hashes, in their order; all if there are fewer.

    Rows that repeat an id follow each other, the smaller vector first; rows without an id come last.
    """
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [list(r.v) for r in whole.orderBy(order.asc_nulls_last(), "v").limit(clusters).select("v").collect()]


def nearest(centroids: list[list[int]]) -> Column:
    """Struct of the least squared distance from ``v`` and the number of its centroid."""
    distance = "aggregate(zip_with(v, array({}), (a, b) -> (a - b) * (a - b)), 0L, (total, square) -> total + square)"
    choices = [
        f"struct({distance.format(', '.join(f'{x}L' for x in c))} AS distance, {n} AS cluster)"
        for n, c in enumerate(centroids)
    ]
    return F.expr(f"array_min(array({', '.join(choices)}))")


def next_centroids(whole: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The exact floor of each cluster's mean; an empty cluster keeps its centroid."""
    places = range(len(centroids[0]))
    sums = [F.expr(f"sum(v[{i}]) AS s{i}") for i in places]  # a sum beyond a long is an error, not a wrong one
    chosen = whole.select("v", nearest(centroids)["cluster"].alias("cluster"))
    moved = {
        r["cluster"]: [r[f"s{i}"] // r["held"] for i in places]
        for r in chosen.groupBy("cluster").agg(F.count(F.lit(1)).alias("held"), *sums).collect()
    }
    return [moved.get(n, c) for n, c in enumerate(centroids)]


def fit(whole: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> list[list[int]]:
    """The centroids after ``rounds`` rounds; none for an empty table. Pass a stored table."""
    centroids = first_centroids(whole, clusters, seed)
    for _ in range(rounds if centroids else 0):
        before, centroids = centroids, next_centroids(whole, centroids)
        if centroids == before:  # later rounds would repeat this one
            break
    return centroids


def digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def assign(whole: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """vec_id, cluster, squared distance, the sums of distances over its cluster and over all, centroid digest."""
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not centroids:
        return whole.sparkSession.createDataFrame([], schema)
    found = whole.select("vec_id", nearest(centroids).alias("near")).select("vec_id", "near.*")
    found = stash(found, "assigned")
    sums = {
        r["cluster"]: int(r["inertia"])
        for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("inertia")).collect()
    }
    of_cluster = F.array(*[F.lit(sums.get(n, 0)).cast("long") for n in range(len(centroids))])
    digests = F.array(*[F.lit(digest(c)) for c in centroids])
    return found.select(
        "vec_id",
        F.col("cluster").cast("int").alias("cluster"),
        "distance",
        of_cluster[F.col("cluster")].alias("cluster_inertia"),
        F.lit(sum(sums.values())).cast("long").alias("inertia"),
        digests[F.col("cluster")].alias("centroid_sha256"),
    )


def op12(spark: SparkSession, folder: str) -> DataFrame:
    whole = stash(whole_vectors(read(spark, folder, "embeddings")), "whole-vectors")
    return assign(whole, fit(whole))


def _oracle() -> str:
    """The rounds as common table expressions: c holds components of centroids, n which vector is nearest to which."""
    near = """n{r} AS MATERIALIZED (
    SELECT vec_id, row, v, CAST(k AS INTEGER) AS cluster, d AS distance FROM (
        SELECT *, row_number() OVER (PARTITION BY row ORDER BY d, k) AS place FROM (
            SELECT vec_id, row, v, k, CAST(list_sum([(v[i] - c[i]) * (v[i] - c[i]) FOR i IN range(1, 65)]) AS BIGINT) AS d
            FROM vectors, c{r}))
    WHERE place = 1)"""
    moved = """m{r} AS MATERIALIZED (
    SELECT cluster, list(CAST((s - ((s % held) + held) % held) // held AS BIGINT) ORDER BY i) AS c FROM (
        SELECT cluster, i, sum(v[i]) AS s, count(*) AS held FROM n{r}, (SELECT unnest(range(1, 65)) AS i) GROUP BY cluster, i)
    GROUP BY cluster),
c{next} AS MATERIALIZED (SELECT k, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} ON k = cluster)"""
    steps = [
        """vectors AS MATERIALIZED (
    SELECT vec_id, row_number() OVER () AS row, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
    FROM embeddings WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)""",
        """c0 AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY sha256('3:' || CAST(vec_id AS VARCHAR)), v) - 1 AS k, v AS c FROM vectors
    ORDER BY k LIMIT 8)""",
    ]
    for r in range(ROUNDS):
        steps += [near.format(r=r), moved.format(r=r, next=r + 1)]
    steps.append(near.format(r=ROUNDS))
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, cluster, distance,
       CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c, ',')) AS centroid_sha256
FROM n{ROUNDS} JOIN c{ROUNDS} ON k = cluster"""


ORACLE = _oracle()
