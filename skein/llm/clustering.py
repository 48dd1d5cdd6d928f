"""Centroid clustering in integers, screened by block norms.

A kept vector is stored once as integers with the norms of its segments (eight
components each), its compressed form. By Cauchy-Schwarz the distance of two
segments is at least the difference of their norms, so the sum of the squared
differences of norms bounds the squared distance of a vector and a centroid
from below. Each vector gets the exact distance to the centroid of the least
bound; then only centroids whose bound does not pass the best exact distance so
far get exact distances, in integers. Bounds are floating-point numbers and
are lowered by more than their rounding, so that no nearest centroid and no tie is lost.

A round is one job: tasks assign their rows and give componentwise sums for each
cluster, which Spark adds up; the driver sees the centroids alone.

Defined results: null vectors, null or non-finite components and other lengths
are left out; null vec_ids come after all others as first centroids; vectors
repeated are rows of their own, also as first centroids, where equal ids go by
their components; distances that tie go to the smaller number; fewer vectors than
centroids give as many centroids as vectors; a centroid without vectors stays as
it is; an empty table gives an empty result; other columns are ignored. A
component of 2**26 or more in integers is an error, since a distance would not
fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, table

DIM, SCALE, CLUSTERS, ROUNDS, SEED = 64, 256, 40, 5, "2"
SEGMENT = 8
LARGEST = 1 << 26
#: Vectors that are compared at once.
BLOCK = 4096


def integers(vector: Column, dim: int = DIM, scale: int = SCALE) -> Column:
    """The components times ``scale``, rounded down; null where the vector is not kept."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    return F.when((F.size(vector) == dim) & fine, scaled)


def segment_norms(v: Column, dim: int = DIM, segment: int = SEGMENT) -> Column:
    total = lambda k: F.aggregate(F.slice(v, k + 1, segment), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return F.array(*(F.sqrt(total(k)) for k in range(0, dim, segment)))


def compressed(vectors: DataFrame, column: str, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """The kept vectors, stored: vec_id, v (integers), norms."""
    v = vectors.select("vec_id", integers(F.col(column), dim, scale).alias("v")).where("v IS NOT NULL")
    small = F.forall("v", lambda x: F.abs(x) < LARGEST)
    v = v.withColumn("v", F.when(small, F.col("v").cast("array<int>")).otherwise(F.raise_error(F.lit(f"a component of {LARGEST} or more in integers")).cast("array<int>")))
    return cut(v.withColumn("norms", segment_norms(F.col("v"), dim)))


def norms_of(centroids: np.ndarray, segment: int = SEGMENT) -> np.ndarray:
    return np.sqrt((centroids.astype(float) ** 2).reshape(len(centroids), -1, segment).sum(axis=2))


def nearest(v: np.ndarray, norms: np.ndarray, centroids: np.ndarray, of_centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number and exact squared distance of the nearest centroid of each row, and how many exact distances were taken."""
    a, b = (norms**2).sum(axis=1)[:, None], (of_centroids**2).sum(axis=1)[None, :]
    bounds = (a + b) * (1 - 1e-9) - 2 * (norms @ of_centroids.T) - 1e-6  # lower than the bound by more than rounding
    first = bounds.argmin(axis=1)
    number, best, taken = first.copy(), ((v - centroids[first]) ** 2).sum(axis=1), len(v)
    for k in range(len(centroids)):
        at = np.flatnonzero((bounds[:, k] <= best) & (first != k))
        d = ((v[at] - centroids[k]) ** 2).sum(axis=1)
        better = (d < best[at]) | ((d == best[at]) & (k < number[at]))
        number[at[better]], best[at[better]] = k, d[better]
        taken += len(at)
    return number, best, taken


def _lists(column: pa.Array, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def _blocks(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of rows with their integers, cluster numbers and distances."""
    of_centroids = norms_of(centroids)
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            block = batch.slice(at, BLOCK)
            v = _lists(block.column(1), np.int64)
            yield block, v, *nearest(v, _lists(block.column(2), float), centroids, of_centroids)[:2]


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance of each compressed vector."""
    schema = T.StructType([vectors.schema["vec_id"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, number, best in _blocks(batches, centroids):
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(number, pa.int32()), pa.array(best, pa.int64())], names=schema.names)

    return vectors.select("vec_id", "v", "norms").mapInArrow(run, schema)


def cluster_sums(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """cluster, i, s: sums of each component of a cluster's vectors, and at ``i`` = -1 their number. A task gives a row a component, and Spark adds these up."""
    dim = centroids.shape[1]
    schema = T.StructType([T.StructField("cluster", T.IntegerType()), T.StructField("i", T.IntegerType()), T.StructField("s", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(centroids), dim + 1), np.int64)
        for _, v, number, _ in _blocks(batches, centroids):
            np.add.at(sums, number, np.column_stack([np.ones(len(v), np.int64), v]))
        cluster, i = np.indices(sums.shape, np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(cluster.ravel()), pa.array(i.ravel() - 1, pa.int32()), pa.array(sums.ravel())], names=schema.names)

    wide = F.sum(F.col("s").cast("decimal(38,0)"))  # a long holds a task's sums, not those of very many tasks
    return vectors.select("vec_id", "v", "norms").mapInArrow(run, schema).groupBy("cluster", "i").agg(wide.alias("s"))


def first_centroids(vectors: DataFrame, clusters: int = CLUSTERS, seed: str = SEED) -> np.ndarray:
    """The vectors with the least hashes of ``seed:vec_id``, in their order."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select("v", mark.alias("mark")).orderBy(F.col("mark").asc_nulls_last(), "v").limit(clusters).collect()
    return np.array([r["v"] for r in rows], np.int64)


def moved(centroids: np.ndarray, sums: DataFrame) -> np.ndarray:
    """Each centroid that has vectors at their mean, rounded down."""
    found = {(r["cluster"], r["i"]): int(r["s"]) for r in sums.collect()}  # a row a component of a centroid
    out = centroids.copy()
    for k in range(len(centroids)):
        if n := found.get((k, -1)):
            out[k] = [found[k, i] // n for i in range(centroids.shape[1])]
    return out


def clustered(vectors: DataFrame, column: str = "embedding", dim: int = DIM, scale: int = SCALE, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: str = SEED) -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster, distance of each kept vector, stored, and the final centroids."""
    kept = compressed(vectors, column, dim, scale)
    centroids = first_centroids(kept, clusters, seed)
    if not len(centroids):
        return kept.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    for _ in range(rounds):
        centroids = moved(centroids, cluster_sums(kept, centroids))
    return cut(assigned(kept, centroids)), centroids


def op13_block_norm_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, centroids = clustered(table(spark, sf_dir, "embeddings"))
    sums = rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    stated = [(k, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for k, c in enumerate(centroids)]
    marks = spark.createDataFrame(stated, "cluster int, centroid_sha256 string")  # a row a centroid
    total = sums.agg(F.sum("cluster_inertia")).first()[0]
    return rows.join(F.broadcast(sums.join(F.broadcast(marks), "cluster")), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", F.lit(total).cast("long").alias("inertia"), "centroid_sha256"
    )


def _assign_sql(k: int) -> str:
    return f"""
a{k} AS (
  SELECT place, any_value(vec_id) AS vec_id, any_value(v) AS v, min({{'d': d, 'c': c}}) AS near
  FROM (SELECT p.place, p.vec_id, p.v, m.c, list_sum(list_transform(list_zip(p.v, m.m), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) AS d FROM kept p, m{k} m)
  GROUP BY place
),"""


def _move_sql(k: int) -> str:
    return f"""
s{k} AS (SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT near.c AS c, unnest(v) AS x, unnest(range({DIM})) AS i FROM a{k}) GROUP BY c, i),
t{k} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS m FROM s{k} GROUP BY c),
m{k + 1} AS (SELECT m.c, coalesce(t.m, m.m) AS m FROM m{k} m LEFT JOIN t{k} t USING (c)),"""


OP13_SQL = f"""
WITH kept AS (
  SELECT vec_id, row_number() OVER () AS place, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) = {DIM} AND list_count(embedding) = {DIM} AND len(list_filter(embedding, lambda x: isfinite(x))) = {DIM}
),
m0 AS (
  SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id) NULLS LAST, v) - 1 AS c, v AS m FROM kept
  QUALIFY c < {CLUSTERS}
),{"".join(_assign_sql(k) + _move_sql(k) for k in range(ROUNDS))}{_assign_sql(ROUNDS)}
out AS (SELECT vec_id, CAST(near.c AS INT) AS cluster, CAST(near.d AS BIGINT) AS distance FROM a{ROUNDS})
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM out JOIN m{ROUNDS} ON c = cluster
"""
