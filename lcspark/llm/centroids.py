"""Centroid clustering of integer vectors by scalar lookup tables.

Components are whole numbers, so few values of each dimension occur.  In a
round, each block of rows tabulates, for every dimension and every value
that occurs there in the block, the squared difference to each centroid's
component; a vector's distances are then sums of one table row per
dimension, gathered by NumPy.  Everything is in whole numbers, so results
are exact and the same for any partitioning.

Vectors are stored once; a round reads them, adds up each cluster's
components per task, and sends (clusters x dimensions) sums to the driver,
which holds the centroids.  Nothing else is collected, and a lost executor
costs its tasks only.

Defined cases: vectors of another length, null, or with a null or non-finite
component are left out; components whose whole number is beyond 2^27 are
taken as 2^27 (with their sign), so that a distance fits a long; fewer
vectors than clusters give that many clusters; a null id is hashed as
nothing and kept; vectors that share an id are clustered each for itself,
and tied in the hash order they start in the order of their components; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lcspark.llm.common import parts, ship_package, staged

DIMENSIONS, SCALE, CLUSTERS, ROUNDS = 64, 256, 40, 5
LARGEST = 1 << 27
# Rows that share the tables, and rows whose sums are gathered at a time.
BLOCK_ROWS, GATHER_ROWS = 8192, 1024


def quantised(df: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE,
              id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, v: the vectors that are kept, as whole numbers floor(scale * x)."""
    def kept(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))

    def whole(x: Column) -> Column:
        near = F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), x.cast("double") * float(scale)))
        return F.floor(near).cast("int")
    return (df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("v"))
            .where((F.size("v") == dimensions) & F.forall("v", kept))
            .select("id", F.transform("v", whole).alias("v")))


def first_centroids(vectors: DataFrame, clusters: int = CLUSTERS, seed: int = 2) -> list[list[int]]:
    """The vectors with the smallest SHA-256 of ``seed:id``, in that order."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    return [list(r["v"]) for r in vectors.select(order.alias("o"), "v").orderBy("o", "v").limit(clusters).collect()]


# -- inside tasks ----------------------------------------------------------
def _codes(column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values that occur, ascending, and each row's place among them."""
    low = int(column.min())
    span = int(column.max()) - low + 1
    if span > 8 * len(column):
        return np.unique(column, return_inverse=True)
    there = np.zeros(span, bool)
    there[column - low] = True
    return np.flatnonzero(there) + low, (np.cumsum(there) - 1)[column - low]


def distances(block: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """[rows, clusters] squared distances of whole-number vectors, by tables."""
    most = max(int(np.abs(block).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    kind = np.int32 if 4 * most * most * block.shape[1] < 2 ** 31 else np.int64
    tables = []
    for d in range(block.shape[1]):
        values, code = _codes(block[:, d])
        tables.append((np.square(values[:, None].astype(np.int64) - centroids[:, d]).astype(kind), code))
    out = np.zeros((len(block), len(centroids)), kind)
    for at in range(0, len(block), GATHER_ROWS):
        rows = slice(at, at + GATHER_ROWS)
        total = out[rows]
        for table, code in tables:
            total += table[code[rows]]
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """ids and [rows, dimensions] matrix of each block."""
    for batch in batches:
        for part in parts([batch], BLOCK_ROWS):
            if part.num_rows:
                flat = part.column("v").flatten().to_numpy(zero_copy_only=False)
                yield part.column("id"), flat.reshape(part.num_rows, -1)


def cluster_sums(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """cluster, n, sums (array): per task and cluster, its vectors' number and
    componentwise sums."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(centroids), np.int64)
        sums = np.zeros(centroids.shape, np.int64)
        for _, block in _blocks(batches):
            nearest = distances(block, centroids).argmin(axis=1)
            order = np.argsort(nearest, kind="stable")
            here, first = np.unique(nearest[order], return_index=True)
            sums[here] += np.add.reduceat(block[order].astype(np.int64), first, axis=0)
            n[here] += np.diff(np.append(first, len(order)))
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), pa.array(n[used]), pa.array(list(sums[used]), pa.list_(pa.int64()))],
            ["cluster", "n", "sums"])
    return vectors.mapInArrow(run, "cluster int, n bigint, sums array<bigint>")


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """id, cluster, distance: the nearest centroid, of equal ones the first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, block in _blocks(batches):
            far = distances(block, centroids)
            nearest = far.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(nearest, pa.int32()), pa.array(far[np.arange(len(far)), nearest], pa.int64())],
                ["id", "cluster", "distance"])
    return vectors.mapInArrow(run, "id bigint, cluster int, distance bigint")


def _moved(vectors: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Centroids as the floor of their vectors' means; empty ones stay."""
    exact = F.col("total").cast("decimal(38,0)")
    sums = (cluster_sums(vectors, np.array(centroids, np.int64))
            .select("cluster", "n", F.posexplode("sums").alias("dimension", "total"))
            .groupBy("cluster", "dimension").agg(F.sum("n").alias("n"), F.sum(exact).alias("total")))
    out = [list(c) for c in centroids]
    for r in sums.collect():                        # clusters x dimensions rows
        out[r["cluster"]][r["dimension"]] = int(r["total"]) // r["n"]
    return out


def cluster(df: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS,
            scale: int = SCALE, seed: int = 2, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia, centroid (array<bigint>)
    and centroid_sha256 for each vector that is kept."""
    spark = df.sparkSession
    ship_package(spark)
    vectors = staged(quantised(df, dimensions, scale, id_col, vector_col), "vectors")
    centroids = first_centroids(vectors, clusters, seed)
    for _ in range(rounds if centroids else 0):
        centroids = _moved(vectors, centroids)
    matrix = np.array(centroids, np.int64).reshape(-1, dimensions)
    rows = staged(assigned(vectors, matrix), "assigned")
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    known = spark.createDataFrame(list(zip(range(len(centroids)), centroids, digest)),
                                  "cluster int, centroid array<bigint>, centroid_sha256 string")
    total = F.sum("distance").cast("bigint")
    # at most one row per cluster: small enough to broadcast at any size
    per_cluster = {r["cluster"]: r["s"] for r in rows.groupBy("cluster").agg(total.alias("s")).collect()}
    sums = spark.createDataFrame(list(per_cluster.items()), "cluster int, cluster_inertia bigint")
    facts = known.join(sums, "cluster").withColumn("inertia", F.lit(sum(per_cluster.values())).cast("bigint"))
    return rows.join(F.broadcast(facts), "cluster").select(
        "id", "cluster", "distance", "cluster_inertia", "inertia", "centroid", "centroid_sha256")
