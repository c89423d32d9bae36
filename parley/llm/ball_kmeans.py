"""Ball k-means: clusters as balls, whose radii tell which centroids a member must be compared with."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise, remove_table, small_batches

#: Rows that numpy compares at a time.
ROWS = 2_048


@dataclass(frozen=True)
class Balls:
    """Centroids (k x dim, whole numbers) and an upper bound of each ball's radius; no radii before the first round."""

    centroids: np.ndarray
    radii: np.ndarray | None

    def neighbours(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Centroids that may be nearest to a member of ball ``i``, nearest ones first, and their squared distances.

        A centroid at twice the radius or farther cannot be nearer to any member than the ball's own.
        """
        gaps = ((self.centroids - self.centroids[i]) ** 2).sum(axis=1)
        near = np.flatnonzero(gaps.astype(float) <= 4.0 * self.radii[i] ** 2 * (1 + 1e-9) + 1e-6)
        near = near[near != i]
        near = near[np.lexsort((near, gaps[near]))]
        return near, gaps[near]


def most_component(dim: int) -> int:
    """Largest absolute component with which four times any squared distance fits 64 bits."""
    return isqrt((1 << 60) // max(dim, 1)) // 2


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, dim: int, scale: int) -> DataFrame:
    """Rows (id, v array<long>) of vectors with exactly ``dim`` components, none null or not finite: floor(scale * x)."""
    x, most = F.col(vector_col), most_component(dim)
    fine = (F.size(x) == dim) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    whole = F.transform(x, lambda e: F.floor(F.greatest(F.lit(-float(most)), F.least(F.lit(float(most)), F.lit(float(scale)) * e.cast("double")))).cast("long"))
    return vectors.where(F.coalesce(fine, F.lit(False))).select(F.col(id_col).alias("id"), whole.alias("v"))


def first_centroids(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors whose ids have the smallest hashes, in their order; null ids come last. Never more than k rows."""
    order = [F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).asc_nulls_last(), F.col("v")]
    return np.array([row.v for row in rows.orderBy(*order).limit(k).select("v").collect()], np.int64)


def _distances(x: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    return ((x - centroid) ** 2).sum(axis=1)


def assign(x: np.ndarray, own: np.ndarray | None, balls: Balls) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of each row and its squared distance; equal distances go to the smaller number.

    Without ``own`` (the first round) all centroids are compared. Else a row at distance d of its own centroid belongs to
    the annulus of those neighbours whose centroids lie within 2 d, and is compared with these only; rows within half
    the gap to the nearest neighbour are the stable core and stay.
    """
    if balls.radii is None:
        gaps = np.stack([_distances(x, c) for c in balls.centroids], axis=1)
        best = gaps.argmin(axis=1)
        return best, gaps[np.arange(len(x)), best]
    best, least = own.copy(), np.empty(len(x), np.int64)
    for i in np.unique(own):
        rows = np.flatnonzero(own == i)
        least[rows] = _distances(x[rows], balls.centroids[i])
        near, gaps = balls.neighbours(i)
        ring = np.searchsorted(gaps, 4 * least[rows], "right")  # neighbours that the row's annulus reaches
        for place in range(ring.max(initial=0)):
            reached = rows[ring > place]
            d, j = _distances(x[reached], balls.centroids[near[place]]), near[place]
            nearer = (d < least[reached]) | ((d == least[reached]) & (j < best[reached]))
            best[reached[nearer]], least[reached[nearer]] = j, d[nearer]
    return best, least


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, dim)


def _assigned(rows: DataFrame, balls: Balls, dim: int) -> DataFrame:
    """Rows (id, v, cluster, distance) under the given centroids; ``rows`` has the clusters of the round before, if any."""
    again = balls.radii is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                own = batch.column("cluster").to_numpy() if again else None
                best, least = assign(_matrix(batch.column("v"), dim), own, balls)
                columns = [batch.column("id"), batch.column("v"), pa.array(best, pa.int32()), pa.array(least, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "v", "cluster", "distance"])

    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, v array<bigint>, cluster int, distance bigint")


def _sums(rows: DataFrame, k: int, dim: int) -> DataFrame:
    """Per cluster: n, sums of the components, largest and summed distance. Tasks send at most k rows each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, far, total, sums = np.zeros(k, np.int64), np.zeros(k, np.int64), [0] * k, np.zeros((k, dim), np.int64)
        for batch in batches:
            cluster, distance, x = batch.column("cluster").to_numpy(), batch.column("distance").to_numpy(), _matrix(batch.column("v"), dim)
            for i in np.unique(cluster):
                own = cluster == i
                n[i] += own.sum()
                sums[i] += x[own].sum(axis=0)
                far[i] = max(far[i], distance[own].max())
                total[i] += sum(distance[own].tolist())
        held = np.flatnonzero(n)
        columns = [pa.array(held, pa.int32()), pa.array(n[held]), pa.array(far[held]), pa.array([str(total[i]) for i in held], pa.string()), pa.array(sums[held].tolist(), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["cluster", "n", "far", "total", "sums"])

    part = rows.select("v", "cluster", "distance").mapInArrow(run, "cluster int, n bigint, far bigint, total string, sums array<bigint>")
    whole = [F.sum(F.get("sums", F.lit(j)).cast("decimal(38,0)")).cast("string").alias(f"s{j}") for j in range(dim)]
    return part.groupBy("cluster").agg(F.sum("n").alias("n"), F.max("far").alias("far"), F.sum(F.col("total").cast("decimal(38,0)")).cast("string").alias("total"), F.array(*whole).alias("sums"))


def cluster_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dim: int = 64, k: int = 16, rounds: int = 3, scale: int = 64, seed: int = 1) -> DataFrame:
    """Clusters of vectors by ball k-means: (id, cluster, distance, cluster_inertia, inertia, centroid array<long>).

    Vectors with exactly ``dim`` components, none null or not finite, take part, as whole numbers floor(scale * x); others
    have no row. The ``k`` vectors whose ids have the smallest sha256 of "<seed>:<id>" start as centroids (fewer vectors:
    fewer centroids). A round assigns every vector to its nearest centroid by squared distance, ties to the smaller
    number, then moves each non-empty centroid to the exact floor of its members' mean. At last vectors are
    assigned once more. All arithmetic is in whole numbers, so no partitioning changes a result.

    Each round reads and writes the vectors once; a ball's radius is bounded by its members' largest distance before the
    centroid moved plus the move, so no pass of its own is needed. The driver gets k rows of sums a round. Components
    beyond ``most_component(dim)`` count as that, so that distances fit 64 bits; inertias beyond 64 bits as the largest long.

    Null ids take part and start clusters last; repeated ids are vectors of their own. An empty table, or one without a
    vector to keep, gives an empty result. Further columns are ignored.
    """
    spark, kind = vectors.sparkSession, dict(vectors.dtypes)[id_col]
    out = f"id {kind}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid array<bigint>"
    with small_batches(spark, ROWS * 4):
        rows = materialise(whole_vectors(vectors, id_col, vector_col, dim, scale), "whole-vectors")
        start = first_centroids(rows, k, seed)
        if not len(start):
            return spark.createDataFrame([], out).withColumnRenamed("id", id_col)
        balls = Balls(start, None)
        for turn in range(rounds + 1):
            done = materialise(_assigned(rows, balls, dim), "balls")
            remove_table(rows)
            rows = done
            found = {row.cluster: row for row in _sums(rows, len(start), dim).collect()}
            if turn < rounds:
                moved, radii = balls.centroids.copy(), np.zeros(len(start))
                for i, row in found.items():
                    moved[i] = [int(s) // row.n for s in row.sums]
                    radii[i] = np.sqrt(float(row.far)) + np.sqrt(float(_distances(moved[i][None], balls.centroids[i])[0]))
                balls = Balls(moved, radii)
    most = (1 << 63) - 1
    inertia = {i: int(row.total) for i, row in found.items()}
    total = min(sum(inertia.values()), most)
    # One row a cluster, k at most.
    facts = spark.createDataFrame([(i, min(s, most), total, balls.centroids[i].tolist()) for i, s in inertia.items()], "cluster int, cluster_inertia bigint, inertia bigint, centroid array<bigint>")
    return rows.select(F.col("id").alias(id_col), "cluster", "distance").join(F.broadcast(facts), "cluster").select(id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def digest(clusters: DataFrame) -> DataFrame:
    """Clusters with the sha256 of each centroid's decimal components instead of the centroid."""
    joined = F.sha2(F.array_join(F.transform("centroid", lambda x: x.cast("string")), ","), 256)
    return clusters.withColumn("centroid_sha256", joined).drop("centroid")


def centroid_digest(centroid: np.ndarray) -> str:
    """The same digest outside Spark."""
    return hashlib.sha256(",".join(str(int(x)) for x in centroid).encode()).hexdigest()
