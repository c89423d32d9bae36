"""Speaker identity: centroids, nearest-centroid matching, moving centroids and clustering of windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import dot, norm, unit
from .folds import fold

#: Cosine from which a name is given, and from which a name is proposed for review.
ASSIGN, REVIEW = 0.70, 0.60
#: Rows of a registry that may be broadcast; a larger one is matched block by block with a shuffle.
BROADCAST_NAMES = 20_000


def centroids(vectors: DataFrame, key: str, vector: str, normalise: bool = True) -> DataFrame:
    """Mean vector of each key: (key, samples, centroid). Sums by (key, place) combine before the exchange."""
    places = vectors.select(key, F.posexplode(vector).alias("place", "x"))
    means = places.groupBy(key, "place").agg(F.avg(F.col("x").cast("double")).alias("x"), F.count(F.lit(1)).alias("n"))
    rows = means.groupBy(key).agg(F.max("n").alias("samples"), F.transform(F.array_sort(F.collect_list(F.struct("place", "x"))), lambda e: e["x"]).alias("centroid"))
    return rows.withColumn("centroid", unit(F.col("centroid"))) if normalise else rows


def match(vectors: DataFrame, registry: DataFrame, ident: str, vector: str) -> DataFrame:
    """Best name of each vector by cosine: (ident, name, similarity, assigned, needs_review).

    ``registry`` has (name, centroid). A registry within ``BROADCAST_NAMES`` goes to all tasks; a larger one is cut into
    blocks by name, vectors meet one block after the other, and the best of the blocks is kept. Equal similarities go to
    the smallest name. ``assigned`` from 0.70 on; between 0.60 and that a match is proposed for review.
    """
    names = registry.select("name", unit(F.col("centroid")).alias("_c"))
    rows = vectors.select(ident, F.col(vector).alias("_v"))
    count = names.limit(BROADCAST_NAMES + 1).count()
    if count <= BROADCAST_NAMES:
        held = F.broadcast(names.agg(F.collect_list(F.struct("name", "_c")).alias("_names")).withColumn("_one", F.lit(1)))
        pairs = rows.withColumn("_one", F.lit(1)).join(held, "_one")
    else:
        blocks = -(-registry.count() // BROADCAST_NAMES)
        part = names.withColumn("_block", F.pmod(F.xxhash64("name"), F.lit(blocks))).groupBy("_block").agg(F.collect_list(F.struct("name", "_c")).alias("_names"))
        pairs = rows.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>"))).join(part, "_block")
    length = norm(F.col("_v")) + 1e-9
    scored = F.transform("_names", lambda n: F.struct((-dot(n["_c"], F.col("_v")) / length).alias("s"), n["name"].alias("name")))
    best = pairs.select(ident, F.array_min(scored).alias("_b"))
    if count > BROADCAST_NAMES:
        best = best.groupBy(ident).agg(F.min("_b").alias("_b"))
    similarity = -F.col("_b.s")
    return best.select(ident, F.col("_b.name").alias("name"), similarity.alias("similarity"), (similarity >= ASSIGN).alias("assigned"), ((similarity >= REVIEW) & (similarity < ASSIGN)).alias("needs_review"))


def moving_centroids(vectors: DataFrame, key: str, order: str, vector: str, alpha: float = 0.30) -> DataFrame:
    """Centroid of each key after all its vectors in order, each blended in with weight ``alpha``: (key, samples, centroid)."""
    rows = vectors.select(F.col(key).alias("key"), F.col(order).alias("place"), F.col(vector).cast("array<double>").alias("v")).where("v is not null")

    def step(state: tuple | None, row: tuple) -> tuple[tuple, list[tuple]]:
        v = np.array(row[2])
        if state is None:
            return (1, v / (np.linalg.norm(v) + 1e-9)), []
        mixed = (1 - alpha) * state[1] + alpha * v
        return (state[0] + 1, mixed / (np.linalg.norm(mixed) + 1e-9)), []

    done = fold(rows, "key", ["place", "v"], step, lambda row, state: [(row[0], state[0], state[1].tolist())], f"key {dict(rows.dtypes)['key']}, samples long, centroid array<double>")
    return done.withColumnRenamed("key", key)


def _average_linkage(x: np.ndarray, threshold: float, clusters: int | None) -> np.ndarray:
    """Labels of average-linkage clustering by cosine distance, numbered by first row."""
    return linkage(x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-9), np.ones(len(x)), threshold, clusters)


def linkage(totals: np.ndarray, size: np.ndarray, threshold: float, clusters: int | None) -> np.ndarray:
    """The same over rows that stand for several vectors: ``totals`` are sums of unit vectors, ``size`` their numbers.

    Chains of nearest neighbours find the merges in a time that grows with the square of the rows; merges are then
    taken by their distance, as far as the threshold or until so many clusters are left.
    """
    n = len(totals)
    mean, size, alive = 1.0 - totals @ totals.T / np.outer(size, size), size.astype(float), np.ones(n, bool)
    np.fill_diagonal(mean, np.inf)
    merges: list[tuple[float, int, int]] = []
    chain: list[int] = []
    for _ in range(n - 1):
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        while True:
            row = mean[chain[-1]]
            near = int(row.argmin())
            if len(chain) > 1 and row[chain[-2]] <= row[near]:
                break
            chain.append(near)
        j, i = sorted((chain.pop(), chain.pop()), reverse=True)
        merges.append((float(mean[i, j]), i, j))
        new = (size[i] * mean[i] + size[j] * mean[j]) / (size[i] + size[j])
        new[i], new[j] = np.inf, np.inf
        new[~alive] = np.inf
        mean[i], mean[:, i] = new, new
        mean[j], mean[:, j] = np.inf, np.inf
        size[i] += size[j]
        alive[j] = False
    own = np.arange(n)

    def root(k: int) -> int:
        while own[k] != k:
            own[k] = own[own[k]]
            k = own[k]
        return k

    left = n
    for height, i, j in sorted(merges):
        if left <= (clusters or 1) or clusters is None and height > threshold:
            break
        a, b = sorted((root(i), root(j)))
        own[b] = a
        left -= 1
    _, first, label = np.unique([root(k) for k in range(n)], return_index=True, return_inverse=True)
    return np.argsort(np.argsort(first))[label]


def cluster(windows: DataFrame, file: str, order: str, vector: str, threshold: float = 0.15, clusters: int | None = None) -> DataFrame:
    """Speaker labels of a file's windows by average linkage: (file, order, cluster).

    A group is one file's windows, a bounded number for a recording; files are clustered in parallel.
    """
    kinds = dict(windows.dtypes)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable")
        labels = _average_linkage(np.stack(rows[vector].to_list()).astype(float), threshold, clusters)
        return pd.DataFrame({file: rows[file], order: rows[order], "cluster": labels.astype("int64")})

    return windows.select(file, order, vector).groupBy(file).applyInPandas(run, f"{file} {kinds[file]}, {order} {kinds[order]}, cluster long")


def infer(rows: DataFrame, make_model, schema: str, batch: int = 256) -> DataFrame:
    """Apply a model to rows in batches; ``make_model()`` runs once a task and returns a function of pandas frames.

    Any model can be plugged in: transcription, embeddings, sound events, emotion, intent. None is shipped.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_model()
        for frame in frames:
            for i in range(0, len(frame), batch):
                yield model(frame.iloc[i : i + batch])

    return rows.mapInPandas(run, schema)
