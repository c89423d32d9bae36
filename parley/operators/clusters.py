"""Clustering of long recordings in levels: average linkage inside parts, then of weighted clusters, in bounded memory."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import materialise
from .identity import linkage
from .islands import ordered

#: Windows of a part, and clusters that meet in one group; a group takes the square of that in memory.
PART = 1_000


def _merged(rows: DataFrame, threshold: float, clusters: int | None) -> DataFrame:
    """Average linkage inside each (file, part) over rows (file, part, item, total array, n): (file, part, item, own).

    ``total`` is the sum of the unit vectors that an item stands for and ``n`` their number, which give the mean cosine
    between two items exactly. ``own`` is the item that leads the row's cluster.
    """
    kinds = dict(rows.dtypes)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("item", kind="stable")
        labels = linkage(np.stack(group["total"].to_list()), group["n"].to_numpy(float), threshold, clusters)
        items = group["item"].to_numpy()
        _, first = np.unique(labels, return_index=True)
        return pd.DataFrame({"file": group["file"], "part": group["part"], "item": items, "own": items[first][labels]})

    return rows.groupBy("file", "part").applyInPandas(run, f"file {kinds['file']}, part long, item long, own long")


def cluster_in_levels(windows: DataFrame, file: str, order: str, vector: str, threshold: float = 0.15, clusters: int | None = None, part: int = PART) -> DataFrame:
    """Speaker labels of a file's windows: (file, order, cluster), numbered by first window.

    Windows are cut into parts of ``part`` in order. Average linkage by cosine distance runs inside each part, then over the
    clusters of all parts, each with its sum of unit vectors and its number of windows, so that the mean distance between
    two clusters is that of all their windows. While a file has more than ``part`` clusters they are put into parts again;
    if a level merges hardly any, parts grow to twice the size. So a task holds the distances of one part only,
    whatever a recording's length. Where clusters lie apart the labels are those of one level; else they may differ, as a
    part decides by what it holds. ``clusters`` bounds the number in the last level alone.

    Null vectors have no label; null files are a file. Windows need distinct orders. An empty table gives an empty result.
    """
    unit = F.transform(vector, lambda x: x.cast("double") / (F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, y: s + y.cast("double") * y.cast("double"))) + 1e-9))
    rows = windows.where(F.col(vector).isNotNull()).select(F.col(file).alias("file"), F.col(order).alias("order"), unit.alias("total"), F.lit(1).cast("long").alias("n"))
    place = (F.row_number().over(ordered(["file"], ["order"])) - 1).cast("long")
    first = materialise(rows.withColumn("item", place), "windows")
    items, own = first.select("file", "item", "total", "n"), first.select("file", "order", F.col("item").alias("lead"))
    size, before = part, None
    while True:
        rank = (F.row_number().over(ordered(["file"], ["item"])) - 1).cast("long")
        parts = items.withColumn("part", F.floor(rank / size))
        level = materialise(parts.withColumn("last", F.max("part").over(W.partitionBy("file")) == 0), "parts")
        left = level.count()
        whole = level.where("last")
        # The bound on the number of clusters holds where a file is one part.
        done = _merged(level.where("not last"), threshold, None) if clusters is not None else _merged(level, threshold, None)
        if clusters is not None:
            done = done.unionByName(_merged(whole, threshold, clusters))
        step = materialise(done, "merged")
        leads = step.select(F.col("file").alias("_f"), F.col("item").alias("_i"), "own")
        own = materialise(own.join(leads, own["file"].eqNullSafe(F.col("_f")) & (own["lead"] == F.col("_i"))).select("file", "order", F.col("own").alias("lead")), "leads")
        if not level.where("not last").limit(1).count():
            break
        held = level.join(leads, level["file"].eqNullSafe(F.col("_f")) & (level["item"] == F.col("_i")))
        at = held.select("file", "own", "n", F.posexplode("total").alias("at", "x"))
        sums = at.groupBy("file", "own", "at").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).groupBy("file", "own")
        items = materialise(sums.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda e: e["x"]).alias("total"), F.max("n").alias("n")).select("file", F.col("own").alias("item"), "total", "n"), "clusters")
        if before is not None and left > 0.9 * before:
            size *= 2
        before = left
    number = F.dense_rank().over(ordered(["file"], ["lead"])) - 1
    return own.select(F.col("file").alias(file), F.col("order").alias(order), number.cast("long").alias("cluster"))
