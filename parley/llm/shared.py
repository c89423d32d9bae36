"""Helpers that several corpus operators need: sizes, batches, plain column names and connected components."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import broadcast_if_small, clear, materialise, new_path, remove_table, shared_folder  # noqa: F401

#: Words are runs of anything but these six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


@contextmanager
def small_batches(spark: SparkSession, rows: int = 2_000) -> Iterator[None]:
    """Arrow batches of at most so many rows for what runs inside; executors hold a batch outside their heap, twice while
    it grows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def plain(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its columns named c0, c1 and so on, so that no name of theirs meets one that an operator uses, and
    the plain name of each column."""
    names = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def named(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` out of rows with plain names, under their own names."""
    return rows.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)])


def whole_ids(docs: DataFrame, id_col: str) -> None:
    """Refuse a table whose ids are no whole numbers, before any job runs."""
    kind = dict(docs.dtypes)[id_col]
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"column {id_col} must hold whole numbers, not {kind}")


def word_count(text) -> F.Column:
    """Number of words of a text column; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Connected components of ``edges`` (a long, b long) as rows (id, component); component is the smallest id.

    Each round hooks every node onto the smallest label next to it and then jumps one pointer ahead, so paths shrink
    by half and few rounds are needed. A hub with very many links costs one partially aggregated group; no group is
    collected. Empty input gives an empty result; self links and repeated links are harmless.
    """
    both = edges.select("a", "b").where("a <> b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a <> b"))
    both = materialise(both.distinct(), "links")
    labels = materialise(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("a"), F.min("b")).alias("component")), "labels")
    for _ in range(max_rounds):
        near = (
            both.join(labels, both["b"] == labels["id"])
            .groupBy(F.col("a").alias("near_id"))
            .agg(F.min("component").alias("near"))
        )
        hooked = labels.join(near, labels["id"] == near["near_id"], "left").select(
            "id", F.least("component", F.coalesce("near", "component")).alias("next"), F.col("component").alias("before")
        )
        up = hooked.select(F.col("id").alias("up_id"), F.col("next").alias("up"))
        jumped = hooked.join(up, hooked["next"] == up["up_id"], "left").select(
            "id", F.least("next", F.coalesce("up", "next")).alias("component"), "before"
        )
        done = materialise(jumped, "labels")
        moved = done.where("component <> before").limit(1).count()
        labels = done.select("id", "component")
        if not moved:
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
