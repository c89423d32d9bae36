"""Gaps and islands: runs, merges and hysteresis over ordered rows.

All times are whole milliseconds, so that results do not depend on rounding. Every operator takes the key columns and a
total order; a key's rows meet in one task, so keys should be as fine as files or (file, label) pairs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ordered(keys: Sequence[str], order: Sequence[str]) -> WindowSpec:
    return W.partitionBy(*keys).orderBy(*order)


def number_islands(df: DataFrame, keys: Sequence[str], order: Sequence[str], begins: Column, name: str = "island") -> DataFrame:
    """Number islands within ``keys``: an island begins where ``begins`` is true (it may use windows by ``order``)."""
    flagged = df.withColumn("_begins", F.coalesce(begins.cast("int"), F.lit(0)))
    return flagged.withColumn(name, F.sum("_begins").over(ordered(keys, order).rowsBetween(W.unboundedPreceding, 0))).drop("_begins")


def merge_spans(df: DataFrame, keys: Sequence[str], gap_ms: int, extra: dict[str, Column] | None = None) -> DataFrame:
    """Merge spans (start_ms, end_ms) that overlap or lie at most ``gap_ms`` apart, whatever their nesting.

    Returns keys, start_ms, end_ms, n_spans and the ``extra`` aggregates.
    """
    order = ["start_ms", "end_ms"]
    reach = F.max("end_ms").over(ordered(keys, order).rowsBetween(W.unboundedPreceding, -1))
    islands = number_islands(df, keys, order, reach.isNull() | (F.col("start_ms") - reach > gap_ms))
    more = [c.alias(n) for n, c in (extra or {}).items()]
    merged = islands.groupBy(*keys, "island").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count(F.lit(1)).alias("n_spans"), *more)
    return merged.drop("island")


def merge_neighbours(df: DataFrame, key: str, label: str, gap_ms: int, order: Sequence[str], least_gap_ms: int | None = None) -> DataFrame:
    """Merge rows with the next one of the same label if that starts at most ``gap_ms`` after the last one's end.

    Only neighbours in order merge, the merged end is that of the last row. With ``least_gap_ms`` overlaps beyond it
    do not merge. Returns key, label, start_ms, end_ms, n_spans.
    """
    w = ordered([key], order)
    gap = F.col("start_ms") - F.lag("end_ms").over(w)
    apart = F.lag(label).over(w).isNull() | (F.lag(label).over(w) != F.col(label)) | (gap > gap_ms)
    if least_gap_ms is not None:
        apart = apart | (gap < least_gap_ms)
    islands = number_islands(df, [key], order, apart)
    last = F.max_by("end_ms", F.struct(*order))
    return islands.groupBy(key, "island").agg(F.first(label).alias(label), F.min("start_ms").alias("start_ms"), last.alias("end_ms"), F.count(F.lit(1)).alias("n_spans")).drop("island")


def runs(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """Run lengths: keys, value, first and last order value and number of rows of each run of equal values."""
    w = ordered(keys, [order])
    islands = number_islands(df, keys, [order], F.lag(value).over(w).isNull() | ~F.lag(value).over(w).eqNullSafe(F.col(value)))
    return islands.groupBy(*keys, "island").agg(F.first(value).alias(value), F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n_rows")).drop("island")


def hysteresis(frames: DataFrame, keys: Sequence[str], enter: float, leave: float, score: str = "score", order: str = "frame") -> DataFrame:
    """Events of a two-threshold switch over frames: on at ``enter`` or more, off at ``leave`` or less.

    Returns keys, first_frame, last_frame (the last one above ``leave``), exit_frame (null if the switch stays on),
    start_ms of the first frame, last_end_ms and exit_end_ms (ends of the last and of the exit frame, the latter null
    like it) and the peak score, which the exit frame may not exceed. One window sort per key, no Python.
    """
    w = ordered(keys, [order])
    switch = F.when(F.col(score) >= enter, 1).when(F.col(score) <= leave, 0)
    state = F.coalesce(F.last(switch, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)), F.lit(0))
    rows = frames.withColumn("_on", state)
    rows = rows.withColumn("_was", F.coalesce(F.lag("_on").over(w), F.lit(0)))
    rows = number_islands(rows, keys, [order], (F.col("_on") == 1) & (F.col("_was") == 0), "_event")
    inside = rows.where("_on = 1 or _was = 1")
    on, off = F.col("_on") == 1, (F.col("_on") == 0) & (F.col("_was") == 1)
    return (
        inside.groupBy(*keys, "_event")
        .agg(
            F.min(F.when(on, F.col(order))).alias("first_frame"),
            F.max(F.when(on, F.col(order))).alias("last_frame"),
            F.max(F.when(off, F.col(order))).alias("exit_frame"),
            F.min(F.when(on, F.col("start_ms"))).alias("start_ms"),
            F.max(F.when(on, F.col("end_ms"))).alias("last_end_ms"),
            F.max(F.when(off, F.col("end_ms"))).alias("exit_end_ms"),
            F.max(score).alias("score"),
        )
        .drop("_event")
    )


def merge_events(events: DataFrame, key: str, label: str, gap_ms: int) -> DataFrame:
    """Merge events of a file in global order: an event joins the one before it if the labels agree and the gap is small.

    An event of another label in between keeps two events apart. Returns key, label, start_ms, end_ms, score, n_events.
    """
    order = ["start_ms", "end_ms", label]
    w = ordered([key], order)
    change = F.lag(label).over(w).isNull() | (F.lag(label).over(w) != F.col(label))
    stretches = number_islands(events, [key], order, change, "_stretch")
    reach = F.max("end_ms").over(ordered([key, "_stretch"], order).rowsBetween(W.unboundedPreceding, -1))
    islands = number_islands(stretches, [key, "_stretch"], order, reach.isNull() | (F.col("start_ms") - reach > gap_ms))
    merged = islands.groupBy(key, "_stretch", "island").agg(
        F.first(label).alias(label), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.max("score").alias("score"), F.count(F.lit(1)).alias("n_events")
    )
    return merged.drop("_stretch", "island")


def median_filter(frames: DataFrame, keys: Sequence[str], width: int, score: str = "score", order: str = "frame") -> DataFrame:
    """Centred median over ``width`` (odd) frames, zeros beyond the ends; adds column ``smooth``."""
    half = width // 2
    near = F.collect_list(score).over(ordered(keys, [order]).rowsBetween(-half, half))
    padded = F.array_sort(F.concat(near, F.array_repeat(F.lit(0.0), F.lit(width) - F.size(near))))
    return frames.withColumn("smooth", F.element_at(padded, half + 1))
