"""Joins of spans by overlap in time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def overlap_join(left: DataFrame, right: DataFrame, keys: Sequence[str], bucket_ms: int, how: str = "inner", row: Sequence[str] = ()) -> DataFrame:
    """Pairs of spans of equal keys with ``left.start < right.end and right.start < left.end``.

    Both sides have start_ms and end_ms; the right side's columns come back with prefix ``r_``. Spans are exploded into
    time buckets and joined on (keys, bucket), so that a long file spreads over many tasks; a pair is given out only in
    the first bucket that both touch. ``how`` is "inner" or "left" (unmatched left rows with nulls; ``row`` names the
    columns that tell left rows of equal keys apart). Spans of no length
    overlap with what strictly contains them.
    """
    touched = lambda: F.sequence(F.floor(F.col("start_ms") / bucket_ms), F.floor(F.greatest("end_ms", "start_ms") / bucket_ms))
    r = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns], F.explode(touched()).alias("_bucket"))
    l_ = left.withColumn("_bucket", F.explode(touched()))
    same = F.lit(True)
    for k in keys:
        same = same & (l_[k] == r[f"r_{k}"])
    first = F.floor(F.greatest(l_["start_ms"], r["r_start_ms"]) / bucket_ms)
    meets = same & (l_["_bucket"] == r["_bucket"]) & (l_["start_ms"] < r["r_end_ms"]) & (r["r_start_ms"] < l_["end_ms"]) & (l_["_bucket"] == first)
    pairs = l_.join(r, meets).drop("_bucket")
    if how == "inner":
        return pairs.drop(*[f"r_{k}" for k in keys])
    named, more = [*keys, *row], [f"r_{c}" for c in right.columns if c not in keys]
    found = pairs.select(*[F.col(c).alias(f"_left_{c}") for c in named], *more)
    matched = F.lit(True)
    for c in named:
        matched = matched & (left[c] == found[f"_left_{c}"])
    return left.join(found, matched, "left").select(*left.columns, *more)


def overlap_ms(a: str = "", b: str = "r_") -> Column:
    """Milliseconds that the two spans of a pair have in common."""
    return F.greatest(F.least(f"{a}end_ms", f"{b}end_ms") - F.greatest(f"{a}start_ms", f"{b}start_ms"), F.lit(0))


def self_overlaps(spans: DataFrame, key: str, order: str, bucket_ms: int, least_ms: int) -> DataFrame:
    """Pairs of spans of one key that share at least ``least_ms``; the row that is first in (start, ``order``) is the left."""
    pairs = overlap_join(spans, spans, [key], bucket_ms)
    first = (F.col("start_ms") < F.col("r_start_ms")) | ((F.col("start_ms") == F.col("r_start_ms")) & (F.col(order) < F.col(f"r_{order}")))
    return pairs.where(first).withColumn("overlap_ms", overlap_ms()).where(F.col("overlap_ms") >= least_ms)


def windows_of(spans: DataFrame, size_ms: int, hop_ms: int, least_ms: int = 0, tail: bool = False) -> DataFrame:
    """Sliding windows inside each span: adds window (number), win_start_ms and win_end_ms.

    Windows are cut at the span's end and those shorter than ``least_ms`` are left out. With ``tail`` only whole windows
    count, and one more that ends with the span covers what they leave over.
    """
    length = F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(0))
    if tail:
        steps = F.when(length <= size_ms, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.floor((length - size_ms) / hop_ms).cast("int")))
        starts = F.transform(steps, lambda k: (F.col("start_ms") + k * hop_ms).cast("long"))
        starts = F.array_distinct(F.concat(starts, F.array(F.greatest(F.col("end_ms") - size_ms, F.col("start_ms")).cast("long"))))
    else:
        steps = F.sequence(F.lit(0), F.greatest(F.ceil(length / hop_ms).cast("int") - 1, F.lit(0)))
        starts = F.transform(steps, lambda k: (F.col("start_ms") + k * hop_ms).cast("long"))
    rows = spans.select("*", F.posexplode(starts).alias("window", "win_start_ms"))
    rows = rows.withColumn("win_end_ms", F.least(F.col("win_start_ms") + size_ms, F.col("end_ms")))
    return rows.where(F.col("win_end_ms") - F.col("win_start_ms") >= least_ms)


def whole_windows(spans: DataFrame, size_ms: int, hop_ms: int) -> DataFrame:
    """Windows of full size only, the last one ending at or before the span's end; a shorter span is one window.

    Spans without length have none. Adds window, win_start_ms, win_end_ms (beyond the end of a short span: padding).
    """
    length = F.col("end_ms") - F.col("start_ms")
    steps = F.sequence(F.lit(0), F.floor(F.greatest(length - size_ms, F.lit(0)) / hop_ms).cast("int"))
    starts = F.transform(steps, lambda k: (F.col("start_ms") + k * hop_ms).cast("long"))
    rows = spans.where(length > 0).select("*", F.posexplode(starts).alias("window", "win_start_ms"))
    return rows.withColumn("win_end_ms", F.col("win_start_ms") + size_ms)


def lapping_windows(spans: DataFrame, size_ms: int, lap_ms: int) -> DataFrame:
    """Windows of a long span that step by size less lap; all but the first begin another lap earlier, for context.

    Adds window, win_start_ms and win_end_ms on the span's own clock; spans without length have none.
    """
    step, length = size_ms - lap_ms, F.col("end_ms") - F.col("start_ms")
    rows = spans.where(length > 0).select("*", F.explode(F.sequence(F.lit(0), (F.ceil(length / step) - 1).cast("int"))).alias("window"))
    at = F.col("window").cast("long") * step
    start = F.greatest(F.lit(0), at - F.when(F.col("window") > 0, lap_ms).otherwise(0))
    return rows.withColumns({"win_start_ms": F.col("start_ms") + start, "win_end_ms": F.col("start_ms") + F.least(length, at + size_ms)})


def chunks(files: DataFrame, least_ms: int, chunk_ms: int, lap_ms: int) -> DataFrame:
    """Chunk plan of files (file_id, duration_ms): files from ``least_ms`` on are cut into chunks that lap on both sides.

    Returns file_id, chunk, start_ms, end_ms, lap_start_ms and lap_end_ms; shorter files are one chunk.
    """
    size = F.when(F.col("duration_ms") >= least_ms, F.lit(chunk_ms)).otherwise(F.greatest(F.col("duration_ms"), F.lit(1))).cast("long")
    last = F.greatest(F.ceil(F.col("duration_ms") / size).cast("long") - 1, F.lit(0).cast("long"))
    rows = files.select("file_id", "duration_ms", size.alias("_size"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("chunk"))
    start, end = F.col("chunk") * F.col("_size"), F.least((F.col("chunk") + 1) * F.col("_size"), F.col("duration_ms"))
    rows = rows.select("file_id", "chunk", "duration_ms", start.alias("start_ms"), end.alias("end_ms"))
    return rows.select(
        "file_id", "chunk", "start_ms", "end_ms",
        F.greatest(F.col("start_ms") - lap_ms, F.lit(0)).alias("lap_start_ms"), F.least(F.col("end_ms") + lap_ms, F.col("duration_ms")).alias("lap_end_ms"),
    )
