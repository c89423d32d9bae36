"""Sound-event timelines from frame scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import NOISE_WORDS
from .islands import hysteresis, merge_events, merge_spans

#: Thresholds and times of the two timeline variants.
ENTER, LEAVE, HOP_MS, FRAME_MS = 0.50, 0.35, 500, 1_000


def events_to_exit(frames: DataFrame, enter: float = ENTER, leave: float = LEAVE) -> DataFrame:
    """Events that last to the end of the frame that ends them, or of the label's last frame: (file_id, label, start_ms, end_ms, score)."""
    found = hysteresis(frames, ["file_id", "label"], enter, leave)
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), "score"))
    return found.select("file_id", "label", "start_ms", F.coalesce("exit_end_ms", "last_end_ms").alias("end_ms"), score.alias("score"))


def runs_before_exit(frames: DataFrame, enter: float = ENTER, leave: float = LEAVE, hop_ms: int = HOP_MS, frame_ms: int = FRAME_MS) -> DataFrame:
    """Runs without the frame that ends them: (file_id, label, first_frame, end_frame, start_ms, end_ms, score).

    Frames count from 1; end_frame is the one after the run.
    """
    found = hysteresis(frames, ["file_id", "label"], enter, leave)
    return found.select(
        "file_id", "label", "first_frame", (F.col("last_frame") + 1).alias("end_frame"), ((F.col("first_frame") - 1) * hop_ms).alias("start_ms"),
        ((F.col("last_frame") - 1) * hop_ms + frame_ms).alias("end_ms"), "score",
    )


def filter_then_merge(events: DataFrame, least_ms: int, gap_ms: int, least_by_label: dict[str, int] | None = None) -> DataFrame:
    """Drop short events, then merge neighbours of one label in the file's global order."""
    least = F.lit(least_ms)
    for label, ms in (least_by_label or {}).items():
        least = F.when(F.lower("label") == label.lower(), ms).otherwise(least)
    kept = events.where(F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(0)) >= least)
    return merge_events(kept, "file_id", "label", gap_ms)


def merge_then_filter(runs: DataFrame, least_ms: int, gap_ms: int) -> DataFrame:
    """Merge a label's runs over gaps, then drop short ones."""
    merged = merge_spans(runs.select("file_id", "label", "start_ms", "end_ms", "score"), ["file_id", "label"], gap_ms, {"score": F.max("score")})
    return merged.where(F.col("end_ms") - F.col("start_ms") >= least_ms)


def collapse(frames: DataFrame, groups: DataFrame) -> DataFrame:
    """Best score of each label group per frame; ``groups`` has label and group, others keep their own label."""
    named = frames.join(groups.select(F.lower("label").alias("_l"), "group"), F.lower("label") == F.col("_l"), "left")
    return named.groupBy("file_id", "frame", F.coalesce("group", "label").alias("label")).agg(F.max("score").alias("score"))


def frame_top(frames: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` best labels of each frame, equal ones by label."""
    place = F.row_number().over(W.partitionBy("file_id", "frame").orderBy(F.desc("score"), "label"))
    return frames.withColumn("place", place.cast("long")).where(F.col("place") <= k).select("file_id", "frame", "place", "label", "score")


def noise_scores(tags: DataFrame) -> DataFrame:
    """Sum of a file's scores whose labels hold a noise word: (file_id, noise_score)."""
    noisy = F.lower("label").rlike("|".join(NOISE_WORDS))
    return tags.groupBy("file_id").agg(F.coalesce(F.sum(F.when(noisy, F.col("score"))), F.lit(0.0)).alias("noise_score"))


def density(events: DataFrame) -> DataFrame:
    """Per file and label: events, their length and weight (length times score)."""
    length = F.col("end_ms") - F.col("start_ms")
    return events.groupBy("file_id", "label").agg(F.count(F.lit(1)).alias("events"), F.sum(length).alias("length_ms"), F.sum(length * F.col("score")).alias("weight"))
