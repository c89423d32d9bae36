"""Tables and derived views that the queries start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import word_count
from ..operators.timeline import FRAME_MS, HOP_MS, events_to_exit

#: Milliseconds of a word, and what segments are moved by, by their number modulo 3.
WORD_MS, SHIFT_MS = 400, {1: 700, 2: -100}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def segments(conversations: DataFrame) -> DataFrame:
    """Turns of conversations as segments: length by words, start behind the turns before, with gaps and overlaps."""
    length = WORD_MS * word_count(F.col("text"))
    shift = F.lit(0)
    for rest, ms in SHIFT_MS.items():
        shift = F.when(F.col("turn") % 3 == rest, ms).otherwise(shift)
    before = F.sum("_d").over(W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, -1))
    rows = conversations.withColumn("_d", length)
    start = F.greatest(F.lit(0), F.coalesce(before, F.lit(0)) + shift).cast("long")
    rows = rows.select(F.col("conv_id").alias("file_id"), F.col("turn").alias("ord"), F.col("role").alias("speaker"), "text", start.alias("start_ms"), "_d")
    return rows.select("file_id", "ord", "speaker", "text", "start_ms", (F.col("start_ms") + F.col("_d")).alias("end_ms"))


def frames(events: DataFrame) -> DataFrame:
    """Events of a user and type as a frame score series: numbered from 1, a frame each half second."""
    number = F.row_number().over(W.partitionBy("user_id", "event_type").orderBy("ts", "event_id")).cast("long")
    rows = events.select(F.col("user_id").alias("file_id"), F.col("event_type").alias("label"), number.alias("frame"), F.least(F.col("value") / 100, F.lit(1.0)).alias("score"))
    return rows.withColumn("start_ms", (F.col("frame") - 1) * HOP_MS).withColumn("end_ms", F.col("start_ms") + FRAME_MS)


def sound_events(events: DataFrame) -> DataFrame:
    return events_to_exit(frames(events))


def registry(embeddings: DataFrame) -> DataFrame:
    """One name per label with the label's mean vector: (name, samples, centroid)."""
    from ..operators.identity import centroids

    return centroids(embeddings, "label", "embedding").select(F.concat(F.lit("speaker_"), F.col("label").cast("string")).alias("name"), "samples", "centroid")


#: Vectors of a file of sound, and its rate.
FILE_VECTORS, SOUND_RATE = 50, 8_000


def sound(embeddings: DataFrame) -> DataFrame:
    """Vectors as chunks of sound, fifty a file one after the other: (file_id, start_ms, rate, samples).

    Every ten vectors the level falls by 24 decibels, then begins anew.
    """
    place = F.col("vec_id") % FILE_VECTORS
    quieter = F.pow(F.lit(2.0), -4.0 * (1 + F.floor(F.col("vec_id") / 10) % 4))
    samples = F.transform("embedding", lambda x: (x * quieter).cast("float"))
    return embeddings.select(F.floor(F.col("vec_id") / FILE_VECTORS).alias("file_id"), (place * 64 * 1000 / SOUND_RATE).cast("long").alias("start_ms"), F.lit(SOUND_RATE).alias("rate"), samples.alias("samples"))


def voiced_frames(events: DataFrame) -> DataFrame:
    """A user's events as frames of sound, every 200 ms, with made-up figures."""
    number = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    i, voiced = F.col("event_id"), F.col("event_type").isin("click", "view")
    figures = {
        "db": F.col("value") - 80, "hz": F.when(voiced, 80 + 2 * F.col("value")), "centroid_hz": 500 + i % 97 * 10.0, "flatness": i % 89 / 89.0, "jitter": F.when(voiced, i % 7 / 100.0),
        "shimmer_db": F.when(voiced, i % 5 / 4.0), "hnr_db": F.when(voiced, i % 31 * 1.0), "cpp_db": i % 17 * 1.0, "low_mag": 1.0 + i % 3, "high_mag": 0.1 + i % 4 / 10.0,
    }
    return events.select(F.col("user_id").alias("file_id"), ((number - 1) * 200).alias("start_ms"), *[c.alias(n) for n, c in figures.items()])
