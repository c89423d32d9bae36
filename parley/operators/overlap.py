"""Overlapping speech and interruptions, and how events overlap with segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .intervals import overlap_join, overlap_ms, self_overlaps

#: Buckets of the joins, shortest overlap that counts, and largest distance of onsets of an interruption.
BUCKET_MS, LEAST_MS, ONSET_MS = 10_000, 50, 150


def overlap_pairs(segments: DataFrame) -> DataFrame:
    """Pairs of overlapping segments of a file, also of one speaker, with the later one as right side."""
    spans = segments.select("file_id", "ord", "speaker", F.least("start_ms", "end_ms").alias("start_ms"), F.greatest("start_ms", "end_ms").alias("end_ms"))
    return self_overlaps(spans, "file_id", "ord", BUCKET_MS, LEAST_MS)


def interruptions(segments: DataFrame) -> DataFrame:
    """Overlaps of two speakers whose onsets lie close: (file_id, at_ms, interrupter, interrupted, overlap_ms)."""
    pairs = overlap_pairs(segments).where((F.col("speaker") != F.col("r_speaker")) & (F.col("r_start_ms") - F.col("start_ms") <= ONSET_MS))
    # Of equal onsets the segment that comes first in the file's order counts as the later one.
    tie = F.col("r_start_ms") == F.col("start_ms")
    later, earlier = F.when(tie, F.col("speaker")).otherwise(F.col("r_speaker")), F.when(tie, F.col("r_speaker")).otherwise(F.col("speaker"))
    return pairs.select("file_id", F.col("r_start_ms").alias("at_ms"), later.alias("interrupter"), earlier.alias("interrupted"), "overlap_ms")


def overlap_by_speaker(segments: DataFrame) -> DataFrame:
    """Overlap and interruptions of each speaker with any: (file_id, speaker, overlap_ms, interruptions).

    A pair adds to both sides, to one speaker twice if both are that speaker's.
    """
    pairs = overlap_pairs(segments)
    sides = pairs.select("file_id", "speaker", "overlap_ms").unionByName(pairs.select("file_id", F.col("r_speaker").alias("speaker"), "overlap_ms"))
    sums = sides.groupBy("file_id", "speaker").agg(F.sum("overlap_ms").alias("overlap_ms"))
    cuts = interruptions(segments).groupBy("file_id", F.col("interrupter").alias("speaker")).agg(F.count(F.lit(1)).alias("n"))
    return sums.join(cuts, ["file_id", "speaker"], "left").select("file_id", "speaker", "overlap_ms", F.coalesce("n", F.lit(0)).cast("long").alias("interruptions"))


def file_overlap(segments: DataFrame) -> DataFrame:
    """Overlap of each file and its ratio to the time from first start to last end."""
    files = segments.groupBy("file_id").agg((F.max(F.greatest("start_ms", "end_ms")) - F.min(F.least("start_ms", "end_ms"))).alias("span_ms"))
    per = overlap_pairs(segments).groupBy("file_id").agg(F.sum("overlap_ms").alias("o"), F.count(F.lit(1)).alias("n"))
    total = F.coalesce("o", F.lit(0))
    return files.join(per, "file_id", "left").select("file_id", total.alias("overlap_ms"), F.coalesce("n", F.lit(0)).cast("long").alias("pairs"), F.coalesce(total / F.nullif("span_ms", F.lit(0)), F.lit(0.0)).alias("overlap_ratio"))


def interruption_map(segments: DataFrame) -> DataFrame:
    """Made and received interruptions of each speaker with any overlap, from one pass over the overlapping pairs.

    The same as ``merge_interruptions`` of the speaker sums and the single interruptions of these segments.
    """
    pairs = overlap_pairs(segments)
    cut = (F.col("speaker") != F.col("r_speaker")) & (F.col("r_start_ms") - F.col("start_ms") <= ONSET_MS)
    tie = F.col("r_start_ms") == F.col("start_ms")
    side = lambda who, made: F.struct(F.col(who).alias("speaker"), (cut & made).cast("long").alias("made"), (cut & ~made).cast("long").alias("received"), "overlap_ms")
    sides = pairs.select("file_id", F.explode(F.array(side("speaker", tie), side("r_speaker", ~tie))).alias("s")).select("file_id", "s.*")
    return sides.groupBy("file_id", "speaker").agg(*[F.sum(c).alias(c) for c in ("made", "received", "overlap_ms")])


def merge_interruptions(by_speaker: DataFrame, single: DataFrame) -> DataFrame:
    """See ``interruption_map``; the two inputs may also come from elsewhere."""
    made = single.where("interrupter <> ''").groupBy("file_id", F.col("interrupter").alias("speaker")).agg(F.count(F.lit(1)).alias("m"))
    got = single.where("interrupted <> ''").groupBy("file_id", F.col("interrupted").alias("speaker")).agg(F.count(F.lit(1)).alias("g"))
    rows = by_speaker.join(made, ["file_id", "speaker"], "full_outer").join(got, ["file_id", "speaker"], "full_outer")
    whole = lambda *c: F.coalesce(*c, F.lit(0)).cast("long")
    return rows.select("file_id", "speaker", whole("interruptions", "m").alias("made"), whole("g").alias("received"), whole("overlap_ms").alias("overlap_ms"))


def segment_events(segments: DataFrame, events: DataFrame) -> DataFrame:
    """Segments with the events that they overlap: overlap_ms and weight (overlap times score, never below 0)."""
    right = events.select("file_id", "label", "score", "start_ms", "end_ms")
    pairs = overlap_join(segments.select("file_id", "ord", "start_ms", "end_ms"), right, ["file_id"], BUCKET_MS)
    return pairs.withColumn("overlap_ms", overlap_ms()).select("file_id", "ord", F.col("r_label").alias("label"), "overlap_ms", (F.col("overlap_ms") * F.greatest("r_score", F.lit(0.0))).alias("weight"))


def top_events(segments: DataFrame, events: DataFrame, k: int = 3) -> DataFrame:
    """Each segment's ``k`` labels of most weight: (file_id, ord, place, label, overlap_ms, score)."""
    per = segment_events(segments, events).groupBy("file_id", "ord", "label").agg(F.sum("overlap_ms").alias("overlap_ms"), F.sum("weight").alias("weight"))
    per = per.withColumn("score", F.when(F.col("overlap_ms") > 0, F.col("weight") / F.col("overlap_ms")).otherwise(0.0))
    order = W.partitionBy("file_id", "ord").orderBy(F.desc(F.round("weight", 6)), F.desc(F.round("score", 6)), "label")
    return per.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= k).select("file_id", "ord", "place", "label", "overlap_ms", "score")


def event_snr(segments: DataFrame, events: DataFrame) -> DataFrame:
    """Signal-to-noise estimate of a segment from how densely events cover it, -5 to 35 dB."""
    per = segment_events(segments, events).groupBy("file_id", "ord").agg(F.sum("overlap_ms").alias("o"), F.sum("weight").alias("w"))
    own = segments.select("file_id", "ord", (F.col("end_ms") - F.col("start_ms")).alias("d")).where("d > 0")
    one = F.lit(1.0)
    mix = F.least(one, 0.5 * F.least(one, F.col("o") / F.col("d")) + 0.5 * F.least(one, F.col("w") / F.col("d")))
    return own.join(per, ["file_id", "ord"]).where("o > 0").select("file_id", "ord", F.greatest(F.lit(-5.0), F.least(F.lit(35.0), 35.0 - 35.0 * mix)).alias("snr_db"))


def turns_with_events(segments: DataFrame, events: DataFrame) -> DataFrame:
    """All segments with their events as JSON of the top three, ``[]`` without any, and the SNR estimate."""
    top = top_events(segments, events)
    item = F.struct("place", "label", F.round("score", 6).alias("score"))
    lists = top.groupBy("file_id", "ord").agg(F.array_sort(F.collect_list(item)).alias("l"))
    lists = lists.select("file_id", "ord", F.to_json(F.transform("l", lambda x: F.struct(x["label"].alias("label"), x["score"].alias("score")))).alias("events_top3_json"))
    rows = segments.select("file_id", "ord").join(lists, ["file_id", "ord"], "left").join(event_snr(segments, events), ["file_id", "ord"], "left")
    return rows.select("file_id", "ord", F.coalesce("events_top3_json", F.lit("[]")).alias("events_top3_json"), "snr_db")


def noise_snr(score):
    """SNR estimate from a clip's noise score: 35 dB without noise, falling with its logarithm, -5 at least."""
    value = 35.0 - 20.0 * F.log10(1.0 + 10.0 * score)
    return F.when(score.isNull(), F.lit(None).cast("double")).when(score <= 0, 35.0).otherwise(F.greatest(F.lit(-5.0), F.least(F.lit(35.0), value)))
