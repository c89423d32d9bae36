"""Features of segments: loudness, pauses, pitch, spectrum and voice out of frames, rates and disfluencies out of words."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as words_
from .audio import smooth_mask
from .islands import ordered

KEYS = ["file_id", "ord"]
#: Rounding that the fences of outliers are given, so that a pitch that lies on one stays.
SLACK = 1e-9
#: What frames hold besides file_id and start_ms; missing ones count as null.
FIGURES = ("db", "hz", "centroid_hz", "flatness", "jitter", "shimmer_db", "hnr_db", "cpp_db", "low_mag", "high_mag")


@dataclass(frozen=True)
class Limits:
    """A frame is silent below its segment's 5th percentile of levels plus ``margin_db``; pauses last ``pause_ms`` or more,
    long ones ``long_ms``. Pitch needs voice in ``least_voice`` of the frames, voice figures need ``voice_ms``, and are
    reliable from ``least_snr_db`` and half of the frames voiced on."""

    margin_db: float = 8.0
    pause_ms: int = 200
    long_ms: int = 600
    least_voice: float = 0.05
    voice_ms: int = 600
    least_snr_db: float = 10.0
    least_range_db: float = 12.0
    slope_points: int = 10


def frames_of_segments(segments: DataFrame, frames: DataFrame, bucket_ms: int = 5_000) -> DataFrame:
    """Frames with the ``ord`` of each segment whose span (start_ms, end_ms) they begin in, by an equi-join on buckets of time.

    Segments may overlap: a frame counts in each of them. A long segment spreads over as many buckets as it touches.
    """
    last = F.greatest(F.col("end_ms") - 1, F.col("start_ms"))
    spans = segments.select(F.col("file_id").alias("_f"), "ord", F.col("start_ms").alias("_a"), F.col("end_ms").alias("_b"), F.explode(F.sequence(F.floor(F.col("start_ms") / bucket_ms), F.floor(last / bucket_ms))).alias("_k"))
    have = set(frames.columns)
    points = frames.select("file_id", "start_ms", *[(F.col(c) if c in have else F.lit(None)).cast("double").alias(c) for c in FIGURES])
    meets = (points["file_id"] == spans["_f"]) & (F.floor(points["start_ms"] / bucket_ms) == spans["_k"]) & (points["start_ms"] >= spans["_a"]) & (points["start_ms"] < spans["_b"])
    return points.join(spans, meets).drop("_f", "_a", "_b", "_k")


def _sums(inside: DataFrame) -> DataFrame:
    """Order statistics and means of each segment's frames, partially aggregated."""
    mean = {"jitter": 100.0, "shimmer_db": 1.0, "hnr_db": 1.0, "cpp_db": 1.0, "low_mag": 1.0, "high_mag": 1.0}
    part = lambda c, *q: F.percentile(c, [float(x) for x in q])
    return inside.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n"), F.count("hz").alias("n_voiced"), part("db", 0.05, 0.5, 0.85, 0.95).alias("db_q"), F.max("db").alias("db_top"), part("hz", 0.25, 0.5, 0.75).alias("hz_q"),
        part("centroid_hz", 0.25, 0.5, 0.75).alias("centroid_q"), part("flatness", 0.5).alias("flat_q"), *[(F.avg(c) * k).alias(f"mean_{c}") for c, k in mean.items()],
    )


def frame_features(segments: DataFrame, frames: DataFrame, hop_ms: int = 10, how: Limits = Limits()) -> DataFrame:
    """What the frames of each segment tell, a row for each segment that has any; see ``segment_features`` for the columns.

    Frames and segments meet in one bucketed join whose rows are dealt out once by segment. A first aggregate gives
    each segment's thresholds; these go back to its frames, where windows in order of time find pauses and the run
    of the pitch, and a last aggregate in place gives the row. Segments are bounded by a recording.
    """
    inside = frames_of_segments(segments, frames).repartition(*KEYS)
    facts = _sums(inside)
    own = facts.toDF(*[f"_{c}" if c in KEYS else c for c in facts.columns])
    rows = inside.join(own, (inside["file_id"] == own["_file_id"]) & (inside["ord"] == own["_ord"])).drop("_file_id", "_ord")
    rows = rows.withColumn("quiet", F.col("db") < F.get("db_q", F.lit(0)) + how.margin_db)
    rows = smooth_mask(rows, KEYS, "quiet", "start_ms").withColumnRenamed("smooth_mask", "silent")
    w = ordered(KEYS, ["start_ms"])
    begins = F.lag("silent").over(w).isNull() | (F.lag("silent").over(w) != F.col("silent"))
    rows = rows.withColumn("begins", begins).withColumn("run", F.sum(F.col("begins").cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.withColumn("run_ms", F.count(F.lit(1)).over(W.partitionBy(*KEYS, "run")) * hop_ms)
    q = lambda i: F.get("hz_q", F.lit(i))
    reach = 1.5 * (q(2) - q(0))
    fine = F.col("hz").isNotNull() & ((reach <= 0) | F.col("hz").between(q(0) - reach - SLACK, q(2) + reach + SLACK))
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = rows.withColumn("fine", fine).withColumn("n_fine", F.count(F.when(F.col("fine"), 1)).over(W.partitionBy(*KEYS)))
    # Outliers go if most frames stay.
    rows = rows.withColumn("used", F.when(F.col("n_fine") * 2 > F.col("n_voiced"), F.col("fine")).otherwise(F.col("hz").isNotNull()))
    rows = rows.withColumn("n_used", F.count(F.when(F.col("used"), 1)).over(whole)).withColumn("place", F.count(F.when(F.col("used"), 1)).over(w.rowsBetween(W.unboundedPreceding, 0)) - 1)
    step = F.greatest(F.floor(F.col("n_used") / how.slope_points), F.lit(1))
    rows = rows.withColumn("point", F.when(F.col("used") & (F.col("place") % step == 0), F.struct("start_ms", "hz")))
    before = F.last("point", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("slope", F.when(F.col("point").isNotNull(), (F.col("hz") - before["hz"]) * 1000 / (F.col("start_ms") - before["start_ms"])))
    pause = F.col("begins") & F.col("silent") & (F.col("run_ms") >= how.pause_ms)
    long = pause & (F.col("run_ms") >= how.long_ms)
    done = rows.groupBy(*KEYS).agg(
        F.count(F.when(pause, 1)).alias("pause_count"), F.count(F.when(long, 1)).alias("pause_long_count"), F.coalesce(F.sum(F.when(pause, F.col("run_ms"))), F.lit(0)).alias("pause_ms"),
        F.percentile(F.when(F.col("used"), F.col("hz")), [0.25, 0.5, 0.75]).alias("used_q"), F.median("slope").alias("slope"), F.first("n_used").alias("n_used"),
        *[F.first(c).alias(c) for c in facts.columns if c not in KEYS],
    )
    return _figures(done, hop_ms, how)


def _figures(done: DataFrame, hop_ms: int, how: Limits) -> DataFrame:
    at = lambda c, i: F.get(c, F.lit(i))
    covered = F.col("n_voiced") >= how.least_voice * F.col("n")
    pitch = lambda c: F.when(covered & (F.col("n_voiced") > 0), c)
    snr, span = at("db_q", 2) - at("db_q", 0), F.col("db_top") - at("db_q", 0)
    voiced = F.col("n_voiced") / F.col("n")
    # Decibels a decade between the edges of the band.
    tilt = 20 * (F.log10(F.col("mean_high_mag") + 1e-12) - F.log10(F.col("mean_low_mag") + 1e-12)) / F.log10(F.lit(4.0))
    within = lambda c, low, high: F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(c, F.lit(0.0))))
    return done.select(
        *KEYS, F.col("n").alias("n_frames"), "pause_count", (F.col("pause_count") - F.col("pause_long_count")).alias("pause_short_count"), "pause_long_count", (F.col("pause_ms") / 1000).alias("pause_time_s"),
        (F.col("pause_ms") / (F.col("n") * hop_ms)).alias("pause_ratio"), pitch(at("used_q", 1)).alias("f0_mean_hz"), pitch(at("used_q", 2) - at("used_q", 0)).alias("f0_std_hz"),
        pitch(F.when(F.col("n_used") >= 10, F.col("slope"))).alias("pitch_slope_hzps"), at("db_q", 1).alias("loudness_rms"), (at("db_q", 3) - at("db_q", 0)).alias("loudness_dr_db"),
        (at("db_q", 1) - at("db_q", 0)).alias("loudness_over_floor_db"), at("centroid_q", 1).alias("spectral_centroid_med_hz"),
        F.when(F.col("n") > 4, at("centroid_q", 2) - at("centroid_q", 0)).otherwise(0.0).alias("spectral_centroid_iqr_hz"), at("flat_q", 0).alias("spectral_flatness_med"),
        within(F.col("mean_jitter"), 0.0, 25.0).alias("vq_jitter_pct"), within(F.col("mean_shimmer_db"), 0.0, 15.0).alias("vq_shimmer_db"), within(F.col("mean_hnr_db"), 0.0, 40.0).alias("vq_hnr_db"),
        within(F.col("mean_cpp_db"), 0.0, 35.0).alias("vq_cpps_db"), voiced.alias("vq_voiced_ratio"), within(tilt, -30.0, 10.0).alias("vq_spectral_slope_db"), snr.alias("snr_db"),
        F.coalesce((snr >= how.least_snr_db) & (span >= how.least_range_db) & (voiced >= 0.5), F.lit(False)).alias("vq_reliable"),
    )


def word_features(text: Column, tokens: Column, duration_ms: Column) -> dict[str, Column]:
    """Rates and disfluencies of a segment's words; ``tokens`` are those of ``text``, best a column, as they are looked at often."""
    count = F.size(tokens)
    spoken = F.aggregate(tokens, F.lit(0).cast("long"), lambda n, w: n + words_.syllables(w))
    fillers, repeats, starts = words_.fillers(text, tokens), words_.repetitions(tokens), words_.false_starts(text, tokens)
    return {
        "duration_s": F.greatest(duration_ms, F.lit(0)) / 1000, "words": words_.word_count(text), "wpm": words_.per_minute(count, duration_ms), "sps": F.when(count > 0, words_.per_minute(spoken, duration_ms)),
        "filler_count": fillers, "repetition_count": repeats, "false_start_count": starts, "disfluency_count": fillers + repeats + starts, "disfluency_rate": words_.disfluency_rate(fillers + repeats + starts, count),
    }


def segment_features(segments: DataFrame, frames: DataFrame, hop_ms: int = 10, how: Limits = Limits()) -> DataFrame:
    """Segments with their features: the columns of ``segments`` (file_id, ord, start_ms, end_ms, text and others) and

    words (words, wpm, sps, fillers, repetitions, false starts), pauses (count, short, long, time, share), pitch (median, spread,
    slope), loudness (median, range, over the floor), spectrum (centroid and its spread, flatness), voice quality (jitter in
    percent, shimmer, harmonicity, cepstral peak, share of voice, spectral slope, whether they can be relied on, and a note).

    ``frames`` has file_id, start_ms and figures as ``voice.voice_frames`` gives them, every ``hop_ms``. A segment without frames has
    no pauses and null pitch, loudness and spectrum; voice figures of segments under ``voice_ms`` are 0 with a note. (file_id,
    ord) tells segments apart; an empty table gives an empty result.
    """
    found = frame_features(segments, frames, hop_ms, how)
    own = found.toDF(*[f"_{c}" if c in KEYS else c for c in found.columns])
    rows = segments.join(own, (segments["file_id"] == own["_file_id"]) & (segments["ord"] == own["_ord"]), "left").drop("_file_id", "_ord")
    length = F.col("end_ms") - F.col("start_ms")
    short = length < how.voice_ms
    voice = {c: F.when(short | F.col("n_frames").isNull(), 0.0).otherwise(F.col(c)) for c in found.columns if c.startswith("vq_") and c != "vq_reliable"}
    none = {c: F.coalesce(c, F.lit(0)).cast(dict(found.dtypes)[c]) for c in ("n_frames", "pause_count", "pause_short_count", "pause_long_count", "pause_time_s", "pause_ratio")}
    note = F.when(short, "too_short").when(F.col("n_frames").isNull(), "no_audio").when(F.col("vq_reliable"), "reliable").when(F.col("snr_db") < how.least_snr_db, "low_snr").when(F.col("vq_voiced_ratio") < 0.5, "unvoiced").otherwise("low_dr")
    reliable = F.coalesce(F.col("vq_reliable") & ~short, F.lit(False))
    said = word_features(F.col("text"), F.col("_tokens"), length)
    rows = rows.withColumn("_tokens", words_.tokens(F.col("text"))).withColumns(said).drop("_tokens")
    return rows.withColumns({**none, **voice, "vq_reliable": reliable, "vq_note": note})
