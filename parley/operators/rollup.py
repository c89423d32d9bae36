"""Rollups of segments by speaker and file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbers import number

#: Columns whose medians are reported, with the names that readers of the table expect.
MEDIANS = {
    "valence": "avg_valence", "arousal": "avg_arousal", "dominance": "avg_dominance", "f0_mean_hz": "f0_mean_hz", "f0_std_hz": "f0_std_hz",
    "loudness_rms": "loudness_rms_med", "vq_jitter_pct": "vq_jitter_pct_med", "vq_shimmer_db": "vq_shimmer_db_med", "vq_hnr_db": "vq_hnr_db_med",
    "vq_cpps_db": "vq_cpps_db_med",
}


def words_per_minute(words: Column, duration_ms: Column) -> Column:
    return F.when(duration_ms > 0, words * 60000.0 / duration_ms)


def core(segments: DataFrame) -> DataFrame:
    """Per file and speaker: segments, duration, words, and words per minute over the whole duration.

    ``segments`` has file_id, speaker, start_ms, end_ms, words and may have wpm, whose median stands in for speakers
    without any duration. Negative durations count as none.
    """
    length = F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(0))
    fallback = F.median(number(F.col("wpm").cast("string"))) if "wpm" in segments.columns else F.lit(None).cast("double")
    per = segments.groupBy("file_id", "speaker").agg(F.count(F.lit(1)).alias("segments"), F.sum(length).alias("duration_ms"), F.sum("words").alias("words"), fallback.alias("_wpm"))
    return per.withColumn("wpm", F.coalesce(words_per_minute(F.col("words"), F.col("duration_ms")), F.col("_wpm"), F.lit(0.0))).drop("_wpm")


def medians(rows: DataFrame, keys: list[str], columns: dict[str, str]) -> DataFrame:
    """Exact interpolating medians of the columns that exist, 0 without any value."""
    own = {c: n for c, n in columns.items() if c in rows.columns}
    if not own:
        return rows.select(*keys).distinct()
    return rows.groupBy(*keys).agg(*[F.coalesce(F.median(number(F.col(c).cast("string"))), F.lit(0.0)).alias(n) for c, n in own.items()])


def vote(rows: DataFrame, keys: list[str], label: str, order: str, default: str) -> DataFrame:
    """Most frequent non-empty label of each key, of equal ones that seen first: (keys, label, votes)."""
    counted = rows.where(F.coalesce(F.trim(label), F.lit("")) != "").groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    best = counted.groupBy(*keys).agg(F.max_by(label, F.struct("n", (-F.col("first").cast("long")).alias("f"))).alias(label), F.max("n").alias("votes"))
    every = rows.select(*keys).distinct()
    return every.join(best, keys, "left").select(*keys, F.coalesce(label, F.lit(default)).alias(label), F.coalesce("votes", F.lit(0)).cast("long").alias("votes"))


def label_shares(scores: DataFrame, keys: list[str], label: str, score: str) -> DataFrame:
    """Scores summed by label as shares of the key's sum: (keys, label, share); keys without mass are left out."""
    sums = scores.groupBy(*keys, label).agg(F.sum(score).alias("s"))
    mass = F.sum("s").over(W.partitionBy(*keys))
    return sums.withColumn("share", F.when(mass > 0, F.col("s") / mass)).where("share is not null").drop("s")


def top_labels(shares: DataFrame, keys: list[str], label: str, k: int = 5) -> DataFrame:
    """The ``k`` labels of most share, equal ones by label: (keys, place, label, share)."""
    order = W.partitionBy(*keys).orderBy(F.desc(F.round("share", 9)), label)
    return shares.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= k)


def order_statistic_spread(rows: DataFrame, keys: list[str], value: str, scale: float = 20.0) -> DataFrame:
    """Robust spread: order statistics at a quarter and three quarters of the values, apart times ``scale``; 0 below 4.

    Places are counted with windows, so that no key's values are gathered into one array.
    """
    fine = rows.where(F.col(value).isNotNull())
    place = F.row_number().over(W.partitionBy(*keys).orderBy(value)) - 1
    n = F.count(F.lit(1)).over(W.partitionBy(*keys))
    placed = fine.select(*keys, F.col(value).alias("v"), place.alias("p"), n.alias("n"))
    quarter = lambda q: F.max(F.when(F.col("p") == F.floor(F.col("n") * q), F.col("v")))
    per = placed.groupBy(*keys).agg(quarter(0.25).alias("low"), quarter(0.75).alias("high"), F.max("n").alias("n"))
    return per.select(*keys, F.when(F.col("n") >= 4, F.greatest(F.lit(0.0), (F.col("high") - F.col("low")) * scale)).otherwise(0.0).alias("spread"))


def speakers(segments: DataFrame, interruptions: DataFrame | None = None) -> DataFrame:
    """The speaker table: core figures, medians of what is there, votes, pauses and interruptions.

    ``interruptions`` has file_id, speaker, made, received and overlap_ms; speakers that only it knows are left out.
    """
    keys = ["file_id", "speaker"]
    out = core(segments).join(medians(segments, keys, MEDIANS), keys)
    for label, default in (("emotion_top", "neutral"), ("voice_quality_hint", "")):
        if label in segments.columns:
            out = out.join(vote(segments, keys, label, "ord", default).drop("votes"), keys)
    if "loudness_rms" in segments.columns:
        out = out.join(order_statistic_spread(segments, keys, "loudness_rms").withColumnRenamed("spread", "loudness_dr_db"), keys, "left")
    if {"pause_time_s", "pause_count"} <= set(segments.columns):
        pauses = segments.groupBy(*keys).agg(F.coalesce(F.sum("pause_time_s"), F.lit(0.0)).alias("pause_total_sec"), F.coalesce(F.sum("pause_count"), F.lit(0)).cast("long").alias("pause_count"))
        out = out.join(pauses, keys).withColumn("pause_ratio", F.coalesce(F.col("pause_total_sec") * 1000 / F.nullif(F.col("duration_ms"), F.lit(0)), F.lit(0.0)))
    if interruptions is not None:
        out = out.join(interruptions, keys, "left")
        out = out.withColumn("overlap_ratio", F.col("overlap_ms") / F.greatest("duration_ms", F.lit(1)))
        out = out.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("made", "received")}).drop("overlap_ms")
    return out


def lead_speaker(segments: DataFrame) -> DataFrame:
    """Speaker with the most speech of each file and its share in percent; of equal ones the smallest name."""
    per = core(segments)
    best = per.groupBy("file_id").agg(F.min_by("speaker", F.struct((-F.col("duration_ms")).alias("d"), "speaker")).alias("speaker"), F.max("duration_ms").alias("duration_ms"), F.sum("duration_ms").alias("_all"), F.count(F.lit(1)).alias("speakers"))
    return best.select("file_id", "speaker", "duration_ms", "speakers", F.coalesce(F.col("duration_ms") / F.nullif(F.col("_all"), F.lit(0)) * 100, F.lit(0.0)).alias("share_pct"))


def keep_top_speakers(segments: DataFrame, n: int) -> DataFrame:
    """Segments of each file's ``n`` speakers with the most speech (a semi join, so nothing is duplicated)."""
    per = core(segments)
    rank = F.row_number().over(W.partitionBy("file_id").orderBy(F.desc("duration_ms"), "speaker"))
    best = per.withColumn("_r", rank).where(F.col("_r") <= n).select("file_id", "speaker")
    return segments.join(best, ["file_id", "speaker"], "left_semi")


def key_moments(segments: DataFrame, score: str, k: int, above: float | None = None) -> DataFrame:
    """The ``k`` rows of each file with the highest score, then only those above a bound; in order of time."""
    place = F.row_number().over(W.partitionBy("file_id").orderBy(F.desc(score), "start_ms", "ord"))
    best = segments.withColumn("place", place.cast("long")).where(F.col("place") <= k)
    return best if above is None else best.where(F.col(score) > above)


def moments_in_order(segments: DataFrame, score: str, k: int = 10) -> DataFrame:
    """The ``k`` moments of each file to check, numbered by time: (file_id, moment, start_ms, speaker, description)."""
    best = key_moments(segments.withColumn(score, F.coalesce(score, F.lit(0.0))), score, k)
    number = F.row_number().over(W.partitionBy("file_id").orderBy("start_ms", "place")).cast("long")
    said = F.substring(F.coalesce("text", F.lit("")), 1, 180)
    return best.select("file_id", number.alias("moment"), "start_ms", "speaker", said.alias("description"))


def quick_take(segments: DataFrame, valence: str = "valence") -> DataFrame:
    """A sentence for each file: speakers, whole minutes and the tone of the speaker with the most speech, in bands at 0.2."""
    length = F.col("end_ms") - F.col("start_ms")
    per = segments.groupBy("file_id", "speaker").agg(F.sum(length).alias("ms"), F.avg(valence).alias("v"), F.max("end_ms").alias("end_ms"))
    lead = per.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"), F.max("end_ms").alias("end_ms"), F.min_by("v", F.struct((-F.col("ms")).alias("ms"), "speaker")).alias("v"))
    tone = F.when(F.col("v") > 0.2, "positive").when(F.col("v") < -0.2, "negative").otherwise("neutral")
    said = F.format_string("%d speakers over %d min; most-active tone %s.", F.col("n"), F.floor(F.greatest("end_ms", F.lit(0)) / 60_000), tone)
    return lead.select("file_id", said.alias("quick_take"))


def pattern_stats(features: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Mean, population deviation, median, least and most of each figure over values that are known and not 0.

    Long form: (keys, feature, n, mean, std, median, min, max).
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns])).alias("p")
    rows = features.select(*keys, pairs).select(*keys, "p.feature", "p.v").where((F.col("v") != 0) & ~F.isnan("v"))
    return rows.groupBy(*keys, "feature").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.median("v").alias("median"), F.min("v").alias("min"), F.max("v").alias("max"))


def without_outliers(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Median and interquartile range of each key after values beyond 1.5 ranges are dropped, if more than half stay."""
    q = lambda p: F.percentile(value, p)
    bounds = rows.groupBy(*keys).agg(q(0.25).alias("a"), q(0.75).alias("b"), F.count(value).alias("n"))
    near = rows.join(bounds, keys)
    inside = F.col(value).between(F.col("a") - 1.5 * (F.col("b") - F.col("a")), F.col("b") + 1.5 * (F.col("b") - F.col("a")))
    near = near.withColumn("_v", F.when(inside, F.col(value)))
    per = near.groupBy(*keys).agg(F.max("n").alias("n"), F.count("_v").alias("kept"), F.median("_v").alias("m1"), (F.percentile("_v", 0.75) - F.percentile("_v", 0.25)).alias("r1"), F.median(value).alias("m0"), (q(0.75) - q(0.25)).alias("r0"))
    most = F.col("kept") * 2 > F.col("n")
    return per.select(*keys, "n", "kept", F.when(most, F.col("m1")).otherwise(F.col("m0")).alias("median"), F.when(most, F.col("r1")).otherwise(F.col("r0")).alias("iqr"))


def text_emotions(rows: DataFrame, keys: list[str], full: str, top: str, known: Sequence[str], neutral: str = "neutral") -> DataFrame:
    """Shares of emotion labels by key: (keys, label, share).

    Rows give their whole distribution (``full``, a map) or, where that is null, their best labels (``top``, an array of
    label and score). A key's whole distributions count if they have any mass on known labels, else its best labels, of
    these the known ones; a key without any is neutral.
    """
    item = lambda kind, label, score: F.struct(F.lit(kind).alias("kind"), label.alias("label"), score.cast("double").alias("score"))
    whole = F.transform(F.map_entries(full), lambda x: item("full", x["key"], x["value"]))
    best = F.transform(top, lambda x: item("top", x["label"], x["score"]))
    said = rows.select(*keys, F.explode(F.when(F.col(full).isNotNull(), whole).otherwise(best)).alias("x")).select(*keys, "x.*")
    sums = said.where(F.col("label").isin(*known)).groupBy(*keys, "kind", "label").agg(F.sum("score").alias("s")).where("s > 0")
    chosen = sums.withColumn("first", F.min("kind").over(W.partitionBy(*keys))).where("kind = first")  # "full" before "top"
    shares = chosen.select(*keys, "label", (F.col("s") / F.sum("s").over(W.partitionBy(*keys))).alias("share"))
    rest = rows.select(*keys).distinct().join(shares.select(*keys).distinct(), keys, "left_anti")
    return shares.unionByName(rest.select(*keys, F.lit(neutral).alias("label"), F.lit(1.0).alias("share")))


def longest_segment(segments: DataFrame) -> DataFrame:
    """The segment of each file that a language is pinned by, the first of equally long ones: (file_id, ord, length_ms)."""
    length = F.col("end_ms") - F.col("start_ms")
    best = F.max_by(F.struct("ord", length.alias("length_ms")), F.struct(length, -F.col("start_ms"), -F.col("ord")))
    return segments.groupBy("file_id").agg(best.alias("b")).select("file_id", "b.ord", "b.length_ms")


def pinned_language(guesses: DataFrame, least: float = 0.75) -> DataFrame:
    """Languages sure enough to hold for a whole file: (file_id, language) of guesses (file_id, language, probability)."""
    return guesses.where((F.coalesce("language", F.lit("")) != "") & (F.coalesce("probability", F.lit(0.0)) >= least)).select("file_id", "language")
