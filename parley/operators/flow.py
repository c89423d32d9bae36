"""Conversation flow: turns, latencies, dominance, balance, pace, coherence and energy over time.

Segments have file_id, ord, speaker, text, start_ms and end_ms; (start_ms, ord) is their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .intervals import overlap_join, overlap_ms
from .islands import ordered

_ORDER = ["start_ms", "ord"]


def _duration():
    return F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(0))


def turns(segments: DataFrame) -> DataFrame:
    """Segments that change the speaker and have a length; a turn spans its first segment only."""
    w = ordered(["file_id"], _ORDER)
    before = F.lag("speaker").over(w)
    changed = segments.withColumn("_new", ~before.eqNullSafe(F.col("speaker")) & (_duration() > 0))
    own = changed.where("_new").withColumn("turn", F.row_number().over(w).cast("long"))
    return own.select("file_id", "turn", "ord", "speaker", "start_ms", "end_ms", _duration().alias("duration_ms"))


def flow_interruptions(segments: DataFrame) -> DataFrame:
    """Segments that start before the end of the segment ahead, whoever spoke that; credited to the later speaker."""
    w = ordered(["file_id"], _ORDER)
    rows = segments.withColumn("over_ms", F.lag("end_ms").over(w) - F.col("start_ms"))
    return rows.where("over_ms > 0").select("file_id", "ord", "speaker", "over_ms")


def latencies(segments: DataFrame, most_ms: int = 5_000) -> DataFrame:
    """Gaps between consecutive turns, those of 0 to ``most_ms``: (file_id, turn, latency_ms)."""
    gap = F.col("start_ms") - F.lag("end_ms").over(ordered(["file_id"], ["turn"]))
    return turns(segments).withColumn("latency_ms", gap).where(F.col("latency_ms").between(0, most_ms)).select("file_id", "turn", "latency_ms")


def latency_stats(segments: DataFrame) -> DataFrame:
    """Per file: mean and median latency in seconds and their number; zeros for a file without any."""
    per = latencies(segments).groupBy("file_id").agg(F.avg("latency_ms").alias("a"), F.median("latency_ms").alias("m"), F.count(F.lit(1)).alias("n"))
    files = segments.select("file_id").distinct()
    zero = F.lit(0.0)
    return files.join(per, "file_id", "left").select("file_id", F.coalesce(F.col("a") / 1000, zero).alias("avg_sec"), F.coalesce(F.col("m") / 1000, zero).alias("median_sec"), F.coalesce("n", F.lit(0)).cast("long").alias("count"))


def dominance(segments: DataFrame) -> DataFrame:
    """Share of a file's speech of each speaker in percent: (file_id, speaker, speech_ms, dominance_pct)."""
    per = segments.groupBy("file_id", "speaker").agg(F.sum(_duration()).alias("speech_ms"))
    whole = F.sum("speech_ms").over(W.partitionBy("file_id"))
    return per.withColumn("dominance_pct", F.when(whole > 0, F.col("speech_ms") / whole * 100).otherwise(0.0))


def balance(segments: DataFrame) -> DataFrame:
    """Turn-taking balance: entropy of speech shares over its maximum, 0 for one speaker: (file_id, speakers, balance)."""
    shares = dominance(segments).withColumn("p", F.col("dominance_pct") / 100)
    entropy = -F.sum(F.when(F.col("p") > 0, F.col("p") * F.log2("p")))
    some = F.count(F.when(F.col("p") > 0, 1))
    per = shares.groupBy("file_id").agg(F.count(F.lit(1)).alias("speakers"), entropy.alias("e"), some.alias("n"))
    return per.select("file_id", "speakers", F.when(F.col("n") > 1, F.col("e") / F.log2(F.col("n").cast("double"))).otherwise(0.0).alias("balance"))


def _stepped(segments: DataFrame, most_ms: int = 5_000) -> DataFrame:
    """Segments with what the one before tells, all from one window: whether a turn begins (_new), the start lies before the
    last end (_cut), the gap to the last turn's end (_gap, null outside 0 to ``most_ms``)."""
    w = ordered(["file_id"], _ORDER)
    rows = segments.withColumns({"_ms": _duration(), "_new": ~F.lag("speaker").over(w).eqNullSafe(F.col("speaker")) & (_duration() > 0), "_cut": F.lag("end_ms").over(w) > F.col("start_ms")})
    ended = F.last(F.when(F.col("_new"), F.col("end_ms")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    gap = F.when(F.col("_new"), F.col("start_ms") - ended)
    return rows.withColumn("_gap", F.when(gap.between(0, most_ms), gap))


def _pace_sums() -> list:
    new = F.col("_new")
    return [
        F.max("end_ms").alias("total_ms"), F.sum("_ms").alias("speech_ms"), F.count(F.when(new, 1)).alias("turns"), F.avg(F.when(new, F.col("_ms"))).alias("_mean"), F.count(F.when(F.col("_cut"), 1)).alias("interruptions"),
    ]


def _pace_columns() -> list:
    minutes = F.nullif(F.col("total_ms"), F.lit(0)) / 60000
    silence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("total_ms") - F.col("speech_ms")) / F.nullif(F.col("total_ms"), F.lit(0))))
    return [
        F.col("total_ms"), F.col("speech_ms"), F.coalesce(silence, F.lit(1.0)).alias("silence_ratio"), F.col("turns"), F.coalesce(F.col("turns") / minutes, F.lit(0.0)).alias("turns_per_min"),
        F.coalesce(F.col("_mean") / 1000, F.lit(0.0)).alias("avg_turn_sec"), F.col("interruptions"), F.coalesce(F.col("interruptions") / minutes, F.lit(0.0)).alias("interruptions_per_min"),
    ]


def pace(segments: DataFrame) -> DataFrame:
    """Per file: length, speech, silence ratio, turns, their pace and mean length, interruptions per minute; one exchange."""
    return _stepped(segments).groupBy("file_id").agg(*_pace_sums()).select("file_id", *_pace_columns())


def long_words(text="text"):
    """Distinct lower-cased words of more than three characters."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"\S+"), F.lit(0)), lambda w: F.length(w) > 3))


def topic_coherence(segments: DataFrame) -> DataFrame:
    """Mean Jaccard similarity of the long words of neighbouring segments: (file_id, pairs, coherence).

    Pairs with a segment without long words are left out; a file without pairs has coherence 0, one of a single
    segment 1.
    """
    return _compared(segments).groupBy("file_id").agg(F.count("_sim").alias("pairs"), _coherence())


def _compared(segments: DataFrame) -> DataFrame:
    """Segments with the similarity of their long words to those of the segment before (_sim)."""
    rows = segments.withColumn("_own", long_words())
    rows = rows.withColumn("_prev", F.lag("_own").over(ordered(["file_id"], _ORDER)))
    said = F.col("_prev").isNotNull() & (F.size("_prev") > 0) & (F.size("_own") > 0)
    return rows.withColumn("_sim", F.when(said, F.size(F.array_intersect("_own", "_prev")) / F.size(F.array_union("_own", "_prev")))).drop("_own", "_prev")


def _coherence():
    alone = F.when(F.count(F.lit(1)) < 2, 1.0).otherwise(0.0)
    return F.coalesce(F.avg("_sim"), alone).alias("coherence")


def energy_flow(segments: DataFrame, size_ms: int = 30_000, arousal: str | None = None) -> DataFrame:
    """Speech density and energy in whole windows of each file: (file_id, window, start, end, speakers, density, energy).

    A file has as many windows as fit whole, one at least; the rest at its end is not looked at. Energy is the mean
    arousal of the segments that touch a window (0 without such a column) times density.
    """
    level = F.coalesce(F.col(arousal), F.lit(0.0)) if arousal else F.lit(0.0)
    spans = segments.withColumn("_level", level)
    files = segments.groupBy("file_id").agg(F.max("end_ms").alias("total_ms")).where("total_ms > 0")
    last = F.greatest(F.floor(F.col("total_ms") / size_ms).cast("long"), F.lit(1).cast("long")) - 1
    windows = files.select("file_id", "total_ms", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("window"))
    windows = windows.select("file_id", "window", (F.col("window") * size_ms).alias("start_ms"), F.least((F.col("window") + 1) * size_ms, F.col("total_ms")).alias("end_ms"))
    pairs = overlap_join(windows, spans.select("file_id", "speaker", "_level", "start_ms", "end_ms"), ["file_id"], size_ms, "left", ["window"])
    per = pairs.groupBy("file_id", "window", "start_ms", "end_ms").agg(
        F.coalesce(F.sum(overlap_ms()), F.lit(0)).alias("speech_ms"), F.countDistinct("r_speaker").alias("speakers"), F.coalesce(F.avg("r__level"), F.lit(0.0)).alias("_level")
    )
    density = F.col("speech_ms") / size_ms
    return per.select("file_id", "window", F.col("start_ms").alias("window_start_ms"), F.col("end_ms").alias("window_end_ms"), "speakers", "speech_ms", density.alias("density"), (F.col("_level") * density).alias("energy"))


def metrics(segments: DataFrame) -> DataFrame:
    """One row per file with the scalar flow metrics: one window in order and one aggregate, and the speakers' balance."""
    zero = F.lit(0.0)
    per = _stepped(_compared(segments)).groupBy("file_id").agg(*_pace_sums(), _coherence(), F.avg("_gap").alias("_avg"), F.median("_gap").alias("_median"), F.count("_gap").alias("latencies"))
    rows = per.select("file_id", *_pace_columns(), "coherence", F.coalesce(F.col("_avg") / 1000, zero).alias("avg_sec"), F.coalesce(F.col("_median") / 1000, zero).alias("median_sec"), "latencies")
    return rows.join(balance(segments), "file_id")
