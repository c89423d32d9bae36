"""The catalogue: a query for each group of operators over the driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers, text
from .. import storage
from ..operators import audio, carried, clusters, denoise, dynamics, features, flow, folds, identity, intervals, islands, nearest, overlap, rollup, segments, timeline, voice
from ..sources import sinks, sound, stages, tables
from ..streaming import events as streams
from ..streaming import timed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded at the very end, so that engines that sum in another order agree."""
    return df.select(*[F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def _add(name: str, source: str, build: Callable[[DataFrame], DataFrame]) -> None:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        view = {"segments": ("conversations", tables.segments), "frames": ("events", tables.frames), "sound": ("embeddings", tables.sound)}.get(source)
        rows = view[1](tables.table(spark, folder, view[0])) if view else tables.table(spark, folder, source)
        return rounded(build(rows))

    QUERIES[name] = query


def _with_words(seg: DataFrame) -> DataFrame:
    return seg.withColumn("words", text.word_count(F.col("text")))


def _props(events: DataFrame) -> DataFrame:
    return events.withColumn("k", numbers.number(F.get_json_object("props", "$.k")))


def _shares(events: DataFrame) -> DataFrame:
    return rollup.label_shares(events, ["user_id"], "event_type", "value")


def _share_lists(events: DataFrame) -> DataFrame:
    lists = _shares(events).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_type", "share"))).alias("l"))
    return lists.select("user_id", F.col("l.event_type").alias("names"), F.col("l.share").alias("p"))


def _file_regions(seg: DataFrame, size: int = 20_000) -> DataFrame:
    last = seg.groupBy("file_id").agg(F.floor(F.max("end_ms") / size).cast("long").alias("n"))
    rows = last.select("file_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n"))).alias("region"))
    return rows.withColumn("start_ms", F.col("region") * size).withColumn("end_ms", (F.col("region") + 1) * size)


# Conversation flow.
_add("flow_turns", "segments", flow.turns)
_add("flow_interruptions", "segments", flow.flow_interruptions)
_add("flow_latency", "segments", flow.latency_stats)
_add("flow_dominance", "segments", flow.dominance)
_add("flow_balance_entropy", "segments", flow.balance)
_add("flow_silence_pace", "segments", flow.pace)
_add("flow_topic_coherence", "segments", flow.topic_coherence)
_add("flow_energy_buckets", "segments", lambda s: flow.energy_flow(s.withColumn("a", (F.col("ord") % 10) / 10), arousal="a"))
_add("flow_metrics", "segments", flow.metrics)

# Speaker rollups.
_add("speaker_rollup_core", "segments", lambda s: rollup.core(_with_words(s)))
_add("speaker_rollup_median", "events", lambda e: rollup.medians(_props(e).select(F.col("user_id").alias("file_id"), F.col("event_type").alias("speaker"), "value", "k"), ["file_id", "speaker"], {"value": "med_value", "k": "med_k"}))
_add("speaker_vote_argmax", "events", lambda e: rollup.vote(e.withColumnRenamed("user_id", "file_id"), ["file_id"], "event_type", "event_id", "neutral"))
_add("speaker_emotion_distribution", "events", _shares)
_add("speaker_top5_labels", "events", lambda e: rollup.top_labels(_shares(e), ["user_id"], "event_type", 5))
_add("speaker_loudness_orderstat", "events", lambda e: rollup.order_statistic_spread(e, ["user_id"], "value"))
_add("speaker_lead", "segments", lambda s: rollup.lead_speaker(_with_words(s)))
_add("speaker_table", "segments", lambda s: rollup.speakers(_with_words(s), overlap.interruption_map(s)))
_add("top_speakers_semi", "segments", lambda s: rollup.keep_top_speakers(_with_words(s), 1).select("file_id", "ord", "speaker"))
_add("key_moments", "segments", lambda s: rollup.key_moments(s.withColumn("length", F.col("end_ms") - F.col("start_ms")), "length", 5, 20_000).select("file_id", "ord", "place"))
_add("pattern_stats", "events", lambda e: rollup.pattern_stats(_props(e), ["user_id"], ["value", "k"]))
_add("percentile_iqr", "events", lambda e: rollup.without_outliers(e, ["user_id"], "value"))

_add("longest_segment", "segments", rollup.longest_segment)


def _emotions(e: DataFrame) -> DataFrame:
    label = F.when(F.col("user_id") % 11 == 0, "other").otherwise(F.col("event_type"))
    full = F.when((F.col("event_id") % 3 == 0) & (F.col("user_id") % 7 != 0), F.create_map(label, "value"))
    rows = e.select("user_id", full.alias("full"), F.array(F.struct(label.alias("label"), F.col("value").alias("score"))).alias("top"))
    return rollup.text_emotions(rows, ["user_id"], "full", "top", ("click", "error", "purchase"))


_add("text_emotion_rollup", "events", _emotions)

# Overlaps.
_add("overlap_pairs", "segments", lambda s: overlap.overlap_pairs(s).select("file_id", F.col("ord").alias("ord_a"), F.col("r_ord").alias("ord_b"), "overlap_ms"))
_add("overlap_by_speaker", "segments", overlap.overlap_by_speaker)
_add("overlap_by_file", "segments", overlap.file_overlap)
# Turns that begin within the same four seconds begin together, so that onsets lie close.
_add("interruption_onsets", "segments", lambda s: overlap.interruptions(s.withColumn("start_ms", F.col("start_ms") - F.col("start_ms") % 4_000)))
_add("interrupt_full_outer", "segments", overlap.interruption_map)


def _add_cover(name: str, build: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        seg = tables.segments(tables.table(spark, folder, "conversations"))
        return rounded(build(seg, tables.sound_events(tables.table(spark, folder, "events"))))

    QUERIES[name] = query


def _labels(seg: DataFrame, events: DataFrame) -> DataFrame:
    top = overlap.top_events(seg, events).groupBy("file_id", "ord").agg(F.array_sort(F.collect_list(F.struct("place", "label"))).alias("l"))
    rows = seg.select("file_id", "ord").join(top, ["file_id", "ord"], "left").join(overlap.event_snr(seg, events), ["file_id", "ord"], "left")
    return rows.select("file_id", "ord", F.coalesce(F.array_join("l.label", ","), F.lit("")).alias("labels"), "snr_db")


_add_cover("segment_event_join", overlap.segment_events)
# Scores are quotients that may lie half-way between two roundings; the tiny offset sends them the same way everywhere.
_add_cover("segment_event_top3", lambda s, e: overlap.top_events(s, e).withColumn("score", F.col("score") + 1e-9))
_add_cover("segment_event_snr", overlap.event_snr)
_add_cover("turns_left_events", _labels)

# Event timelines and regions.
_add("sed_hysteresis_a", "frames", timeline.events_to_exit)
_add("sed_hysteresis_b", "frames", timeline.runs_before_exit)
_add("sed_min_dur_merge", "frames", lambda f: timeline.filter_then_merge(timeline.events_to_exit(f), 2_000, 200, {"error": 2_500}))
_add("sed_merge_then_filter", "frames", lambda f: timeline.merge_then_filter(timeline.runs_before_exit(f), 1_500, 200))
_add("sed_median_filter", "frames", lambda f: islands.median_filter(f, ["file_id", "label"], 5).select("file_id", "label", "frame", "smooth"))
_add("sed_frame_topk", "frames", timeline.frame_top)
_add("regions_merge_gap", "segments", lambda s: islands.merge_spans(s, ["file_id"], 300))
_add("regions_rle", "frames", lambda f: islands.runs(f.withColumn("loud", F.col("score") >= 0.5), ["file_id", "label"], "frame", "loud"))
_add("same_speaker_merge", "segments", lambda s: islands.merge_neighbours(s, "file_id", "speaker", 1_000, ["start_ms", "ord"]))
_add("span_vote", "segments", lambda s: segments.sweep_votes(_file_regions(s), s.select("file_id", "speaker", "start_ms", "end_ms")))
_add("sliding_windows", "segments", lambda s: intervals.windows_of(s, 1_500, 750, 600).select("file_id", "ord", "window", "win_start_ms", "win_end_ms"))
_add("tail_windows", "segments", lambda s: intervals.windows_of(s, 1_000, 500, tail=True).select("file_id", "ord", "window", "win_start_ms", "win_end_ms"))
_add("chunk_plan", "segments", lambda s: intervals.chunks(s.groupBy("file_id").agg(F.max("end_ms").alias("duration_ms")), 60_000, 20_000, 3_000))


def _collapse(spark: SparkSession, folder: str) -> DataFrame:
    groups = spark.createDataFrame([("click", "browse"), ("view", "browse"), ("purchase", "account"), ("signup", "account")], "label string, group string")
    return rounded(timeline.collapse(tables.frames(tables.table(spark, folder, "events")), groups))


QUERIES["sed_label_collapse"] = _collapse


def _noise(events: DataFrame) -> DataFrame:
    label = F.when(F.col("event_type") == "click", "Typing on keyboard").when(F.col("event_type") == "error", "Wind noise").otherwise("Speech")
    tags = events.select(F.col("user_id").alias("file_id"), label.alias("label"), (F.col("value") / 10_000).alias("score"))
    return timeline.noise_scores(tags).withColumn("snr_db", overlap.noise_snr(F.col("noise_score")))


_add("noise_score_snr", "events", _noise)


# Text.
def _said(c: DataFrame) -> DataFrame:
    return c.withColumn("w", text.tokens(F.col("text")))


_add("word_tokenize", "conversations", lambda c: _said(c).select("conv_id", "turn", F.size("w").cast("long").alias("n_tokens"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"), F.array_join("w", " ").alias("joined")))
_add("filler_count", "conversations", lambda c: _said(c).select("conv_id", "turn", text.fillers(F.col("text"), F.col("w")).alias("fillers")))
_add("repetition_count", "conversations", lambda c: _said(c).select("conv_id", "turn", text.repetitions(F.col("w")).alias("repetitions")))
_add("false_start_count", "conversations", lambda c: _said(c).select("conv_id", "turn", text.false_starts(F.col("text"), F.col("w")).alias("false_starts")))


def _syllables(c: DataFrame) -> DataFrame:
    rows = c.select("conv_id", "turn", F.explode(text.tokens(F.col("text"))).alias("x"))
    return rows.groupBy("conv_id", "turn").agg(F.sum(text.syllables(F.col("x"))).alias("syllables"))


def _backchannels(c: DataFrame) -> DataFrame:
    """Every word of a turn as a turn of its own."""
    words = c.select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("place", "word"))
    rows = words.select("conv_id", "turn", "place", text.backchannel(F.col("word"), tables.WORD_MS * text.word_count(F.col("word")), 1_200).alias("confidence_text"))
    return rows.where("confidence_text is not null").withColumn("confidence_combined", F.col("confidence_text") / 2)


_add("syllable_estimate", "conversations", _syllables)
_add("backchannel", "conversations", _backchannels)
_add("action_items", "conversations", lambda c: c.where(text.is_action(F.col("text"), F.when(F.col("role") == "system", "instruction"))).select("conv_id", "turn", "role", "text"))


# Vectors.
def _matched(spark: SparkSession, folder: str) -> DataFrame:
    vectors = tables.table(spark, folder, "embeddings")
    return identity.match(vectors, tables.registry(vectors), "vec_id", "embedding")


def _pool(e: DataFrame) -> DataFrame:
    return tables.registry(e).select("name", "samples", F.posexplode("centroid").alias("place", "x"))


QUERIES["cosine_nearest"] = lambda spark, folder: rounded(_matched(spark, folder).select("vec_id", "name", "similarity"), 5)
QUERIES["registry_threshold_bands"] = lambda spark, folder: _matched(spark, folder).select("vec_id", "assigned", "needs_review")
_add("centroid_pool", "embeddings", _pool)
_add("ema_centroid", "embeddings", lambda e: identity.moving_centroids(e, "label", "vec_id", "embedding").select("label", "samples", F.posexplode("centroid").alias("place", "x")))
_add("agglomerative_clusters", "embeddings", lambda e: identity.cluster(e.withColumn("file_id", F.floor(F.col("vec_id") / 20)), "file_id", "vec_id", "embedding", 0.5))

# Distributions and rules.
_add("softmax_norm", "events", lambda e: _share_lists(e).select("user_id", F.explode(F.arrays_zip(F.col("names").alias("names"), numbers.softmax(F.col("p")).alias("p"))).alias("x")).select("user_id", F.col("x.names").alias("event_type"), F.col("x.p").alias("p")))
_add("entropy_confidence", "events", lambda e: _share_lists(e).select("user_id", numbers.entropy(F.col("p")).alias("entropy"), numbers.normal_entropy(F.col("p")).alias("normal_entropy"), numbers.top_margin(F.col("p")).alias("margin"), numbers.low_confidence(F.col("p")).alias("low_confidence")))
_add("affect_hint", "events", lambda e: e.select("event_id", numbers.affect_hint((F.col("event_id") % 201 - 100) / 100.0, (F.col("event_id") % 97) / 96.0, F.col("event_type")).alias("hint")))


def _anomalies(e: DataFrame) -> DataFrame:
    flags, score, word = numbers.anomalies(F.col("value"), F.col("event_id") % 21 * 1.0, F.col("event_id") % 11 / 16.0)
    return e.select("event_id", F.array_join(flags, ",").alias("flags"), score.alias("severity"), word.alias("word"))


def _tuned(e: DataFrame) -> DataFrame:
    i = F.col("event_id")
    given = [F.lit(x) for x in (0.3, 0.8, 0.4, 0.1, 1, 0.5)]
    found = numbers.tune((i % 34) * 1.0, (i % 101) / 100.0, 6.0 + i % 13, i % 7 == 0, *given)
    return e.select("event_id", *[v.alias(k) for k, v in found.items()])


_add("anomaly_flags", "events", _anomalies)
_add("tuner_rules", "events", _tuned)
_add("json_props_extract", "events", lambda e: _props(e).select("event_id", F.col("k").cast("long").alias("k"), F.col("k").isNull().alias("broken")))


# Segment rows, caches and reports.
def _completed(s: DataFrame) -> DataFrame:
    rows = segments.complete(s.select("file_id", (F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"), F.col("speaker").alias("speaker_id"), "text"))
    known = {"file_id", "start", "end", "speaker_id", "text", *segments.DEFAULTS}
    empty = sum((F.col(c).isNull().cast("int") for c in segments.SEGMENT_COLUMNS if c not in known), F.lit(0))
    return rows.select("file_id", "start", "end", "speaker_id", *segments.DEFAULTS, (empty + 4).cast("int").alias("missing"))


def _allocated(s: DataFrame) -> DataFrame:
    whole = s.groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), " ").alias("text"))
    return segments.share_words(s.select("file_id", "ord", "start_ms", "end_ms"), whole, "file_id")


def _uncached(c: DataFrame) -> DataFrame:
    keyed = c.withColumn("key", segments.content_key(F.col("text"), "v1"))
    return segments.missing(keyed, keyed.where("turn = 0"), ["key"]).select("conv_id", "turn")


def _report(s: DataFrame) -> DataFrame:
    flag = F.when(F.col("end_ms") - F.col("start_ms") > 60_000, "long").otherwise("")
    rows = s.select("file_id", F.col("speaker").alias("speaker_id"), flag.alias("error_flags"), F.when(F.col("ord") % 2 == 0, F.col("ord") / 7.0).alias("vq_jitter_pct"))
    return sinks.quality_report(rows).select(F.col("file_id").cast("long").alias("file_id"), "segments", "speakers", "flagged", "vq_jitter_pct_mean")


def _gate(e: DataFrame) -> DataFrame:
    """Forty vectors a piece of sound: most are quiet for two vectors of three, some are clipped, some end early."""
    key, place = F.floor(F.col("vec_id") / 40), F.col("vec_id") % 40
    level = F.when(key % 5 == 4, 8.0).when(F.col("vec_id") % 3 == 0, 1.0).otherwise(0.015625)
    rows = e.where((key % 5 != 3) | (place < 8)).select(key.alias("key"), place.alias("place"), level.alias("level"), F.posexplode("embedding").alias("i", "x"))
    return audio.quality_gate(rows.select("key", (F.col("place") * 64 + F.col("i")).alias("pos"), (F.col("x").cast("double") * F.col("level")).alias("x")), 8_000)


def _scored(s: DataFrame) -> DataFrame:
    return s.withColumns({"arousal": (F.col("ord") * 7 + F.col("file_id")) % 10 / 10, "valence": (F.col("ord") % 2 * 2 - 1) * (F.col("file_id") % 5) / 10})


def _shared_words(s: DataFrame) -> DataFrame:
    """Four segments a batch, put together end to end; their words come 150 ms late, so that the last one reaches the next."""
    own = s.withColumn("batch", F.floor(F.col("ord") / 4))
    before = F.sum(F.col("end_ms") - F.col("start_ms")).over(islands.ordered(["file_id", "batch"], ["ord"]).rowsBetween(islands.W.unboundedPreceding, -1))
    own = own.withColumn("from_ms", F.coalesce(before, F.lit(0))).withColumn("to_ms", F.col("from_ms") + F.col("end_ms") - F.col("start_ms"))
    found = F.posexplode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"\S+"), F.lit(0))).alias("i", "word")
    words = own.select("file_id", "batch", "ord", "from_ms", found).withColumn("start_ms", F.col("from_ms") + F.col("i") * tables.WORD_MS + 150)
    words = words.select("file_id", "batch", (F.col("ord") * 10_000 + F.col("i")).alias("place"), "word", "start_ms", (F.col("start_ms") + tables.WORD_MS).alias("end_ms"))
    return segments.words_to_spans(words, own.select("file_id", "batch", "ord", "start_ms", "from_ms", "to_ms"))


def _joined(s: DataFrame) -> DataFrame:
    rows = intervals.lapping_windows(s.select("file_id", "ord", "text", "start_ms", "end_ms"), 3_000, 400)
    said = F.when(F.col("window") % 3 != 1, F.concat(F.lit(" "), F.substring("text", 1, 12), F.lit(" "), F.col("window").cast("string")))
    return segments.join_windows(rows.select("file_id", "ord", "window", said.alias("text"), F.when(F.col("window") % 2 == 0, -0.1 * (F.col("window") + 1)).alias("logprob"), F.concat(F.lit("l"), F.col("window").cast("string")).alias("language")))


def _unlapped(s: DataFrame) -> DataFrame:
    plan = intervals.chunks(s.groupBy("file_id").agg(F.max("end_ms").alias("duration_ms")), 10_000, 4_000, 700).where("lap_end_ms > lap_start_ms")
    made = plan.withColumns({"first": F.col("chunk") == 0, "rate": F.lit(10), "samples": F.transform(F.sequence(F.floor(F.col("lap_start_ms") / 100), F.floor(F.col("lap_end_ms") / 100)), lambda x: x.cast("double"))})
    return audio.drop_laps(made).select("file_id", "chunk", F.size("samples").cast("long").alias("n"), F.element_at("samples", 1).alias("first"), F.element_at("samples", -1).alias("last"))


def _faded(e: DataFrame) -> DataFrame:
    """Vectors as chunks of audio, ten or a hundred thousand times quieter for some."""
    return e.select("vec_id", F.transform("embedding", lambda x: x.cast("double") / F.pow(F.lit(10.0), F.col("vec_id") % 6)).alias("samples"))


def _flips(e: DataFrame) -> DataFrame:
    files = e.groupBy(F.col("user_id").alias("file_id")).agg((F.max("event_id") * 40).alias("duration_ms"))
    turns = e.select(F.col("user_id").alias("file_id"), F.when(F.col("event_type") != "view", F.col("event_id") % 3 == 0).alias("is_boundary_flip"))
    return segments.unstable_voice(turns, files, 0.5)


def _chunked(s: DataFrame) -> DataFrame:
    """Segments that begin half a second early and say what one speaker says, with a vector for some."""
    rows = s.select("file_id", F.greatest(F.col("start_ms") - 500, F.lit(0)).alias("start_ms"), "end_ms", F.when(F.col("ord") % 4 == 3, "b").otherwise("a").alias("speaker"), F.when(F.col("ord") % 3 > 0, F.array(F.col("ord") * 1.0, F.lit(1.0))).alias("embedding"))
    return folds.merged_chunks(rows).select("file_id", "start_ms", "end_ms", "speaker", "n_spans", F.col("embedding")[0].alias("x"))


def _notes(e: DataFrame) -> DataFrame:
    i = F.col("event_id")
    given = [F.lit(x) for x in (0.3, 0.8, 0.4, 0.1, 1, 0.5)]
    return e.select("event_id", F.array_join(numbers.tune_notes((i % 34) * 1.0, (i % 101) / 100.0, 6.0 + i % 13, i % 7 == 0, *given), ",").alias("notes"))


def _clocks(e: DataFrame) -> DataFrame:
    ms = (F.col("event_id") * 7_919_317) % 100_000_000 - 1_000
    return e.select("event_id", text.short_clock(ms).alias("short"), text.fine_clock(ms).alias("fine"), text.full_clock(ms).alias("whole"))


def _mask(f: DataFrame) -> DataFrame:
    rows = f.select("file_id", "label", "frame", (F.col("score") < 0.4).alias("silent"))
    return audio.smooth_mask(rows, ["file_id", "label"], "silent").unionByName(_one_key(rows))


def _one_key(rows: DataFrame) -> DataFrame:
    """All frames of a label as one long series, numbered by file and frame."""
    number = F.row_number().over(islands.ordered(["label"], ["file_id", "frame"])).cast("long")
    return audio.smooth_mask(rows.select(F.lit(-1).cast("long").alias("file_id"), "label", number.alias("frame"), "silent"), ["file_id", "label"], "silent")


_add("words_to_spans", "segments", _shared_words)
_add("asr_window_plan", "segments", lambda s: intervals.lapping_windows(s, 3_000, 400).select("file_id", "ord", "window", "win_start_ms", "win_end_ms"))
_add("asr_window_text", "segments", _joined)
_add("whole_windows", "segments", lambda s: intervals.whole_windows(s, 1_000, 320).select("file_id", "ord", "window", "win_start_ms", "win_end_ms"))
_add("chunk_laps_dropped", "segments", _unlapped)
_add("chunk_energy_gate", "embeddings", lambda e: audio.loud_chunks(_faded(e)).select("vec_id", "rms_db"))
_add("chunk_speaker_merge", "segments", _chunked)
_add("vad_flips", "events", _flips)
_add("silence_mask", "frames", _mask)
_add("hann_smoothing", "frames", lambda f: audio.hann_smooth(f, ["file_id", "label"], "score", 5).select("file_id", "label", "frame", "score_hann"))
_add("moments_in_order", "segments", lambda s: rollup.moments_in_order(_scored(s), "arousal", 3))
_add("quick_take", "segments", lambda s: rollup.quick_take(_scored(s)))
_add("tuner_notes", "events", _notes)
_add("clock_formats", "events", _clocks)
_add("audio_quality_gate", "embeddings", _gate)
_add("event_rows", "frames", lambda f: sinks.formatted_events(timeline.events_to_exit(f)))
_add("schema_completion", "segments", _completed)
_add("midpoint_overlap_split", "segments", segments.split_overlaps)
_add("batch_packing", "segments", lambda s: segments.pack_batches(s, 60_000, 4))
_add("proportional_words", "segments", _allocated)
_add("latest_checkpoint", "events", lambda e: segments.latest(e, ["user_id", "event_type"], ["ts", "event_id"], 2).select("user_id", "event_type", "event_id", "place"))
_add("cache_left_anti", "conversations", _uncached)
_add("qc_summary", "segments", _report)


# Sound: fifty vectors a file. Blocks are short, so that frames and gains cross them.
def _played(chunks: DataFrame) -> DataFrame:
    """Files of sound that were written and read again, in chunks of a second and ranges of 1,000 bytes."""
    path = storage.new_path(chunks.sparkSession, "played")
    sound.write(chunks, path)
    rows = sound.read(chunks.sparkSession, path, 1, 1_000)
    number = F.regexp_extract("file_id", r"(\d+)\.wav$", 1).cast("long")
    each = rows.select(number.alias("file_id"), F.posexplode("samples").alias("pos", "x"), "chunk").select("file_id", (F.floor((F.col("chunk") * 8_000 + F.col("pos")) / 400)).alias("chunk"), F.col("x").cast("double").alias("x"))
    return each.groupBy("file_id", "chunk").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("total"), F.max(F.abs("x")).alias("peak"))


def _lengths(chunks: DataFrame) -> DataFrame:
    path = storage.new_path(chunks.sparkSession, "played")
    sound.write(chunks, path)
    return sound.durations(chunks.sparkSession, path).withColumn("file_id", F.regexp_extract("file_id", r"(\d+)\.wav$", 1).cast("long"))


_add("audio_durations", "sound", _lengths)
_add("audio_decoded", "sound", _played)
_add("audio_frames", "sound", lambda s: audio.frame_energies(s, block_ms=100))
_add("gain_curve", "sound", lambda s: dynamics.gain_curve(s, block_ms=100))
_add("denoise_energies", "sound", lambda s: denoise.residuals(s, block_ms=100))
_add("voice_figures", "sound", lambda s: voice.voice_frames(s, block_ms=100))
QUERIES["voice_pitch"] = lambda spark, folder: QUERIES["voice_figures"](spark, folder).select("file_id", "frame", F.round("hz", 4).alias("hz"), "aperiodicity")


def _features(spark: SparkSession, folder: str) -> DataFrame:
    seg = tables.segments(tables.table(spark, folder, "conversations"))
    return rounded(features.segment_features(seg, tables.voiced_frames(tables.table(spark, folder, "events")), 200).drop("speaker", "text", "start_ms", "end_ms"))


QUERIES["segment_features"] = _features


# Models, clusters and large registries.
def _pruned(e: DataFrame) -> DataFrame:
    """Every vector against those whose id is divisible by 20 as names."""
    names = e.where("vec_id % 20 = 0").select(F.format_string("v%010d", "vec_id").alias("name"), F.transform("embedding", lambda x: x.cast("double")).alias("centroid"))
    return nearest.match_pruned(e, names, "vec_id", "embedding")[0].select("vec_id", "name", F.round("similarity", 5).alias("similarity"))


def _staged(s: DataFrame) -> DataFrame:
    """Two stages that write their rows; counts are observed as they do."""
    log = stages.Stages(s.sparkSession)
    kept = log.run("segments", s.where("end_ms > start_ms"), lambda df: storage.materialise(df, "stage"), {"ms": F.sum(F.col("end_ms") - F.col("start_ms")), "silent": F.count(F.when(F.col("text") == "", 1))})
    log.run("speakers", rollup.core(_with_words(kept)), lambda df: storage.materialise(df, "stage"), {"words": F.sum("words")})
    return log.table().select("stage", "rows", F.explode("counts").alias("count", "n"))


_add("carried_scores", "sound", lambda s: carried.infer_carried(s, carried.LevelGate, 64, 16))
_add("leveled_clusters", "embeddings", lambda e: clusters.cluster_in_levels(e.withColumn("file_id", F.floor(F.col("vec_id") / 200)), "file_id", "vec_id", "embedding", 0.5, part=50))
_add("nearest_pruned", "embeddings", _pruned)
_add("stage_counts", "segments", _staged)


# Streams, drained into a table in the shared folder. The parts of a table come in no order, so they are one micro-batch.
def _add_stream(name: str, build: Callable[[DataFrame], DataFrame], mode: str) -> None:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        batch = tables.table(spark, folder, "events")
        stream = streams.read_events(spark, f"{folder}/events.parque[t]", batch.schema, None)
        return rounded(streams.drain(build(stream), f"{name}_out", mode), 4 if name == "stream_tumbling" else 6)

    QUERIES[name] = query


_add_stream("stream_tumbling", streams.tumbling, "complete")
_add_stream("stream_sliding", streams.sliding, "complete")
_add_stream("stream_session", streams.sessions, "complete")
_add_stream("stream_hysteresis", lambda e: streams.switch_events(e.withColumn("score", F.col("value")), 50.0, 35.0), "append")


# Streams whose state ends: only what the watermark has closed comes out.
def _add_timed(name: str, table: str, build: Callable[[DataFrame], DataFrame], mode: str, then: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        stream = streams.read_events(spark, f"{folder}/{table}.parque[t]", tables.table(spark, folder, table).schema, None)
        return rounded(then(timed.drain_timed(build(stream), f"{name}_out", mode)), 4 if name == "stream_tumbling_closed" else 6)

    QUERIES[name] = query


def _newest(rows: DataFrame) -> DataFrame:
    best = rows.groupBy("key").agg(F.max_by("centroid", "samples").alias("c"), F.max("samples").alias("samples"))
    return best.select(F.col("key").alias("label"), "samples", F.posexplode("c").alias("place", "x"))


_add_timed("stream_tumbling_closed", "events", streams.tumbling, "append")
_add_timed("stream_session_closed", "events", streams.sessions, "append")
_add_timed("stream_switch_timed", "events", lambda e: timed.timed_switches(e.withColumn("score", F.col("value")), 50.0, 35.0, 3 * 86_400_000), "append")
_add_timed("stream_moving_centroids", "embeddings", lambda e: timed.moving_centroids(e.withColumn("ts", F.timestamp_seconds(F.col("vec_id") + 86_400)), "label", "vec_id", "embedding", "ts"), "append", _newest)
