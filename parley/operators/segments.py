"""Segment rows: the fixed schema, defaults, overlap resolution, allocation of words and spans' votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .folds import fold

from ..functions.numbers import positive
from .intervals import overlap_join, overlap_ms

#: The 39 columns of a segment row in their order, with Spark types.
SEGMENT_COLUMNS = {
    "file_id": "string", "start": "double", "end": "double", "speaker_id": "string", "speaker_name": "string", "text": "string",
    "valence": "double", "arousal": "double", "dominance": "double", "emotion_top": "string", "emotion_scores_json": "string",
    "text_emotions_top5_json": "string", "text_emotions_full_json": "string", "intent_top": "string", "intent_top3_json": "string",
    "events_top3_json": "string", "noise_tag": "string", "asr_logprob_avg": "double", "snr_db": "double", "snr_db_sed": "double",
    "wpm": "double", "duration_s": "double", "words": "long", "pause_ratio": "double", "low_confidence_ser": "boolean",
    "vad_unstable": "boolean", "affect_hint": "string", "pause_count": "long", "pause_time_s": "double", "f0_mean_hz": "double",
    "f0_std_hz": "double", "loudness_rms": "double", "disfluency_count": "long", "error_flags": "string", "vq_jitter_pct": "double",
    "vq_shimmer_db": "double", "vq_hnr_db": "double", "vq_cpps_db": "double", "voice_quality_hint": "string",
}
DEFAULTS = {"events_top3_json": "[]", "low_confidence_ser": False, "vad_unstable": False, "error_flags": ""}


def complete(rows: DataFrame) -> DataFrame:
    """Rows with exactly the segment columns: missing ones get their default or null."""
    have = set(rows.columns)
    return rows.select(*[(F.col(c) if c in have else F.lit(DEFAULTS.get(c))).cast(kind).alias(c) for c, kind in SEGMENT_COLUMNS.items()])


def normalise_input(rows: DataFrame) -> DataFrame:
    """Accept the alternative column names; an end that is missing lies half a second after the start."""
    pick = lambda *names: F.coalesce(*[F.col(n) for n in names if n in rows.columns], F.lit(None))
    start = F.coalesce(pick("start", "start_time").try_cast("double"), F.lit(0.0))
    end = F.coalesce(pick("end", "end_time").try_cast("double"), start + 0.5)
    speaker = F.coalesce(F.nullif(pick("speaker_id", "speaker").cast("string"), F.lit("")), F.lit("Unknown"))
    return rows.select("file_id", start.alias("start"), end.alias("end"), speaker.alias("speaker_id"))


def fallback_metrics(words: Column, duration_ms: Column, given: dict[str, Column] | None = None) -> dict[str, Column]:
    """Duration, words, pause ratio and rate of a segment: the given figures where they are sound, else from the text."""
    given = given or {}
    take = lambda name, other: F.coalesce(positive(given[name]), other) if name in given else other
    duration = take("duration_s", F.greatest(duration_ms, F.lit(0)) / 1000)
    count = take("words", words.cast("double")).cast("long")
    pause = take("pause_time_s", F.lit(0.0))
    ratio = take("pause_ratio", F.coalesce(pause / F.nullif(duration, F.lit(0.0)), F.lit(0.0)))
    return {"duration_s": duration, "words": count, "pause_ratio": F.greatest(F.lit(0.0), F.least(F.lit(1.0), ratio)), "wpm": F.coalesce(count * 60.0 / F.nullif(duration, F.lit(0.0)), F.lit(0.0))}


def placeholders(turns: DataFrame, texts: DataFrame, keys: list[str], stand_in: str = "[Transcription unavailable]") -> DataFrame:
    """Turns with their texts, or a stand-in for those without one."""
    return turns.join(texts.select(*keys, "text"), keys, "left").withColumn("text", F.coalesce("text", F.lit(stand_in)))


def whole_file_turns(files: DataFrame, turns: DataFrame) -> DataFrame:
    """Turns of all files; a file without any is one turn of Speaker_1."""
    none = files.join(turns.select("file_id").distinct(), "file_id", "left_anti")
    made = none.select("file_id", F.lit(0).cast("long").alias("start_ms"), F.col("duration_ms").alias("end_ms"), F.lit("Speaker_1").alias("speaker"))
    return turns.select("file_id", "start_ms", "end_ms", "speaker").unionByName(made)


def split_overlaps(segments: DataFrame, least_ms: int = 50) -> DataFrame:
    """Resolve overlaps of a file's segments one after the other: two that overlap meet at the middle of their overlap.

    What becomes shorter than ``least_ms`` is dropped, but the segment before keeps its cut. Each step depends on the
    result of the one before it, so the file's segments stream through a fold in order. (file_id, ord, start_ms,
    end_ms), halves of a millisecond rounded down.
    """
    rows = segments.select("file_id", F.greatest("start_ms", F.lit(0)).cast("long").alias("start_ms"), F.col("ord").cast("long").alias("ord"), F.col("end_ms").cast("long").alias("end_ms"))
    rows = rows.where(F.col("end_ms") - F.col("start_ms") >= least_ms)

    def step(last: tuple | None, row: tuple) -> tuple[tuple | None, list[tuple]]:
        file_id, start, number, end = row
        out = []
        if last is not None and start < last[3]:
            start = (last[3] + start) // 2
            last = (*last[:3], start)
        if end - start < least_ms:
            return last, out
        if last is not None:
            out.append(last)
        return (file_id, number, start, end), out

    schema = f"file_id {dict(rows.dtypes)['file_id']}, ord long, start_ms long, end_ms long"
    return fold(rows, "file_id", ["start_ms", "ord", "end_ms"], step, lambda _, last: [] if last is None else [last], schema)


def pack_batches(segments: DataFrame, most_ms: int = 300_000, most_rows: int = 50) -> DataFrame:
    """Number the batches of a file: segments in order, a new batch where length or number would be exceeded."""
    rows = segments.select("file_id", "start_ms", F.col("ord").cast("long").alias("ord"), (F.col("end_ms") - F.col("start_ms")).cast("long").alias("d"))

    def step(state: tuple | None, row: tuple) -> tuple[tuple, list[tuple]]:
        batch, ms, n = state or (0, 0, 0)
        if n and (ms + row[3] > most_ms or n >= most_rows):
            batch, ms, n = batch + 1, 0, 0
        return (batch, ms + row[3], n + 1), [(row[0], row[2], batch)]

    return fold(rows, "file_id", ["start_ms", "ord", "d"], step, lambda *_: [], f"file_id {dict(rows.dtypes)['file_id']}, ord long, batch long")


def share_words(spans: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """Hand a text's words out over the spans of its key in order, by their length, one word a span at least.

    ``spans`` has key, ord, start_ms, end_ms; ``texts`` key and text. Returns key, ord, text; "[silence]" without words.
    """
    length = F.col("end_ms") - F.col("start_ms")
    whole = F.sum(length).over(W.partitionBy(key))
    words = F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit(r"\S+"), F.lit(0))
    said = texts.select(F.col(key).alias("_key"), words.alias("_words")).where(F.size("_words") > 0)
    # Only the number of words goes to the spans; the places they get come back, so a text's words stay in one row.
    counted = said.select("_key", F.size("_words").alias("_all"))
    rows = spans.withColumn("_share", length / whole).join(counted, F.col(key) == F.col("_key")).drop("_key")
    rows = rows.withColumn("_n", F.greatest(F.lit(1), F.floor(F.col("_all") * F.col("_share")).cast("int")))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(key).orderBy("ord").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    places = rows.select(key, F.struct("ord", before.cast("int").alias("at"), "_n").alias("p")).groupBy(key).agg(F.collect_list("p").alias("_p"))
    each = places.join(said, F.col(key) == F.col("_key"))
    text = lambda p: F.array_join(F.slice("_words", p["at"] + 1, p["_n"]), " ")
    each = each.select(key, F.explode(F.transform("_p", lambda p: F.struct(p["ord"].alias("ord"), text(p).alias("text")))).alias("s"))
    return each.select(key, "s.ord", F.when(F.col("s.text") == "", "[silence]").otherwise(F.col("s.text")).alias("text"))


def words_to_spans(words: DataFrame, spans: DataFrame, bucket_ms: int = 10_000) -> DataFrame:
    """Give the words of a batch back to the spans it was put together from, on the spans' own clocks.

    ``words`` has file_id, batch, place, word, start_ms, end_ms on the batch's clock; ``spans`` file_id, batch, ord,
    start_ms (of its file), from_ms and to_ms (its place in the batch). A word that touches two spans goes to both.
    Returns file_id, batch, ord, text ("[silence]" without words), n_words, first_ms and last_ms (null without words).
    """
    own = spans.select("file_id", "batch", "ord", F.col("start_ms").alias("own_ms"), F.col("from_ms").alias("start_ms"), F.col("to_ms").alias("end_ms"))
    pairs = overlap_join(own, words, ["file_id", "batch"], bucket_ms, "left", ["ord"])
    moved = F.col("own_ms") - F.col("start_ms")
    said = F.when(F.trim("r_word") != "", F.struct(F.col("r_start_ms").alias("at"), F.col("r_place").alias("place"), F.trim("r_word").alias("word")))
    rows = pairs.groupBy("file_id", "batch", "ord").agg(
        F.array_sort(F.collect_list(said)).alias("_w"), F.count("r_place").alias("n_words"), F.min(F.col("r_start_ms") + moved).alias("first_ms"), F.max(F.col("r_end_ms") + moved).alias("last_ms"),
    )
    text = F.array_join(F.transform("_w", lambda x: x["word"]), " ")
    return rows.select("file_id", "batch", "ord", F.when(text == "", "[silence]").otherwise(text).alias("text"), "n_words", "first_ms", "last_ms")


def join_windows(windows: DataFrame) -> DataFrame:
    """Put the texts of a long segment's windows together in order: windows without text count for nothing.

    ``windows`` has file_id, ord, window, text, logprob, language. Returns file_id, ord, text, n_windows, logprob (mean of
    what is known), confidence (its exponential, 1 without) and the first window's language.
    """
    spoken = windows.where(F.trim(F.coalesce("text", F.lit(""))) != "")
    rows = spoken.groupBy("file_id", "ord").agg(
        F.array_sort(F.collect_list(F.struct("window", F.trim("text").alias("text")))).alias("_t"), F.count(F.lit(1)).alias("n_windows"),
        F.avg("logprob").alias("logprob"), F.min_by("language", "window").alias("language"),
    )
    text = F.array_join(F.transform("_t", lambda x: x["text"]), " ")
    return rows.select("file_id", "ord", text.alias("text"), "n_windows", "logprob", F.coalesce(F.exp("logprob"), F.lit(1.0)).alias("confidence"), "language")


def unstable_voice(turns: DataFrame, files: DataFrame, most: float = 60.0) -> DataFrame:
    """Files whose turns flip at boundaries more than ``most`` times a minute: (file_id, flips, vad_unstable).

    ``turns`` has file_id and is_boundary_flip (null: none), ``files`` file_id and duration_ms; minutes are whole, 1 at least.
    """
    flips = turns.groupBy("file_id").agg(F.count_if(F.coalesce("is_boundary_flip", F.lit(False))).alias("flips"))
    rows = files.join(flips, "file_id", "left").withColumn("flips", F.coalesce("flips", F.lit(0)))
    minutes = F.greatest(F.lit(1), F.floor(F.col("duration_ms") / 60_000))
    return rows.select("file_id", "flips", (F.col("flips") / minutes > most).alias("vad_unstable"))


def sweep_votes(regions: DataFrame, spans: DataFrame, bucket_ms: int = 10_000) -> DataFrame:
    """Cut regions where spans begin or end and give each piece the speaker with most of it: a sweep as joins.

    ``regions`` has file_id, region, start_ms, end_ms; ``spans`` file_id, speaker, start_ms, end_ms. Returns file_id,
    region, start_ms, end_ms, speaker, vote_ms. Pieces without a span are left out; equal votes go to the smaller name.
    """
    pairs = overlap_join(regions, spans, ["file_id"], bucket_ms)
    edges = F.array(F.greatest("start_ms", "r_start_ms"), F.least("end_ms", "r_end_ms"), F.col("start_ms"), F.col("end_ms"))
    points = pairs.select("file_id", "region", F.explode(edges).alias("t")).distinct()
    ahead = F.lead("t").over(W.partitionBy("file_id", "region").orderBy("t"))
    pieces = points.select("file_id", "region", F.col("t").alias("start_ms"), ahead.alias("end_ms")).where("end_ms > start_ms")
    votes = overlap_join(pieces, spans, ["file_id"], bucket_ms).withColumn("v", overlap_ms())
    sums = votes.groupBy("file_id", "region", "start_ms", "end_ms", F.col("r_speaker").alias("speaker")).agg(F.sum("v").alias("v"))
    return sums.groupBy("file_id", "region", "start_ms", "end_ms").agg(F.min_by("speaker", F.struct((-F.col("v")).alias("n"), "speaker")).alias("speaker"), F.max("v").alias("vote_ms"))


def latest(rows: DataFrame, keys: list[str], order: list[str], n: int = 1) -> DataFrame:
    """The ``n`` latest rows of each key by the descending order."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))
    return rows.withColumn("place", place.cast("long")).where(F.col("place") <= n)


def missing(wanted: DataFrame, cached: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that no cached result stands for: cache keys are content hashes with version and settings."""
    return wanted.join(cached.select(*keys).distinct(), keys, "left_anti")


def content_key(content: Column, version: str, settings: str = "") -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(version), F.lit(settings), F.sha2(content.cast("binary"), 256)), 256)
