"""Signal figures of audio chunks: frame energies, health, pauses and spectra with numpy in grouped tasks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbers import decibels
from .blocks import BLOCK_MS, Block, blocks, laid, samples_of
from .folds import fold
from .islands import ordered, runs

FRAME_MS, HOP_MS = 25, 10


def _frame_length(rate: int, frame_ms: int, hop_ms: int) -> tuple[int, int]:
    return max(1, rate * frame_ms // 1000), max(1, rate * hop_ms // 1000)


def _by_block(chunks: DataFrame, frame_ms: int, of_block, schema: str, block_ms: int) -> DataFrame:
    """Apply ``of_block`` (a block to a frame of rows, or None) to blocks that hold a frame's length behind their own part."""
    held = blocks(chunks, F.lit(0), samples_of(frame_ms), block_ms)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in laid(batches, lambda rate: -(-rate * frame_ms // 1000)):
            found = of_block(block)
            if found is not None and len(found):
                yield found

    return held.mapInPandas(run, f"file_id {dict(chunks.dtypes)['file_id']}, {schema}")


def frame_energies(chunks: DataFrame, frame_ms: int = FRAME_MS, hop_ms: int = HOP_MS, block_ms: int = BLOCK_MS) -> DataFrame:
    """Root mean square, peak and spectral figures of short frames: (file_id, frame, start_ms, rms, peak, centroid_hz, flatness).

    ``chunks`` has file_id, start_ms, rate, samples. Frame k of a file begins k * ``hop_ms`` after its start; all frames that lie
    within the file are there, also those that cross chunks, so results do not depend on how a file was cut.
    """

    def of_block(block: Block) -> pd.DataFrame:
        size, hop = _frame_length(block.row.rate, frame_ms, hop_ms)
        k, frames = block.frames(size, hop)
        power = np.abs(np.fft.rfft(frames * np.hanning(size), axis=1)) ** 2 + 1e-12
        hz = np.fft.rfftfreq(size, 1 / block.row.rate)
        return pd.DataFrame({
            "file_id": block.row.file_id, "frame": k, "start_ms": k * hop_ms, "rms": np.sqrt((frames**2).mean(axis=1)), "peak": np.abs(frames).max(axis=1, initial=0),
            "centroid_hz": power @ hz / power.sum(axis=1), "flatness": np.exp(np.log(power).mean(axis=1)) / power.mean(axis=1),
        })

    return _by_block(chunks, frame_ms, of_block, "frame long, start_ms long, rms double, peak double, centroid_hz double, flatness double", block_ms)


def drop_laps(chunks: DataFrame) -> DataFrame:
    """Chunks without the lead lap that the chunk before them holds too, so that a file's samples come once.

    ``chunks`` has file_id, chunk, start_ms, lap_start_ms, rate, samples; (file_id, chunk) tells chunks apart. A file's first chunk
    stays whole, and so does one that is not longer than its lap. Samples stay in chunk rows. Where a column ``first`` says
    which chunk is a file's first, as a plan knows, rows stream through; else the least start of each file is joined.
    """
    if "first" not in chunks.columns:
        head = chunks.groupBy(F.col("file_id").alias("_f")).agg(F.min(F.struct("start_ms", "chunk")).alias("_least"))
        own = chunks.join(head, chunks["file_id"].eqNullSafe(head["_f"]))
        return drop_laps(own.withColumn("first", F.struct("start_ms", "chunk") == F.col("_least")).drop("_f", "_least")).drop("first")
    lead = F.floor((F.col("start_ms") - F.col("lap_start_ms")) * F.col("rate") / 1000).cast("int")
    drop = F.when(F.col("first") | (lead >= F.size("samples")), 0).otherwise(lead)
    rows = chunks.withColumn("_drop", drop)
    return rows.withColumn("samples", F.slice("samples", F.col("_drop") + 1, F.size("samples"))).drop("_drop")


def loud_chunks(chunks: DataFrame, least_db: float = -60.0) -> DataFrame:
    """Chunks whose root mean square is at least ``least_db``; adds it as ``rms_db``. Chunks without samples go."""
    squares = F.aggregate("samples", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    level = 20.0 * F.log10(F.sqrt(squares / F.size("samples")) + 1e-10)
    return chunks.where(F.size("samples") > 0).withColumn("rms_db", level).where(F.col("rms_db") >= least_db)


def smooth_mask(frames: DataFrame, keys: Sequence[str], mask: str, order: str = "frame") -> DataFrame:
    """Median-smoothed flags: adds ``smooth_mask``.

    The width is a twentieth of the key's frames, 3 to 7, the next odd number up; keys of up to 7 frames stay as they
    are. Frames beyond the ends count as not set; keys of more than 1,000 frames are smoothed in blocks of 500.
    """
    place = F.row_number().over(ordered(keys, [order])) - 1
    rows = frames.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(*keys))).withColumn("_p", place)
    rows = rows.withColumn("_b", F.when(F.col("_n") > 1000, F.floor(F.col("_p") / 500)).otherwise(0))
    half = F.floor(F.least(F.lit(7), F.greatest(F.lit(3), F.floor(F.col("_n") / 20))) / 2)
    w = ordered([*keys, "_b"], ["_p"])
    flag = F.coalesce(F.col(mask), F.lit(False)).cast("int")
    near = [F.when(half >= abs(i), F.coalesce((F.lag(flag, -i) if i < 0 else F.lead(flag, i)).over(w), F.lit(0))).otherwise(0) for i in range(-3, 4) if i]
    smooth = sum(near, flag) > half
    return rows.withColumn("smooth_mask", F.when(F.col("_n") <= 7, flag == 1).otherwise(smooth)).drop("_n", "_p", "_b")


def health(frames: DataFrame, silent_db: float = -50.0) -> DataFrame:
    """Per file: level, noise floor, signal-to-noise ratio, dynamic range, silence ratio and clipping."""
    level = decibels(F.col("rms"))
    rows = frames.withColumn("db", level)
    per = rows.groupBy("file_id").agg(
        decibels(F.sqrt(F.avg(F.col("rms") * F.col("rms")))).alias("rms_db"), F.percentile("db", 0.05).alias("floor_db"), F.percentile("db", 0.95).alias("top_db"),
        F.avg((F.col("db") < silent_db).cast("double")).alias("silence_ratio"), F.max((F.col("peak") >= 0.999).cast("int")).alias("_clip"),
    )
    return per.select(
        "file_id", "rms_db", "floor_db", F.greatest(F.lit(-30.0), F.least(F.lit(60.0), F.col("rms_db") - F.col("floor_db"))).alias("snr_db"),
        (F.col("top_db") - F.col("floor_db")).alias("dynamic_range_db"), "silence_ratio", (F.col("_clip") == 1).alias("clipping_detected"),
    )


def combine_health(parts: DataFrame) -> DataFrame:
    """Health of chunks as that of their file: means, and clipping if any chunk clips."""
    means = [F.avg(c).alias(c) for c in ("rms_db", "floor_db", "snr_db", "dynamic_range_db", "silence_ratio")]
    return parts.groupBy("file_id").agg(*means, F.bool_or("clipping_detected").alias("clipping_detected"))


def pauses(frames: DataFrame, silent_db: float = -40.0, hop_ms: int = HOP_MS, least_ms: int = 200, long_ms: int = 600) -> DataFrame:
    """Per file: pauses of at least 200 ms, long ones, their time and share of all frames; single frames are smoothed away."""
    quiet = frames.withColumn("quiet", decibels(F.col("rms")) < silent_db)
    silent = smooth_mask(quiet, ["file_id"], "quiet").withColumnRenamed("smooth_mask", "silent")
    spans = runs(silent, ["file_id"], "frame", "silent").withColumn("ms", F.col("n_rows") * hop_ms)
    counted = F.col("silent") & (F.col("ms") >= least_ms)
    return spans.groupBy("file_id").agg(
        F.count(F.when(counted, 1)).alias("pause_count"), F.count(F.when(counted & (F.col("ms") >= long_ms), 1)).alias("long_pauses"),
        F.coalesce(F.sum(F.when(counted, F.col("ms"))), F.lit(0)).alias("pause_ms"), F.coalesce(F.sum(F.when(counted, F.col("ms"))) / F.sum("ms"), F.lit(0.0)).alias("pause_ratio"),
    )


def voiced_regions(frames: DataFrame, enter_db: float = -35.0, hop_ms: int = HOP_MS, least_ms: int = 100, pad_ms: int = 50, gap_ms: int = 200) -> DataFrame:
    """Speech regions of an energy gate: loud runs of some length, padded and merged over short gaps."""
    from .islands import merge_spans

    loud = frames.withColumn("loud", decibels(F.col("rms")) >= enter_db)
    spans = runs(loud, ["file_id"], "frame", "loud").where("loud").withColumn("ms", F.col("n_rows") * hop_ms).where(F.col("ms") >= least_ms)
    padded = spans.select("file_id", F.greatest(F.col("first") * hop_ms - pad_ms, F.lit(0)).alias("start_ms"), ((F.col("last") + 1) * hop_ms + pad_ms).alias("end_ms"))
    return merge_spans(padded, ["file_id"], gap_ms)


def smooth(frames: DataFrame, value: str, alpha: float) -> DataFrame:
    """Exponential smoothing of a file's frames in order: s = s + alpha (x - s), from the first value on; adds ``<value>_smooth``.

    A fold that holds one number, so the recursion is exact for files of any length; null values leave it as it is.
    """
    rows = frames.select("file_id", *[c for c in frames.columns if c != "file_id"])
    at = rows.columns.index(value)

    def step(state: float | None, row: tuple) -> tuple[float | None, list[tuple]]:
        x = row[at]
        state = state if x is None else x if state is None else state + alpha * (x - state)
        return state, [(*row, state)]

    schema = ", ".join(f"{c} {kind}" for c, kind in [*rows.dtypes, (f"{value}_smooth", "double")])
    return fold(rows, "file_id", ["frame"], step, lambda *_: [], schema)


def hann_smooth(frames: DataFrame, keys: Sequence[str], value: str, width: int, order: str = "frame") -> DataFrame:
    """Smoothing by a Hann window of an odd ``width``, end values repeated beyond the ends; adds ``<value>_hann``."""
    if width < 1 or width % 2 == 0:
        raise ValueError("width must be odd")
    weights = np.hanning(width) if width > 1 else np.ones(1)
    weights = weights / (weights.sum() + 1e-12)
    w, half = ordered(keys, [order]), width // 2
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = frames.withColumns({"_first": F.first(value).over(whole), "_last": F.last(value).over(whole)})
    taps = [F.coalesce(F.lag(value, -i).over(w), F.col("_first")) if i < 0 else F.coalesce(F.lead(value, i).over(w), F.col("_last")) if i else F.col(value) for i in range(-half, half + 1)]
    terms = [float(k) * x for k, x in zip(weights, taps) if k]
    return rows.withColumn(f"{value}_hann", sum(terms[1:], terms[0])).drop("_first", "_last")


def loudness(frames: DataFrame, window: int = 40, gate_db: float = 10.0) -> DataFrame:
    """Approximate loudness of a file: mean power of its windows that lie at most ``gate_db`` below the mean of all."""
    w = ordered(["file_id"], ["frame"]).rowsBetween(-(window - 1), 0)
    power = frames.select("file_id", F.avg(F.col("rms") * F.col("rms")).over(w).alias("p"))
    level = power.groupBy("file_id").agg(decibels(F.sqrt(F.avg("p"))).alias("mean_db"))
    loud = power.join(level, "file_id").where(decibels(F.sqrt("p")) >= F.col("mean_db") - gate_db)
    return loud.groupBy("file_id").agg(decibels(F.sqrt(F.avg("p"))).alias("loudness_db"))


def mel_energies(chunks: DataFrame, bands: int = 40, frame_ms: int = FRAME_MS, hop_ms: int = HOP_MS, block_ms: int = BLOCK_MS) -> DataFrame:
    """Log energies in mel bands of each frame: (file_id, frame, mel array<float>). Frames are those of ``frame_energies``."""

    def bank(rate: int, size: int) -> np.ndarray:
        mel = lambda hz: 2595 * np.log10(1 + hz / 700)
        edges = 700 * (10 ** (np.linspace(0, mel(rate / 2), bands + 2) / 2595) - 1)
        hz = np.fft.rfftfreq(size, 1 / rate)
        up, down = (hz - edges[:-2, None]) / np.diff(edges)[:-1, None], (edges[2:, None] - hz) / np.diff(edges)[1:, None]
        return np.maximum(0, np.minimum(up, down))

    def of_block(block: Block) -> pd.DataFrame:
        size, hop = _frame_length(block.row.rate, frame_ms, hop_ms)
        k, frames = block.frames(size, hop)
        power = np.abs(np.fft.rfft(frames * np.hanning(size), axis=1)) ** 2
        mel = np.log(power @ bank(block.row.rate, size).T + 1e-10).astype(np.float32)
        return pd.DataFrame({"file_id": block.row.file_id, "frame": k, "mel": list(mel)})

    return _by_block(chunks, frame_ms, of_block, "frame long, mel array<float>", block_ms)


def pitch_slope(pitches: DataFrame, hop_ms: int = HOP_MS) -> DataFrame:
    """Median step of a file's pitch between voiced neighbours, in hertz a second: (file_id, slope)."""
    w = ordered(["file_id"], ["frame"])
    voiced = pitches.where("hz is not null")
    step = (F.col("hz") - F.lag("hz").over(w)) * 1000 / ((F.col("frame") - F.lag("frame").over(w)) * hop_ms)
    return voiced.withColumn("step", step).groupBy("file_id").agg(F.median("step").alias("slope"))


def high_pass(chunks: DataFrame, cut_hz: float = 80.0) -> DataFrame:
    """Chunks without what lies below ``cut_hz``: zero phase, a second-order roll-off in the frequency domain."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for x, rate in zip(batch["samples"], batch["rate"]):
                if len(x) and rate:
                    hz = np.fft.rfftfreq(len(x), 1 / rate)
                    gain = hz**4 / (hz**4 + cut_hz**4)
                    x = np.fft.irfft(np.fft.rfft(np.asarray(x, float)) * gain, len(x)).astype(np.float32)
                out.append(x)
            yield batch.assign(samples=out)

    return chunks.mapInPandas(run, chunks.schema)


def level(chunks: DataFrame, loudness_by_file: DataFrame, target_db: float = -20.0, most_db: float = 12.0, limit: float = 0.95) -> DataFrame:
    """Chunks with their file's gain towards a loudness, at most ``most_db`` either way, limited in amplitude."""
    gain = F.greatest(F.lit(-most_db), F.least(F.lit(most_db), target_db - F.col("loudness_db")))
    rows = chunks.join(loudness_by_file, "file_id", "left").withColumn("_g", F.pow(F.lit(10.0), F.coalesce(gain, F.lit(0.0)) / 20))
    out = F.transform("samples", lambda x: F.greatest(F.lit(-limit), F.least(F.lit(limit), x * F.col("_g"))).cast("float"))
    return rows.withColumn("samples", out).select(*chunks.columns)


def resample(chunks: DataFrame, rate: int = 16_000) -> DataFrame:
    """Chunks at another rate, by linear interpolation."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for x, own in zip(batch["samples"], batch["rate"]):
                n = len(x) * rate // own if own else 0
                out.append(np.interp(np.arange(n) * own / rate, np.arange(len(x)), x).astype(np.float32) if n else np.zeros(0, np.float32))
            yield batch.assign(samples=out, rate=np.int32(rate))

    return chunks.mapInPandas(run, chunks.schema)


def quality_gate(samples: DataFrame, rate: int) -> DataFrame:
    """Whether voice figures of a piece of audio can be relied on: (key, snr_db, clipping, range_db, reliable, status).

    ``samples`` has key, pos (from 0) and x. Energies are those of frames of 50 ms, at most a twentieth of the piece, half
    overlapping; the noise floor is their 5th percentile, the level their 85th. Frames come from each sample's places, so
    no piece is gathered in one row.
    """
    size = samples.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("x") * F.col("x")).alias("power"), F.avg((F.abs("x") > 0.95).cast("double")).alias("clipping"))
    size = size.withColumn("frame", F.least(F.lit(rate // 20), F.floor(F.col("n") / 20)).cast("long")).withColumn("hop", F.greatest(F.floor(F.col("frame") / 2), F.lit(1)).cast("long"))
    placed = samples.join(size.where("frame >= 64").select("key", "n", "frame", "hop"), "key")
    first = F.greatest(F.floor((F.col("pos") - F.col("frame")) / F.col("hop")) + 1, F.lit(0))
    frames = placed.select("key", "x", "n", "frame", "hop", F.explode(F.sequence(first, F.floor(F.col("pos") / F.col("hop")))).alias("k")).where("k * hop < n - frame")
    energy = frames.groupBy("key", "k").agg(F.avg(F.col("x") * F.col("x")).alias("e"))
    part = lambda p: F.percentile("e", F.lit(p))
    level = energy.groupBy("key").agg(F.count(F.lit(1)).alias("frames"), part(0.05).alias("floor"), part(0.85).alias("level"), F.max("e").alias("top"))
    rows = size.join(level, "key", "left")
    over = lambda c: 10 * F.log10((F.col(c) + 1e-12) / (F.col("floor") + 1e-12))
    early = [(F.col("n") < 0.1 * rate, -40.0, "too_short"), (F.sqrt("power") < 1e-8, -60.0, "silent"), (F.col("frame") < 64, -30.0, "insufficient_length"), (F.coalesce("frames", F.lit(0)) < 5, -30.0, "insufficient_frames")]
    snr, status = F.when(F.col("floor") <= 0, 10.0).otherwise(over("level")), None
    fine = (F.col("n") >= 0.2 * rate) & (snr >= 6.0) & (F.col("clipping") < 0.03) & (over("top") >= 12.0)
    status = F.when(fine, "reliable").when(snr < 6.0, "low_snr").when(F.col("clipping") >= 0.03, "clipping").when(over("top") < 12.0, "low_dr").otherwise("short_duration")
    usable = F.lit(True)
    for test, value, word in reversed(early):
        snr, status, usable = F.when(test, value).otherwise(snr), F.when(test, word).otherwise(status), F.when(test, False).otherwise(usable)
    return rows.select("key", snr.alias("snr_db"), "clipping", over("top").alias("range_db"), (usable & F.coalesce(fine, F.lit(False))).alias("reliable"), status.alias("status"))
