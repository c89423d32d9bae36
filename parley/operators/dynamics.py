"""Gain of sound: gated gain and soft-knee compression by frame, interpolated to samples, and loudness with a limiter."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import broadcast_if_small, materialise
from .blocks import BLOCK_MS, Block, blocks, laid, samples_of
from .denoise import HOP_MS, halo, levels, sizes, window

#: Window and step of loudness, and how far below the mean a window may lie.
LOUD_MS, LOUD_HOP_MS, LOUD_GATE_DB = 400, 100, 10.0


@dataclass(frozen=True)
class Gains:
    """Levels between ``gate_db`` and ``target_db`` are raised to the latter by at most ``most_db``, smoothed over
    ``smooth_ms``; above ``threshold_db`` the level rises by 1/``ratio`` only, with a soft knee."""

    gate_db: float = -45.0
    target_db: float = -23.0
    most_db: float = 18.0
    smooth_ms: int = 250
    threshold_db: float = -26.0
    ratio: float = 2.0
    knee_db: float = 6.0

    @property
    def width(self) -> int:
        """Frames of the smoothing window, an odd number."""
        return max(1, round(self.smooth_ms / HOP_MS)) // 2 * 2 + 1

    def raised(self, db: np.ndarray) -> np.ndarray:
        return np.where((db > self.gate_db) & (db < self.target_db), np.minimum(self.target_db - db, self.most_db), 0.0)

    def compressed(self, db: np.ndarray) -> np.ndarray:
        over = db - self.threshold_db
        knee = np.clip((over + self.knee_db / 2) / self.knee_db, 0, 1) if self.knee_db > 0 else (over > 0).astype(float)
        return over * (1 / self.ratio - 1) * knee


def _frame_levels(x: np.ndarray, first: int, k: np.ndarray, size: int, hop: int) -> np.ndarray:
    """Levels of centred frames of ``x``, which begins at sample ``first``; silence around it."""
    if not len(k):
        return np.zeros(0)
    start, n = int(k[0]) * hop - size // 2, (len(k) - 1) * hop + size
    held = np.zeros(n)
    a, b = max(start, first), min(start + n, first + len(x))
    if b > a:
        held[a - start : b - start] = x[a - first : b - first]
    return levels(np.abs(np.fft.rfft(np.lib.stride_tricks.sliding_window_view(held, size)[::hop] * window(size), axis=1)))


def _around(block: Block, samples: int, hop: int) -> np.ndarray:
    """Frames whose middles lie at most ``samples`` outside of the block's own part, and within the file."""
    low, high = max(0, block.low - samples), min(block.high + samples, block.end) if block.ended else block.high + samples
    return np.arange(-(-low // hop), high // hop + 1)


def _raise_curve(block: Block, how: Gains, samples: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Frames up to ``samples`` around the block with their levels, gains and smoothed gains; end values are repeated."""
    size, hop = sizes(block.row.rate)
    half = how.width // 2
    k = _around(block, samples, hop)
    wide = _around(block, samples + half * hop, hop)
    db = _frame_levels(block.x, block.first, wide, size, hop)
    gain = how.raised(db)
    padded = np.pad(gain, (max(0, half - int(k[0] - wide[0])), max(0, half - int(wide[-1] - k[-1]))), mode="edge")
    weights = np.hanning(how.width) if how.width > 1 else np.ones(1)
    smooth = np.convolve(padded, weights / (weights.sum() + 1e-12), mode="valid")
    own = slice(int(k[0] - wide[0]), int(k[0] - wide[0]) + len(k))
    return k, db[own], gain[own], smooth


def _frames_of_halo(how: Gains) -> int:
    return how.width + 8


def _held(chunks: DataFrame, how: Gains, block_ms: int) -> DataFrame:
    wide = 2 * halo(F.col("rate"), _frames_of_halo(how))
    return blocks(chunks, wide, wide, block_ms)


def _mapped(chunks: DataFrame, how: Gains, block_ms: int, of_block, schema: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in laid(batches, lambda rate: 2 * halo(rate, _frames_of_halo(how))):
            found = of_block(block)
            if found is not None and len(found):
                yield found

    return _held(chunks, how, block_ms).mapInPandas(run, f"file_id {dict(chunks.dtypes)['file_id']}, {schema}")


def gain_curve(chunks: DataFrame, how: Gains = Gains(), block_ms: int = BLOCK_MS) -> DataFrame:
    """Gated gain of each frame: (file_id, frame, level_db, gain_db, smooth_db). Frame k has its middle at the k-th step."""

    def of_block(block: Block) -> pd.DataFrame:
        _, hop = sizes(block.row.rate)
        if block.end < block.low:
            return None
        k, db, gain, smooth = _raise_curve(block, how, hop)
        own = (k * hop >= block.low) & (k * hop < block.high)
        return pd.DataFrame({"file_id": block.row.file_id, "frame": k[own], "level_db": db[own], "gain_db": gain[own], "smooth_db": smooth[own]})

    return _mapped(chunks, how, block_ms, of_block, "frame long, level_db double, gain_db double, smooth_db double")


def shape(chunks: DataFrame, how: Gains = Gains(), block_ms: int = BLOCK_MS) -> DataFrame:
    """Chunk rows after gated gain and compression: (file_id, chunk, start_ms, rate, samples), one for each block.

    Both gains belong to frames; between their middles they are interpolated, beyond the last one they stay. Levels of the
    compression are those after the gated gain. A block holds enough around its own part to come to the same samples
    however a file was cut. Files without samples have no rows; null file ids are a file.
    """

    def of_block(block: Block) -> pd.DataFrame:
        size, hop = sizes(block.row.rate)
        high = min(block.high, block.end)
        if high <= block.low:
            return None
        reach = size // 2 + 2 * hop  # samples that the levels of the compression look at beyond the own part
        a, b = max(0, block.low - reach), min(block.end, high + reach)
        k, _, _, smooth = _raise_curve(block, how, reach + hop)
        raised = block.x[a - block.first : b - block.first] * np.interp(np.arange(a, b), k * hop, 10 ** (smooth / 20))
        near = _around(block, hop, hop)
        gain = 10 ** (how.compressed(_frame_levels(raised, a, near, size, hop)) / 20)
        own = np.arange(block.low, high)
        y = raised[block.low - a : high - a] * np.interp(own, near * hop, gain)
        return pd.DataFrame({"file_id": [block.row.file_id], "chunk": block.row.block, "start_ms": block.row.block * block_ms, "rate": block.row.rate, "samples": [y.astype(np.float32)]})

    return _mapped(chunks, how, block_ms, of_block, "chunk long, start_ms long, rate int, samples array<float>")


def file_loudness(chunks: DataFrame, block_ms: int = BLOCK_MS) -> DataFrame:
    """Loudness and peak of each file: (file_id, loudness_db, peak).

    The mean level of windows of 400 ms that lie above the mean of all windows less 10 dB; files that are shorter have the
    level of all samples.
    """
    held = blocks(chunks, F.lit(0), samples_of(LOUD_MS), block_ms)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in laid(batches, lambda rate: -(-rate * LOUD_MS // 1000)):
            size, hop = int(LOUD_MS * block.row.rate / 1000), max(1, int(LOUD_HOP_MS * block.row.rate / 1000))
            _, frames = block.frames(max(size, 1), hop)
            db = 20 * np.log10(np.sqrt((frames**2).mean(axis=1) + 1e-12) + 1e-12)
            own = block.x[max(0, block.low - block.first) : max(0, min(block.high, block.end) - block.first)]
            yield pd.DataFrame({"file_id": [block.row.file_id], "db": [db], "squares": (own**2).sum(), "n": len(own), "peak": np.abs(own).max(initial=0)})

    parts = materialise(held.mapInPandas(run, f"file_id {dict(chunks.dtypes)['file_id']}, db array<double>, squares double, n long, peak double"), "loudness")
    each = parts.select("file_id", F.explode("db").alias("db"))
    mean = parts.groupBy("file_id").agg(
        F.max("peak").alias("peak"), (F.sum("squares") / F.sum("n")).alias("power"), (F.sum(F.aggregate("db", F.lit(0.0), lambda s, x: s + x)) / F.nullif(F.sum(F.size("db")), F.lit(0))).alias("mean")
    ).withColumnRenamed("file_id", "_f")
    loud = each.join(broadcast_if_small(materialise(mean.select("_f", "mean"), "means")), F.col("file_id").eqNullSafe(F.col("_f")))
    gated = loud.where(F.col("db") > F.col("mean") - LOUD_GATE_DB).groupBy("file_id").agg(F.avg("db").alias("gated"))
    whole = 20 * F.log10(F.sqrt(F.col("power") + 1e-12))
    return mean.join(gated, F.col("_f").eqNullSafe(F.col("file_id")), "left").select(F.col("_f").alias("file_id"), F.coalesce("gated", "mean", whole).alias("loudness_db"), "peak")


def normalise(chunks: DataFrame, target_db: float = -20.0, most_db: float = 12.0, limit: float = 0.95) -> DataFrame:
    """Chunks brought to a loudness by one gain a file, at most ``most_db`` either way, and scaled down as a whole where the
    peak would pass ``limit``."""
    facts = materialise(file_loudness(chunks), "file-loudness")
    gain = F.pow(F.lit(10.0), F.greatest(F.lit(-most_db), F.least(F.lit(most_db), target_db - F.col("loudness_db"))) / 20)
    safe = F.when(F.col("peak") * gain > limit, limit / F.col("peak")).otherwise(gain)
    own = broadcast_if_small(facts.select(F.col("file_id").alias("_f"), safe.alias("_g")))
    rows = chunks.join(own, chunks["file_id"].eqNullSafe(own["_f"]), "left")
    return rows.withColumn("samples", F.transform("samples", lambda x: (x * F.coalesce(F.col("_g"), F.lit(1.0))).cast("float"))).select(*chunks.columns)
