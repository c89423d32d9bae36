"""Spectral subtraction: the noise spectrum of a stretch of sound as an aggregate, a soft mask, and overlap-add over halos."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import broadcast_if_small, materialise
from .blocks import BLOCK_MS, Block, blocks, laid

#: Files from an hour on are cleaned in stretches of 20 minutes, each with a noise spectrum of its own.
LONG_MS, STRETCH_MS = 3_600_000, 1_200_000
FRAME_MS, HOP_MS, LEAST_SIZE = 20, 10, 256
KEY = ["file_id", "stretch"]


@dataclass(frozen=True)
class Subtraction:
    """How much noise goes: over-subtraction in decibels, the floor as a share of the noise, the mask's exponent and the
    frames over which it is smoothed; quiet frames lie at most ``gate_db`` over the ``quiet`` quantile of levels. Where more
    than ``most_floor`` of the bins meet the floor, a milder subtraction is taken."""

    over_db: float = 3.0
    floor: float = 0.06
    exponent: float = 1.0
    smooth: int = 3
    quiet: float = 0.20
    gate_db: float = 12.0
    least_frames: int = 30
    most_floor: float = 0.12

    def strength(self, mild: bool) -> tuple[float, float]:
        """Factors of the noise that are subtracted and left."""
        over = 10 ** (self.over_db / 20)
        return (0.75 * over, min(0.08, 1.25 * self.floor)) if mild else (over, self.floor)


def sizes(rate: int, frame_ms: int = FRAME_MS, hop_ms: int = HOP_MS) -> tuple[int, int]:
    """Samples of a frame, a power of two, and of a step."""
    size = LEAST_SIZE
    while size < round(rate * frame_ms / 1000):
        size *= 2
    return size, max(1, min(round(rate * hop_ms / 1000), size // 2))


def halo(rate, frames: int = 4):
    """Samples on both sides that hold a frame and some steps, for a number or the column ``rate``; at least what is needed."""
    if isinstance(rate, Column):
        return F.greatest(F.lit(LEAST_SIZE), F.ceil(2 * rate * FRAME_MS / 1000)).cast("long") + frames * (F.ceil(rate * HOP_MS / 1000).cast("long") + 1)
    return max(LEAST_SIZE, -(-2 * rate * FRAME_MS // 1000)) + frames * (-(-rate * HOP_MS // 1000) + 1)


def window(size: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)


def spectra(block: Block, more: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and spectra of the block's centred frames."""
    size, hop = sizes(block.row.rate)
    k, frames = block.frames(size, hop, centred=True, more=more)
    return k, np.fft.rfft(frames * window(size), axis=1)


def levels(magnitudes: np.ndarray) -> np.ndarray:
    """Level of each frame in decibels."""
    return 20 * np.log10(np.sqrt((magnitudes**2).mean(axis=1) + 1e-12) + 1e-12)


def stretches(chunks: DataFrame, block_ms: int = BLOCK_MS, frames: int = 4) -> DataFrame:
    """Blocks with a halo and the stretch of their file that they belong to; blocks are written to the shared folder."""
    if STRETCH_MS % block_ms:
        raise ValueError("blocks must divide stretches")
    held = blocks(chunks, halo(F.col("rate"), frames), halo(F.col("rate"), frames), block_ms)
    held = materialise(held, "blocks")
    end = F.element_at("starts", -1) + F.element_at("lengths", -1)
    length = held.groupBy(F.col("file_id").alias("_f")).agg(
        (F.max(end * 1000 / F.col("rate")) >= LONG_MS).alias("_long"), F.max(F.when(end > F.col("block") * F.col("size"), F.col("block"))).alias("_last")
    )
    rows = held.join(broadcast_if_small(materialise(length, "lengths")), held["file_id"].eqNullSafe(F.col("_f")))
    # What lies behind the last sample, half a frame at most, goes with it.
    own = F.floor(F.least("block", "_last") * block_ms / STRETCH_MS)
    return rows.withColumn("stretch", F.when(F.col("_long"), own).otherwise(0)).drop("_f", "_long", "_last")


def _with(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """``rows`` with the facts of their stretch, by broadcast if those are small; else hot files are split at run time."""
    own = facts.toDF(*[f"_{c}" if c in KEY else c for c in facts.columns])
    return rows.join(broadcast_if_small(own), rows["file_id"].eqNullSafe(own["_file_id"]) & (rows["stretch"] == own["_stretch"])).drop("_file_id", "_stretch")


def _mapped(rows: DataFrame, of_block, schema: str, frames: int = 4) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in laid(batches, lambda rate: halo(rate, frames)):
            found = of_block(block)
            if found is not None and len(found):
                yield found

    return rows.mapInPandas(run, f"file_id {dict(rows.dtypes)['file_id']}, {schema}")


def _quantile(values: Column, q: Column) -> Column:
    """Quantile of an array by linear interpolation."""
    place = q * (F.size(values) - 1)
    low = F.floor(place).cast("int")
    a, b = F.get(values, low), F.get(values, F.least(low + 1, F.size(values) - 1))
    return a + (place - low) * (b - a)


def noise_spectra(held: DataFrame, how: Subtraction = Subtraction()) -> DataFrame:
    """Noise of each stretch: (file_id, stretch, noise array<double>), a magnitude for each frequency.

    Where a stretch has ``least_frames`` quiet frames or more, their median, else the 10th percentile of all frames. Blocks
    send one array for each frequency, so a group has one number for each frame of a stretch.
    """
    level = _mapped(held, lambda b: _levels(b), "stretch long, frame long, db double")
    level = materialise(level, "levels")
    gate = level.groupBy(*KEY).agg((F.percentile("db", how.quiet) + how.gate_db).alias("gate"))
    quiet = _with(level, materialise(gate, "gates")).groupBy(*KEY, "gate").agg(F.count(F.when(F.col("db") <= F.col("gate"), 1)).alias("quiet"))
    facts = materialise(quiet.withColumn("trusted", F.col("quiet") >= max(how.least_frames, 5)), "quiet")

    def magnitudes(block: Block) -> pd.DataFrame:
        _, s = spectra(block)
        mag = np.abs(s)
        if block.row.trusted:
            mag = mag[levels(mag) <= block.row.gate]
        if not len(mag):
            return None
        return pd.DataFrame({"file_id": block.row.file_id, "stretch": block.row.stretch, "bin": np.arange(mag.shape[1]), "trusted": block.row.trusted, "mags": list(mag.T)})

    each = _mapped(_with(held, facts), magnitudes, "stretch long, bin int, trusted boolean, mags array<double>")
    whole = each.groupBy(*KEY, "bin", "trusted").agg(F.sort_array(F.flatten(F.collect_list("mags"))).alias("m"))
    one = whole.select(*KEY, "bin", _quantile(F.col("m"), F.when(F.col("trusted"), 0.5).otherwise(0.1)).alias("v"))
    return one.groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", "v"))), lambda e: e["v"]).alias("noise"))


def _levels(block: Block) -> pd.DataFrame:
    k, s = spectra(block)
    return pd.DataFrame({"file_id": block.row.file_id, "stretch": block.row.stretch, "frame": k, "db": levels(np.abs(s))})


def masks(mag: np.ndarray, noise: np.ndarray, how: Subtraction, mild: bool, smooth: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Mask of each frame and frequency (0 to 1), and whether it lies at the floor. Smoothing is a median over neighbouring
    frames; beyond the ends frames repeat in reverse."""
    over, floor = how.strength(mild)
    left = mag - over * noise
    clean = np.maximum(left, floor * noise)
    mask = (clean / (clean + over * noise + 1e-12)) ** how.exponent
    if smooth and how.smooth > 1 and len(mask):
        half = how.smooth // 2
        wide = np.pad(mask, ((half, half), (0, 0)), mode="symmetric")
        mask = np.median(np.lib.stride_tricks.sliding_window_view(wide, how.smooth, axis=0), axis=-1)
    return mask, left <= floor * noise


def subtraction_plan(held: DataFrame, how: Subtraction = Subtraction()) -> DataFrame:
    """Noise and strength for each stretch: (file_id, stretch, noise, mild, floor_ratio); the ratio is that of bins at the
    floor, under the milder subtraction where the first one passes ``most_floor``."""
    noise = materialise(noise_spectra(held, how), "noise")

    def hits(block: Block) -> pd.DataFrame:
        mag = np.abs(spectra(block)[1])
        at = [int(masks(mag, np.asarray(block.row.noise), how, mild, smooth=False)[1].sum()) for mild in (False, True)]
        return pd.DataFrame({"file_id": [block.row.file_id], "stretch": block.row.stretch, "firm": at[0], "mild": at[1], "bins": mag.size})

    sums = _mapped(_with(held, noise), hits, "stretch long, firm long, mild long, bins long").groupBy(*KEY).agg(*[F.sum(c).alias(c) for c in ("firm", "mild", "bins")])
    mild = F.col("firm") / F.col("bins") > how.most_floor
    facts = sums.select(*KEY, mild.alias("is_mild"), (F.when(mild, F.col("mild")).otherwise(F.col("firm")) / F.col("bins")).alias("floor_ratio"))
    own = facts.toDF("_f", "_s", "mild", "floor_ratio")
    return materialise(noise.join(own, noise["file_id"].eqNullSafe(own["_f"]) & (noise["stretch"] == own["_s"])).drop("_f", "_s"), "subtraction")


def _own_masks(block: Block, how: Subtraction, more: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers, spectra and masks of the block's frames and those ``more`` samples around, smoothed over true neighbours."""
    size, hop = sizes(block.row.rate)
    k, s = spectra(block, more + how.smooth // 2 * hop)
    mask, _ = masks(np.abs(s), np.asarray(block.row.noise), how, block.row.mild)
    size, hop = sizes(block.row.rate)
    own = (k * hop >= block.low - more) & (k * hop < block.high + more)
    return k[own], s[own], mask[own]


def subtracted(held: DataFrame, plan: DataFrame, how: Subtraction = Subtraction(), block_ms: int = BLOCK_MS) -> DataFrame:
    """Chunk rows without the noise: (file_id, chunk, start_ms, rate, samples), one for each block."""

    def clean(block: Block) -> pd.DataFrame:
        size, hop = sizes(block.row.rate)
        high = min(block.high, block.end)
        if high <= block.low:
            return None
        k, s, mask = _own_masks(block, how, size // 2)
        parts, w = np.fft.irfft(mask * s, size, axis=1) * window(size), window(size) ** 2
        first = int(k[0]) * hop - size // 2
        y, weight = np.zeros((len(k) - 1) * hop + size), np.zeros((len(k) - 1) * hop + size)
        for i, part in enumerate(parts):
            y[i * hop : i * hop + size] += part
            weight[i * hop : i * hop + size] += w
        y = np.divide(y, weight, out=np.zeros_like(y), where=weight > 1e-10)
        own = np.zeros(high - block.low)
        a, b = max(block.low, first), min(high, first + len(y))
        own[a - block.low : b - block.low] = y[a - first : b - first]
        return pd.DataFrame({"file_id": [block.row.file_id], "chunk": block.row.block, "start_ms": block.row.block * block_ms, "rate": block.row.rate, "samples": [own.astype(np.float32)]})

    return _mapped(_with(held, plan), clean, "chunk long, start_ms long, rate int, samples array<float>")


def denoise(chunks: DataFrame, how: Subtraction = Subtraction(), block_ms: int = BLOCK_MS) -> tuple[DataFrame, DataFrame]:
    """Sound without its steady noise, as chunk rows, and (file_id, stretch, mild, floor_ratio) of each stretch.

    ``chunks`` has file_id, start_ms, rate, samples. The result depends neither on chunks nor, within a stretch, on blocks:
    each block has the frames around its own part. Files without samples have no rows; null file ids are a file.
    """
    held = stretches(chunks, block_ms)
    plan = subtraction_plan(held, how)
    return subtracted(held, plan, how, block_ms), plan.drop("noise")


def residuals(chunks: DataFrame, how: Subtraction = Subtraction(), block_ms: int = BLOCK_MS) -> DataFrame:
    """Energies of each stretch's spectra before and after: (file_id, stretch, frames, energy, residual, floor_ratio, mild)."""
    held = stretches(chunks, block_ms)
    plan = subtraction_plan(held, how)

    def sums(block: Block) -> pd.DataFrame:
        k, s, mask = _own_masks(block, how, 0)
        if not len(k):  # the block holds the end of a halo alone
            return None
        mag = np.abs(s)
        return pd.DataFrame({"file_id": [block.row.file_id], "stretch": block.row.stretch, "frames": len(k), "energy": (mag**2).sum(), "residual": ((mask * mag) ** 2).sum()})

    per = _mapped(_with(held, plan), sums, "stretch long, frames long, energy double, residual double").groupBy(*KEY).agg(F.sum("frames").alias("frames"), F.sum("energy").alias("energy"), F.sum("residual").alias("residual"))
    return _with(per, plan.drop("noise"))
