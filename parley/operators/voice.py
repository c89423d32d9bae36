"""Voice figures of frames: pitch by difference functions, period marks, harmonicity and cepstral peaks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import BLOCK_MS, blocks, laid, samples_of

#: Range of pitch, step between frames, dip of the difference function that ends the search, and from which a frame is unvoiced.
LOW_HZ, HIGH_HZ, HOP_MS, DIP, UNVOICED = 60.0, 400.0, 10, 0.1, 0.45
#: Edges of the band whose slope tells breathiness.
SLOPE_HZ = (1_000.0, 4_000.0)


def lags(rate: int, low_hz: float, high_hz: float) -> tuple[int, int]:
    """Shortest and longest period in samples."""
    return max(2, int(rate / high_hz)), max(3, int(np.ceil(rate / low_hz)))


def normal_difference(frames: np.ndarray, width: int, most: int) -> np.ndarray:
    """Cumulative mean normalised difference of each frame for the lags 0 to ``most``: the squared difference of the first
    ``width`` samples and those a lag later, over its mean at all lags up to it; 1 at lag 0 and in silence."""
    n = frames.shape[1]
    long = 1 << int(np.ceil(np.log2(n + width)))
    own = np.fft.rfft(frames[:, :width], long, axis=1)
    product = np.fft.irfft(np.conj(own) * np.fft.rfft(frames, long, axis=1), long, axis=1)[:, : most + 1]
    sums = np.concatenate([np.zeros((len(frames), 1)), np.cumsum(frames**2, axis=1)], axis=1)
    energy = sums[:, width : width + most + 1] - sums[:, : most + 1]
    d = np.maximum(energy[:, :1] + energy - 2 * product, 0)
    # Differences below the rounding of the transform are none.
    d[d < 1e-12 * np.maximum(energy[:, :1], 1e-300)] = 0
    mean = np.cumsum(d[:, 1:], axis=1) / np.arange(1, most + 1)
    out = np.ones_like(d)
    np.divide(d[:, 1:], mean, out=out[:, 1:], where=mean > 1e-12 * np.maximum(energy[:, :1], 1e-300))
    return out


def parabola(left: np.ndarray, middle: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Place of the extreme of the parabola through three neighbours, from the middle one, at most half a step away."""
    bend = left - 2 * middle + right
    shift = np.divide(left - right, 2 * bend, out=np.zeros_like(middle), where=np.abs(bend) > 1e-15)
    return np.clip(shift, -0.5, 0.5)


def periods(frames: np.ndarray, rate: int, low_hz: float = LOW_HZ, high_hz: float = HIGH_HZ, dip: float = DIP) -> tuple[np.ndarray, np.ndarray]:
    """Period of each frame in samples and how aperiodic it is (0 to about 1).

    The period is the first dip below ``dip`` of the normalised difference, followed down to its bottom; without one, the
    lowest of all. A first dip instead of the lowest keeps the pitch from falling by an octave, and the difference instead
    of a product keeps it from rising where the fundamental is weak. The bottom is refined by a parabola.
    """
    least, most = lags(rate, low_hz, high_hz)
    f = normal_difference(frames, most, most + 1)
    inner = f[:, least : most + 1]
    bottom = (inner <= f[:, least - 1 : most]) & (inner < f[:, least + 1 : most + 2])
    good = bottom & (inner < dip)
    best = np.where(good.any(axis=1), good.argmax(axis=1), inner.argmin(axis=1)) + least
    row = np.arange(len(f))
    shift = parabola(f[row, best - 1], f[row, best], f[row, np.minimum(best + 1, most + 1)])
    return best + shift, f[row, best]


def _peak(x: np.ndarray, low: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place and height of the highest sample of each row within ``width`` samples from ``low`` on, refined by a parabola."""
    span = np.arange(int(width.max(initial=1)))
    at = np.clip(low[:, None] + span, 1, x.shape[1] - 2)
    seen = np.where(span < width[:, None], np.take_along_axis(x, at, axis=1), -np.inf)
    row, place = np.arange(len(x)), np.take_along_axis(at, seen.argmax(axis=1)[:, None], axis=1)[:, 0]
    left, middle, right = x[row, place - 1], x[row, place], x[row, place + 1]
    shift = parabola(left, middle, right)
    return place + shift, middle - 0.25 * (left - right) * shift


def marks(wide: np.ndarray, middle: int, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and heights of three neighbouring period marks around the middle of each row: (rows x 3) each.

    The first is the highest sample of a period around the middle, the others the highest ones 0.8 to 1.2 periods on.
    """
    whole = np.maximum(np.rint(period), 2).astype(int)
    place, height = _peak(wide, middle - whole - whole // 2, whole)
    places, heights = [place], [height]
    for _ in range(2):
        place, height = _peak(wide, np.rint(places[-1] + 0.8 * period).astype(int), np.maximum(np.rint(0.4 * period), 1).astype(int) + 1)
        places.append(place)
        heights.append(height)
    return np.stack(places, axis=1), np.stack(heights, axis=1)


def harmonicity(frames: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Harmonics-to-noise ratio in decibels, from the correlation of the frame with itself a period later, -20 to 40."""
    n = frames.shape[1] // 2 - 1
    whole, a, best = np.clip(np.rint(period).astype(int), 1, n + 1), frames[:, :n], np.zeros(len(frames))
    for step in (-1, 0, 1):
        b = np.take_along_axis(frames, (whole + step)[:, None] + np.arange(n), axis=1)
        best = np.maximum(best, (a * b).sum(axis=1) / np.sqrt((a**2).sum(axis=1) * (b**2).sum(axis=1) + 1e-300))
    r = np.clip(best, 1e-9, 1 - 1e-9)
    return np.clip(10 * np.log10(r / (1 - r)), -20, 40)


def cepstral_peak(frames: np.ndarray, rate: int, low_hz: float = LOW_HZ, high_hz: float = HIGH_HZ) -> np.ndarray:
    """Cepstral peak prominence in decibels: the highest cepstral value among possible periods, above the regression line
    over all places from a millisecond on."""
    n = frames.shape[1]
    power = np.abs(np.fft.rfft(frames * np.hanning(n), axis=1)) ** 2
    cepstrum = 20 * np.log10(np.abs(np.fft.irfft(10 * np.log10(power + 1e-12), axis=1)) + 1e-12)
    first, (least, most) = max(1, rate // 1000), lags(rate, low_hz, high_hz)
    q = np.arange(first, n // 2)
    if len(q) < 2 or most >= n // 2:
        return np.zeros(len(frames))
    y = cepstrum[:, q]
    slope = (y - y.mean(axis=1, keepdims=True)) @ (q - q.mean()) / ((q - q.mean()) ** 2).sum()
    peak = cepstrum[:, least : most + 1].argmax(axis=1) + least
    line = y.mean(axis=1) + slope * (peak - q.mean())
    return cepstrum[np.arange(len(frames)), peak] - line


def voice_frames(chunks: DataFrame, low_hz: float = LOW_HZ, high_hz: float = HIGH_HZ, hop_ms: int = HOP_MS, unvoiced: float = UNVOICED, block_ms: int = BLOCK_MS) -> DataFrame:
    """Figures of frames: (file_id, frame, start_ms, db, centroid_hz, flatness, hz, aperiodicity, jitter, shimmer_db, hnr_db, cpp_db,
    low_mag, high_mag).

    Frame k has its middle k * ``hop_ms`` after the file's start and two longest periods and a bit of samples; files see silence
    around them. ``hz`` is null where nothing repeats (aperiodicity from ``unvoiced`` on, or silence), and jitter, shimmer
    and harmonicity with it. Jitter is the difference of two neighbouring periods between marks over their mean, shimmer
    the difference of the marks' levels. ``low_mag`` and ``high_mag`` are magnitudes at the edges of ``SLOPE_HZ``.
    Blocks hold enough on both sides that results do not depend on how a file was cut.
    """
    widest = 1000 / low_hz  # longest period in milliseconds
    halo_ms = 5 * widest + hop_ms + 5
    held = blocks(chunks, samples_of(halo_ms), samples_of(halo_ms), block_ms)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in laid(batches, lambda rate: int(np.ceil(rate * halo_ms / 1000))):
            rate = block.row.rate
            _, most = lags(rate, low_hz, high_hz)
            size, hop, wide = 2 * (most + 2), max(1, rate * hop_ms // 1000), 8 * (most + 2)
            k, frames = block.frames(size, hop, centred=True)
            if not len(k):
                continue
            _, around = block.frames(wide, hop, centred=True)
            period, rough = periods(frames, rate, low_hz, high_hz)
            loud = np.abs(frames).max(axis=1) > 1e-6
            voiced = loud & (rough < unvoiced)
            places, heights = marks(around, wide // 2, period)
            gap = np.diff(places, axis=1)
            jitter = np.abs(gap[:, 1] - gap[:, 0]) / np.maximum(gap.mean(axis=1), 1e-9)
            level = 20 * np.log10(np.maximum(heights, 1e-12))
            shimmer = np.abs(np.diff(level, axis=1)).mean(axis=1)
            spectrum, hz = np.abs(np.fft.rfft(frames * np.hanning(size), axis=1)), np.fft.rfftfreq(size, 1 / rate)
            power = spectrum**2 + 1e-12
            edges = [int(np.abs(hz - min(h, rate / 2)).argmin()) for h in SLOPE_HZ]
            out = pd.DataFrame({
                "file_id": block.row.file_id, "frame": k, "start_ms": k * hop_ms, "db": 10 * np.log10((frames**2).mean(axis=1) + 1e-12),
                "centroid_hz": power @ hz / power.sum(axis=1), "flatness": np.exp(np.log(power).mean(axis=1)) / power.mean(axis=1), "hz": rate / period, "aperiodicity": rough, "jitter": jitter, "shimmer_db": shimmer,
                "hnr_db": harmonicity(frames, period), "cpp_db": cepstral_peak(around[:, wide // 4 : -(wide // 4)], rate, low_hz, high_hz), "low_mag": spectrum[:, edges[0]], "high_mag": spectrum[:, edges[1]],
            })
            out.loc[~voiced, ["hz", "jitter", "shimmer_db", "hnr_db"]] = np.nan
            yield out

    names = ("db", "centroid_hz", "flatness", "hz", "aperiodicity", "jitter", "shimmer_db", "hnr_db", "cpp_db", "low_mag", "high_mag")
    found = held.mapInPandas(run, f"file_id {dict(chunks.dtypes)['file_id']}, frame long, start_ms long, " + ", ".join(f"{n} double" for n in names))
    return found.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in ("hz", "jitter", "shimmer_db", "hnr_db")})


def pitch(chunks: DataFrame, low_hz: float = LOW_HZ, high_hz: float = HIGH_HZ, hop_ms: int = HOP_MS) -> DataFrame:
    """Pitch of each frame: (file_id, frame, hz), null where nothing repeats."""
    return voice_frames(chunks, low_hz, high_hz, hop_ms).select("file_id", "frame", "hz")
