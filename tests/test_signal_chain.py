"""Noise subtraction and gains in blocks, held against plain versions that see the whole file at once."""

from __future__ import annotations

import numpy as np
import pytest

from parley.operators import audio
from parley.operators import denoise as D
from parley.operators import dynamics as G

from .test_sound import CHUNK, cut

RATE = 2_000


def sound(seconds: float, noise: float = 0.02, seed: int = 1) -> np.ndarray:
    t = np.arange(int(RATE * seconds)) / RATE
    x = 0.4 * np.sin(2 * np.pi * 180 * t) * ((t % 2.3) < 1.1) * (0.2 + (t % 5) / 5)
    return (x + np.random.default_rng(seed).normal(0, noise, len(t))).astype(np.float32)


def plain_spectra(x: np.ndarray) -> np.ndarray:
    size, hop = D.sizes(RATE)
    w = np.array([0.5 - 0.5 * np.cos(2 * np.pi * i / size) for i in range(size)])
    padded = np.concatenate([np.zeros(size // 2), x, np.zeros(size // 2)])
    return np.array([np.fft.rfft(padded[k * hop : k * hop + size] * w) for k in range(len(x) // hop + 1)])


def plain_denoise(x: np.ndarray, how: D.Subtraction) -> tuple[np.ndarray, float, bool]:
    size, hop = D.sizes(RATE)
    s = plain_spectra(x)
    mag = np.abs(s)
    db = np.array([20 * np.log10(np.sqrt(np.mean(m**2) + 1e-12) + 1e-12) for m in mag])
    quiet = db <= np.percentile(db, 20) + how.gate_db
    noise = np.median(mag[quiet], axis=0) if quiet.sum() >= how.least_frames else np.percentile(mag, 10, axis=0)
    for mild in (False, True):
        over, floor = how.strength(mild)
        left = mag - over * noise
        hits = left <= floor * noise
        clean = np.maximum(left, floor * noise)
        mask = clean / (clean + over * noise + 1e-12)
        if hits.mean() <= how.most_floor or mild:
            break
    n = len(mask)
    mask = np.array([np.median([mask[max(k - 1, 0)], mask[k], mask[min(k + 1, n - 1)]], axis=0) for k in range(n)])
    y, weight = np.zeros(len(x) + size), np.zeros(len(x) + size)
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    for k in range(n):
        y[k * hop : k * hop + size] += np.fft.irfft(mask[k] * s[k], size) * w
        weight[k * hop : k * hop + size] += w**2
    y = np.where(weight > 1e-10, y / np.maximum(weight, 1e-300), 0)[size // 2 : size // 2 + len(x)]
    return y, hits.mean(), mild


def joined(rows) -> np.ndarray:
    return np.concatenate([r.samples for r in sorted(rows, key=lambda r: r.start_ms)])


@pytest.mark.parametrize("seconds,noise,how", [(12.3, 0.02, D.Subtraction()), (12.3, 0.0, D.Subtraction(least_frames=5_000)), (3.0, 0.02, D.Subtraction(most_floor=0.9))])
def test_subtraction_equals_plain(spark, seconds, noise, how):
    x = sound(seconds, noise)
    expected, ratio, mild = plain_denoise(x, how)
    for ms, block in ((333, 10_000), (12_300, 800)):
        rows, facts = D.denoise(cut(spark, x, RATE, ms), how, block)
        assert np.allclose(joined(rows.collect()), expected, atol=2e-6)
        facts = facts.collect()
        assert len(facts) == 1 and facts[0].floor_ratio == pytest.approx(ratio) and facts[0].mild == mild


def test_subtraction_takes_noise_and_leaves_speech(spark):
    x = sound(8.0, 0.03, seed=3)
    pure = sound(8.0, 0.0)
    rows, _ = D.denoise(cut(spark, x, RATE, 1_000))
    y = joined(rows.collect())
    still = np.abs(pure) < 1e-9
    assert (y[still] ** 2).mean() < 0.25 * (x[still] ** 2).mean() and np.corrcoef(y, pure)[0, 1] > 0.97
    energies = D.residuals(cut(spark, x, RATE, 700)).first()
    assert energies.residual < energies.energy and energies.frames == len(x) // 20 + 1
    for n in (1, 160, 321):  # files whose halo reaches into a block without any frame
        short = cut(spark, x[:n], RATE, 1_000)
        assert D.residuals(short, block_ms=80).first().frames == n // 20 + 1 and len(joined(D.denoise(short, block_ms=80)[0].collect())) == n
    empty = spark.createDataFrame([], CHUNK)
    assert D.denoise(empty)[0].count() == 0 and D.residuals(empty).count() == 0


def test_long_files_are_cleaned_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(D, "LONG_MS", 6_000)
    monkeypatch.setattr(D, "STRETCH_MS", 4_000)
    x = np.concatenate([sound(4.0, 0.02), sound(4.0, 0.002)])
    _, facts = D.denoise(cut(spark, x, RATE, 500), block_ms=1_000)
    assert sorted(r.stretch for r in facts.collect()) == [0, 1]


def plain_shape(x: np.ndarray, how: G.Gains) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    _, hop = D.sizes(RATE)
    level = lambda v: np.array([20 * np.log10(np.sqrt(np.mean(np.abs(s) ** 2) + 1e-12) + 1e-12) for s in plain_spectra(v)])
    db = level(x)
    gain = np.array([min(how.target_db - v, how.most_db) if how.gate_db < v < how.target_db else 0.0 for v in db])
    half, w = how.width // 2, np.hanning(how.width)
    w = w / (w.sum() + 1e-12)
    smooth = np.array([sum(w[j + half] * gain[min(max(k + j, 0), len(gain) - 1)] for j in range(-half, half + 1)) for k in range(len(gain))])
    t = np.arange(len(x))
    y = x * np.interp(t, np.arange(len(gain)) * hop, 10 ** (smooth / 20))
    cut_db = []
    for v in level(y):
        over = v - how.threshold_db
        if over <= -how.knee_db / 2:
            cut_db.append(0.0)
        elif over < how.knee_db / 2:
            cut_db.append((how.threshold_db + over / how.ratio - v) * (over + how.knee_db / 2) / how.knee_db)
        else:
            cut_db.append(how.threshold_db + over / how.ratio - v)
    return y * np.interp(t, np.arange(len(cut_db)) * hop, 10 ** (np.array(cut_db) / 20)), db, smooth


def test_gains_equal_plain(spark):
    x = (sound(7.77, 0.0005) * np.linspace(0.001, 1, int(RATE * 7.77))).astype(np.float32)
    how = G.Gains()
    expected, db, smooth = plain_shape(x, how)
    assert (smooth > 1).any() and np.ptp(smooth) > 5
    for ms, block in ((250, 10_000), (7_770, 600), (130, 1_000)):
        assert np.allclose(joined(G.shape(cut(spark, x, RATE, ms), how, block).collect()), expected, atol=1e-5)
        curve = G.gain_curve(cut(spark, x, RATE, ms), how, block).orderBy("frame").collect()
        assert [r.frame for r in curve] == list(range(len(db)))
        assert np.allclose([r.level_db for r in curve], db, atol=1e-4) and np.allclose([r.smooth_db for r in curve], smooth, atol=1e-4)
    assert G.shape(spark.createDataFrame([], CHUNK)).count() == 0


def test_loudness_and_limit(spark):
    x = sound(4.0, 0.01)
    size, hop = RATE * 4 // 10, RATE // 10
    db = np.array([20 * np.log10(np.sqrt(np.mean(x[a : a + size].astype(float) ** 2) + 1e-12)) for a in range(0, len(x) - size + 1, hop)])
    expected = db[db > db.mean() - 10].mean()
    rows = cut(spark, x, RATE, 300).unionByName(cut(spark, x[:100], RATE, 300, "short")).unionByName(cut(spark, np.zeros(900), RATE, 300, "silent"))
    found = {r.file_id: r for r in G.file_loudness(rows, block_ms=900).collect()}
    assert found["f"].loudness_db == pytest.approx(expected, abs=1e-6) and found["f"].peak == pytest.approx(np.abs(x).max())
    assert found["short"].loudness_db == pytest.approx(20 * np.log10(np.sqrt(np.mean(x[:100].astype(float) ** 2))), abs=1e-4) and found["silent"].loudness_db == pytest.approx(-120, abs=1)
    loud = joined(G.normalise(rows.where("file_id = 'f'")).collect())
    gain = 10 ** (np.clip(-20 - expected, -12, 12) / 20)
    assert np.allclose(loud, x * min(gain, 0.95 / np.abs(x).max()), atol=1e-6)
    hot = joined(G.normalise(rows.where("file_id = 'f'"), target_db=0.0).collect())
    assert np.abs(hot).max() == pytest.approx(0.95, abs=1e-6)


def test_marked_chunks_lose_their_laps_without_a_sort(spark):
    rows = [(f, k, 100 * k, max(100 * k - 20, 0), 1_000, [float(x) for x in range(max(100 * k - 20, 0), 100 * k + 100)]) for f in ("a", None) for k in range(3)]
    chunks = spark.createDataFrame(rows, "file_id string, chunk long, start_ms long, lap_start_ms long, rate int, samples array<double>")
    marked = audio.drop_laps(chunks.withColumn("first", chunks["chunk"] == 0))
    plan = marked._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan and "Exchange" not in plan
    joined = {(r.file_id, r.chunk): r.samples for r in audio.drop_laps(chunks).collect()}
    assert {(r.file_id, r.chunk): r.samples for r in marked.collect()} == joined
    assert all(joined[f, k] == [float(x) for x in range(100 * k, 100 * k + 100)] for f in ("a", None) for k in range(3))
