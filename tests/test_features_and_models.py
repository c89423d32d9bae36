"""Segment features, models with a state, clustering in levels and pruned matching, against plain versions."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.operators import carried, clusters, features, identity, nearest, voice

from .test_sound import CHUNK, cut, pulses

SEG = "file_id string, ord long, start_ms long, end_ms long, text string"


def frame_rows(n: int, seed: int, step: int = 10) -> list[tuple]:
    rng = np.random.default_rng(seed)
    quiet = np.repeat(rng.random(n // 25 + 1) < 0.4, 25)[:n]
    db = np.where(quiet, -60, -25) + rng.normal(0, 3, n)
    hz = [None if q or rng.random() < 0.2 else float(140 + 20 * np.sin(k / 40) + rng.normal(0, 3) + (300 if rng.random() < 0.03 else 0)) for k, q in enumerate(quiet)]
    return [("f", k * step, float(db[k]), hz[k], float(rng.uniform(300, 3_000)), float(rng.random()), None if hz[k] is None else float(rng.random() / 50)) for k in range(n)]


def plain_features(rows: list[tuple], start: int, end: int, step: int) -> dict:
    """Figures of one segment with lists and numpy alone."""
    own = [r for r in rows if start <= r[1] < end]
    if not own:
        return {"n_frames": 0, "pause_count": 0}
    db = np.array([r[2] for r in own])
    floor = np.percentile(db, 5)
    quiet = (db < floor + 8).astype(int)
    n = len(quiet)
    silent = quiet.copy()
    if n > 7:
        half = min(7, max(3, n // 20)) // 2
        for a in range(0, n, 500 if n > 1000 else n):
            part = quiet[a : a + 500] if n > 1000 else quiet
            wide = np.concatenate([np.zeros(half), part, np.zeros(half)])
            silent[a : a + len(part)] = [np.median(wide[k : k + 2 * half + 1]) for k in range(len(part))]
    runs, last = [], None
    for s in silent:
        if s == last:
            runs[-1][1] += step
        else:
            runs.append([s, step])
            last = s
    pauses = [ms for s, ms in runs if s and ms >= 200]
    hz = [(r[1], r[3]) for r in own if r[3] is not None]
    out = {"n_frames": n, "pause_count": len(pauses), "pause_long_count": sum(ms >= 600 for ms in pauses), "pause_time_s": sum(pauses) / 1000, "pause_ratio": sum(pauses) / (n * step), "loudness_rms": np.median(db), "loudness_dr_db": np.percentile(db, 95) - floor}
    if len(hz) >= 0.05 * n and hz:
        low, high = np.percentile([h for _, h in hz], [25, 75])
        reach = 1.5 * (high - low)
        kept = [(t, h) for t, h in hz if reach <= 0 or low - reach <= h <= high + reach]
        kept = kept if len(kept) * 2 > len(hz) else hz
        points = kept[:: max(1, len(kept) // 10)]
        slopes = [(b[1] - a[1]) * 1000 / (b[0] - a[0]) for a, b in zip(points, points[1:])]
        q = np.percentile([h for _, h in kept], [25, 50, 75])
        out |= {"f0_mean_hz": q[1], "f0_std_hz": q[2] - q[0], "pitch_slope_hzps": np.median(slopes) if len(kept) >= 10 else None}
        out["vq_jitter_pct"] = 100 * np.mean([r[6] for r in own if r[6] is not None]) if end - start >= 600 else 0.0
    return out


def test_segment_features_equal_plain(spark):
    rows = frame_rows(4_000, 3)
    frames = spark.createDataFrame(rows, "file_id string, start_ms long, db double, hz double, centroid_hz double, flatness double, jitter double")
    spans = [(0, 5_000), (4_990, 12_345), (12_345, 12_400), (13_000, 39_999), (20_000, 20_300), (50_000, 60_000), (39_950, 70_000), (500, 500)]
    seg = spark.createDataFrame([("f", k, a, b, "um well I I think so") for k, (a, b) in enumerate(spans)] + [("g", 0, 0, 1_000, None), (None, 0, 0, 1_000, "")], SEG)
    found = {(r.file_id, r.ord): r for r in features.segment_features(seg, frames).collect()}
    assert len(found) == len(spans) + 2
    for k, (a, b) in enumerate(spans):
        for name, value in plain_features(rows, a, b, 10).items():
            assert (found["f", k][name] is None) == (value is None) and (value is None or found["f", k][name] == pytest.approx(value)), (k, name)
    assert found["f", 0].words == 6 and found["f", 0].filler_count == 3 and found["f", 0].wpm == pytest.approx(6 * 12)
    assert found["f", 4].vq_note == "too_short" and found["f", 5].vq_note == "no_audio" and found["g", 0].n_frames == 0
    assert features.segment_features(seg.limit(0), frames).count() == 0


def test_features_of_sound(spark):
    """From samples to rows: a voice of 125 Hz with a pause of 700 ms."""
    rate = 16_000
    x = np.concatenate([pulses(rate, 128.0, 0.0, 0.0, 150)[: rate], np.zeros(int(0.7 * rate)), pulses(rate, 128.0, 0.0, 0.0, 150)[: rate]])
    x = x + np.random.default_rng(1).normal(0, 1e-4, len(x))
    frames = voice.voice_frames(cut(spark, x, rate, 300))
    row = features.segment_features(spark.createDataFrame([("f", 0, 0, 2_700, "yes so we went")], SEG), frames).first()
    assert row.pause_long_count == 1 and row.pause_time_s == pytest.approx(0.7, abs=0.08) and row.f0_mean_hz == pytest.approx(125, rel=0.01)
    assert row.vq_reliable and row.vq_note == "reliable" and row.vq_hnr_db > 20 and row.vq_jitter_pct < 1


def test_a_pitch_on_the_fence_is_no_outlier(spark):
    """The upper fence is 242.745 + 1.5 * 119.09 = 421.38, which doubles miss by a rounding."""
    hz = [98.44, 115.88, 121.47999999999999, 124.38, 129.48, 134.44, 161.57999999999998, 169.07999999999998, 183.2, 421.38, 425.08, 451.64]
    rows = [("f", 200 * k, -50.0, x) for k, x in enumerate(hz)]
    row = features.segment_features(spark.createDataFrame([("f", 0, 0, 2_400, "yes")], SEG), spark.createDataFrame(rows, "file_id string, start_ms long, db double, hz double"), 200).first()
    assert row.f0_mean_hz == pytest.approx((129.48 + 134.44) / 2) and row.pitch_slope_hzps is not None


class Recurrent:
    """A stand-in with a state of two numbers that sees what came before each window."""

    def fresh(self, n):
        return np.zeros((n, 2))

    def __call__(self, windows, states):
        own, before = windows[:, 16:].astype(float), windows[:, :16].astype(float)
        states = np.stack([0.8 * states[:, 0] + np.abs(own).mean(axis=1), 0.5 * states[:, 1] + before.sum(axis=1)], axis=1)
        return 1 / (1 + np.exp(-(states[:, 0] - 0.3 * states[:, 1]))), states


def test_any_chunking_gives_the_same_scores(spark):
    rng = np.random.default_rng(8)
    sounds = {f"f{k}": rng.normal(0, 0.3, int(rng.integers(1, 9_000))).astype(np.float32) for k in range(9)}
    expected = {}
    for f, x in sounds.items():
        model, padded = Recurrent(), np.pad(x, (16, -len(x) % 128))
        state = model.fresh(1)
        for w in range(-(-len(x) // 128)):
            score, state = model(padded[None, w * 128 : w * 128 + 144], state)
            expected[f, w] = score[0]
    for ms, side in ((1, 64), (50, 2), (700, 3), (10_000, 64)):
        rows = None
        for f, x in sounds.items():
            rows = cut(spark, x, 1_000, ms, f) if rows is None else rows.unionByName(cut(spark, x, 1_000, ms, f))
        found = {(r.file_id, r.window): r.score for r in carried.infer_carried(rows, Recurrent, 128, 16, side).collect()}
        assert set(found) == set(expected) and all(found[k] == pytest.approx(expected[k], rel=1e-6) for k in found)
        if ms == 1:
            break_at = rows.where("file_id = 'f1' or file_id = 'f2'")
            assert carried.infer_carried(break_at, Recurrent, 128, 16, 1).count() == sum(k[0] in ("f1", "f2") for k in expected)
    odd = spark.createDataFrame([("a", 0, 0, [1.0]), ("b", 0, 1_000, []), ("c", 0, 1_000, None), (None, 0, 1_000, [0.5] * 5)], CHUNK)
    assert [(r.file_id, r.window) for r in carried.infer_carried(odd, Recurrent, 128, 16).collect()] == [(None, 0)]


def test_levels_equal_one_level_on_separated_data(spark):
    rng = np.random.default_rng(6)
    middles = np.eye(8)[:5] + 0.01
    who = rng.integers(0, 5, 700)
    rows = [(f"f{k % 2}", k, (middles[w] + rng.normal(0, 0.02, 8)).tolist()) for k, w in enumerate(who.tolist())] + [("f0", 9_000, None)]
    table = spark.createDataFrame(rows, "file_id string, place long, v array<double>").repartition(4)
    one = {(r[0], r[1]): r[2] for r in identity.cluster(table.where("v is not null"), "file_id", "place", "v", 0.3).collect()}
    for part in (7, 100, 1_000):
        assert {(r[0], r[1]): r[2] for r in clusters.cluster_in_levels(table, "file_id", "place", "v", 0.3, part=part).collect()} == one
    three = clusters.cluster_in_levels(table, "file_id", "place", "v", 0.3, clusters=3, part=50)
    assert three.groupBy("file_id").agg(F.countDistinct("cluster").alias("n")).where("n <> 3").count() == 0
    lonely = spark.createDataFrame([("f", k, np.eye(30)[k].tolist()) for k in range(30)], "file_id string, place long, v array<double>")
    assert sorted(r[2] for r in clusters.cluster_in_levels(lonely, "file_id", "place", "v", 0.3, part=4).collect()) == list(range(30))
    assert clusters.cluster_in_levels(table.limit(0), "file_id", "place", "v").count() == 0


def test_a_long_recording_in_bounded_memory(spark):
    """20,000 windows of one file: no group holds more rows than a part, where one level would need 3.2 GB."""
    rows = spark.range(20_000).select(F.lit("f").alias("file_id"), F.col("id").alias("place"), F.array(*[(F.when(F.col("id") % 6 == k, 1.0).otherwise(0.0) + F.rand(k) * 0.05) for k in range(6)]).alias("v"))
    found = clusters.cluster_in_levels(rows, "file_id", "place", "v", 0.3, part=250)
    assert found.where("cluster <> place % 6").count() == 0 and found.count() == 20_000


def test_weighted_linkage_is_that_of_all_windows():
    """Clusters given by their sums merge at the mean distance of all pairs of their windows."""
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (12, 4))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    own = np.array([0, 0, 1, 1, 1, 2, 3, 3, 4, 4, 4, 4])
    totals, size = np.stack([x[own == k].sum(axis=0) for k in range(5)]), np.bincount(own).astype(float)
    pairs = {(a, b): np.mean([1 - u @ v for u in x[own == a] for v in x[own == b]]) for a in range(5) for b in range(a)}
    (a, b), least = min(pairs.items(), key=lambda p: p[1])
    labels = identity.linkage(totals, size, 2.0, 4)
    assert labels[a] == labels[b] and len(set(labels.tolist())) == 4 and least <= min(pairs.values())


def test_pruned_match_equals_the_full_product(spark):
    rng = np.random.default_rng(9)
    middles = rng.normal(0, 1, (40, 16))
    names = [(f"n{k:04d}", (middles[k % 40] + rng.normal(0, 0.1, 16)).tolist()) for k in range(600)] + [("n0000b", None)]
    names.append(("a-twin", names[7][1]))
    table = [(k, (middles[k % 40] + rng.normal(0, 0.1, 16)).tolist()) for k in range(500)] + [(900, None), (901, names[7][1])]
    registry = spark.createDataFrame(names, "name string, centroid array<double>").repartition(3)
    vectors = spark.createDataFrame(table, "id long, v array<double>")
    found, work = nearest.match_pruned(vectors, registry, "id", "v")
    expected = {r.id: r for r in identity.match(vectors.where("v is not null"), registry.where("centroid is not null"), "id", "v").collect()}
    got = {r.id: r for r in found.collect()}
    assert set(got) == set(expected) and all(got[k].name == expected[k].name and got[k].similarity == pytest.approx(expected[k].similarity) and got[k][3:] == expected[k][3:] for k in got)
    assert got[901].name == "a-twin"
    work = work.first()
    assert work.pairs == 501 * 601 and work.compared < 0.4 * work.pairs
    again, _ = nearest.match_pruned(vectors, registry, "id", "v", pivots=3)
    assert {r.id: r.name for r in again.collect()} == {k: r.name for k, r in expected.items()}
    assert nearest.match_pruned(vectors, registry.limit(0), "id", "v")[0].count() == 0
    assert nearest.match_pruned(vectors.limit(0), registry, "id", "v")[0].count() == 0


def test_pruned_match_streams_names_past_blocks(spark, monkeypatch):
    """Small blocks and slices, no structure and many copies give the full product; no row holds more than one vector."""
    monkeypatch.setattr(nearest, "VECTORS", 60)
    monkeypatch.setattr(nearest, "BLOCK", 7)
    rng = np.random.default_rng(3)
    points = rng.normal(0, 1, (150, 8)).tolist()
    registry = spark.createDataFrame([(f"n{k:04d}", points[k % 40]) for k in range(160)], "name string, centroid array<double>")
    vectors = spark.createDataFrame([(k, points[k % 150]) for k in range(300)] + [(7, points[90])], "id long, v array<double>")
    found, work = nearest.match_pruned(vectors, registry, "id", "v")
    expected = {r.id: r for r in identity.match(vectors.where("id <> 7"), registry, "id", "v").collect()}
    got = {r.id: r for r in found.collect()}
    assert len(got) == 300 and all(got[k].name == expected[k].name and got[k].similarity == pytest.approx(expected[k].similarity) for k in expected)
    assert got[7].name == "n0007" and got[37].name == "n0037" and work.first().compared <= 301 * 40 + 301 * 25 + 160 * 25
