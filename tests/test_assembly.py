"""Chunks, windows and words put together again; masks, clocks, notes and report sections."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.functions import numbers, text
from parley.operators import audio, folds, intervals, rollup, segments
from parley.sources import sinks


def test_words_return_to_their_spans(spark):
    spans = spark.createDataFrame([(1, 0, 0, 5_000, 0, 1_000), (1, 0, 1, 9_000, 1_000, 1_500), (1, 0, 2, 20_000, 1_500, 2_000)], "file_id long, batch long, ord long, start_ms long, from_ms long, to_ms long")
    words = spark.createDataFrame([(1, 0, 0, " a", 0, 400), (1, 0, 1, "b ", 900, 1_100), (1, 0, 2, "", 1_200, 1_300)], "file_id long, batch long, place long, word string, start_ms long, end_ms long")
    found = [tuple(r)[2:] for r in segments.words_to_spans(words, spans).orderBy("ord").collect()]
    assert found == [(0, "a b", 2, 5_000, 6_100), (1, "b", 2, 8_900, 9_300), (2, "[silence]", 0, None, None)]


def test_windows(spark):
    spans = spark.createDataFrame([(i, 100, 100 + n) for i, n in enumerate([0, 1, 2_600, 2_601, 9_999])], "ord long, start_ms long, end_ms long")
    lapping = {}
    for r in intervals.lapping_windows(spans, 3_000, 400).orderBy("ord", "window").collect():
        lapping.setdefault(r["ord"], []).append((r["win_start_ms"] - 100, r["win_end_ms"] - 100))
    for i, n in enumerate([0, 1, 2_600, 2_601, 9_999]):
        want, at = [], 0
        while at < n:
            want.append((max(0, at - (400 if want else 0)), min(n, at + 3_000)))
            at += 2_600
        assert lapping.get(i, []) == want
    whole = [(r["ord"], r["win_start_ms"] - 100) for r in intervals.whole_windows(spans, 1_000, 800).orderBy("ord", "window").collect()]
    assert whole == [(1, 0), (2, 0), (2, 800), (2, 1_600), (3, 0), (3, 800), (3, 1_600), *[(4, 800 * k) for k in range(12)]][: len(whole)] and whole[-1] == (4, 8_800)
    texts = spark.createDataFrame([(1, 0, 0, " one ", -0.2, None), (1, 0, 2, "three", None, "fr"), (1, 0, 1, "  ", -9.0, "xx"), (1, 1, 0, None, None, None)], "file_id long, ord long, window int, text string, logprob double, language string")
    assert [tuple(r) for r in segments.join_windows(texts).collect()] == [(1, 0, "one three", 2, -0.2, pytest.approx(math.exp(-0.2)), None)]


def test_chunks_without_laps_hold_every_sample_once(spark):
    rate, x = 100, [float(i) for i in range(1_000)]
    plan = intervals.chunks(spark.createDataFrame([("f", 10_000)], "file_id string, duration_ms long"), 5_000, 3_000, 500).collect()
    rows = [("f", r["chunk"], r["start_ms"], r["lap_start_ms"], rate, x[r["lap_start_ms"] // 10 : r["end_ms"] // 10]) for r in plan]
    rows += [("g", 0, 50, 0, rate, [1.0]), ("g", 1, 100, 50, rate, [2.0]), ("h", 0, 0, 0, rate, [])]
    out = audio.drop_laps(spark.createDataFrame(rows, "file_id string, chunk long, start_ms long, lap_start_ms long, rate int, samples array<double>"))
    merged = [v for r in out.where("file_id = 'f'").orderBy("start_ms").collect() for v in r["samples"]]
    assert merged == x and out.where("file_id = 'g'").selectExpr("sum(size(samples))").first()[0] == 2
    loud = audio.loud_chunks(out.withColumn("samples", F.when(F.col("file_id") == "g", F.array(F.lit(1e-4))).otherwise(F.col("samples"))))
    assert {r["file_id"] for r in loud.collect()} == {"f"}


@pytest.mark.parametrize("n", [0, 1, 7, 8, 99, 141, 1_000, 1_777])
def test_mask_and_hann(spark, n):
    flip = random.Random(n)
    flags = [flip.random() < 0.5 for _ in range(n)]
    frames = spark.createDataFrame([(1, i, f, float(i * i % 17)) for i, f in enumerate(flags)], "file_id long, frame long, quiet boolean, v double").repartition(3)
    got = [r["smooth_mask"] for r in audio.smooth_mask(frames, ["file_id"], "quiet").orderBy("frame").collect()]
    half = min(7, max(3, n // 20)) // 2
    want = list(flags)
    if n > 7:
        size = 500 if n > 1_000 else n
        for a in range(0, n, size):
            block = [False] * half + flags[a : a + size] + [False] * half
            want[a : a + size] = [sum(block[i : i + 2 * half + 1]) > half for i in range(len(block) - 2 * half)]
    assert got == want
    if n:
        values = np.array([float(i * i % 17) for i in range(n)])
        w = np.hanning(7) / np.hanning(7).sum()
        smooth = [r["v_hann"] for r in audio.hann_smooth(frames, ["file_id"], "v", 7).orderBy("frame").collect()]
        assert smooth == pytest.approx(list(np.convolve(np.pad(values, 3, mode="edge"), w, mode="valid")))
    with pytest.raises(ValueError):
        audio.hann_smooth(frames, ["file_id"], "v", 4)


def test_chunk_merge_and_flips(spark):
    rows = [(1, 0, 1_000, "a", [2.0]), (1, 500, 700, "a", None), (1, 1_000, 1_500, "a", [4.0]), (1, 1_501, 1_600, "a", None), (1, 1_550, 1_700, "b", [1.0]), (None, 0, 1, None, None)]
    kind = "file_id long, start_ms long, end_ms long, speaker string, embedding array<double>"
    out = {tuple(r) if r["embedding"] is None else (*tuple(r)[:5], tuple(r["embedding"])) for r in folds.merged_chunks(spark.createDataFrame(rows, kind)).collect()}
    assert out == {(1, 0, 1_500, "a", 3, (3.0,)), (1, 1_501, 1_600, "a", 1, None), (1, 1_550, 1_700, "b", 1, (1.0,)), (None, 0, 1, None, 1, None)}
    files = spark.createDataFrame([(1, 90_000), (2, 1), (3, 120_000)], "file_id long, duration_ms long")
    turns = spark.createDataFrame([(1, True)] * 61 + [(3, True)] * 120 + [(2, None)], "file_id long, is_boundary_flip boolean")
    assert {tuple(r) for r in segments.unstable_voice(turns, files).collect()} == {(1, 61, True), (2, 0, False), (3, 120, False)}


def test_clocks_issues_and_notes(spark):
    row = lambda *c: tuple(spark.range(1).select(*c).first())
    for ms, want in {3_661_007: ("1:01:01", "1:01:01.007", "01:01:01"), 59_999: ("00:59", "00:59.999", "00:00:59"), -5: ("00:00", "00:00.000", "00:00:00")}.items():
        assert row(text.short_clock(F.lit(ms)), text.fine_clock(F.lit(ms)), text.full_clock(F.lit(ms))) == want
    assert row(text.issues(F.array(F.lit("b"), F.lit(None), F.lit("a"), F.lit("b")))) == (["a", "b"],)
    given = [F.lit(v) for v in (0.35, 0.8, 0.8, 0.1, 1, 0.6)]
    notes = lambda snr, silence, dynamic, clip: row(numbers.tune_notes(F.lit(snr).cast("double"), F.lit(silence), F.lit(dynamic), F.lit(clip), *given))[0]
    assert notes(4.0, 0.5, 20.0, False) == ["snr<6_lower_vad", "shorten_min_speech_low_snr", "low_snr_raise_beam", "low_snr_lower_no_speech"]
    assert notes(20.0, 0.5, 20.0, False) == ["noop"]
    assert notes(None, 0.2, 5.0, True) == ["clipping_detected", "dense_speech_shorten_min_silence", "low_dynamic_range_shorter_min_speech", "clipping_guard_no_speech"]


def test_report_sections(spark):
    rows = [(1, 0, "a", "we will follow up <soon>", 0, 70_000, 0.5, 0.2), (1, 1, "b", None, 70_000, 80_000, None, None), (1, 2, "a", "fine", 80_000, 81_000, 0.1, 0.9)]
    seg = spark.createDataFrame(rows, "file_id long, ord long, speaker string, text string, start_ms long, end_ms long, valence double, arousal double")
    parts = sinks.report_sections(seg, 2)
    assert parts["Executive summary"].first()["quick_take"] == "2 speakers over 1 min; most-active tone positive."
    assert [r["start_ms"] for r in parts["Moments to check"].collect()] == [0, 80_000]
    page = sinks.html_report(parts)
    assert page.index("Executive summary") < page.index("Transcript") and "&lt;soon&gt;" in page and "01:20" in page
    empty = sinks.html_report(sinks.report_sections(seg.where("false")))
    assert "Moments to check" in empty
    assert rollup.quick_take(seg.withColumn("valence", F.lit(None).cast("double"))).first()["quick_take"].endswith("neutral.")
