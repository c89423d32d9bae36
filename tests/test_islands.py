"""Windows and islands against plain loops, whatever the order and partitioning of the rows."""

from __future__ import annotations

import random
from statistics import median

import pytest
from pyspark.sql import functions as F

from parley.operators import islands, timeline


def frames(spark, series: dict[str, list[float]], parts: int = 3):
    rows = [(1, label, k + 1, v, k * 500, k * 500 + 1_000) for label, values in series.items() for k, v in enumerate(values)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "file_id long, label string, frame long, score double, start_ms long, end_ms long").repartition(parts)


def loop(values: list[float], enter: float, leave: float) -> list[tuple]:
    """(first, exit or None, last on, peak) of each event, frames from 1."""
    out, on, peak = [], None, 0.0
    for k, v in enumerate(values, 1):
        if on is None and v >= enter:
            on, peak = k, v
        elif on is not None:
            peak = max(peak, v)
            if v <= leave:
                out.append((on, k, k - 1, peak))
                on = None
    if on is not None:
        out.append((on, None, len(values), peak))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_hysteresis_equals_a_loop(spark, seed):
    rng = random.Random(seed)
    series = {f"l{i}": [round(rng.random(), 2) for _ in range(rng.randint(1, 120))] for i in range(6)}
    found = islands.hysteresis(frames(spark, series), ["label"], 0.6, 0.4).collect()
    for label, values in series.items():
        got = sorted((r["first_frame"], r["exit_frame"], r["last_frame"], r["score"]) for r in found if r["label"] == label)
        assert got == sorted(loop(values, 0.6, 0.4))


@pytest.mark.parametrize(
    ("values", "gap_ms", "least_ms", "runs"),
    [([0.1, 0.6, 0.55, 0.2, 0.1], 0, 0, [(2, 4, 0.6)]), ([0.55, 0.2, 0.52, 0.25, 0.1], 300, 0, [(1, 4, 0.55)]), ([0.6, 0.2], 0, 1_500, [])],
)
def test_known_runs(spark, values, gap_ms, least_ms, runs):
    found = timeline.runs_before_exit(frames(spark, {"x": values}), 0.5, 0.35)
    merged = timeline.merge_then_filter(found, least_ms, gap_ms).collect()
    got = [(r["start_ms"] // 500 + 1, (r["end_ms"] - 1_000) // 500 + 2, r["score"]) for r in merged]
    assert got == runs


@pytest.mark.parametrize("seed", range(3))
def test_spans_merge_like_a_loop(spark, seed):
    rng = random.Random(seed)
    spans = [(f, s, s + rng.randint(0, 900)) for f in range(4) for s in [rng.randint(0, 9_000) for _ in range(40)]]
    want = []
    for f in range(4):
        own = sorted((s, e) for g, s, e in spans if g == f)
        for s, e in own:
            if want and want[-1][0] == f and s - want[-1][2] <= 200:
                want[-1][2] = max(want[-1][2], e)
            else:
                want.append([f, s, e])
    found = islands.merge_spans(spark.createDataFrame(spans, "file_id long, start_ms long, end_ms long"), ["file_id"], 200)
    assert sorted([r["file_id"], r["start_ms"], r["end_ms"]] for r in found.collect()) == want


@pytest.mark.parametrize("seed", range(3))
def test_events_merge_in_global_order(spark, seed):
    rng = random.Random(seed)
    events = [(1, rng.choice("ab"), s, s + rng.randint(100, 900), rng.random()) for s in [rng.randint(0, 12_000) for _ in range(60)]]
    want = []
    for _, label, s, e, score in sorted(events, key=lambda x: (x[2], x[3], x[1])):
        if want and want[-1][0] == label and s - want[-1][2] <= 150:
            want[-1][2], want[-1][3] = max(want[-1][2], e), max(want[-1][3], score)
        else:
            want.append([label, s, e, score])
    found = islands.merge_events(spark.createDataFrame(events, "file_id long, label string, start_ms long, end_ms long, score double").repartition(5), "file_id", "label", 150)
    assert sorted([r["label"], r["start_ms"], r["end_ms"], r["score"]] for r in found.collect()) == sorted(want)


def test_median_filter_pads_with_zeros(spark):
    values = [random.Random(4).random() for _ in range(30)]
    found = islands.median_filter(frames(spark, {"x": values}), ["label"], 5).orderBy("frame").collect()
    padded = [0.0, 0.0, *values, 0.0, 0.0]
    assert [r["smooth"] for r in found] == [median(padded[k : k + 5]) for k in range(30)]


def test_neighbours_of_one_speaker_merge(spark):
    rows = [(1, 0, "a", 0, 500), (1, 1, "a", 1_500, 1_800), (1, 2, "b", 1_900, 2_000), (1, 3, "a", 2_100, 2_200), (1, 4, "a", 3_300, 3_400), (1, 5, "a", 3_350, 3_360)]
    segs = spark.createDataFrame(rows, "file_id long, ord long, speaker string, start_ms long, end_ms long")
    found = islands.merge_neighbours(segs, "file_id", "speaker", 1_000, ["start_ms", "ord"]).orderBy("start_ms").collect()
    assert [(r["speaker"], r["start_ms"], r["end_ms"]) for r in found] == [("a", 0, 1_800), ("b", 1_900, 2_000), ("a", 2_100, 2_200), ("a", 3_300, 3_360)]
    apart = islands.merge_neighbours(segs, "file_id", "speaker", 1_000, ["start_ms", "ord"], least_gap_ms=0).count()
    assert apart == 5


def test_runs_of_equal_values(spark):
    rows = [(1, k, k % 7 > 3) for k in range(20)]
    found = islands.runs(spark.createDataFrame(rows, "f long, frame long, on boolean"), ["f"], "frame", "on").orderBy("first").collect()
    assert [(r["on"], r["first"], r["last"], r["n_rows"]) for r in found][:3] == [(False, 0, 3, 4), (True, 4, 6, 3), (False, 7, 10, 4)]


def test_collapse_and_top(spark):
    f = frames(spark, {"Dog": [0.1, 0.9], "cat": [0.5, 0.2], "x": [0.3, 0.3]})
    groups = spark.createDataFrame([("dog", "animal"), ("CAT", "animal")], "label string, group string")
    found = {(r["frame"], r["label"]): r["score"] for r in timeline.collapse(f, groups).collect()}
    assert found == {(1, "animal"): 0.5, (2, "animal"): 0.9, (1, "x"): 0.3, (2, "x"): 0.3}
    assert [r["label"] for r in timeline.frame_top(f, 2).where("frame = 1").orderBy("place").collect()] == ["cat", "x"]


def test_filter_comes_before_merge(spark):
    rows = [(1, "a", 0, 100, 0.5), (1, "a", 150, 900, 0.6), (1, "b", 950, 2_000, 0.7), (1, "a", 2_050, 2_900, 0.8)]
    events = spark.createDataFrame(rows, "file_id long, label string, start_ms long, end_ms long, score double")
    found = timeline.filter_then_merge(events, 200, 500, {"B": 1_100}).orderBy("start_ms").collect()
    assert [(r["label"], r["start_ms"], r["end_ms"]) for r in found] == [("a", 150, 900), ("a", 2_050, 2_900)]
    assert timeline.noise_scores(events.withColumn("label", F.lit("Wind noise"))).first()["noise_score"] == pytest.approx(2.6)
