"""Flow, overlaps, rollups, segments, identity and text features."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.functions import numbers, text, vectors
from parley.operators import flow, identity, intervals, overlap, rollup, segments

SEG = "file_id long, ord long, speaker string, text string, start_ms long, end_ms long"


@pytest.fixture(scope="module")
def talk(spark):
    rows = [(1, 0, "a", "hello there everyone", 0, 2_000), (1, 1, "b", "hello there um everyone", 1_900, 4_000), (1, 2, "b", "yes", 4_500, 5_000), (1, 3, "a", "", 5_000, 5_000), (1, 4, "c", "we will go", 4_990, 65_000), (2, 0, "a", "alone", 100, 1_100)]
    return spark.createDataFrame(rows, SEG).repartition(3)


def rows_of(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_flow(talk):
    assert [r[2] for r in rows_of(flow.turns(talk), "file_id", "turn")] == [0, 1, 4, 0]
    assert rows_of(flow.flow_interruptions(talk), "file_id", "ord") == [(1, 1, "b", 100), (1, 3, "a", 60_000), (1, 4, "c", 10)]
    stats = {r["file_id"]: r for r in flow.latency_stats(talk).collect()}
    assert stats[1]["count"] == 1 and stats[1]["avg_sec"] == pytest.approx(0.99) and stats[2]["count"] == 0
    shares = {(r["file_id"], r["speaker"]): r["dominance_pct"] for r in flow.dominance(talk).collect()}
    assert shares[2, "a"] == 100 and sum(v for (f, _), v in shares.items() if f == 1) == pytest.approx(100)
    even = {r["file_id"]: r["balance"] for r in flow.balance(talk).collect()}
    p = np.array([2_000, 2_600, 60_010]) / 64_610
    assert even == {1: pytest.approx(-(p * np.log2(p)).sum() / math.log2(3)), 2: 0}
    windows = rows_of(flow.energy_flow(talk).where("file_id = 1"), "window")
    assert len(windows) == 2 and windows[0][4] == 3
    assert flow.metrics(talk).count() == 2


def test_coherence(talk):
    found = {r["file_id"]: r for r in flow.topic_coherence(talk).collect()}
    assert found[1]["pairs"] == 1 and found[1]["coherence"] == 1
    assert found[2]["pairs"] == 0 and found[2]["coherence"] == 1


def test_overlaps_equal_all_pairs(spark):
    rng = random.Random(2)
    rows = [(f, k, rng.choice("abc"), "", s, s + rng.randint(0, 4_000)) for f in range(3) for k, s in enumerate(sorted(rng.randint(0, 60_000) for _ in range(60)))]
    segs = spark.createDataFrame(rows, SEG).repartition(5)
    want = set()
    for x in rows:
        for y in rows:
            if x[0] == y[0] and (x[4], x[1]) < (y[4], y[1]) and min(x[5], y[5]) - max(x[4], y[4]) >= 50:
                want.add((x[0], x[1], y[1], min(x[5], y[5]) - max(x[4], y[4])))
    got = overlap.overlap_pairs(segs)
    assert {(r["file_id"], r["ord"], r["r_ord"], r["overlap_ms"]) for r in got.collect()} == want and got.count() == len(want)
    sums = {(r["file_id"], r["speaker"]): r["overlap_ms"] for r in overlap.overlap_by_speaker(segs).collect()}
    assert sum(sums.values()) == 2 * sum(w[3] for w in want)


@pytest.mark.parametrize("bucket", [100, 1_000, 100_000])
def test_overlap_join_has_each_pair_once(spark, bucket):
    rng = random.Random(bucket)
    span = lambda k: (k % 3, k, s := rng.randint(0, 9_000), s + rng.randint(0, 2_500))
    left, right = [span(k) for k in range(50)], [span(k) for k in range(60)]
    a, b = (spark.createDataFrame(x, "file_id long, n long, start_ms long, end_ms long") for x in (left, right))
    pairs = [(r["n"], r["r_n"]) for r in intervals.overlap_join(a, b, ["file_id"], bucket).collect()]
    want = [(x[1], y[1]) for x in left for y in right if x[0] == y[0] and x[2] < y[3] and y[2] < x[3]]
    assert sorted(pairs) == sorted(want)
    outer = [(r["n"], r["r_n"]) for r in intervals.overlap_join(a, b, ["file_id"], bucket, "left", ["n"]).collect()]
    assert sorted(x for x in outer if x[1] is not None) == sorted(want) and {x[0] for x in outer} == set(range(50))


def test_interruption_map(spark):
    sums = spark.createDataFrame([(1, "S1", 2_500, 2), (1, "S2", 1_500, 1)], "file_id long, speaker string, overlap_ms long, interruptions long")
    one = spark.createDataFrame([(1, 0, "S2", "S1", 5), (1, 0, "S3", "S1", 5), (1, 0, "S1", "S2", 5), (1, 0, "S1", "S2", 5)], "file_id long, at_ms long, interrupter string, interrupted string, overlap_ms long")
    found = {r["speaker"]: (r["made"], r["received"], r["overlap_ms"]) for r in overlap.merge_interruptions(sums, one).collect()}
    assert found == {"S1": (2, 2, 2_500), "S2": (1, 2, 1_500), "S3": (1, 0, 0)}


def test_votes_go_to_the_first_seen(spark):
    rows = [(1, "x", 3), (1, "y", 1), (1, "y", 2), (1, "x", 4), (2, "", 1), (2, None, 2)]
    found = {r["k"]: (r["label"], r["votes"]) for r in rollup.vote(spark.createDataFrame(rows, "k long, label string, o long"), ["k"], "label", "o", "neutral").collect()}
    assert found == {1: ("y", 2), 2: ("neutral", 0)}


def test_spread_and_medians(spark):
    values = [(1, v) for v in (5.0, 1.0, 4.0, 2.0, 3.0)] + [(2, 1.0), (2, 9.0)]
    df = spark.createDataFrame(values, "k long, v double")
    assert {r["k"]: r["spread"] for r in rollup.order_statistic_spread(df, ["k"], "v").collect()} == {1: 40.0, 2: 0.0}
    assert {r["k"]: r["m"] for r in rollup.medians(df, ["k"], {"v": "m"}).collect()} == {1: 3.0, 2: 5.0}


def test_speaker_table(talk):
    segs = talk.withColumn("words", text.word_count(F.col("text"))).withColumns({"arousal": F.lit(0.5), "emotion_top": F.lit("calm"), "loudness_rms": F.col("ord") * 1.0, "pause_time_s": F.lit(0.1), "pause_count": F.lit(1)})
    found = {(r["file_id"], r["speaker"]): r for r in rollup.speakers(segs, overlap.interruption_map(talk)).collect()}
    assert found[1, "b"]["words"] == 5 and found[1, "b"]["emotion_top"] == "calm" and found[1, "b"]["avg_arousal"] == 0.5 and found[1, "b"]["pause_count"] == 2
    assert rollup.lead_speaker(segs).where("file_id = 1").first()["speaker"] == "c"
    assert rollup.keep_top_speakers(segs, 1).where("file_id = 1").select("speaker").distinct().collect()[0][0] == "c"


def test_segment_schema(spark):
    row = segments.complete(spark.createDataFrame([("f", 0.0, 1.0, "s")], "file_id string, start double, end double, speaker_id string"))
    assert row.columns == list(segments.SEGMENT_COLUMNS) and len(row.columns) == 39
    first = row.first()
    assert (first["events_top3_json"], first["low_confidence_ser"], first["error_flags"], first["noise_tag"], first["words"]) == ("[]", False, "", None, None)
    odd = segments.normalise_input(spark.createDataFrame([("f", "1.5", None, "")], "file_id string, start_time string, end_time string, speaker string")).first()
    assert tuple(odd) == ("f", 1.5, 2.0, "Unknown")


def test_fallback_metrics(spark):
    df = spark.createDataFrame([(3, 3_000, None, None), (2, 900, "1.5", "0.25"), (4, 0, "nan", "7")], "w long, ms long, d string, p string")
    made = segments.fallback_metrics(F.col("w"), F.col("ms"), {"duration_s": F.col("d"), "pause_ratio": F.col("p")})
    found = [(r["duration_s"], r["words"], r["pause_ratio"]) for r in df.select(*[v.alias(k) for k, v in made.items()]).collect()]
    assert found == [(3.0, 3, 0.0), (1.5, 2, 0.25), (0.0, 4, 1.0)]


def test_overlaps_are_split_in_order(spark):
    rng = random.Random(8)
    rows = [(f, k, s, s + rng.randint(0, 3_000)) for f in range(4) for k, s in enumerate(rng.randint(0, 20_000) for _ in range(25))]
    want = []
    for f in range(4):
        done = []
        for s, k, e in sorted((s, k, e) for g, k, s, e in rows if g == f and e - s >= 50):
            if done and s < done[-1][3]:
                s = done[-1][3] = (done[-1][3] + s) // 2
            if e - s >= 50:
                done.append([f, k, s, e])
        want += [tuple(d) for d in done]
    found = segments.split_overlaps(spark.createDataFrame(rows, "file_id long, ord long, start_ms long, end_ms long").repartition(3))
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)


def test_batches_fill_up(spark):
    rows = [(1, k, k * 10_000, k * 10_000 + d) for k, d in enumerate([4_000, 5_000, 2_000, 9_000, 500, 500, 500])]
    found = segments.pack_batches(spark.createDataFrame(rows, "file_id long, ord long, start_ms long, end_ms long"), 10_000, 3)
    assert [r["batch"] for r in found.orderBy("ord").collect()] == [0, 0, 1, 2, 2, 2, 3]


def test_words_are_shared_by_length(spark):
    spans = spark.createDataFrame([(1, 0, 0, 500), (1, 1, 500, 1_000), (1, 2, 1_000, 1_010), (1, 3, 1_010, 1_020)], "k long, ord long, start_ms long, end_ms long")
    texts = spark.createDataFrame([(1, "a b c d")], "k long, text string")
    assert [r["text"] for r in segments.share_words(spans, texts, "k").orderBy("ord").collect()] == ["a", "b", "c", "d"]


def test_fallback_rows(spark):
    files = spark.createDataFrame([(1, 900), (2, 500)], "file_id long, duration_ms long")
    turns = spark.createDataFrame([(1, 0, 10, "x")], "file_id long, start_ms long, end_ms long, speaker string")
    assert rows_of(segments.whole_file_turns(files, turns), "file_id") == [(1, 0, 10, "x"), (2, 0, 500, "Speaker_1")]
    texts = spark.createDataFrame([(2, "t")], "file_id long, text string")
    assert [r["text"] for r in segments.placeholders(files, texts, ["file_id"]).orderBy("file_id").collect()] == ["[Transcription unavailable]", "t"]


def test_windows_and_chunks(spark):
    span = spark.createDataFrame([(1, 0, 2_300)], "file_id long, start_ms long, end_ms long")
    assert [(r["win_start_ms"], r["win_end_ms"]) for r in intervals.windows_of(span, 1_500, 750, 600).orderBy("window").collect()] == [(0, 1_500), (750, 2_250), (1_500, 2_300)]
    assert [r["win_start_ms"] for r in intervals.windows_of(span, 1_000, 500, tail=True).orderBy("win_start_ms").collect()] == [0, 500, 1_000, 1_300]
    files = spark.createDataFrame([(1, 50_000), (2, 5_000)], "file_id long, duration_ms long")
    assert rows_of(intervals.chunks(files, 30_000, 20_000, 1_000), "file_id", "chunk")[:3] == [(1, 0, 0, 20_000, 0, 21_000), (1, 1, 20_000, 40_000, 19_000, 41_000), (1, 2, 40_000, 50_000, 39_000, 50_000)]


def test_text_features(spark):
    said = "Um, you know - I I I mean the cat-like dog... dog ran ran um ran; we - we will x they're"
    df = spark.createDataFrame([(said,), ("",), (None,)], "t string").withColumn("w", text.tokens(F.col("t")))
    got = df.select(F.col("w"), text.fillers(F.col("t"), F.col("w")).alias("f"), text.repetitions(F.col("w")).alias("r"), text.false_starts(F.col("t"), F.col("w")).alias("s"), text.word_count(F.col("t")).alias("n")).collect()
    assert got[0]["w"] == ["um", "you", "know", "i", "i", "i", "mean", "the", "cat-like", "dog", "dog", "ran", "ran", "um", "ran", "we", "we", "will", "they're"]
    assert (got[0]["f"], got[0]["r"]) == (4, 2)
    assert [tuple(r)[1:] for r in got[1:]] == [(0, 0, 0, 0)] * 2
    for word, n in {"cat": 1, "table": 1, "nation": 3, "a": 1, "queue": 1, "syllable": 2, "delicious": 4}.items():
        assert spark.range(1).select(text.syllables(F.lit(word))).first()[0] == n, word
    one = spark.range(1).select(text.clock(F.lit(3_725_900)), text.clock(F.lit(3_725_900), True), text.intent_label(F.lit(" Status Update ")), text.display_name(F.lit(" "), F.lit(3)), text.preview(F.lit("x" * 120)), text.backchannel(F.lit("Uh-huh!"), F.lit(200)), text.backchannel(F.lit("ohh"), F.lit(200)), text.backchannel(F.lit("ohh"), F.lit(2_000))).first()
    assert tuple(one) == ("1:02:05", "1:02:06", "status", "Speaker 3", "x" * 100 + "...", 1.0, 0.7, None)
    maps = spark.createDataFrame([('{"a": 1.5}',), ("Dog=2, cat=x",)], "t string").select(text.duration_map(F.col("t")).alias("m")).collect()
    assert [r["m"] for r in maps] == [{"a": 1.5}, {"dog": 2.0, "cat": None}]


def test_distributions(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], {"Joy": 0.2, "anger": -1.0, "what": 0.3, "x": float("nan")})], "v array<double>, m map<string,double>")
    row = df.select(numbers.softmax(F.col("v")).alias("s"), numbers.entropy(F.array(F.lit(0.5), F.lit(0.5))).alias("e"), numbers.normal_entropy(F.array(F.lit(0.5), F.lit(0.5))).alias("n"), numbers.top_margin(F.array(F.lit(0.7), F.lit(0.1))).alias("g"), numbers.low_confidence(F.array(F.lit(0.9), F.lit(0.1))).alias("c"), numbers.shares(F.col("m"), ["neutral", "joy", "anger"]).alias("h"), numbers.top_k(F.col("m"), 2).alias("k")).first()
    e = np.exp([1, 2, 3])
    assert row["s"] == pytest.approx(list(e / e.sum())) and row["e"] == pytest.approx(math.log(2)) and row["n"] == pytest.approx(1) and row["g"] == pytest.approx(0.6) and row["c"] is False
    assert row["h"] == pytest.approx([0.6, 0.4, 0.0]) and [x["label"] for x in row["k"]] == ["what", "Joy"]


def test_tuner_cases(spark):
    given = [F.lit(x) for x in (0.3, 0.8, 0.4, 0.1, 1, 0.5)]
    low = spark.range(1).select(*[v.alias(k) for k, v in numbers.tune(F.lit(4.0), F.lit(0.4), F.lit(20.0), F.lit(False), *given).items()]).first()
    assert low["vad_threshold"] < 0.25 and low["beam_size"] == 2
    still = spark.range(1).select(*[v.alias(k) for k, v in numbers.tune(F.lit(20.0), F.lit(0.8), F.lit(20.0), F.lit(False), *given).items()]).first()
    assert still["vad_min_silence_sec"] >= 0.6 and still["no_speech_threshold"] >= 0.55


def test_identity(spark, monkeypatch):
    rng = np.random.default_rng(0)
    centers = rng.normal(size=(5, 8))
    rows = [(k, k % 5, [float(x) for x in centers[k % 5] + 0.05 * rng.normal(size=8)]) for k in range(60)]
    df = spark.createDataFrame(rows, "id long, label long, v array<float>").repartition(4)
    names = identity.centroids(df, "label", "v").select(F.concat(F.lit("n"), "label").alias("name"), "centroid")
    found = identity.match(df, names, "id", "v").collect()
    assert all(r["name"] == f"n{r['id'] % 5}" and r["assigned"] and r["similarity"] > 0.9 for r in found) and len(found) == 60
    monkeypatch.setattr(identity, "BROADCAST_NAMES", 2)
    assert {(r["id"], r["name"]) for r in identity.match(df, names, "id", "v").collect()} == {(r["id"], r["name"]) for r in found}
    clusters = identity.cluster(df.withColumn("f", F.lit(1)), "f", "id", "v", 0.15).collect()
    assert len({(r["id"] % 5, r["cluster"]) for r in clusters}) == 5
    assert len({r["cluster"] for r in identity.cluster(df.withColumn("f", F.lit(1)), "f", "id", "v", clusters=3).collect()}) == 3
    moved = {r["label"]: r for r in identity.moving_centroids(df, "label", "id", "v").collect()}
    c = None
    for _, label, v in rows:
        if label == 2:
            x = np.array(v)
            c = x / np.linalg.norm(x) if c is None else (0.7 * c + 0.3 * x) / np.linalg.norm(0.7 * c + 0.3 * x)
    assert moved[2]["samples"] == 12 and moved[2]["centroid"] == pytest.approx(list(c), abs=1e-6)
    assert spark.range(1).select(vectors.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(2.0), F.lit(0.0)))).first()[0] == pytest.approx(1)


def test_models_plug_in(spark):
    def make():
        return lambda frame: frame.assign(score=frame["id"] * 2.0)

    assert identity.infer(spark.range(5), make, "id long, score double", batch=2).agg(F.sum("score")).first()[0] == 20
