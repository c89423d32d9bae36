"""Folds over long keys, pooled merges and clustering against plain loops."""

from __future__ import annotations

import random

import numpy as np
import pytest

from parley.operators import folds, identity, overlap, segments


def test_long_keys_fold_in_order(spark):
    rng = random.Random(2)
    rows, at = [], 0
    for k in range(10_000):
        at = max(0, at + rng.randint(-300, 900))
        rows.append((1, k, at, at + rng.randint(0, 900)))
    rows += [(2, 0, 5, 900), (None, 0, 0, 100)]
    frame = spark.createDataFrame(rows, "file_id long, ord long, start_ms long, end_ms long").repartition(5)
    kept: list[list] = []
    for _, number, start, end in sorted((r for r in rows if r[0] == 1 and r[3] - r[2] >= 50), key=lambda r: (r[2], r[1])):
        if kept and start < kept[-1][2]:
            start = kept[-1][2] = (kept[-1][2] + start) // 2
        if end - start >= 50:
            kept.append([number, start, end])
    found = sorted((r["ord"], r["start_ms"], r["end_ms"]) for r in segments.split_overlaps(frame).where("file_id = 1").collect())
    assert found == sorted(map(tuple, kept)) and segments.split_overlaps(frame).where("file_id is null").count() == 1
    batch, ms, n, want = 0, 0, 0, {}
    for _, number, start, end in sorted((r for r in rows if r[0] == 1), key=lambda r: (r[2], r[1])):
        if n and (ms + end - start > 60_000 or n >= 40):
            batch, ms, n = batch + 1, 0, 0
        ms, n, want[number] = ms + end - start, n + 1, batch
    assert {r["ord"]: r["batch"] for r in segments.pack_batches(frame, 60_000, 40).where("file_id = 1").collect()} == want


def test_neighbours_pool_their_vectors(spark):
    rows = [("f", 0, 1_000, "a", [1.0, 0.0]), ("f", 1_500, 2_500, "a", [0.0, 1.0]), ("f", 2_600, 2_700, "b", None), ("f", 9_000, 9_500, "b", [2.0, 0.0]), ("g", 0, 10, None, None)]
    found = folds.pooled_neighbours(spark.createDataFrame(rows, "file_id string, start_ms long, end_ms long, speaker string, embedding array<double>")).collect()
    got = {(r["file_id"], r["start_ms"]): r for r in found}
    assert len(got) == 4 and (got["f", 0]["end_ms"], got["f", 0]["n_spans"]) == (2_500, 2)
    assert got["f", 0]["embedding"] == pytest.approx([2**-0.5, 2**-0.5]) and got["f", 9_000]["embedding"] == [2.0, 0.0]


@pytest.mark.parametrize("clusters", [None, 3])
def test_chains_find_the_average_linkage(clusters):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 6)) + 3 * rng.normal(size=(5, 6))[rng.integers(5, size=40)]
    groups = [[k] for k in range(40)]
    unit = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-9)
    far = 1 - unit @ unit.T
    while len(groups) > (clusters or 1):
        d, i, j = min((far[np.ix_(a, b)].mean(), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        if clusters is None and d > 0.4:
            break
        groups[i] += groups.pop(j)
    label = identity._average_linkage(x, 0.4, clusters)
    assert {frozenset(g) for g in groups} == {frozenset(np.flatnonzero(label == k).tolist()) for k in set(label.tolist())}
    assert label[0] == 0 and sorted(set(label.tolist())) == list(range(len(groups)))


def test_interruptions_from_one_pass(spark):
    rng = random.Random(5)
    rows = [(k % 3, k, rng.choice("abc"), at := rng.randint(0, 40) * 100, at + rng.randint(0, 9) * 100) for k in range(90)]
    frame = spark.createDataFrame(rows, "file_id long, ord long, speaker string, start_ms long, end_ms long")
    want = overlap.merge_interruptions(overlap.overlap_by_speaker(frame), overlap.interruptions(frame))
    assert sorted(map(tuple, overlap.interruption_map(frame).collect())) == sorted(map(tuple, want.collect())) and want.where("made > 0").count()
