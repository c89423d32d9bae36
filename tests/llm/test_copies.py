"""Exact classes, near copies and repeated passages against plain loops."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley import storage
from parley.llm import bwt_merge, exact_dedup, shared, sketch_join

from .conftest import SPACES, edge_rows, words

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def clean(text: str | None) -> str:
    return re.sub(SPACES, " ", text or "")


@pytest.mark.parametrize("content_hash", [F.md5, lambda c: F.length(c).cast("string")], ids=["md5", "colliding"])
def test_exact_classes(edge_docs, content_hash):
    rows = edge_rows()
    found = exact_dedup.exact_classes(edge_docs, content_hash=content_hash).collect()
    assert len(found) == len(rows)
    by_text: dict[str, list] = {}
    for r in rows:
        by_text.setdefault(clean(r[1]), []).append(r[0])
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): (min((i for i in ids if i is not None), default=None), len(ids)) for t, ids in by_text.items()}
    for r in found:
        keep, size = by_sha[r["text_sha256"]]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (keep, size, r["doc_id"] == keep)


def test_exact_classes_of_nothing(no_docs):
    assert exact_dedup.exact_classes(no_docs).count() == 0
    assert exact_dedup.drop_exact_copies(no_docs).count() == 0


def test_drop_keeps_one_row_of_each_text(edge_docs):
    kept = exact_dedup.drop_exact_copies(edge_docs)
    assert kept.columns == edge_docs.columns
    texts = [clean(r["text"]) for r in kept.collect()]
    assert sorted(texts) == sorted({clean(r[1]) for r in edge_rows()})


def shingle_set(text: str | None, width: int) -> frozenset:
    w = [x for x in re.split(SPACES, (text or "").translate(LOW)) if x]
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def plain_groups(rows: list[tuple], width: int, percent: int) -> dict:
    own = [(r[0], shingle_set(r[1], width)) for r in rows if r[0] is not None]
    up = {i: i for i, _ in own}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, x in own:
        for b, y in own:
            if a < b and x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = top(a), top(b)
                up[max(p, q)] = min(p, q)
    return {i: top(i) for i in up}


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80), (1, 50)])
def test_near_groups_equal_all_pairs(edge_docs, width, percent):
    rows = edge_rows()
    want = plain_groups(rows, width, percent)
    found = sketch_join.near_groups(edge_docs, width, percent).collect()
    assert len(found) == len(rows)
    sizes = sorted((r[0] or -1, len(shingle_set(r[1], width))) for r in rows)
    assert sorted((r["doc_id"] or -1, r["n_shingles"]) for r in found) == sizes
    assert all(r["component_id"] == (want[r["doc_id"]] if r["doc_id"] is not None else None) for r in found)


def test_near_groups_of_nothing(no_docs):
    assert sketch_join.near_groups(no_docs).count() == 0
    assert sketch_join.one_of_each_group(no_docs).count() == 0


def test_chains_link_across_components(spark):
    """A chain whose ends are far apart, and texts that share single words of their sketches only."""
    base = [f"w{i}" for i in range(200)]
    rows = [(k, " ".join(base[k * 6 : k * 6 + 110]), None, None, None) for k in range(14)]
    rows += [(50 + k, " ".join(base[:20] + [f"x{k}_{i}" for i in range(60)]), None, None, None) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = plain_groups(rows, 4, 85)
    assert {r["doc_id"]: r["component_id"] for r in sketch_join.near_groups(docs).collect()} == want


def test_linked_sets_share_a_word_key():
    rng = np.random.default_rng(0)
    low = sketch_join.bands(85)
    for _ in range(400):
        n = int(rng.integers(1, 400))
        common = rng.integers(0, 2**63, n).astype(np.uint64)
        most = int((2 * n) * 15 / (100 - 15))
        k = int(rng.integers(0, most + 1))
        a = np.unique(np.concatenate([common, rng.integers(0, 2**63, k // 2).astype(np.uint64)]))
        b = np.unique(np.concatenate([common, rng.integers(0, 2**63, k - k // 2).astype(np.uint64)]))
        inter = len(np.intersect1d(a, b))
        if 100 * inter >= 85 * (len(a) + len(b) - inter):
            assert set(sketch_join._keys(a, 85).tolist()) & set(sketch_join._keys(b, 85).tolist())
            x, y = sketch_join.sketch(a, 16), sketch_join.sketch(b, 16)
            assert np.bitwise_count(x ^ y).sum() <= len(a) + len(b) - 2 * inter
    assert (low[1:] * 85 >= low[:-1] * 100 - 99).all()


def test_components_of_long_paths(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 120)] + [(300, 301), (301, 302), (500, 500)], "a long, b long")
    found = {r["id"]: r["component"] for r in shared.components(edges).collect()}
    assert all(found[i] == 0 for i in range(121)) and found[302] == 300 and 500 not in found
    assert shared.components(edges.where("false")).count() == 0


def plain_removal(rows: list[tuple]) -> dict:
    last = 1 << 63
    order = sorted(range(len(rows)), key=lambda k: (last if rows[k][0] is None else rows[k][0], (rows[k][1] or "").encode()))
    seen, out = set(), {}
    for k in order:
        data = (rows[k][1] or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - 99):
            s = data[p : p + 100]
            if s in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(s)
        kept = bytes(c for c, g in zip(data, gone) if not g)
        spans = sum(1 for p in range(len(data)) if gone[p] and not (p and gone[p - 1]))
        out.setdefault(rows[k][0], []).append((len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return {i: sorted(v) for i, v in out.items()}


@pytest.mark.parametrize("shard_bytes", [4_000_000, 20_000])
def test_repeats_equal_all_strings(spark, edge_docs, shard_bytes):
    rows = edge_rows()
    rows += [(300, "a" * 450, None, None, None), (301, "b" * 150 + "a" * 130 + "c" * 20, None, None, None), (302, "q" * 100, None, None, None), (303, "q" * 99, None, None, None), (304, "\0" * 120 + "z", None, None, None), (305, "\0" * 130, None, None, None)]
    passage = rows[6][1][5_000:5_180]
    rows += [(310 + k, f"{k:03d}" * 20 + passage[k : 130 + k] + f"{k:02d}" * 30, None, None, None) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found: dict = {}
    for r in bwt_merge.remove_repeats(docs, shard_bytes=shard_bytes, part_anchors=500).collect():
        found.setdefault(r["doc_id"], []).append((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]))
    assert {i: sorted(v) for i, v in found.items()} == plain_removal(rows)


def test_repeats_of_nothing(no_docs):
    assert bwt_merge.remove_repeats(no_docs).count() == 0


def test_interleave_finds_strings_that_start_earlier():
    """Transforms of three shards merged: all strings of 100 symbols in the windows, against a plain table of them."""
    rng = np.random.default_rng(6)
    pool = [rng.integers(97, 100, 100 + bwt_merge.NEAR - 1) for _ in range(4)]
    windows = []
    for _ in range(90):
        w = pool[rng.integers(4)].copy()
        w[: rng.integers(0, 40)] = rng.integers(97, 100)
        w[len(w) - rng.integers(0, 40) :] = rng.integers(97, 100)
        windows.append(w)
    sizes, windows = [40, 1, 49], np.array(windows, np.uint8)
    near, rank = rng.integers(0, 30, 90), rng.permutation(90)
    far = near + rng.integers(0, 34, 90)
    shards = np.split(windows, np.cumsum(sizes)[:-1])
    for w in shards:  # a transform has the windows' symbols, place by place
        made = bwt_merge.transform(w.T.copy(), np.zeros(len(w), np.int64))
        assert (np.sort(made, axis=1) == np.sort(w.T, axis=1)).all()
    rows, back = bwt_merge.later_strings([bwt_merge.transform(w.T.copy(), np.zeros(len(w), np.int64)) for w in shards], near, far, rank)
    first: dict = {}
    strings = {(r, o): (o, windows[r][63 - o : 163 - o].tobytes()) for r in range(90) for o in range(near[r], far[r] + 1)}
    for (r, _), s in strings.items():
        first[s] = min(first.get(s, 1_000), rank[r])
    want = {(r, o) for (r, o), s in strings.items() if rank[r] > first[s]}
    assert want and set(zip(rows.tolist(), back.tolist())) == want and len(rows) == len(want)


@pytest.mark.parametrize("hot", [1, 3])
def test_hot_anchors_are_split(spark, hot):
    """A line that stands in most texts, with other text around it, is dealt out by what the strings share."""
    rng = random.Random(8)
    line = words(rng, 30)
    rows = [(k, " ".join((words(rng, rng.randint(0, 12)), line, words(rng, rng.randint(0, 3)), line[:80], words(rng, 9)))) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {}
    for r in bwt_merge.remove_repeats(docs, shard_bytes=1_500, part_anchors=300, hot=hot).collect():
        found.setdefault(r["doc_id"], []).append((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]))
    assert {i: sorted(v) for i, v in found.items()} == plain_removal(rows)
    assert sum(v[0][1] for v in found.values()) > 39 * 100


def test_text_ids_are_refused(spark):
    for run in (bwt_merge.remove_repeats,):
        with pytest.raises(TypeError):
            run(spark.createDataFrame([("d0", "x")], "doc_id string, text string"))


def test_written_tables_can_be_cleared(spark):
    shared.clear(spark)
    kept = shared.materialise(spark.range(3), "some")
    path = kept.inputFiles()[0]
    shared.clear(spark)
    import os

    assert not os.path.exists(path.removeprefix("file://")) and not storage._written


def test_many_rows_without_an_id(spark):
    rows = [(None, f"{k % 3} " + "same words over and over " * 10, None, None, None) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = bwt_merge.remove_repeats(docs, shard_bytes=2_000).collect()
    assert len(found) == 60 and sum(r["n_removed"] < r["n_bytes"] - 10 for r in found) <= 3
