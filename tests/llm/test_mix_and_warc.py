"""Mixing by min-cost flow and WARC archives."""

from __future__ import annotations

import hashlib
import random
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from parley.llm import mixing, warc

from .conftest import edge_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_targets_stop_and_share_the_excess():
    found = mixing.fill_targets({"a": 10, "b": 100, "c": 100}, {"a": 3, "b": 1, "c": 2}, Fraction(315), 2)
    assert found == {"a": 20, "b": Fraction(295, 3), "c": Fraction(590, 3)}
    assert mixing.fill_targets({"a": 1, "b": 1}, {"a": 1, "b": 1}, Fraction(100), 2) == {"a": 2, "b": 2}
    assert mixing.fill_targets({}, {}, Fraction(0), 2) == {}


def brute_cost(capacity, quotas, most):
    """Least cost of the largest flow by trying all splits of small networks."""
    from itertools import product

    patterns = list(capacity)
    options = []
    for p in patterns:
        options.append([x for x in product(*[range(most * capacity[p] + 1)] * len(p)) if sum(x) <= most * capacity[p]])
    best = None
    for choice in product(*options):
        got = dict.fromkeys(quotas, 0)
        cost = 0
        for p, x in zip(patterns, choice):
            for s, v in zip(p, x):
                got[s] += v
            full, rest = divmod(sum(x), capacity[p])
            cost += capacity[p] * full * full + rest * (2 * full + 1)
        if all(got[s] <= quotas[s] for s in quotas):
            key = (-sum(got.values()), cost)
            best = key if best is None or key < best else best
    return best


def test_flow_is_largest_and_cheapest():
    rng = random.Random(3)
    for _ in range(12):
        capacity = {("a",): rng.randint(1, 2), ("b",): rng.randint(1, 2), ("a", "b"): rng.randint(1, 2)}
        quotas = {"a": rng.randint(0, 6), "b": rng.randint(0, 6)}
        flow = mixing.least_cost_flow(capacity, quotas, 2)
        cost = 0
        for p, c in capacity.items():
            sent = sum(v for (q, _), v in flow.items() if q == p)
            full, rest = divmod(sent, c)
            cost += c * full * full + rest * (2 * full + 1)
            assert sent <= 2 * c
        for s in quotas:
            assert sum(v for (_, t), v in flow.items() if t == s) <= quotas[s]
        assert (-sum(flow.values()), cost) == brute_cost(capacity, quotas, 2)


def test_standing_mix(edge_docs, no_docs):
    rows = mixing.mix_documents(edge_docs).collect()
    assert len(rows) == len(edge_rows())
    taken, target, size = {}, {}, {}
    for r, row in zip(sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"])), sorted(edge_rows(), key=lambda r: (r[0] is None, r[0]))):
        assert r["size"] == len(WORD.findall(row[1] or "")) and 0 <= r["taken"] <= 2 * r["size"]
        taken[row[3]] = taken.get(row[3], 0) + r["taken"]
        size[row[3]] = size.get(row[3], 0) + r["size"]
        target[row[3]] = r["target"]
        assert target[row[3]] == r["target"]
    assert all(abs(taken[s] - target[s]) <= 2 for s in target)
    assert target == {s: float(t) for s, t in mixing.production_targets(size).items()}
    again = mixing.mix_documents(edge_docs.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))
    assert mixing.mix_documents(no_docs).count() == 0


def test_overlapping_sources(spark):
    rows = [(i, [["a"], ["b"], ["a", "b"], []][i % 4], 10 + i % 7) for i in range(400)]
    sized = spark.createDataFrame(rows, "id long, members array<string>, size long")
    words = {k: sum(r[2] for r in rows if tuple(r[1]) == k) for k in (("a",), ("b",), ("a", "b"))}
    quotas = {"a": 2_500, "b": 700}
    found = mixing.mix(sized, quotas, seed=5).collect()
    assert sum(r["taken"] for r in found) == sum(quotas.values()) and words[("a",)] < 2_500
    assert all(r["taken"] == 0 for r in found if not r["members"])
    assert {r["id"]: r["taken"] for r in found} != {r["id"]: r["taken"] for r in mixing.mix(sized, quotas, seed=6).collect()}


def test_mixed_rows_keep_columns(edge_docs, no_docs):
    found = mixing.mixed_documents(edge_docs)
    assert found.columns == edge_docs.columns
    per = {r["doc_id"]: r["count"] for r in found.groupBy("doc_id").count().collect()}
    assert max(per.values()) <= 4  # an id that stands twice may come twice as often
    assert mixing.mixed_documents(no_docs).count() == 0


def test_equal_draws_share_the_rest(spark):
    sized = spark.createDataFrame([(7, ["a"], 10)] * 9, "id long, members array<string>, size long")
    assert sum(r["taken"] for r in mixing.mix(sized, {"a": 45}).collect()) == 45


def test_chunked_framing():
    for size in (0, 1, 4_095, 4_096, 9_000):
        payload = bytes(range(256)) * 40
        assert warc.unchunked(warc.chunked(payload[:size])) == payload[:size]
    assert warc.unchunked(b"3;x=1\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    for broken in (b"5\r\nabc\r\n0\r\n\r\n", b"3\r\nabc\r\n"):
        with pytest.raises(ValueError):
            warc.unchunked(broken)


def pages(spark):
    long = "<p>" + "words é " * 20_000 + "</p>"
    rows = [(3, "http://a/1", long), (1, "http://a/2", long), (2, None, "short"), (4, "http://b\r\nX: y", "short"), (5, "u", None), (6, "u", ""), (7, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 20), (8, "u", "x" * 100), (9, "u", "x" * 100), (10, "u", "y" * 99), (11, "u", "y" * 99), (None, "u", "x" * 100), (12, "u", "z" * 40_000), (12, "u", "z" * 40_000)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)), rows


def test_archives_round_trip(spark, tmp_path):
    frame, rows = pages(spark)
    warc.write_archives(frame, str(tmp_path / "w"))
    back = warc.read_archives(spark, str(tmp_path / "w")).collect()
    assert len(back) == len(rows)
    whole = {(r["page_id"], bytes(r["payload"])) for r in back if r["record_type"] == "response"}
    full = {(None if i is None else str(i), (h or "").encode()) for i, _, h in rows if not (i == 3 or i == 9)}
    assert whole == full
    assert all(hashlib.sha256(r["payload"]).hexdigest() == r["digest"] for r in back if r["payload"] is not None)


def test_pages_are_described(spark):
    frame, rows = pages(spark)
    found = sorted(warc.archive_pages(frame).collect(), key=lambda r: (r["page_id"] is None, r["page_id"]))
    want = []
    for i, _, h in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        data = (h or "").encode()
        first = min((j for j, _, g in rows if j is not None and (g or "") == (h or "")), default=None)
        again = len(data) >= 100 and i is not None and i != first
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None))
    assert [tuple(r) for r in found] == want
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archive_pages(empty).count() == 0


def test_missing_or_short_segments_are_told(spark, tmp_path):
    made = list(warc.records(1, "u", b"x" * 90_000, "d", None, segment=40_000))
    assert len(made) == 3
    heads = [(warc.parse(r).__next__()) for r in made]
    row = lambda h, b: {"number": int(h["warc-segment-number"]), "record_id": h["warc-record-id"], "record_type": h["warc-type"], "page_id": None, "url": None, "digest": "", "refers_to": None, "total": int(h.get("warc-segment-total-length", -1)), "block": b}
    parts = [row(h, b) for h, b in heads]
    assert warc._joined(parts)[0][-1] == b"x" * 90_000
    with pytest.raises(ValueError):
        warc._joined([parts[0], parts[2]])
    with pytest.raises(ValueError):
        warc._joined([parts[0], parts[1] | {"block": b"x"}, parts[2]])
