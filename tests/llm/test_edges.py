"""Clashing column names, line labels within a text, rules against plain evaluation, archives of segments, odd pages."""

from __future__ import annotations

import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parley.llm import exact_dedup, host_paths, line_crf, mixing, rule_ensemble, sketch_join, warc
from parley.llm.statistics import LINE_FEATURES, STATISTICS, Texts

from .conftest import words
from .test_texts import poor

#: Names that the operators use inside.
INNER = ("label", "_id", "_size", "_draw", "_pattern", "_passes", "_copies", "_copy", "_part", "_of", "_all", "_cut", "_left", "_tied", "_gone", "gone", "c0", "c3", "hash", "clean", "row", "place", "key", "rep", "component", "quality", "features", "score")


def good(rng: random.Random, lines: int = 5) -> str:
    return "\n".join(words(rng, 20) + "." for _ in range(lines))


@pytest.fixture(scope="module")
def clashing(spark):
    rng = random.Random(3)
    rows = [(k, good(rng) if k % 2 else poor(k), "en", ["a", "b\x01c", None][k % 3], 1) for k in range(90)]
    rows += [(200 + k, rows[1][1] + f" {k % 3}", "en", "a", 1) for k in range(6)] + [(1, rows[1][1], "en", "a", 1)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for k, c in enumerate(INNER):
        docs = docs.withColumn(c, F.lit(1000 + k))
    docs = docs.withColumn("extra map", F.create_map(F.lit("k"), F.lit(1)))
    labels = docs.where("doc_id < 90").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), F.lit(5).alias("label"), F.lit(6).alias("_id"))
    return docs, labels, rows


def test_clashing_columns_come_back_unchanged(clashing):
    docs, labels, rows = clashing
    model = rule_ensemble.fit(docs, labels, rows=60)
    assert model.rules and line_crf.fit(docs, labels, documents=40) is not None
    assert rule_ensemble.score(docs, model).count() == line_crf.apply_rules(docs, None).count() == len(rows)
    for made in (rule_ensemble.keep_good(docs, model), exact_dedup.drop_exact_copies(docs), sketch_join.one_of_each_group(docs), mixing.mixed_documents(docs)):
        assert made.columns == docs.columns
        kept = made.collect()
        assert kept and all(r[c] == 1000 + k for r in kept for k, c in enumerate(INNER)) and all(r["extra map"] == {"k": 1} for r in kept)


def test_any_source_is_mixed(clashing):
    docs, _, rows = clashing
    found = mixing.mix_documents(docs).collect()
    taken = Counter()
    for r in found:
        taken[r["target"]] += r["taken"]
    assert all(abs(taken[r["target"]] - r["target"]) <= 3 for r in found) and len({r["target"] for r in found}) == 3


def test_too_many_patterns_are_refused(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_NODES", 3)
    docs = spark.range(5).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), F.col("id").cast("string").alias("source"))
    with pytest.raises(ValueError):
        mixing.mix_documents(docs)


def test_labelled_rows_are_bounded(clashing):
    docs, labels, _ = clashing
    assert rule_ensemble.labelled_sample(docs.unionByName(docs).unionByName(docs), labels, 10).count() == 20


# --- line labels ------------------------------------------------------------------------------------------------------


def test_gradient_equals_differences():
    rng = np.random.default_rng(4)
    size = np.array([6, 4, 1])
    x, y = rng.random((6, 3, 3)), rng.integers(0, 2, (6, 3))
    line, step, part = rng.normal(size=(3, 2)), rng.normal(size=(2, 2)), np.array([0.2, 0.5, 0.3])
    value = lambda a, b: line_crf.likelihood(a, b, x, y, size, part, 0.05)[0]
    _, up_line, up_step = line_crf.likelihood(line, step, x, y, size, part, 0.05)
    for which, up in ((line, up_line), (step, up_step)):
        for at in np.ndindex(which.shape):
            shift = np.zeros_like(which)
            shift[at] = 1e-5
            pair = [(line + d * shift, step) if which is line else (line, step + d * shift) for d in (1, -1)]
            assert (value(*pair[0]) - value(*pair[1])) / 2e-5 == pytest.approx(up[at], abs=1e-6)


def test_likelihood_equals_enumeration():
    from itertools import product

    rng = np.random.default_rng(5)
    x, y, line, step = rng.random((5, 1, 3)), rng.integers(0, 2, (5, 1)), rng.normal(size=(3, 2)), rng.normal(size=(2, 2))
    score = lambda path: sum(x[t, 0] @ line[:, k] for t, k in enumerate(path)) + sum(step[a, b] for a, b in zip(path, path[1:]))
    want = score(y[:, 0]) - np.log(sum(np.exp(score(p)) for p in product((0, 1), repeat=5)))
    assert line_crf.likelihood(line, step, x, y, np.array([5]), np.ones(1), 0.0)[0] == pytest.approx(want)


def test_half_of_a_text_is_content(spark):
    rng = random.Random(6)
    docs = spark.createDataFrame([(k, good(rng) if k % 2 else poor(k)) for k in range(240)], "doc_id long, text string")
    model = line_crf.fit(docs, docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality")), documents=60)
    halves = []
    for k in range(40):
        lines = [f"{'BUY!! ' * 3}{k} {i} | menu | $$$ {words(rng, 10).upper()}" for i in range(6)]
        content = [words(rng, 16 + i) + "." for i in range(6)]
        both = [content, lines] if k % 2 else [lines, content]
        halves.append((k, "\n".join(both[0] + both[1])))
    for r in line_crf.apply_rules(spark.createDataFrame(halves, "doc_id long, text string"), model).collect():
        assert 0.25 < r["content_share"] < 0.75, r


def test_line_field_agrees_on_rows_it_has_not_seen(spark):
    folder = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = line_crf.fit(docs, labels)
    found = line_crf.apply_rules(docs, model).where("not base_failed").join(labels, "doc_id").where(rule_ensemble.held_out(F.col("doc_id")))
    rows = found.select("kept", "quality").collect()
    assert rows and sum(r["kept"] == (r["quality"] == 1) for r in rows) >= 0.8 * len(rows)


# --- rules ------------------------------------------------------------------------------------------------------------


def test_rules_equal_plain_evaluation(spark, clashing):
    """The JVM expression against a loop over the rules; the lasso's weights against the conditions of its optimum."""
    docs, labels, rows = clashing
    model = rule_ensemble.fit(docs, labels, rows=60)
    stats = Texts(pa.array([t or "" for _, t, *_ in rows])).statistics()
    want = Counter()
    for k, (i, *_) in enumerate(rows):
        total = model.bias
        for conditions, weight in model.rules:
            if all((stats[name][k] <= bound) == at_most for name, at_most, bound in conditions):
                total += weight
        want[i, round(1 / (1 + np.exp(-total)), 9)] += 1
    assert Counter((r["doc_id"], round(r["score"], 9)) for r in rule_ensemble.score(docs, model).collect()) == want
    assert all(name in STATISTICS for conditions, _ in model.rules for name, _, _ in conditions)


def test_lasso_reaches_its_optimum():
    rng = np.random.default_rng(8)
    z = (rng.random((400, 12)) < 0.4).astype(float)
    y = (z[:, 0] + 0.5 * z[:, 1] + 0.3 * rng.random(400) > 0.8).astype(float)
    part, lasso = np.full(400, 1 / 400), 5e-3
    weight, bias = rule_ensemble._lasso(z, y, part, lasso, 4_000)
    slope = z.T @ (part * (1 / (1 + np.exp(-(z @ weight + bias))) - y))
    assert np.allclose(slope[weight != 0], -lasso * np.sign(weight[weight != 0]), atol=1e-4)
    assert (np.abs(slope[weight == 0]) <= lasso + 1e-4).all() and 0 < (weight != 0).sum() < 12


def test_first_split_is_the_best_of_all():
    rng = np.random.default_rng(9)
    x, y = rng.integers(0, 20, (120, 4)), rng.normal(size=120)
    y[x[:, 2] > 11] += 2
    found: list = []
    rule_ensemble._grow(x, y, np.arange(120), 1, (), found, 5)
    gains = {}
    for j in range(4):
        for k in range(20):
            a, b = y[x[:, j] <= k], y[x[:, j] > k]
            if len(a) >= 5 and len(b) >= 5:
                gains[j, k] = len(a) * a.mean() ** 2 + len(b) * b.mean() ** 2
    (j, low, k), = found[0]
    assert low and gains[j, k] == pytest.approx(max(gains.values())) and found[1] == ((j, False, k),)


# --- archives -----------------------------------------------------------------------------------------------------------


def test_a_fifth_of_the_pages_comes_in_segments(spark, tmp_path):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    warc.write_archives(pages, str(tmp_path / "w"))
    heads = [h for r in spark.read.format("binaryFile").load(str(tmp_path / "w")).collect() for h, _ in warc.parse(warc.unpacked(r["content"]))]
    first = [h for h in heads if h.get("warc-segment-number") == "1"]
    assert len(first) >= pages.count() / 5 and sum(h["warc-type"] == "continuation" for h in heads) >= len(first)


def test_rows_without_an_id_and_odd_ids(spark):
    rows = [(None, "u", "q" * 5_000)] * 3 + [(" a\r\nX: y", "u", "q" * 6_000), ("é%41", "u", "z"), ("é%41", "u", "z" * 9_000)]
    found = warc.archive_pages(spark.createDataFrame(rows, "page_id string, url string, html string")).collect()
    assert sorted((r["page_id"] or "", r["payload_bytes"]) for r in found) == sorted((i or "", len(h)) for i, _, h in rows)


# --- pages ----------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ('<div class="content has-sidebar"><p>one</p><p>two</p></div>', "one\ntwo"), ('<article class="post comment-open"><p>text</p></article>', "text"),
        ('<article class="post category-social"><p>text</p></article>', "text"), ('<p title="the hidden truth">seen</p>', "seen"), ('<p hidden>no</p><p>yes</p>', "yes"),
        ('<div class="md:block hidden lg:flex"><p>seen</p></div>', "seen"), ("<article><p>a <math><mi>x</mi></math> b</p></article>", "a x b"),
        ('<article><div class="share-box"><p>whole text here</p></div><div class="share">x</div></article>', "whole text here"),
        ('<article><p>short</p><section class="comments"><p>a much longer comment</p></section></article>', "short"), ('<p aria-hidden="TRUE">no</p><p>yes</p>', "yes"),
    ],
)
def test_no_article_is_lost(html, text):
    assert host_paths.main_text(html) == text


@pytest.mark.parametrize("part", ["<div>x", "<span>x", "<div><span>", "<p title='>x", "<a ", "<!-", "<li>", "</b><i>"])
def test_broken_pages_take_linear_time(part):
    start = time.process_time()
    host_paths.main_text(part * (250_000 // len(part)))
    assert time.process_time() - start < 20


def plain_vote(pages: list[tuple]) -> dict:
    """Host votes counted in plain Python, each page read on its own."""
    votes: dict = {}
    for _, url, html in pages:
        page = host_paths.Page(html)
        best = page.best()
        if page.text({best}):
            host = url.split("/")[2].lower()
            n, chars = votes.setdefault(host, {}).get(page.path(best), (0, 0))
            votes[host][page.path(best)] = (n + 1, chars + len(page.text({best})))
    return {h: min(v, key=lambda p: (-v[p][0], -v[p][1], p)) for h, v in votes.items()}


def test_hosts_vote_where_it_matters(spark):
    """Pages whose own best container is another one take the path that their host's other pages agree on."""
    rng = random.Random(11)
    pages = []
    for k in range(60):
        side = "" if k % 5 else f"<div class='box'><p>{words(rng, 90)}</p></div>"
        body = f"<div class='text-{k}'><p>{words(rng, 20 if not k % 5 else 60)}</p><p>{words(rng, 8)}</p></div>"
        links = "".join(f"<a href=x>{words(rng, 3)}</a> " for _ in range(9))
        pages.append((k, f"http://H{k % 2}.example/{k}", f"<html><body><div class='list'>{links}</div>{body}{side}</body></html>"))
    found = {r["page_id"]: r["text"] for r in host_paths.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    winners, changed = plain_vote(pages), 0
    for i, url, html in pages:
        page = host_paths.Page(html)
        want = page.text(page.at(winners[url.split("/")[2].lower()])) or page.text({page.best()})
        assert found[i] == want
        changed += want != page.text({page.best()})
    assert changed and len(LINE_FEATURES) > 10
