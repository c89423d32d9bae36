"""Statistics, quality classifier and line labelling against plain loops."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parley.llm import line_crf, rule_ensemble
from parley.llm.statistics import LINE_FEATURES, Texts

from .conftest import edge_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text: str | None) -> tuple:
    text = text or ""
    w = WORD.findall(text)
    three = Counter(zip(w, w[1:], w[2:]))
    inside = {i + k for i in range(len(w) - 2) if three[tuple(w[i : i + 3])] > 1 for k in range(3)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), again, len(inside)


def test_counts_equal_plain_loops():
    texts = [r[1] for r in edge_rows()] + ["a b c a b c\n\nx\nx\n", "\n", "x\n x\nx ", "# |<> *\n# |<> *"]
    found = Texts(pa.array(texts)).counts()
    for k, text in enumerate(texts):
        assert tuple(int(found[c][k]) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == counts(text)


def test_line_rules_cover_edge_cases(spark, edge_docs, no_docs):
    found = line_crf.apply_rules(edge_docs, None).collect()
    assert len(found) == edge_docs.count()
    for row in found:
        if row["doc_id"] in (4, 5, 6):
            assert (row["n_words"], row["base_failed"], row["kept"]) == (0, True, False)
        assert row["base_failed"] == (row["n_words"] < 50 or 100 * row["n_repeat_words"] > 50 * row["n_words"])
    assert line_crf.apply_rules(no_docs, None).count() == 0
    assert line_crf.fit(no_docs, spark.createDataFrame([], "doc_id long, quality int")) is None


def test_viterbi_equals_enumeration():
    from itertools import product

    rng = np.random.default_rng(1)
    model = line_crf.LineField(rng.normal(size=(len(LINE_FEATURES), 2)), rng.normal(size=(2, 2)))
    lengths = np.array([3, 1, 5, 0, 2])
    features = rng.random((lengths.sum(), len(LINE_FEATURES))) < 0.4
    got, at = model.decode(features, lengths), 0
    for n in lengths:
        score = features[at : at + n] @ model.line
        best = max(product((0, 1), repeat=n), key=lambda y: sum(score[t, y[t]] for t in range(n)) + sum(model.step[y[t], y[t + 1]] for t in range(n - 1)))
        assert tuple(got[at : at + n]) == best
        at += n


def poor(k: int) -> str:
    return "\n".join("BUY!! NOW!! | menu | $$$" for _ in range(12)) + f" {k}"


@pytest.fixture(scope="module")
def labelled(spark):
    from .conftest import words
    import random

    rng = random.Random(9)
    rows = [(k, "\n".join(words(rng, 20) + "." for _ in range(5)) if k % 2 else poor(k), "en", "a", 1) for k in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    return docs, labels


def test_line_field_tells_boilerplate(labelled):
    docs, labels = labelled
    model = line_crf.fit(docs, labels, documents=60)
    found = line_crf.apply_rules(docs, model)
    assert found.where("doc_id % 2 = 1").agg(F.avg(F.col("kept").cast("int"))).first()[0] == 1
    assert found.where("doc_id % 2 = 0 and kept").count() == 0


def test_rules_classify_held_out_rows(labelled, edge_docs, no_docs):
    docs, labels = labelled
    model = rule_ensemble.fit(docs, labels, rows=60)
    scored = rule_ensemble.score(docs, model)
    wrong = scored.where("held_out and predicted <> doc_id % 2").count()
    assert scored.where("held_out").count() > 50 and wrong == 0
    held = {r["doc_id"]: r["held_out"] for r in scored.collect()}
    assert all(h == (zlib.crc32(str(k).encode()) % 3 == 1) for k, h in held.items())
    odd = rule_ensemble.score(edge_docs, model).collect()
    assert len(odd) == edge_docs.count() and all(0 <= r["score"] <= 1 for r in odd)
    assert len({r["score"] for r in odd if r["doc_id"] in (4, 5)}) == 1
    assert rule_ensemble.score(no_docs, model).count() == 0
    kept = rule_ensemble.keep_good(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in scored.where("predicted = 1").collect()}


def test_constant_model_without_labels(edge_docs, spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = rule_ensemble.fit(edge_docs, none)
    assert not model.rules and rule_ensemble.score(edge_docs, model).select("score").distinct().count() == 1


def test_labels_of_held_out_rows_are_never_used(labelled):
    docs, labels = labelled
    turned = labels.withColumn("quality", F.when(rule_ensemble.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert rule_ensemble.fit(docs, labels, rows=60) == rule_ensemble.fit(docs, turned, rows=60)


def test_fit_covers_long_texts_and_bounds_what_the_driver_gets(spark, monkeypatch):
    """A text of 300,000 lines gives as many lines as any other, from its end too."""
    good = "\n".join(["plain words of a good line, with a stop."] * 150_000 + ["$$$ | ### | $$$"] * 150_000)
    docs = spark.createDataFrame([(k, good if k == 7 else poor(k)) for k in range(12)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") == 7).cast("int").alias("quality"))
    seen = []
    monkeypatch.setattr(line_crf, "spliced", lambda good_, poor_: seen.extend([list(good_), list(poor_)]) or [])
    monkeypatch.setattr(line_crf, "fit_field", lambda texts: None)
    assert zlib.crc32(b"7") % 3 != 1  # not held out
    line_crf.fit(docs, labels, lines=40)
    assert len(seen[0]) == 1 and len(seen[0][0]) == 40 and all(len(p) <= 40 for p in seen[1])
    assert (seen[0][0][1] != seen[0][0][-2]).any()
    assert line_crf.spread_lines(5, 9).tolist() == [0, 1, 2, 3, 4] and line_crf.spread_lines(1_000, 3).tolist() == [0, 500, 999]
