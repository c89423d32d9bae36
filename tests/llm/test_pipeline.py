"""Each stage of the pipeline against a plain version on a small table."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from parley.llm import merge_dropout, mixing

from .conftest import SPACES, words
from .test_copies import plain_groups
from .test_texts import poor


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(12)
    base = [words(rng, 150) for _ in range(30)]
    rows = []
    for k in range(200):
        if k % 10 == 0:
            text = poor(k)
        elif k % 3 == 0:
            text = base[k % 30]
        elif k % 3 == 1:
            text = base[k % 30] + f" tail{k}"
        else:
            text = words(rng, 100)
        rows.append((k, text, "en", f"src{k % 4}", len(text)))
    folder = tmp_path_factory.mktemp("tables")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    docs.select("doc_id", F.when(F.col("doc_id") % 10 == 0, 0).otherwise(1).alias("quality"), F.lit(0).alias("toxic")).write.parquet(f"{folder}/labels.parquet")
    return str(folder), rows


def test_stages(spark, tables):
    folder, rows = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality classifier", "exact dedup", "n-gram Jaccard join", "mixing", "SentencePiece encoding"]
    good = stages["quality classifier"](spark, docs, folder)
    assert good.columns == docs.columns and {r["doc_id"] for r in good.collect()} == {k for k, *_ in rows if k % 10}
    once = stages["exact dedup"](spark, good, folder)
    first: dict[str, int] = {}
    for k, text, *_ in rows:
        if k % 10:
            first.setdefault(re.sub(SPACES, " ", text), k)
    assert once.columns == docs.columns and {r["doc_id"] for r in once.collect()} == set(first.values())
    left = [r for r in rows if r[0] in set(first.values())]
    groups = plain_groups(left, 5, 80)
    single = stages["n-gram Jaccard join"](spark, once, folder)
    assert single.columns == docs.columns and {r["doc_id"] for r in single.collect()} == {i for i, c in groups.items() if i == c}
    mix = stages["mixing"](spark, single, folder)
    assert mix.columns == docs.columns
    copies = {r["doc_id"]: r["count"] for r in mix.groupBy("doc_id").count().collect()}
    taken = {r["doc_id"]: (r["taken"], r["size"]) for r in mixing.mix_documents(single).collect()}
    assert {k: round(t / n + 1e-9) for k, (t, n) in taken.items() if round(t / n + 1e-9)} == copies
    ids = stages["SentencePiece encoding"](spark, mix, folder)
    assert ids.count() == mix.count() and ids.where("not lossless").count() == 0
    back = {(r["doc_id"], r["text"]) for r in merge_dropout.decode(ids).collect()}
    assert back == {(r["doc_id"], r["text"]) for r in mix.collect()}


def test_run_is_all_stages(spark, tables):
    folder, _ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    want = sorted((r["doc_id"], r["ids"]) for r in docs.collect())
    assert sorted((r["doc_id"], r["ids"]) for r in corpus_pipeline.run(spark, folder).collect()) == want
    assert corpus_pipeline.ORACLE_SQL is None


def test_stages_of_nothing(spark, tables, no_docs):
    folder, _ = tables
    docs = no_docs
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0
