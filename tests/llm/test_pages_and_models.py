"""HTML extraction, segmentation with merge-dropout, and the hidden Markov model."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parley.llm import hidden_states as hs
from parley.llm import host_paths, merge_dropout
from parley.llm import textarrays as ta

from .conftest import edge_rows

PAGE = "<html><head><title>t</title></head><body><nav><a href=1>Home</a></nav><div class='{c}'><h1>T &lt;b&gt;</h1><p>one\n two<p>three <a href=x>link</a><script>a<b</script>{more}</div><div id=sidebar>no</div><footer>no</footer></body></html>"


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (PAGE.format(c="post-17", more=""), "T <b>\none two\nthree link"),
        ("", ""), ("plain & simple", "plain & simple"), ("<p>a<br>b<p>c", "a b\nc"), ("<article><p>a &amp b &eacute;&#33;</article><div class=ad>x</div>", "a & b é!"),
        ("<body><article><h1>x</h1><p>y<!-- z --></p><div class='comments'><p>no</p></div><form>no</form><p class=cookie-notice>no</p></article>", "x\ny"),
        ("<article><header><h1>in</h1></header><p>text</p><aside>no</aside></article>", "in\ntext"), ("<div><p>cut off <b>here", "cut off here"), ("<script>only", ""), ("a < b", "a < b"),
        ("<ul><li>one<li>two</ul><p title='a > b'>three</p>", "one\ntwo\nthree"),
    ],
)
def test_main_text(html, text):
    assert host_paths.main_text(html) == text


def test_hosts_agree_on_a_path(spark):
    more = "<p>" + "words " * 50 + "</p>"
    rows = [(k, f"http://h.org/{k}", PAGE.format(c=f"post-{k}", more=more)) for k in range(5)]
    odd = PAGE.format(c="post-9", more=more).replace("<footer>", "<div class=promoted><p>" + "buy now " * 90 + "</p></div><footer>")
    rows += [(9, "http://h.org/9", odd), (10, "http://other.org", odd), (11, None, None), (12, "not a url", "<p>x</p>"), (12, "not a url", "<p>x</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("path", F.lit(1)).withColumn("host", F.lit(2))
    found = {r["page_id"]: r for r in host_paths.extract(pages).collect()}
    assert "buy now" not in found[9]["text"] and "words" in found[9]["text"]
    assert "buy now" in found[10]["text"]
    assert (found[11]["text"], found[11]["n_chars"], found[12]["text"]) == ("", 0, "x")
    assert all(r["n_chars"] == len(r["text"]) for r in found.values())
    assert host_paths.extract(pages).count() == len(rows) and host_paths.extract(pages.where("false")).count() == 0


@pytest.fixture(scope="module")
def pieces():
    return merge_dropout.load()


TEXTS = [r[1] for r in edge_rows()[:15]] + ["  x  y", "\n\n", "x" * 300 + " " + "   " * 40, "aaaaabbbbb" * 30, "Hello world, the quick brown fox.", None, ""]


def test_without_dropout_ids_are_the_models_own(pieces):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=merge_dropout.MODEL_FILE)
    ids, counts = merge_dropout.encode_slice(pieces, pa.array(TEXTS), np.zeros(len(TEXTS), np.uint64), 0.0)
    for text, own in zip(TEXTS, np.split(ids, np.cumsum(counts)[:-1])):
        if "▁" not in (text or ""):
            assert own.tolist() == model.encode(text or "")


@pytest.mark.parametrize("dropout", [0.0, 0.1, 0.7, 1.0])
def test_every_segmentation_decodes_losslessly(pieces, dropout):
    ids, counts = merge_dropout.encode_slice(pieces, pa.array(TEXTS), ta.mix(np.arange(len(TEXTS), dtype=np.uint64)), dropout)
    data, ends = merge_dropout.decode_ids(pieces, ids, counts)
    assert [data[a:b].tobytes() for a, b in zip(ends, ends[1:])] == [(t or "").encode() for t in TEXTS]


def test_matrices_equal_the_agenda(pieces):
    rng = np.random.default_rng(0)
    for _ in range(150):
        n = int(rng.integers(1, 30))
        symbols = [pieces.blank, *(int(pieces.of_char[ord(c)]) for c in rng.choice(list("theonrsai"), n))]
        key = np.array([rng.integers(0, 2**63)], np.uint64)
        matrix = np.full((1, 32), -1)
        matrix[0, : n + 1] = symbols
        out, size = merge_dropout._together(pieces, matrix, key, 0.3)
        assert merge_dropout.agenda(pieces, symbols, int(key[0]), 0.3) == out[0, : size[0]].tolist()


def test_encode_and_decode_rows(spark, edge_docs, no_docs):
    made = merge_dropout.encode(edge_docs)
    rows = made.collect()
    assert len(rows) == len(edge_rows()) and all(r["lossless"] and r["n_tokens"] == len(r["ids"]) for r in rows)
    back = sorted((r["doc_id"] or -1, r["text"]) for r in merge_dropout.decode(made).collect())
    assert back == sorted((r[0] or -1, r[1] or "") for r in edge_rows())
    own = {r["doc_id"]: r["ids"] for r in rows}
    assert own[1] != own[2] and own[12] == own[12]
    assert {r["doc_id"]: r["ids"] for r in merge_dropout.encode(edge_docs.repartition(5)).collect()} == own
    assert {r["doc_id"]: r["ids"] for r in merge_dropout.encode(edge_docs, seed=12).collect()} != own
    assert merge_dropout.encode(no_docs).count() == 0


def small_model(rng, states=3, classes=5):
    norm = lambda x: x / x.sum(axis=-1, keepdims=True)
    return hs.StateModel(norm(rng.random(states)), norm(rng.random((states, states))), norm(rng.random((states, classes))))


def test_forward_recursion_equals_enumeration():
    rng = np.random.default_rng(5)
    model = small_model(rng)
    n = np.array([1, 4, 6, 2])
    cls = rng.integers(0, 5, n.sum())
    got = hs.log_likelihood(model, cls, n)
    for value, own in zip(got, np.split(cls, np.cumsum(n)[:-1])):
        total = sum(model.before[z[0]] * np.prod([model.step[z[t], z[t + 1]] * model.emit[z[t + 1], own[t]] for t in range(len(own))]) for z in product(range(3), repeat=len(own) + 1))
        assert value == pytest.approx(np.log(total))


def test_pieces_make_no_difference(monkeypatch):
    rng = np.random.default_rng(6)
    model, n = small_model(rng), np.array([300, 1, 129, 700])
    cls = rng.integers(0, 5, n.sum())
    whole = hs.log_likelihood(model, cls, n)
    counts = hs.expected_counts(model, cls, n)
    monkeypatch.setattr(hs, "PIECE", 1024)
    assert np.allclose(whole, hs.log_likelihood(model, cls, n))
    for a, b in zip(counts, hs.expected_counts(model, cls, n)):
        assert np.allclose(a, b)
    assert counts[1].sum() == pytest.approx(n.sum()) and counts[2].sum() == pytest.approx(n.sum()) and counts[0].sum() == pytest.approx(len(n))


def test_passes_raise_the_likelihood():
    rng = np.random.default_rng(7)
    truth, n = small_model(rng), np.full(60, 40)
    cls = rng.integers(0, 5, n.sum())
    model, last = small_model(np.random.default_rng(8)), -np.inf
    for _ in range(6):
        now = hs.log_likelihood(model, cls, n).sum()
        assert now >= last - 1e-9
        last = now
        b, s, e = hs.expected_counts(model, cls, n)
        model = hs.StateModel(b / b.sum(), s / s.sum(axis=1, keepdims=True), e / e.sum(axis=1, keepdims=True))
    assert truth.emit.shape == model.emit.shape


LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def test_scores_equal_plain_counts(spark, edge_docs, no_docs):
    rows = edge_rows()
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", (r[1] or "").translate(LOW)) + [None] for r in rows]
    held = [r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 2 for r in rows]
    seen = Counter(t for own, h in zip(tokens, held) if not h for t in own)
    total, kinds = sum(seen.values()), len(seen)
    want = sorted((r[0] or -1, h, len(t), sum(seen[x] > 0 for x in t), total, sum(np.log10((seen[x] + 1) / (total + kinds + 1)) for x in t)) for r, h, t in zip(rows, held, tokens))
    found = sorted(((r["doc_id"] or -1, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in hs.score(edge_docs).collect()), key=lambda r: r[:6])
    for a, b in zip(want, found):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5]) and np.isfinite(b[6])
    assert len(found) == len(rows) and hs.score(no_docs).count() == 0
