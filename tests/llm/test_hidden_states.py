"""The hidden Markov model: emissions that grow with the corpus, whole passes, and scores that no partitioning changes."""

from __future__ import annotations

import numpy as np
import pytest

from parley.llm import hidden_states as hs
from parley.llm import textarrays as ta


def model_of(n: int, own: int, class_tokens: np.ndarray, class_types: np.ndarray) -> hs.Vocabulary:
    return hs.Vocabulary(n, own + int(class_types.sum()), own, class_tokens, class_types)


def test_emissions_sum_to_one_over_all_kinds():
    rng = np.random.default_rng(1)
    own, class_types = 900, rng.integers(0, 30, hs.CLASSES)
    counts = rng.gamma(1.0, size=(own + hs.CLASSES, hs.STATES))
    words = model_of(10_000, own, counts[own:].sum(axis=1), class_types)
    now = hs.Training(np.full(hs.STATES, 1 / hs.STATES), np.eye(hs.STATES), counts.sum(axis=0), words)
    types = np.concatenate([np.ones(own, int), class_types + 1])
    assert now.model(counts, types).emit.sum(axis=1) == pytest.approx(1)


def test_one_state_is_the_unigram():
    total, none = np.array([4, 1, 7]), np.zeros(hs.CLASSES, int)
    now = hs.Training(np.ones(1), np.ones((1, 1)), np.array([12.0]), model_of(12, 3, none, none))
    emit = now.model(total[:, None], np.ones(3)).emit[0]
    assert emit == pytest.approx((total + 1) / (12 + 3 + hs.CLASSES))


def sentences(n: int, size: int = 60) -> list[tuple]:
    """Texts of two vocabularies that never meet."""
    rng = np.random.default_rng(2)
    return [(k, " ".join(f"{'ab'[k % 2]}{w:03d}" for w in rng.integers(0, 200, rng.integers(1, size)))) for k in range(n)]


def plain_scores(rows: list[tuple], passes: int, seed: int = 3) -> dict:
    """All texts at once, every training type a kind of its own, plain sums: log10 likelihoods by id."""
    import zlib

    ids, texts = zip(*rows)
    held = np.array([zlib.crc32(str(i).encode()) % 7 == 2 for i in ids])
    tokens = [[w.lower().encode() for w in t.split()] + [None] for t in texts]
    value = {w: int(hs.END) if w is None else int(hs.tokenised(__import__("pyarrow").array([w.decode()]))[0][0]) for t in tokens for w in t}
    count: dict = {}
    for t, h in zip(tokens, held):
        for w in t if not h else ():
            count[w] = count.get(w, 0) + 1
    known = sorted(count, key=lambda w: value[w])
    place = {w: k for k, w in enumerate(known)}
    n = sum(count.values())
    none = np.zeros(hs.CLASSES, int)
    now = hs._start(model_of(n, len(known), none, none))
    sums = hs.spread(np.array([value[w] for w in known], np.uint64), np.array([count[w] for w in known]), seed)
    emit = lambda: now.model(np.vstack([sums, np.zeros(hs.STATES)]), np.ones(len(known) + 1))  # noqa: E731  # the last kind: a class without training tokens
    cls = [np.array([place.get(w, len(known)) for w in t]) for t in tokens]
    for _ in range(passes):
        own = [c for c, h in zip(cls, held) if not h]
        before, step, made = hs.expected_counts(emit(), np.concatenate(own), np.array([len(c) for c in own]))
        sums = made.T[:-1]
        before, step = before + 0.1, step + 0.1
        now = hs.Training(before / before.sum(), step / step.sum(axis=1, keepdims=True), sums.sum(axis=0), now.words)
    return dict(zip(ids, hs.log_likelihood(emit(), np.concatenate(cls), np.array([len(c) for c in cls])) / np.log(10)))


@pytest.mark.parametrize("group", [2, 256])
def test_exact_setting_equals_plain_training(spark, monkeypatch, group):
    monkeypatch.setattr(hs, "GROUP_BLOCKS", group)  # teams of two blocks, or all blocks in one
    rows = sentences(60)
    found = {r["doc_id"]: r["score"] for r in hs.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), least=1, passes=3).collect()}
    want = plain_scores(rows, 3)
    assert found.keys() == want.keys() and all(found[i] == pytest.approx(want[i], abs=1e-4) for i in found)


def test_partitioning_changes_no_score(spark):
    docs = spark.createDataFrame(sentences(200), "doc_id long, text string")
    a, b = ({r["doc_id"]: r["score"] for r in hs.score(docs.repartition(k)).collect()} for k in (3, 16))
    assert a.keys() == b.keys() and max(abs(a[i] - b[i]) for i in a) < 1e-3


def test_types_of_their_own_grow_with_the_corpus(spark):
    own = [hs.coded(spark.createDataFrame(rows, "doc_id long, text string"))[1].own for rows in (sentences(30), sentences(400))]
    assert own[1] > own[0] and own[1] > 390  # all 400 words and the end
    assert hs.own_from(10**8) * 2 < hs.own_from(10**9) < hs.own_from(10**8) * 4  # the root, so types of their own go on growing


def test_no_size_decides_which_types_are_their_own(spark):
    """Words that stand twice have emissions of their own beside few other words and beside 100,000."""
    pairs = [(k, " ".join(f"w{w}" for w in range(50))) for k in (2, 3)]  # ids that are not held out
    more = [(4, "filler " * 100_000)]
    own = [hs.coded(spark.createDataFrame(rows, "doc_id long, text string"))[1].own for rows in (pairs, pairs + more)]
    assert own == [51, 52]  # the words and the end; then the filler too


def test_classes_meet_across_blocks(spark):
    """Words that stand once share classes; no partitioning changes which ones, or their sums."""
    docs = spark.createDataFrame([(k, f"{text} once{k}ing {'x' * (k % 5)}{k}") for k, text in sentences(120)], "doc_id long, text string")
    a, b = ({r["doc_id"]: r["score"] for r in hs.score(docs.repartition(k)).collect()} for k in (1, 9))
    assert a.keys() == b.keys() and max(abs(a[i] - b[i]) for i in a) < 1e-3


def test_rising_values_come_back():
    for values in (np.array([], np.uint64), np.array([3, 9, 2**64 - 1], np.uint64), np.array([0, 5, 70_000, 0, 1, -1], np.int32)):
        assert hs._unpack_rising(hs._pack_rising(values), values.dtype.type).tolist() == values.tolist()


def test_states_learn_the_two_vocabularies(spark):
    rows = hs.score(spark.createDataFrame(sentences(600), "doc_id long, text string").repartition(8)).where("held_out").collect()
    gain = np.mean([(r["score"] - r["base_score"]) / r["n_tokens"] for r in rows])
    assert gain > 0.1  # log10 2 a word at best


def test_rare_types_fall_into_classes_by_length_and_ending():
    import pyarrow as pa

    value, shape, n = hs.tokenised(pa.array(["Walking talking ing x", None, ""]))
    assert n.tolist() == [5, 1, 1] and value[[4, 5, 6]].tolist() == [int(hs.END)] * 3
    assert shape[0] == shape[1] != shape[2] and (shape < hs.CLASSES).all() and len(ta.LOWER) == 256
