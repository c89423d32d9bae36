"""Every occurrence of a unit draws its own merges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from parley.llm import merge_dropout
from parley.llm import textarrays as ta


@pytest.fixture(scope="module")
def pieces():
    return merge_dropout.load()


def segmentations(pieces, word: str, n: int, dropout: float) -> list[tuple]:
    keys = ta.mix(np.arange(1, n + 1, dtype=np.uint64))
    ids, counts = merge_dropout.encode_slice(pieces, pa.array([word] * n), keys, dropout)
    return [tuple(x.tolist()) for x in np.split(ids, np.cumsum(counts)[:-1])]


def test_a_word_has_more_segmentations_than_eight(pieces):
    assert len(set(segmentations(pieces, "international", 4_000, 0.1))) > 20


def test_a_single_merge_is_skipped_at_the_rate_asked_for(pieces):
    whole = segmentations(pieces, "a", 1, 0.0)[0]
    assert len(whole) == 1  # the blank and the letter
    found = segmentations(pieces, "a", 20_000, 0.1)
    assert np.mean([x != whole for x in found]) == pytest.approx(0.1, abs=0.01)


@pytest.mark.parametrize("word", ["international", "the streets of London", "x" * 100])
def test_shared_segmentations_equal_an_agenda_for_each(pieces, word, monkeypatch):
    found = segmentations(pieces, word, 300, 0.1)
    monkeypatch.setattr(merge_dropout, "_WIDTHS", (1,))  # all units count as long ones, which take an agenda each
    assert segmentations(pieces, word, 300, 0.1) == found
