"""Hashes of spans: the words that collide under sums of powers modulo 2**64, in the helper and in the operators."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa

from parley.llm import hidden_states, sketch_join
from parley.llm import textarrays as ta
from parley.llm.statistics import Texts

#: A word over a and b whose i-th letter is the parity of i's bits, and its mirror.
ONE = "".join("ab"[bin(i).count("1") % 2] for i in range(1_024))
TWO = ONE.translate(str.maketrans("ab", "ba"))


def hashes(texts: list[str]) -> np.ndarray:
    data, offsets = ta.flat(pa.array(texts))
    return ta.span_hash(ta.prefix_hash(data), offsets[:-1], offsets[1:])


def test_spans_of_any_length_differ():
    rng = random.Random(1)
    base = "".join(rng.choice("ab") for _ in range(5_000))
    texts = [base[:n] for n in range(1, 5_000, 7)]
    texts += [base[:k] + "c" + base[k + 1 :] for k in range(0, 5_000, 13)]
    texts += [ONE * k for k in range(1, 5)] + [TWO * k for k in range(1, 5)] + [ONE + TWO, TWO + ONE, ONE + ONE[:512], TWO[:512] + ONE]
    parts = [base[k * 128 : k * 128 + 128] for k in range(8)]
    for _ in range(200):
        texts.append("".join(rng.sample(parts, 8)))
    found = hashes(texts)
    assert len(set(found.tolist())) == len(set(texts))
    # Equal spans agree wherever they stand.
    again = hashes(["x" * k + t for k, t in enumerate(texts[:300])])
    data, offsets = ta.flat(pa.array(["x" * k + t for k, t in enumerate(texts[:300])]))
    moved = ta.span_hash(ta.prefix_hash(data), offsets[:-1] + np.arange(300), offsets[1:])
    assert (moved == found[:300]).all() and (again[1:] != found[1:300]).all()


def test_operators_tell_the_words_apart(spark):
    assert hashes([ONE])[0] != hashes([TWO])[0]
    rows = [(1, f"w one two three {ONE} {ONE} x"), (2, f"{ONE}\n{TWO}"), (3, f"w one two three {TWO}"), (4, f"w one two three {ONE}")]
    counted = Texts(pa.array([f"{ONE}\n{TWO}", f"{ONE}\n{ONE}"]))
    assert len(set(counted.word_hash[:2].tolist())) == 2 and counted.word_hash[2] == counted.word_hash[3] == counted.word_hash[0]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    near = {r.doc_id: r.component_id for r in sketch_join.near_groups(docs.where("doc_id > 2"), width=5, percent=85).collect()}
    assert near == {3: 3, 4: 4}
    # Ids whose remainder is not 2 train; the word is known where it stood in training and unknown else.
    train = [k for k in range(60) if zlib.crc32(str(k).encode()) % 7 != 2][:1]
    held = [k for k in range(60) if zlib.crc32(str(k).encode()) % 7 == 2][:2]
    table = spark.createDataFrame([(train[0], ONE), (held[0], ONE), (held[1], TWO)], "doc_id long, text string")
    known = {r.doc_id: r.n_known for r in hidden_states.score(table).select("doc_id", "n_known").collect()}
    assert known == {train[0]: 2, held[0]: 2, held[1]: 1}
