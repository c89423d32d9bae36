"""Quality rules by line sequence labelling: a linear-chain conditional random field marks content lines."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textarrays as ta
from .rule_ensemble import held_out, labelled_sample
from .statistics import COUNTS, LINE_FEATURES, Texts

#: The field is fitted on at most so many labelled documents of each class, those whose ids have the smallest hashes.
FIT_DOCUMENTS = 1_500
#: Of a labelled document so many lines count for the fit, so that a few very long ones do not outweigh all others.
FIT_LINES = 200
#: Share of words in content lines from which a document is kept; shortest text; most repeated words in percent.
CONTENT_SHARE, LEAST_WORDS, MOST_REPEATED = 0.5, 50, 50


@dataclass
class LineField:
    """Weights of a two-label chain (0 boilerplate, 1 content): line features by label, and label to next label."""

    line: np.ndarray
    step: np.ndarray

    def decode(self, features: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Viterbi labels of all lines; ``lengths`` cuts the lines into texts. Texts advance side by side."""
        score = features @ self.line
        out = np.zeros(len(score), np.int8)
        order = np.argsort(-lengths, kind="stable")
        sizes = lengths[order]
        heads = (np.cumsum(lengths) - lengths)[order]
        top = int(sizes[0]) if len(sizes) else 0
        active = np.searchsorted(-sizes, -np.arange(top), "left")  # texts with more than t lines
        best = np.zeros((len(sizes), 2))
        from_label = np.zeros((len(score), 2), np.int8)
        for t in range(top):
            k = active[t]
            at = heads[:k] + t
            if t:
                via = best[:k, :, None] + self.step
                from_label[at] = via.argmax(axis=1)
                best[:k] = via.max(axis=1) + score[at]
            else:
                best[:k] = score[at]
        label = best.argmax(axis=1).astype(np.int8)
        for t in range(top - 1, -1, -1):
            k = active[t]
            at = heads[:k] + t
            out[at] = label[:k]
            label[:k] = from_label[at, label[:k]]
        return out


def likelihood(line: np.ndarray, step: np.ndarray, x: np.ndarray, y: np.ndarray, size: np.ndarray, part: np.ndarray, ridge: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Weighted log likelihood of labelled sequences less a ridge, and its gradient by line features and by steps.

    ``x`` (place, sequence, feature) and ``y`` (place, sequence) hold the longest sequences first; ``part`` has weights.
    """
    top, n = y.shape
    active = np.searchsorted(-size, -np.arange(top), "left")
    score = x @ line
    ahead, back = np.zeros((top, n, 2)), np.zeros((top, n, 2))
    ahead[0] = score[0]
    for t in range(1, top):
        k = active[t]
        ahead[t, :k] = np.logaddexp.reduce(ahead[t - 1, :k, :, None] + step, axis=1) + score[t, :k]
    for t in range(top - 2, -1, -1):
        k = active[t + 1]
        back[t, :k] = np.logaddexp.reduce(step + (score[t + 1, :k] + back[t + 1, :k])[:, None, :], axis=2)
    total = np.logaddexp.reduce(ahead[size - 1, np.arange(n)], axis=1)
    value = -(part @ total) - ridge / 2 * ((line**2).sum() + (step**2).sum())
    up_line, up_step = -ridge * line, -ridge * step
    for t in range(top):
        k = active[t]
        row = np.arange(k)
        value += part[:k] @ score[t, row, y[t, :k]]
        seen = np.eye(2)[y[t, :k]] - np.exp(ahead[t, :k] + back[t, :k] - total[:k, None])
        up_line += x[t, :k].T @ (seen * part[:k, None])
        if t:
            value += part[:k] @ step[y[t - 1, :k], y[t, :k]]
            pair = -np.exp(ahead[t - 1, :k, :, None] + step + (score[t, :k] + back[t, :k])[:, None, :] - total[:k, None, None])
            pair[row, y[t - 1, :k], y[t, :k]] += 1
            up_step += (pair * part[:k, None, None]).sum(axis=0)
    return value, up_line, up_step


def fit_field(texts: list[tuple[np.ndarray, np.ndarray]], rounds: int = 120, ridge: float = 1e-2) -> LineField | None:
    """Maximum conditional likelihood by gradient steps; each text is (line features, labels of its lines).

    None if a label has no line. All texts count alike. For the fit, texts are cut into pieces of at most 64 lines.
    """
    texts = [(f, np.asarray(y, np.int64)) for f, y in texts if len(f)]
    if len({k for _, y in texts for k in np.unique(y)}) < 2:
        return None
    pieces = [(f[i : i + 64], y[i : i + 64], 1.0 / (len(f) * len(texts))) for f, y in texts for i in range(0, len(f), 64)]
    pieces.sort(key=lambda p: -len(p[0]))
    n, top, width = len(pieces), len(pieces[0][0]), len(LINE_FEATURES)
    x, y = np.zeros((top, n, width)), np.zeros((top, n), np.int64)
    for k, (f, label, _) in enumerate(pieces):
        x[: len(f), k], y[: len(f), k] = f, label
    size, part = np.array([len(f) for f, _, _ in pieces]), np.array([w for _, _, w in pieces])
    line, step = np.zeros((width, 2)), np.zeros((2, 2))
    moments = [np.zeros_like(line), np.zeros_like(line), np.zeros_like(step), np.zeros_like(step)]
    for r in range(1, rounds + 1):
        _, up_line, up_step = likelihood(line, step, x, y, size, part, ridge)
        for value, up, i in ((line, up_line, 0), (step, up_step, 2)):
            moments[i] = 0.9 * moments[i] + 0.1 * up
            moments[i + 1] = 0.99 * moments[i + 1] + 0.01 * up * up
            value += 0.1 * (moments[i] / (1 - 0.9**r)) / (np.sqrt(moments[i + 1] / (1 - 0.99**r)) + 1e-8)
    return LineField(line, step)


def spliced(good: list[np.ndarray], poor: list[np.ndarray], seed: int = 7, run: float = 4.0) -> list[tuple[np.ndarray, np.ndarray]]:
    """Training sequences in which both kinds of lines follow each other: runs of lines of good texts (label 1) and of poor
    ones (label 0) in turn, ``run`` lines on average, until all lines of all texts are used up.

    The shorter of the two kinds begins again as often as it takes, so that both have about as many lines.
    """
    if not any(map(len, good)) or not any(map(len, poor)):
        return []
    rng = np.random.default_rng(seed)
    pools = [np.concatenate([f for f in kind if len(f)]) for kind in (poor, good)]
    at, want = [0, 0], max(map(len, pools))
    out: list = []
    while min(at) < want:
        label, features, labels = int(rng.integers(2)), [], []
        for _ in range(int(rng.integers(1, 9))):
            length = int(rng.geometric(1 / run))
            own = np.arange(at[label], at[label] + length) % len(pools[label])
            features.append(pools[label][own])
            labels.append(np.full(length, label))
            at[label] += length
            label = 1 - label
        out.append((np.concatenate(features), np.concatenate(labels)))
    return out


def spread_lines(n: int, lines: int) -> np.ndarray:
    """Places of at most ``lines`` of ``n`` lines, evenly over all of them."""
    return np.arange(n) if n <= lines else np.linspace(0, n - 1, lines).round().astype(np.int64)


def fit(docs: DataFrame, labels: DataFrame, documents: int = FIT_DOCUMENTS, lines: int = FIT_LINES) -> LineField | None:
    """Fit on runs of lines of good and of poor labelled documents, spliced so that the labels change within a sequence.

    Rows of the held-out third are never used, so agreement can be measured on them. At most ``documents`` of each class
    are, and of a text with more than ``lines`` lines so many, spread evenly over the whole text. They are chosen in the
    tasks, so the driver gets 2 * ``documents`` * ``lines`` rows of features at most, whatever the length of a text.
    """
    sample = labelled_sample(docs, labels.where(~held_out(F.col("doc_id"))), documents)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ta.slices(batch, "text"):
                texts = Texts(part.column("text"))
                rows = np.split(texts.line_features(), np.cumsum(np.bincount(texts.line_row, minlength=texts.n))[:-1])
                chosen = [np.ascontiguousarray(r[spread_lines(len(r), lines)]).tobytes() for r in rows]
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "label": part.column("label"), "features": pa.array(chosen, pa.binary())})

    rows = sample.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, label int, features binary").orderBy("doc_id", "features").toPandas()
    width = len(LINE_FEATURES)
    good, poor = ([np.frombuffer(f, bool).reshape(-1, width) for f, y in zip(rows["features"], rows["label"]) if y == label] for label in (1, 0))
    return fit_field(spliced(good, poor))


def apply_rules(docs: DataFrame, model: LineField | None) -> DataFrame:
    """Counts and verdict of every row: (doc_id, COUNTS, base_failed, n_content_words, content_share, kept).

    A row fails the base if it has fewer than 50 words or more than half of its words lie in repeated three-word
    windows. Of the others, those are kept whose words lie in content lines by half or more. Null and empty texts
    have no words, fail the base and are not kept; without a model all lines are content. Lines without words have a
    label but no weight. Repeated rows get equal results; further columns are ignored; ids may be null.
    """
    rows = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ta.slices(batch, "text"):
                texts = Texts(part.column("text"))
                counts = texts.counts()
                if model is None:
                    content = counts["n_words"]
                else:
                    label = model.decode(texts.line_features(), np.bincount(texts.line_row, minlength=texts.n))
                    content = np.bincount(texts.line_row, weights=texts.line_words * label, minlength=texts.n)
                columns = {k: pa.array(v.astype(np.int64)) for k, v in counts.items()}
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id")} | columns | {"n_content_words": pa.array(content.astype(np.int64))})

    schema = ", ".join([f"doc_id {dict(docs.dtypes)['doc_id']}", *(f"{c} long" for c in COUNTS), "n_content_words long"])
    counted = rows.mapInArrow(run, schema)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    share = F.col("n_content_words") / F.greatest("n_words", F.lit(1))
    return counted.withColumns({"base_failed": failed, "content_share": share}).withColumn("kept", ~F.col("base_failed") & (F.col("content_share") >= CONTENT_SHARE))
