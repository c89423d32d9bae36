"""Models that carry a state from window to window of a recording, over chunks of any length and many files side by side."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Samples of a window, those before it that a model sees too, and files whose windows meet in one call.
WINDOW, CONTEXT, SIDE_BY_SIDE = 512, 64, 64


class CarriedModel(Protocol):
    """A model with a state; one instance serves a task."""

    def fresh(self, n: int) -> np.ndarray:
        """States of ``n`` recordings at their start, one a row."""

    def __call__(self, windows: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores and new states for one window of each of several recordings: (n x (context + window)), (n x ...)."""


class _File:
    """What is left of a recording: samples that fill no window yet, the last ones seen, its state and place."""

    def __init__(self, file_id: object, context: int, rate: int) -> None:
        self.file_id, self.rest, self.before, self.state, self.place, self.rate = file_id, np.zeros(0, np.float32), np.zeros(context, np.float32), None, 0, rate


def _steps(held: list[_File], model: CarriedModel, window: int, context: int, side: int, last: bool = False) -> Iterator[tuple]:
    """Take all whole windows of the held recordings, one of each a call; with ``last`` also what is left, filled up with silence."""
    if last:
        for f in held:
            f.rest = np.pad(f.rest, (0, -len(f.rest) % window))
    while ready := [f for f in held if len(f.rest) >= window][:side]:
        while all(len(f.rest) >= window for f in ready):
            seen = np.stack([np.concatenate([f.before, f.rest[:window]]) for f in ready])
            states = np.stack([model.fresh(1)[0] if f.state is None else f.state for f in ready])
            scores, states = model(seen, states)
            for f, row, score, state in zip(ready, seen, scores, states):
                yield f.file_id, f.place, f.place * window * 1000 // f.rate, float(score)
                f.rest, f.before, f.state, f.place = f.rest[window:], row[len(row) - context :], state, f.place + 1


def infer_carried(chunks: DataFrame, make_model: Callable[[], CarriedModel], window: int = WINDOW, context: int = CONTEXT, side_by_side: int = SIDE_BY_SIDE) -> DataFrame:
    """Scores of a recording's windows by a model that carries a state: (file_id, window, start_ms, score).

    ``chunks`` has file_id, start_ms, rate, samples, without laps. Windows follow each other from a file's first sample on, the
    model sees ``context`` samples before each too, and the last window is filled up with silence. State and left-over
    samples pass from chunk to chunk, so any chunking gives the same scores. Files are dealt out to groups of some
    ``side_by_side``; a group's chunks come sorted by time, so that its files advance together and a call takes a window
    of each. A task holds a chunk and a state of each file of one group. Files without samples have no rows.
    """
    rows = chunks.select("file_id", "rate", "start_ms", "samples").where("rate > 0 and size(samples) > 0")
    groups = max(1, -(-rows.select(F.approx_count_distinct("file_id")).first()[0] // side_by_side))
    # A null file is one of its own.
    dealt = rows.select(F.pmod(F.xxhash64("file_id"), F.lit(groups)).cast("int").alias("g"), "start_ms", "file_id", "rate", "samples")
    dealt = dealt.repartition("g").sortWithinPartitions("g", "start_ms", "file_id")
    kind = dict(chunks.dtypes)["file_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, now, files = make_model(), None, {}
        turn: dict[object, None] = {}  # files with chunks that are not taken yet
        out: list[tuple] = []

        def flushed(last: bool = False) -> None:
            out.extend(_steps([files[f] for f in (files if last else turn)], model, window, context, side_by_side, last))
            turn.clear()

        for batch in batches:
            file_type = batch.schema.field("file_id").type
            for g, file_id, rate, samples in zip(batch.column("g").to_pylist(), batch.column("file_id").to_pylist(), batch.column("rate").to_pylist(), batch.column("samples")):
                if g != now:
                    flushed(last=True)
                    now, files = g, {}
                if file_id in turn or len(turn) >= side_by_side:
                    flushed()
                f = files.setdefault(file_id, _File(file_id, context, rate))
                f.rest = np.concatenate([f.rest, np.nan_to_num(samples.values.to_numpy(zero_copy_only=False).astype(np.float32))])
                turn[file_id] = None
            if len(out) > 10_000:
                yield _batch(out, file_type)
                out = []
        flushed(last=True)
        if out:
            yield _batch(out, file_type)

    return dealt.mapInArrow(run, f"file_id {kind}, window long, start_ms long, score double")


def _batch(rows: list[tuple], file_type: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (file_type, pa.int64(), pa.int64(), pa.float64()))], names=["file_id", "window", "start_ms", "score"])


class LevelGate:
    """A small stand-in for a speech model: a leaky mean of the windows' power, as a share of it and ``half``."""

    def __init__(self, keep: float = 0.9, half: float = 1e-4) -> None:
        self.keep, self.half = keep, half

    def fresh(self, n: int) -> np.ndarray:
        return np.zeros((n, 1))

    def __call__(self, windows: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        power = (windows.astype(float) ** 2).mean(axis=1, keepdims=True)
        states = self.keep * states + (1 - self.keep) * power
        return (states / (states + self.half))[:, 0], states
