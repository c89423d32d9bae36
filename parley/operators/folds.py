"""Folds over the ordered rows of a key: rows stream through a task sorted, and only the last state is held."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Takes the state (None at a key's first row) and a row; gives the new state and the rows that are finished.
Step = Callable[[object, tuple], tuple[object, list[tuple]]]


def fold(rows: DataFrame, key: str, order: Sequence[str], step: Step, finish: Callable[[tuple, object], list[tuple]], schema: str) -> DataFrame:
    """Fold each key's rows in order; the first column of ``rows`` is the key.

    Rows are dealt out by key and sorted, so a key of any length costs time in proportion and a state of memory. Keys may
    be null. ``finish`` gets the last row and the state.
    """
    sorted_ = rows.repartition(key).sortWithinPartitions(key, *order)
    names = [part.split()[0] for part in schema.split(", ")]
    kinds = sorted_.sparkSession.createDataFrame([], schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(kinds.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            done: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if last is not None and row[0] != last[0]:
                    done += finish(last, state)
                    state = None
                state, out = step(state, row)
                done += out
                last = row
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), arrow)], names=names)
        if last is not None and (out := finish(last, state)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], names=names)

    return sorted_.mapInArrow(run, schema)


def merged_chunks(segments: DataFrame) -> DataFrame:
    """Merge a file's segments with the next one of the same speaker that begins before the last end or at it.

    ``segments`` has file_id, start_ms, end_ms, speaker, embedding (array, may be null). The end is the latest, vectors are
    averaged pair by pair. (file_id, start_ms, end_ms, speaker, n_spans, embedding).
    """
    rows = segments.select("file_id", "start_ms", "end_ms", "speaker", "embedding")

    def step(state: list | None, row: tuple) -> tuple[list, list[tuple]]:
        file_id, start, end, speaker, vector = row
        vector = None if vector is None else np.array(vector, float)
        if state is None or state[3] != speaker or start > state[2]:
            return [file_id, start, end, speaker, 1, vector], [] if state is None else [_plain_state(state)]
        pooled = vector if state[5] is None else state[5] if vector is None else (state[5] + vector) / 2
        return [file_id, state[1], max(state[2], end), speaker, state[4] + 1, pooled], []

    kind = dict(rows.dtypes)
    schema = f"file_id {kind['file_id']}, start_ms long, end_ms long, speaker {kind['speaker']}, n_spans long, embedding array<double>"
    return fold(rows, "file_id", ["start_ms", "end_ms", "speaker"], step, lambda _, state: [_plain_state(state)], schema)


def _plain_state(state: list) -> tuple:
    return (*state[:5], None if state[5] is None else state[5].tolist())


def pooled_neighbours(segments: DataFrame, gap_ms: int = 1_000) -> DataFrame:
    """Merge a file's segments with the next one of the same speaker that starts at most ``gap_ms`` after the last end.

    ``segments`` has file_id, start_ms, end_ms, speaker, embedding (array, may be null). The end is that of the last
    segment; vectors are pooled by length at each merge and scaled to length 1. (file_id, start_ms, end_ms, speaker,
    n_spans, embedding).
    """
    rows = segments.select("file_id", "start_ms", "end_ms", "speaker", "embedding")

    def step(state: list | None, row: tuple) -> tuple[list, list[tuple]]:
        file_id, start, end, speaker, vector = row
        vector = None if vector is None else np.array(vector, float)
        if state is None or state[3] != speaker or start - state[2] > gap_ms:
            return [file_id, start, end, speaker, 1, vector], [] if state is None else [_plain_state(state)]
        if state[5] is not None and vector is not None:
            pooled = state[5] * (state[2] - state[1]) + vector * (end - start)
            norm = np.linalg.norm(pooled)
            state[5] = pooled / (norm + 1e-8) if norm > 0 else pooled
        return [file_id, state[1], end, speaker, state[4] + 1, state[5]], []

    kind = dict(rows.dtypes)
    schema = f"file_id {kind['file_id']}, start_ms long, end_ms long, speaker {kind['speaker']}, n_spans long, embedding array<double>"
    return fold(rows, "file_id", ["start_ms", "end_ms"], step, lambda _, state: [_plain_state(state)], schema)
