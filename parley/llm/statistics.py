"""Statistics of whole texts and of their lines, computed on flat byte arrays in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textarrays as ta

SYMBOLS = "#*$%&|<>"


def _lut(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars.encode())] = True
    return table


_SYMBOL, _UPPER, _DIGIT, _PIPE, _MARK = (_lut(x) for x in (SYMBOLS, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "|", "!"))
_LOWER = _lut("abcdefghijklmnopqrstuvwxyz")
_STOP = _lut('.,;:?"')
_NEWLINE = _lut("\n")
_WIDE = np.arange(256) >= 128
#: Statistics of a text that the classifier's rules may test; no label, language, source or id is among them.
STATISTICS = (
    "n_words", "word_len", "upper_share", "digit_share", "wide_share", "symbol_rate", "pipe_rate", "mark_rate",
    "stop_rate", "repeat_share", "echo_share", "distinct_share", "dup_line_share", "line_words", "long_word_share",
)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Features of a line for sequence labelling; all are 0 or 1.
LINE_FEATURES = (
    "bias", "upper_third", "upper_most", "symbol_some", "symbol_many", "pipe_some", "pipe_many", "mark_many",
    "digit_many", "echo_some", "echo_many", "short", "long", "ends_in_stop", "stop_some", "seen_before", "blank",
)


class _Sums:
    """Counts of a byte class within spans."""

    def __init__(self, data: np.ndarray, table: np.ndarray) -> None:
        self.total = np.zeros(len(data) + 1, np.int64)
        np.cumsum(table[data], out=self.total[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return self.total[ends] - self.total[starts]


def _first_of_kind(row: np.ndarray, value: np.ndarray) -> np.ndarray:
    """True for the first element of each distinct (row, value)."""
    key = ta.mix(value ^ ta.mix(row.astype(np.uint64) + np.uint64(1)))
    _, at = np.unique(key, return_index=True)
    first = np.zeros(len(key), bool)
    first[at] = True
    return first


def _repeated_words(row: np.ndarray, value: np.ndarray) -> np.ndarray:
    """True for words inside a three-word window that its text has twice or more."""
    out = np.zeros(len(value), bool)
    window = ta.sequence_hash(value, 3)
    if not len(window):
        return out
    inside = np.flatnonzero(row[:-2] == row[2:])
    key = ta.mix(window[inside] ^ ta.mix(row[inside].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    at = inside[twice]
    for k in range(3):
        out[at + k] = True
    return out


class Texts:
    """Words, lines and byte-class counts of a slice of texts."""

    def __init__(self, column: pa.Array) -> None:
        self.data, self.offsets = ta.flat(column)
        self.n = len(self.offsets) - 1
        self.starts, self.ends, self.before = ta.words(self.data, self.offsets)
        self.n_words = np.diff(self.before)
        self.word_row = np.repeat(np.arange(self.n), self.n_words)
        self.prefix = ta.prefix_hash(self.data)
        self.word_hash = ta.span_hash(self.prefix, self.starts, self.ends)
        breaks = np.flatnonzero(self.data == 10)
        # A text starts a line, and so does each break inside it: one at a text's end starts an empty last line there.
        place = np.concatenate([self.offsets[:-1], breaks + 1])
        owner = np.concatenate([np.arange(self.n), np.searchsorted(self.offsets[1:], breaks, "right")])
        order = np.lexsort((place, owner))
        self.line_starts, self.line_row = place[order], owner[order]
        per_row = np.bincount(owner, minlength=self.n)
        last = np.cumsum(per_row) - 1
        self.line_ends = np.empty_like(self.line_starts)
        self.line_ends[:-1] = self.line_starts[1:] - 1
        self.line_ends[last] = self.offsets[1:]
        self.line_words = np.searchsorted(self.starts, self.line_ends) - np.searchsorted(self.starts, self.line_starts)
        full = self.line_words > 0
        self.line_new = np.ones(len(full), bool)
        self.line_new[full] = _first_of_kind(self.line_row[full], ta.span_hash(self.prefix, self.line_starts[full], self.line_ends[full]))
        self.repeated = _repeated_words(self.word_row, self.word_hash)
        self.echo = np.zeros(len(self.word_hash), bool)
        self.echo[1:] = (self.word_hash[1:] == self.word_hash[:-1]) & (self.word_row[1:] == self.word_row[:-1])

    def per_row(self, row: np.ndarray, chosen: np.ndarray) -> np.ndarray:
        return np.bincount(row[chosen], minlength=self.n)

    def counts(self) -> dict[str, np.ndarray]:
        a, b = self.offsets[:-1], self.offsets[1:]
        return {
            "n_words": self.n_words,
            "word_chars": _Sums(self.data, ta.LEAD_BYTE & ~ta.SPACE_BYTE)(a, b),
            "n_symbols": _Sums(self.data, _SYMBOL)(a, b),
            "n_dup_lines": self.per_row(self.line_row, ~self.line_new),
            "n_repeat_words": self.per_row(self.word_row, self.repeated),
        }

    def statistics(self) -> dict[str, np.ndarray]:
        a, b = self.offsets[:-1], self.offsets[1:]
        c = self.counts()
        n = np.maximum(c["n_words"], 1)
        upper, lower, digit, wide = (_Sums(self.data, t)(a, b) for t in (_UPPER, _LOWER, _DIGIT, _WIDE))
        pipe, mark, stop = (_Sums(self.data, t)(a, b) for t in (_PIPE, _MARK, _STOP))
        lines = self.per_row(self.line_row, self.line_words > 0)
        distinct = self.per_row(self.word_row, _first_of_kind(self.word_row, self.word_hash))
        long = self.per_row(self.word_row, self.ends - self.starts > 20)
        size = np.maximum(b - a, 1)
        values = (
            c["n_words"], c["word_chars"] / n, upper / np.maximum(upper + lower, 1), digit / size, wide / size,
            c["n_symbols"] / n, pipe / n, mark / n, stop / n, c["n_repeat_words"] / n, self.per_row(self.word_row, self.echo) / n,
            distinct / n, c["n_dup_lines"] / np.maximum(lines, 1), c["n_words"] / np.maximum(lines, 1), long / n,
        )
        return {k: v.astype(float) for k, v in zip(STATISTICS, values)}

    def line_features(self) -> np.ndarray:
        a, b = self.line_starts, self.line_ends
        upper, lower, digit = (_Sums(self.data, t)(a, b) for t in (_UPPER, _LOWER, _DIGIT))
        symbol, pipe, mark, stop = (_Sums(self.data, t)(a, b) for t in (_SYMBOL, _PIPE, _MARK, _STOP))
        n = np.maximum(self.line_words, 1)
        echo = np.zeros(len(self.echo) + 1, np.int64)
        np.cumsum(self.echo, out=echo[1:])
        echo = echo[np.searchsorted(self.starts, b)] - echo[np.searchsorted(self.starts, a)]
        capital = upper / np.maximum(upper + lower, 1)
        tail = self.data[np.maximum(b - 1, 0)] if len(self.data) else np.zeros(len(b), np.uint8)
        full = self.line_words > 0
        columns = (
            np.ones(len(a), bool), capital >= 0.3, capital >= 0.7, symbol * 10 >= n, symbol * 2 >= n, pipe * 10 >= n, pipe * 2 >= n,
            mark * 2 >= n, digit * 4 >= b - a, echo * 10 >= n, echo * 2 >= n, self.line_words < 4, self.line_words > 30,
            (b > a) & _STOP[tail], stop * 20 >= n, ~self.line_new, ~full,
        )
        out = np.stack(columns, axis=1)
        out[~full, 1:-1] = False
        return out


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """All rows as (id, kept columns, STATISTICS as doubles). Null text is the empty text; empty texts have zeros."""
    rows = docs.select(F.col(id_col).alias("id"), *keep, F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ta.slices(batch, "text"):
                stats = Texts(part.column("text")).statistics()
                yield pa.RecordBatch.from_pydict({c: part.column(c) for c in ("id", *keep)} | {k: pa.array(v) for k, v in stats.items()})

    kinds = dict(docs.dtypes)
    schema = ", ".join([f"id {kinds[id_col]}", *(f"{c} {kinds[c]}" for c in keep), *(f"{s} double" for s in STATISTICS)])
    return rows.mapInArrow(run, schema)
