"""Sound in blocks of equal length with a halo, so that frames, filters and gains do not see where chunks were cut."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Length of a block. Work on a block takes some ten times its samples of memory, whatever the length of files and chunks.
BLOCK_MS = 10_000


def samples_of(ms: int | float) -> Column:
    """Samples that so many milliseconds take, rounded up, by the column ``rate``."""
    return F.ceil(F.col("rate") * F.lit(ms) / 1000).cast("long")


def blocks(chunks: DataFrame, before: Column, after: Column, block_ms: int = BLOCK_MS) -> DataFrame:
    """Blocks of a file's samples: (file_id, block, rate, size, first, starts array<long>, lengths array<int>, samples).

    ``chunks`` has file_id, start_ms, rate, samples, of any lengths, without laps. Block b owns the samples from b * size on,
    ``size`` of them, and holds ``before`` samples before and ``after`` samples after its own, as far as the file has any.
    ``starts`` and ``lengths`` tell where its pieces lie; what no chunk holds counts as silence (``laid``). Chunks send each
    block only what it needs, so a file of any length spreads over as many tasks as it has blocks. Chunks without a rate
    or samples give none.
    """
    size, first = samples_of(block_ms), F.round(F.col("start_ms") * F.col("rate") / 1000).cast("long")
    rows = chunks.select("file_id", "rate", "samples", first.alias("s"), size.alias("size"), before.cast("long").alias("before"), after.cast("long").alias("after")).where("rate > 0 and size(samples) > 0")
    rows = rows.withColumn("e", F.col("s") + F.size("samples"))
    low = F.greatest(F.floor((F.col("s") - F.col("after")) / F.col("size")), F.lit(0))
    high = F.floor((F.col("e") - 1 + F.col("before")) / F.col("size"))
    each = rows.withColumn("block", F.explode(F.sequence(low, F.greatest(low, high))))
    a = F.greatest(F.col("s"), F.col("block") * F.col("size") - F.col("before"))
    b = F.least(F.col("e"), (F.col("block") + 1) * F.col("size") + F.col("after"))
    each = each.withColumns({"a": a, "b": b}).where("b > a")
    piece = F.struct("a", F.slice("samples", (F.col("a") - F.col("s") + 1).cast("int"), (F.col("b") - F.col("a")).cast("int")).alias("x"))
    held = each.select("file_id", "block", "rate", "size", piece.alias("p")).groupBy("file_id", "block", "rate", "size").agg(F.array_sort(F.collect_list("p")).alias("p"))
    return held.select(
        "file_id", "block", "rate", "size", F.element_at("p.a", 1).alias("first"), F.col("p.a").alias("starts"),
        F.transform("p", lambda q: F.size(q["x"])).alias("lengths"), F.flatten("p.x").alias("samples"),
    )


@dataclass
class Block:
    """A block laid out: ``x`` from sample ``first`` on, its own part from ``low`` to ``high``, and whether the file ends in it."""

    row: tuple
    x: np.ndarray
    first: int
    low: int
    high: int
    ended: bool

    @property
    def end(self) -> int:
        return self.first + len(self.x)

    def frames(self, size: int, hop: int, centred: bool = False, more: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and samples of the frames that are the block's: those that begin, or if ``centred`` have their middle, in
        its own part. Frame k begins at k * hop, or has its middle there. ``more`` takes so many samples on both sides as own.

        Centred frames see silence before and after the file and reach up to its end; others lie within the file.
        """
        low, high = max(0, self.low - more), self.high + more
        k0, back = -(-low // hop), size // 2 if centred else 0
        last = self.end // hop if centred else (self.end - size) // hop
        k1 = min(-(-high // hop) - 1, last if self.ended or not centred else -(-high // hop) - 1)
        if k1 < k0:
            return np.zeros(0, np.int64), np.zeros((0, size))
        start, stop = k0 * hop - back, k1 * hop - back + size
        x = np.zeros(stop - start)
        a, b = max(start, self.first), min(stop, self.end)
        if b > a:
            x[a - start : b - start] = self.x[a - self.first : b - self.first]
        return np.arange(k0, k1 + 1), np.lib.stride_tricks.sliding_window_view(x, size)[::hop]


def laid(rows: Iterator[pd.DataFrame], after) -> Iterator[Block]:
    """Blocks of a task one by one. ``after(rate)`` is the halo behind that the blocks were made with."""
    for frame in rows:
        for row in frame.itertuples(index=False):
            ends = np.asarray(row.starts, np.int64) + np.asarray(row.lengths, np.int64)
            x, flat, at = np.zeros(int(ends.max()) - row.first), np.asarray(row.samples, float), 0
            for start, n in zip(row.starts, row.lengths):
                x[start - row.first : start - row.first + n] = flat[at : at + n]
                at += n
            low, high = int(row.block * row.size), int((row.block + 1) * row.size)
            yield Block(row, np.nan_to_num(x), int(row.first), low, high, row.first + len(x) < high + after(row.rate))
