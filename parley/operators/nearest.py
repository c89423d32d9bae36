"""Nearest names of a large registry, exactly: groups around pivots are skipped by the triangle inequality of angles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import unit
from ..storage import materialise
from .identity import ASSIGN, REVIEW

#: Bytes of pivots that each task gets, vectors of a block and names that they meet at a time, rounding that angles are given, and names for each pivot to choose from.
PIVOT_BYTES, VECTORS, BLOCK, SLACK, SAMPLE = 4_000_000, 4_000, 500, 1e-6, 8
#: Rounding of a product of matrices; names that come so close are compared pair by pair.
CLOSE = 1e-9
#: Tasks that blocks are dealt out to at most; a task takes one block after the other.
TASKS = 2_000


class _Block:
    """Vectors of a block, and the best name of each among those that were shown so far."""

    def __init__(self, ids: list, v: np.ndarray, pivots: np.ndarray, radii: np.ndarray) -> None:
        self.ids, self.unit = ids, v / (np.linalg.norm(v, axis=1, keepdims=True) + 1e-9)
        self.near = np.zeros((len(ids), len(pivots)), bool)
        for low in range(0, len(ids), BLOCK):
            angle = np.arccos(np.clip(self.unit[low : low + BLOCK] @ pivots.T, -1, 1))
            self.near[low : low + BLOCK] = angle - radii <= angle.min(axis=1, keepdims=True) + SLACK
        self.best, self.name, self.compared = np.full(len(ids), -np.inf), [None] * len(ids), np.zeros(len(ids), np.int64)

    def show(self, g: int, names: pa.Array, c: np.ndarray) -> None:
        """Names of group ``g``. Products of matrices leave those that may be best; these are compared row by row, so that equal names agree."""
        rows = np.flatnonzero(self.near[:, g])
        self.compared[rows] += len(c)
        product = self.unit[rows] @ c.T
        row, col = np.nonzero(product >= np.maximum(self.best[rows], product.max(axis=1, initial=-np.inf))[:, None] - CLOSE)
        for low in range(0, len(row), 20_000):
            r, k = rows[row[low : low + 20_000]], col[low : low + 20_000]
            for i, j, x in zip(r.tolist(), k.tolist(), (c[k] * self.unit[r]).sum(axis=1).tolist()):
                if x >= self.best[i]:
                    name = names[j].as_py()
                    if x > self.best[i] or name < self.name[i]:
                        self.best[i], self.name[i] = x, name


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def spread(vectors: list[list[float]], k: int) -> list[list[float]]:
    """``k`` of the unit vectors that lie far apart: each next one is the farthest from those before, so groups stay narrow."""
    if not vectors:
        return []
    x = np.array(vectors, float)
    picked, near = [0], x @ x[0]
    while len(picked) < min(k, len(x)):
        picked.append(int(near.argmin()))
        near = np.maximum(near, x @ x[picked[-1]])
    return [vectors[i] for i in picked]


def match_pruned(vectors: DataFrame, registry: DataFrame, ident: str, vector: str, pivots: int | None = None, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Best name of each vector by cosine, like ``identity.match``, and how many pairs were compared.

    The first result has (ident, name, similarity, assigned, needs_review), the second one row (pairs, compared): vectors times
    names, and the products that were taken, those with pivots included.

    Some names, about twice the root of their number and at most ``PIVOT_BYTES`` of vectors, are pivots; they are chosen far apart
    from a sample of ``SAMPLE`` times as many, which bears on speed alone. Each name belongs to its
    nearest pivot, whose group has a radius. The nearest pivot's own cosine is a bound from below for a vector; a group whose
    pivot lies farther than that bound's angle and the radius together cannot hold the best name, as angles between unit
    vectors obey the triangle inequality. Vectors are dealt out in blocks of about ``VECTORS``; to each block go all names,
    sorted by group, which stream past it, ``BLOCK`` at a time. So a task holds one block, whatever the tables' sizes, and
    names travel once a block. Names with one vector are one, the smallest. Equal similarities go to the smallest name.

    Vectors and names must have one length; rows with null vectors have no result, and an id that
    stands there twice has one row, its best. An empty registry gives an empty result.
    """
    names = registry.where("centroid is not null").select("name", unit(F.col("centroid")).alias("c"))
    names = materialise(names.groupBy("c").agg(F.min("name").alias("name"), F.count(F.lit(1)).alias("copies")).select("name", "c", "copies"), "names")
    n, width = names.select(F.coalesce(F.sum("copies"), F.lit(0)), F.coalesce(F.max(F.size("c")), F.lit(1))).first()
    names = names.drop("copies")
    k = max(1, min(pivots or int(2 * np.sqrt(n)), PIVOT_BYTES // (8 * width)))
    # A sample of SAMPLE times as many names, by hash; its bytes are bounded like those of the pivots.
    sample = names.orderBy(F.xxhash64(F.lit(seed), "name"), "name").limit(SAMPLE * k).collect()
    chosen = spread([r.c for r in sample], k)
    rows = vectors.where(F.col(vector).isNotNull()).select(F.col(ident).alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    pivots_ = np.array(chosen, float).reshape(len(chosen), width)

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cosine = np.clip(_matrix(batch.column("c")) @ pivots_.T, -1, 1)
                own = cosine.argmax(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("name"), batch.column("c"), pa.array(own, pa.int32()), pa.array(np.arccos(cosine[np.arange(len(own)), own]))], names=["name", "c", "g", "angle"])

    kind, id_kind = dict(names.dtypes)["name"], dict(rows.dtypes)["id"]
    groups = materialise(names.mapInArrow(grouped, f"name {kind}, c array<double>, g int, angle double"), "grouped")
    radius = {r.g: r.a for r in groups.groupBy("g").agg(F.max("angle").alias("a")).collect()}  # k rows
    radii = np.array([radius.get(g, -np.inf) for g in range(len(chosen))])

    blocks = max(1, -(-rows.count() // VECTORS))
    dealt = rows.select(F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int").alias("block"), F.lit(-1).alias("g"), "id", F.lit(None).cast(kind).alias("name"), F.col("v").alias("x"))
    shown = groups.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "g", F.lit(None).cast(id_kind).alias("id"), "name", F.col("c").alias("x"))
    met = dealt.unionByName(shown).repartition(min(blocks, TASKS), "block").sortWithinPartitions("block", "g")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, held, block, schema = None, [], [], None, None

        def done() -> Iterator[pa.RecordBatch]:
            if block is not None:
                keep = [i for i, name in enumerate(block.name) if name is not None]
                columns = [pa.array([block.ids[i] for i in keep], schema.field("id").type), pa.array(block.best[keep]), pa.array([block.name[i] for i in keep], schema.field("name").type), pa.array(block.compared[keep])]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "s", "name", "n"])

        for batch in batches:
            if not batch.num_rows:
                continue
            schema = batch.schema
            own, group = (batch.column(c).to_numpy() for c in ("block", "g"))
            cuts = np.flatnonzero((np.diff(own) != 0) | (np.diff(group) != 0)) + 1
            for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                if own[low] != now:
                    yield from done()
                    now, ids, held, block = own[low], [], [], None
                part = batch.slice(low, high - low)
                if group[low] < 0:
                    ids += part.column("id").to_pylist()
                    held.append(_matrix(part.column("x")))
                elif held:
                    block = _Block(ids, np.concatenate(held), pivots_, radii) if block is None else block
                    for at in range(0, part.num_rows, BLOCK):
                        some = part.slice(at, BLOCK)
                        block.show(int(group[low]), some.column("name"), _matrix(some.column("x")))
        yield from done()

    found = met.mapInArrow(best, f"id {id_kind}, s double, name {kind}, n bigint")
    found = materialise(found.groupBy("id").agg(F.min(F.struct((-F.col("s")).alias("s"), "name")).alias("b"), F.sum("n").alias("n")), "matches")
    similarity = -F.col("b.s")
    result = found.select(F.col("id").alias(ident), F.col("b.name").alias("name"), similarity.alias("similarity"), (similarity >= ASSIGN).alias("assigned"), ((similarity >= REVIEW) & (similarity < ASSIGN)).alias("needs_review"))
    work = found.agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("c")).select((F.col("v") * n).alias("pairs"), (F.coalesce("c", F.lit(0)) + F.col("v") * len(chosen) + F.lit(n * len(chosen))).alias("compared"))
    return result, work
