"""Quality classifier: rules from tree paths, weighted by a lasso logistic fit, compiled to Spark columns."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .statistics import STATISTICS, with_statistics

#: The fit sees at most so many labelled rows of each class, those whose ids have the smallest hashes.
FIT_ROWS = 8_000


@dataclass
class RuleModel:
    """``bias`` plus the weights of the conjunctive rules that hold, through the logistic function.

    A rule is a tuple of (statistic, at_most, bound): the statistic is at most the bound, or above it.
    """

    bias: float
    rules: list[tuple[tuple[tuple[str, bool, float], ...], float]] = field(default_factory=list)

    def score(self) -> Column:
        """The score as one JVM expression over the statistics' columns."""
        total = F.lit(self.bias)
        for conditions, weight in self.rules:
            holds = F.lit(True)
            for name, at_most, bound in conditions:
                holds = holds & ((F.col(name) <= bound) if at_most else (F.col(name) > bound))
            total = total + F.when(holds, weight).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-total))


def _grow(x: np.ndarray, y: np.ndarray, at: np.ndarray, depth: int, path: tuple, found: list, least: int) -> np.ndarray:
    """A regression tree on binned statistics; adds each node's path to ``found`` and returns the rows' values."""
    value = np.full(len(at), y[at].mean())
    if path:
        found.append(path)
    if not depth or len(at) < 2 * least:
        return value
    best = (1e-12, None)
    for j in range(x.shape[1]):
        n = np.bincount(x[at, j], minlength=64)
        s = np.bincount(x[at, j], weights=y[at], minlength=64)
        left_n, left_s = np.cumsum(n)[:-1], np.cumsum(s)[:-1]
        right_n, right_s = len(at) - left_n, s.sum() - left_s
        good = (left_n >= least) & (right_n >= least)
        gain = np.where(good, left_s**2 / np.maximum(left_n, 1) + right_s**2 / np.maximum(right_n, 1), 0) - s.sum() ** 2 / len(at)
        gain[~good] = 0
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (gain[k], (j, k))
    if best[1] is None:
        return value
    j, k = best[1]
    low = x[at, j] <= k
    value[low] = _grow(x, y, at[low], depth - 1, (*path, (j, True, k)), found, least)
    value[~low] = _grow(x, y, at[~low], depth - 1, (*path, (j, False, k)), found, least)
    return value


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, lasso: float = 2e-3, rounds: int = 300, seed: int = 5) -> RuleModel:
    """Boosted shallow trees give the rules; proximal gradient steps give sparse logistic weights.

    Classes count equally whatever their numbers. With no rows, or one class only, the model is a constant.
    """
    if not len(y) or y.min() == y.max():
        return RuleModel(0.0 if not len(y) else (2.0 if y[0] else -2.0))
    random = np.random.default_rng(seed)
    # Bounds lie half-way between neighbouring quantiles, so that a rule leaves both sides the same margin.
    bounds = [(q[1:] + q[:-1]) / 2 if len(q) > 1 else q for q in (np.unique(np.quantile(x[:, j], np.linspace(0, 1, 33))) for j in range(x.shape[1]))]
    binned = np.stack([np.searchsorted(b, x[:, j], "left") for j, b in enumerate(bounds)], axis=1)
    part = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum()) * len(y)
    target, paths, margin = np.where(y == 1, 1.0, -1.0), [], np.zeros(len(y))
    least = max(4, len(y) // 200)
    for _ in range(trees):
        at = np.flatnonzero(random.random(len(y)) < 0.6)
        if len(at) < 2 * least:
            at = np.arange(len(y))
        rest = part * target / (1 + np.exp(target * margin))
        value = np.zeros(len(y))
        grown: list = []
        _grow(binned, rest, at, depth, (), grown, least)
        paths += grown
        leaves = [p for p in grown if len(p) == depth] or grown
        for p in leaves:
            inside = _holds(binned, p)
            value[inside] = rest[inside].mean() if inside.any() else 0
        margin += value
    paths = list(dict.fromkeys(tuple(sorted(set(p))) for p in paths))
    if not paths:
        return RuleModel(0.0)
    z = np.stack([_holds(binned, p) for p in paths], axis=1).astype(float)
    weight, bias = _lasso(z, y.astype(float), part / len(y), lasso, rounds)
    rules = [(tuple((STATISTICS[j], low, float(bounds[j][k])) for j, low, k in p if k < len(bounds[j])), float(w)) for p, w in zip(paths, weight) if w]
    return RuleModel(float(bias), rules)


def _holds(binned: np.ndarray, path: tuple) -> np.ndarray:
    out = np.ones(len(binned), bool)
    for j, low, k in path:
        out &= (binned[:, j] <= k) == low
    return out


def _lasso(z: np.ndarray, y: np.ndarray, part: np.ndarray, lasso: float, rounds: int) -> tuple[np.ndarray, float]:
    weight, bias = np.zeros(z.shape[1]), 0.0
    ahead, ahead_bias, t = weight.copy(), bias, 1.0
    step = 4.0 / max(1.0, np.linalg.norm(z * np.sqrt(part)[:, None], 2) ** 2 + 1.0)
    for _ in range(rounds):
        miss = part * (1 / (1 + np.exp(-(z @ ahead + ahead_bias))) - y)
        new = ahead - step * (z.T @ miss)
        new = np.sign(new) * np.maximum(np.abs(new) - step * lasso, 0)
        new_bias = ahead_bias - step * miss.sum()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, ahead_bias = new + (t - 1) / t2 * (new - weight), new_bias + (t - 1) / t2 * (new_bias - bias)
        weight, bias, t = new, new_bias, t2
    return weight, bias


def held_out(doc_id: Column, parts: int = 3, part: int = 1) -> Column:
    """True for rows that no fit sees: crc32 of the id as text leaves ``part``. A null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int, label: str = "quality") -> DataFrame:
    """Documents (id, text, label) of at most ``rows`` labelled ids of each class, by the ids' hashes.

    Ids labelled twice count once, with the smaller label; of rows that repeat an id one counts, that with the smallest
    text. The sample's ids are broadcast: their number is bounded. Further columns, whatever their names, are ignored.
    """
    ids = labels.select("doc_id", F.col(label).alias(label)).where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).cast("int").alias("label"))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    chosen = ids.where("label = 0").orderBy(*order).limit(rows).unionByName(ids.where("label = 1").orderBy(*order).limit(rows))
    chosen = chosen.withColumnRenamed("doc_id", "_id")
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    return found.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, seed: int = 5) -> RuleModel:
    """Fit on labelled rows outside the held-out third; only their statistics reach the driver, ``rows`` a class."""
    known = labels.where(~held_out(F.col("doc_id")))
    sample = with_statistics(labelled_sample(docs, known, rows), keep=("label",)).orderBy("id").toPandas()
    return fit_rules(sample[list(STATISTICS)].to_numpy(float), sample["label"].to_numpy(int), seed=seed)


def score(docs: DataFrame, model: RuleModel) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row; texts that are null or empty get the score of zeros.

    Repeated rows get equal scores; a null id stays null. Further columns, whatever their names, are ignored.
    """
    rows = with_statistics(docs)
    return rows.select(
        F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), model.score().alias("score")
    ).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, model: RuleModel) -> DataFrame:
    """Rows whose score is 0.5 or more, with all their columns, in one pass over the texts."""
    from collections.abc import Iterator

    import pyarrow as pa

    from . import textarrays as ta
    from .statistics import Texts

    names = [f"c{k}" for k in range(len(docs.columns))]
    text = names[docs.columns.index("text")]
    plain = docs.toDF(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ta.slices(batch, text):
                stats = Texts(part.column(text)).statistics()
                yield pa.RecordBatch.from_pydict({c: part.column(c) for c in names} | {k: pa.array(v) for k, v in stats.items()})

    schema = ", ".join([*(f"{n} {k}" for n, (_, k) in zip(names, docs.dtypes)), *(f"{s} double" for s in STATISTICS)])
    return plain.mapInArrow(run, schema).where(model.score() >= 0.5).select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])
