"""N-gram Jaccard join by parity sketches, and the groups of near copies that its links form."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textarrays as ta
from .shared import components, materialise, named, plain, small_batches, whole_ids

#: Least size in 64-bit words of the sketch that is compared before texts are looked at again. Larger sets have a bit for
#: each shingle at least, so that the distance of unrelated sets stays far above what a link allows.
FOLD_WORDS = 16
#: Rows of a sketch word that are compared in one go; words with more rows are compared block by block.
BLOCK_ROWS = 2048


@lru_cache(maxsize=8)
def bands(percent: int, top: int = 1 << 40) -> np.ndarray:
    """Smallest set size of each size band. Sets that can link lie in one band or in two adjacent ones."""
    out = [1]
    while out[-1] < top:
        out.append(-(-out[-1] * 100 // percent) if -(-out[-1] * 100 // percent) > out[-1] else out[-1] + 1)
    return np.array(out, np.int64)


def parts_of(band: int, percent: int) -> tuple[int, int]:
    """Sketch words of a band's scheme, and in how many of them a linked pair can differ at most if one set is in this
    band and the other one there or in the next band. An eighth more words than that need agree, so that sets may leave
    out their lightest words."""
    low = bands(percent)
    most = int((low[band + 1] - 1 + low[band + 2] - 1) * (100 - percent) // (100 + percent))
    return most + 1 + most // 8, most


def shingles(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles of a slice of texts, in order, and the place where each text's begin.

    A-Z are lower-cased. A text of fewer words than ``width`` has one shingle, all its words; without words it has
    none. Hashes have 64 bits.
    """
    data, offsets = ta.flat(column)
    data = ta.LOWER[data]
    starts, ends, before = ta.words(data, offsets)
    value = ta.span_hash(ta.prefix_hash(data), starts, ends)
    runs = ta.sequence_hash(value, width)
    n_words = np.diff(before)
    counts = np.where(n_words >= width, n_words - width + 1, np.minimum(n_words, 1))
    row, place = ta.ragged(counts)
    out = np.zeros(len(row), np.uint64)
    full = n_words[row] >= width
    out[full] = runs[before[row[full]] + place[full]]
    for r in np.flatnonzero((n_words > 0) & (n_words < width)):
        own = value[before[r] : before[r + 1]]
        out[np.searchsorted(row, r)] = ta.sequence_hash(own, len(own))[0] ^ np.uint64(len(own))
    return out, np.concatenate([[0], np.cumsum(counts)])


def sketch(tokens: np.ndarray, words: int) -> np.ndarray:
    """Parity sketch: each token flips one bit of ``words`` 64-bit words. Each token that only one of two sets has
    changes one bit of one word, so Hamming distance and differing words never exceed the symmetric difference."""
    word = ((tokens >> np.uint64(32)) * np.uint64(words)) >> np.uint64(32)
    bits = np.bincount((word * np.uint64(64) + (tokens & np.uint64(63))).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.uint64)


def _folded(found: np.ndarray, words: int) -> np.ndarray:
    """The sketch of the same set with at most so many words (both are powers of two)."""
    while len(found) > words:
        found = found[::2] ^ found[1::2]
    return found


def word_keys(tokens: np.ndarray, words: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and keys of the sketch words that a set (sorted, distinct) joins on.

    A word here has a bit for each possible hash; its key is the exclusive or of its bits' values, which is equal for
    equal words. Two linked sets agree in more than ``words - most - 1`` words. A set leaves out the words of the fewest
    tokens, all up to a weight t, as long as that is not more of them than this: then a word that agrees and weighs more
    than either set's t is left in both. So empty words, which unrelated sets share, hardly ever are joined on.
    """
    word = ((tokens >> np.uint64(32)) * np.uint64(words)) >> np.uint64(32)
    begins = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    value, weight = np.bitwise_xor.reduceat(ta.mix(tokens), begins), np.diff(np.append(begins, len(tokens)))
    number = word[begins]
    lighter = np.cumsum(np.bincount(weight, minlength=1)) + words - len(begins)  # words of at most a weight, empty ones too
    least = int(np.searchsorted(lighter, words - most))  # the first weight that must stay
    if least:
        return number[weight >= least], value[weight >= least]
    empty = np.setdiff1d(np.arange(words, dtype=np.uint64), number)
    return np.concatenate([number, empty]), np.concatenate([value, np.zeros(len(empty), np.uint64)])


def _keys(tokens: np.ndarray, percent: int) -> np.ndarray:
    """Join keys of a set in its own band's scheme and in that of the band below."""
    band = int(np.searchsorted(bands(percent), len(tokens), "right")) - 1
    out = []
    for scheme in (band, band - 1):
        if scheme >= 0:
            number, value = word_keys(tokens, *parts_of(scheme, percent))
            out.append(ta.mix(value ^ ta.mix(number + (np.uint64(scheme) << np.uint64(48)))))
    return np.concatenate(out)


def _prints(docs: DataFrame, width: int, percent: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ta.slices(batch, "text"):
                value, at = shingles(part.column("text"), width)
                n, total, mixed, keys, fold = [], [], [], [], []
                for a, b in zip(at[:-1], at[1:]):
                    own = np.unique(value[a:b])
                    n.append(len(own))
                    total.append(own.sum(dtype=np.uint64))
                    mixed.append(np.bitwise_xor.reduce(ta.mix(own)) if len(own) else np.uint64(0))
                    keys.append(_keys(own, percent) if len(own) else own)
                    fold.append(sketch(own, max(FOLD_WORDS, 1 << int(len(own) // 64).bit_length())).tobytes())
                ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
                yield pa.RecordBatch.from_pydict({
                    "id": part.column("id"), "n": pa.array(n, pa.int64()),
                    "s1": pa.array(np.array(total, np.uint64).view(np.int64)), "s2": pa.array(np.array(mixed, np.uint64).view(np.int64)),
                    "fold": pa.array(fold, pa.binary()),
                    "keys": pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys).view(np.int64))),
                })

    return docs.mapInArrow(run, "id long, n long, s1 long, s2 long, fold binary, keys array<long>")


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in order of (key, id): each further id of a key with the key's smallest id."""
    last_key, last_center, last_id = None, 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        key, ident = batch.column("key").to_numpy(), batch.column("id").to_numpy()
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        new[0] = last_key is None or key[0] != last_key
        center = ident[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]
        if not new[0]:
            run = len(key) if new.sum() == 0 else int(np.flatnonzero(new)[0])
            center[:run] = last_center
        before = np.concatenate([[last_id], ident[:-1]])
        keep = ~new & (ident != before)
        last_key, last_center, last_id = key[-1], center[-1], ident[-1]
        if keep.any():
            yield pa.RecordBatch.from_pydict({"key": pa.array(key[keep]), "center": pa.array(center[keep]), "id": pa.array(ident[keep])})


def _verified(pairs: DataFrame, docs: DataFrame, prints: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose sets link. Folded sketches drop most others; the rest compare their shingles exactly."""
    side = prints.select("id", "n", "fold")
    a, b = (side.select(*[F.col(c).alias(f"{c}_{x}") for c in ("id", "n", "fold")]) for x in "ab")
    near = pairs.join(a, pairs["a"] == a["id_a"]).join(b, pairs["b"] == b["id_b"])
    near = near.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")).select("a", "b", "n_a", "n_b", "fold_a", "fold_b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most = (batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()) * (100 - percent)
            apart = np.zeros(batch.num_rows, np.int64)
            for k in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[k].as_buffer(), np.uint64) for c in ("fold_a", "fold_b"))
                apart[k] = np.bitwise_count(_folded(x, len(y)) ^ _folded(y, len(x))).sum()
            yield batch.select(["a", "b"]).filter(pa.array(apart * (100 + percent) <= most))

    close = near.mapInArrow(compare, "a long, b long")
    close = materialise(close.distinct(), "close")
    ids = close.select(F.col("a").alias("_id")).union(close.select("b")).distinct()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ta.slices(batch, "text"):
                value, at = shingles(part.column("text"), width)
                yield pa.RecordBatch.from_pydict({"id": part.column("id"), "tokens": pa.array([np.unique(value[x:y]).tobytes() for x, y in zip(at[:-1], at[1:])], pa.binary())})

    found = docs.join(ids, docs["id"] == ids["_id"], "left_semi").mapInArrow(sets, "id long, tokens binary")
    # Written, so that no task runs this and the comparison at once: each holds a Python process.
    found = materialise(found, "sets")
    left, right = (found.select(F.col("id").alias(f"id_{x}"), F.col("tokens").alias(f"tokens_{x}")) for x in "ab")
    both = close.join(left, close["a"] == left["id_a"]).join(right, close["b"] == right["id_b"]).select("a", "b", "tokens_a", "tokens_b")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for k in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[k].as_buffer(), np.uint64) for c in ("tokens_a", "tokens_b"))
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep[k] = 100 * common >= percent * (len(x) + len(y) - common)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return both.mapInArrow(test, "a long, b long")


def near_groups(docs: DataFrame, width: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of linked documents: every row as (id, n_shingles, component_id).

    Two documents link when ``100 * |common shingles| >= percent * |all their shingles|``. Sets have parity sketches
    in schemes by size band; linked sets agree in a sketch word at least, so an equi-join on the words finds all
    links. Within a word's rows only pairs with the smallest id are looked at first; these links give components.
    Then the words that still hold several components are joined with themselves across components only, so a large
    group of near copies costs one pair a member and yet no link between different texts is lost. Equal sets are
    one node throughout.

    Texts without words (null, empty, blanks) have 0 shingles, link with nothing and are their own component. A null
    id links with nothing and has a null component. Repeated ids are one node; each of their rows is returned. An
    empty table gives an empty result; further columns are ignored. Ids that are no whole numbers are refused.
    """
    whole_ids(docs, id_col)
    with small_batches(docs.sparkSession):
        return _groups(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), width, percent, id_col)


def _groups(rows: DataFrame, width: int, percent: int, id_col: str) -> DataFrame:
    """``near_groups`` of (id, text); all but the last join runs inside."""
    prints = materialise(_prints(rows, width, percent), "prints")
    known = prints.where("id is not null and n > 0")
    first = known.groupBy("n", "s1", "s2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("rows")).where("rows > 1").select(F.col("n").alias("n2"), F.col("s1").alias("t1"), F.col("s2").alias("t2"), "rep")
    # Equal sets: the links of each copy with the smallest id among the copies.
    copies = known.select("id", "n", "s1", "s2").join(first, (F.col("n") == F.col("n2")) & (F.col("s1") == F.col("t1")) & (F.col("s2") == F.col("t2")))
    copies = materialise(copies.where("id <> rep").select("id", "rep").distinct(), "copies")
    keys = known.select(F.explode("keys").alias("key"), "id").repartition("key").sortWithinPartitions("key", "id")
    stars = materialise(keys.mapInArrow(_stars, "key long, center long, id long"), "stars")

    # An id whose rows have several texts has several sets; it is never replaced by a copy of one of them.
    single = copies.join(known.groupBy("id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select(F.col("id").alias("_again")), F.col("id") == F.col("_again"), "left_anti")
    single = single.groupBy("id").agg(F.min("rep").alias("rep"))
    of = lambda x: single.select(F.col("id").alias(f"_{x}"), F.col("rep").alias(f"rep_{x}"))
    pairs = stars.select(F.col("center").alias("a"), F.col("id").alias("b")).distinct()
    pairs = pairs.join(of("a"), F.col("a") == F.col("_a"), "left").join(of("b"), F.col("b") == F.col("_b"), "left")
    pairs = pairs.select(F.coalesce("rep_a", "a").alias("a"), F.coalesce("rep_b", "b").alias("b")).where("a <> b")
    pairs = materialise(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    links = materialise(_verified(pairs, rows, known, width, percent), "verified")
    same = copies.select(F.col("rep").alias("a"), F.col("id").alias("b"))
    labels = components(links.unionByName(same))

    rest = _across(stars, labels, single, known, pairs, percent)
    more = materialise(_verified(rest, rows, known, width, percent), "verified")
    if more.limit(1).count():
        labels = components(links.unionByName(same).unionByName(more))
    out = prints.select("id", "n").join(labels.select(F.col("id").alias("_id"), "component"), F.col("id") == F.col("_id"), "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def _across(stars: DataFrame, labels: DataFrame, single: DataFrame, prints: DataFrame, tested: DataFrame, percent: int) -> DataFrame:
    """Pairs of ids in different components that share a sketch word, are close by their sketches, and were not tested.

    The rows of a word are compared in blocks within tasks, which give out close pairs only. A word with very many rows
    in several components is cut into blocks by id, and each two blocks are compared on their own.
    """
    node = stars.select("key", "id").unionByName(stars.select("key", F.col("center").alias("id")).distinct())
    named = node.join(labels.select(F.col("id").alias("_id"), "component"), F.col("id") == F.col("_id"), "left")
    named = named.select("key", "id", F.coalesce("component", "id").alias("label"))
    split = named.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.count(F.lit(1)).alias("ids"))
    split = split.where("least <> most and ids > 2").select(F.col("key").alias("_key"), F.ceil(F.col("ids") / BLOCK_ROWS).cast("int").alias("blocks"))
    left = named.join(split, F.col("key") == F.col("_key")).select("key", "id", "label", "blocks")
    left = left.join(single.select(F.col("id").alias("_id"), "rep"), F.col("id") == F.col("_id"), "left").select("key", F.coalesce("rep", "id").alias("id"), "label", "blocks").distinct()
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    # A block meets itself and every other one: group (a, b) with a <= b has the rows of both.
    both = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(F.least(own, b).alias("a"), F.greatest(own, b).alias("b")))
    rows = left.select("key", "id", "label", F.explode(both).alias("pair")).join(prints.select(F.col("id").alias("_id"), "n", "fold"), F.col("id") == F.col("_id"))
    rows = rows.select("key", F.col("pair.a").alias("a"), F.col("pair.b").alias("b"), "id", "label", "n", "fold")
    rows = rows.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("key", "a", "b")])
            cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            if held and [held[0].column(c)[0].as_py() for c in ("key", "a", "b")] != key[:, 0].tolist():
                cuts = np.concatenate([[0], cuts])
            for start, stop in zip(np.concatenate([[0], cuts]), np.append(cuts, batch.num_rows)):
                if stop > start:
                    if start in cuts and held:
                        yield _close(held, percent)
                        held = []
                    held.append(batch.slice(start, stop - start))
        if held:
            yield _close(held, percent)

    pairs = rows.mapInArrow(run, "a long, b long").distinct()
    return pairs.join(tested.select(F.col("a").alias("_a"), F.col("b").alias("_b")), (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")), "left_anti")


def _close(rows: list[pa.RecordBatch], percent: int) -> pa.RecordBatch:
    """Pairs of a block's rows of different labels whose sizes and sketches allow a link."""
    ident, label, n = (np.concatenate([r.column(c).to_numpy() for r in rows]) for c in ("id", "label", "n"))
    fold = [np.frombuffer(x.as_buffer(), np.uint64) for r in rows for x in r.column("fold")]
    words = min(len(f) for f in fold)
    bits = np.stack([_folded(f, words) for f in fold])
    out = [np.zeros((2, 0), np.int64)]
    for i in range(len(ident) - 1):
        j = slice(i + 1, None)
        apart = np.bitwise_count(bits[j] ^ bits[i]).sum(axis=1, dtype=np.int64)
        near = (label[j] != label[i]) & (ident[j] != ident[i]) & (apart * (100 + percent) <= (n[j] + n[i]) * (100 - percent))
        near &= 100 * np.minimum(n[j], n[i]) >= percent * np.maximum(n[j], n[i])
        other = ident[j][near]
        out.append(np.stack([np.minimum(other, ident[i]), np.maximum(other, ident[i])]))
    found = np.concatenate(out, axis=1)
    return pa.RecordBatch.from_pydict({"a": pa.array(found[0], pa.int64()), "b": pa.array(found[1], pa.int64())})


def one_of_each_group(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Rows that stay when each group of near copies keeps its smallest doc_id; all columns are kept.

    Rows with a null id stay, and so do all rows that repeat a kept id. Further columns may have any name.
    """
    groups = near_groups(docs, width, percent)
    rows, names = plain(docs)
    gone = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct()
    return named(rows.join(gone, F.col(names["doc_id"]) == F.col("gone"), "left_anti"), docs)
