"""Alignment of two tokenizers: byte ranges of a text that both of them cut out, and how often their ids meet."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import broadcast_if_small, materialise, small_batches
from .textarrays import ragged

#: Folder of the vocabulary files, and the two files that are aligned.
FOLDER, FILE_A, FILE_B = "/opt/tokenizers", "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Neither tokenizer has a token across such a blank: characters that are no white space stand on both sides.
CUT = re.compile(r"(?<=[!-~\w]) (?=[!-~\w])")
EDGE = re.compile(r"[!-~\w]")
#: Units that are encoded as one text, and whose alignment a task remembers; when those are more, it starts to remember anew.
RUN, REMEMBERED = 1_000, 150_000


def byte_values() -> dict[str, int]:
    """Bytes that the characters of a byte-level vocabulary stand for: printable Latin-1 characters for themselves, all
    other bytes in order for the characters from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in own)}


class Pair:
    """Both tokenizers, and the bytes and decimal form of each of their ids."""

    def __init__(self, folder: str, file_a: str, file_b: str) -> None:
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(os.path.join(folder, file_a))
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=os.path.join(folder, file_b))
        values = byte_values()
        self.bytes_a: list[bytes] = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.bytes_a[i] = bytes(values[c] for c in token) if all(c in values for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]

    def encode(self, text: str) -> tuple[list[int], list[int]]:
        """Ids of a text, a blank before it, by either tokenizer."""
        return self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids, self.b.encode(text)


@lru_cache(maxsize=1)
def loaded(folder: str, file_a: str, file_b: str) -> Pair:
    """The tokenizers of a worker process, loaded once for all its tasks."""
    return Pair(folder, file_a, file_b)


def merged(ends_a: Sequence[int], ends_b: Sequence[int]) -> tuple[list[int], list[int]]:
    """Places of the tokens of either row that end at one offset, in one pass of two pointers over the rising ends.

    Tokens have a byte or more, so at each such offset just one token of either ends.
    """
    i, j, n, m = 0, 0, len(ends_a), len(ends_b)
    at_a: list[int] = []
    at_b: list[int] = []
    while i < n and j < m:
        a, b = ends_a[i], ends_b[j]
        if a < b:
            i += 1
        elif a > b:
            j += 1
        else:
            at_a.append(i)
            at_b.append(j)
            i += 1
            j += 1
    return at_a, at_b


class Units:
    """Units that a task has aligned: the groups as text, the numbers of tokens and groups, and the linked ids of each group.

    Links are kept as places in ``pairs``, which has a << 32 | b. Units where a tokenizer's bytes differ from the unit's are
    ``bad`` and have nothing.
    """

    def __init__(self, pair: Pair) -> None:
        self.pair, self.place, self.groups, self.bad = pair, {}, [], set()
        self.counts, self.links = np.zeros((0, 3), np.int64), np.zeros(0, np.int64)
        self.pairs, self.code = np.zeros(0, np.int64), {}

    def add(self, texts: Iterable[list[str]]) -> None:
        """Align those units that are new. Units that stand between blanks everywhere are encoded in runs, as one text."""
        new = {u: None for units in texts for u in units if u not in self.place}
        odd = [u for u in new if not (u and EDGE.match(u[0]) and EDGE.match(u[-1]))]
        for u in odd:
            del new[u]
        plain = list(new)
        counts, links = [self.counts], []
        runs = [plain[k : k + RUN] for k in range(0, len(plain), RUN)] + [[u] for u in odd]
        while runs:
            run = runs.pop()
            found = self._aligned(run)
            if found is None and len(run) > 1:  # a unit among them does not come back from its tokens
                runs += [run[: len(run) // 2], run[len(run) // 2 :]]
                continue
            if found is None:
                self.bad.add(len(self.groups))
                found = [""], np.zeros((1, 3), np.int64), np.zeros(0, np.int64)
            self.place.update(zip(run, range(len(self.groups), len(self.groups) + len(run))))
            self.groups += found[0]
            counts.append(found[1])
            links.append(found[2])
        if links:
            some, at = np.unique(np.concatenate(links), return_inverse=True)
            codes = np.array([self.code.setdefault(p, len(self.code)) for p in some.tolist()], np.int64)
            self.pairs = np.fromiter(self.code, np.int64, len(self.code))
            self.counts, self.links = np.concatenate(counts), np.concatenate([self.links, codes[at]])

    def _aligned(self, run: list[str]) -> tuple[list[str], np.ndarray, np.ndarray] | None:
        """Groups, counts and links of units that are encoded as one text; None if its tokens' bytes differ from it."""
        text = " ".join(run)
        ids_a, ids_b = self.pair.encode(text)
        a, b = [self.pair.bytes_a[i] for i in ids_a], [self.pair.bytes_b[i] for i in ids_b]
        whole = (" " + text).encode("utf-8", "surrogatepass")
        if b"".join(a) != whole or b"".join(b) != whole:
            return None
        ends = np.cumsum(list(map(len, a)))
        at_a, at_b = merged(ends.tolist(), np.cumsum(list(map(len, b))).tolist())
        said_a, said_b = list(map(str, ids_a)), list(map(str, ids_b))
        said, i, j = [], 0, 0
        for k, m in zip(at_a, at_b):
            left = said_a[k] if k == i else ",".join(said_a[i : k + 1])
            said.append(left + "|" + said_b[m] if m == j else left + "|" + ",".join(said_b[j : m + 1]))
            i, j = k + 1, m + 1
        # The groups with which units end; none goes across.
        sizes = map(len, run) if text.isascii() else (len(u.encode("utf-8", "surrogatepass")) for u in run)
        stops, shared = np.cumsum(np.fromiter(sizes, np.int64, len(run)) + 1), ends[at_a]
        last = np.searchsorted(shared, stops)
        if (shared[last] != stops).any():
            raise ValueError("a token goes across a cut")
        tokens = np.stack([np.array(at_a)[last] + 1, np.array(at_b)[last] + 1, last + 1], axis=1)
        linked = np.array(ids_a, np.int64)[at_a] << 32 | np.array(ids_b, np.int64)[at_b]
        bounds = [0, *(last + 1).tolist()]
        return [";".join(said[f:e]) for f, e in zip(bounds, bounds[1:])], np.diff(tokens, axis=0, prepend=0), linked

    def rows(self, texts: list[list[str]], keep_groups: bool) -> pd.DataFrame:
        """A row for each text, given as its units."""
        used = [list(map(self.place.__getitem__, units)) for units in texts]
        if self.bad:
            used = [[] if not self.bad.isdisjoint(p) else p for p in used]
        said = [";".join(map(self.groups.__getitem__, p)) if p else None for p in used]
        sizes = list(map(len, used))
        flat, row = np.fromiter(chain.from_iterable(used), np.int64, sum(sizes)), np.repeat(np.arange(len(used)), sizes)
        n_a, n_b, n_groups = (np.bincount(row, self.counts[flat, c], len(used)).astype(np.int64) for c in range(3))
        n = self.counts[:, 2]
        unit, within = ragged(n[flat])
        size = max(len(self.pairs), 1)
        key, count = np.unique(row[unit] * size + self.links[(np.cumsum(n) - n)[flat][unit] + within], return_counts=True)
        cuts = np.searchsorted(key, np.arange(1, len(used)) * size)
        return pd.DataFrame({
            "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "groups": said if keep_groups else None,
            "groups_sha256": [hashlib.sha256(s.encode()).hexdigest() if s is not None else "" for s in said],
            "pairs": np.split(self.pairs[key % size] if len(key) else key, cuts), "counts": np.split(count, cuts),
        })


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = FOLDER, file_a: str = FILE_A, file_b: str = FILE_B, keep_groups: bool = False) -> DataFrame:
    """Alignment of each text: (row, id, n_a, n_b, n_groups, groups, groups_sha256, links array<struct<pair, n>>).

    Tokenizer A (byte-level) encodes a blank and the text, tokenizer B (pieces) the text, to which it adds the blank itself.
    Byte offsets at which tokens of both end cut them into groups, written ``a1,a2|b1;a3|b2,b3``; the two tokens that end
    at one offset are linked. ``links`` has the number of links of each id pair in the text, ``pair`` is a << 32 | b.
    ``groups`` is null unless ``keep_groups`` is set; the digest is '' for texts without tokens.

    Texts are cut at single blanks between other characters, where no token of either goes across, so each distinct unit
    of a task is encoded once, and a long text never is encoded whole. Null and empty texts, and those whose tokens' bytes
    differ from the text's, have no tokens. Repeated rows each have a row, ids may be null; an empty table
    gives an empty result; further columns are ignored.
    """
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Units(loaded(folder, file_a, file_b))
        for frame in frames:
            texts = [CUT.split(t) if isinstance(t, str) and t else [] for t in frame["text"]]
            if len(known.groups) > REMEMBERED:
                known = Units(known.pair)
            known.add(texts)
            yield known.rows(texts, keep_groups).assign(row=frame["row"].to_numpy(), id=frame["id"].to_numpy())

    schema = "row long, id %s, n_a long, n_b long, n_groups long, groups string, groups_sha256 string, pairs array<bigint>, counts array<bigint>" % kind
    return rows.mapInPandas(run, schema).withColumnRenamed("id", id_col)


def pair_counts(alignments: DataFrame) -> DataFrame:
    """How often id pairs are linked in all texts: (pair, a, b, n_pair, most_a, most_b); the last two are the highest
    counts of the pair's A id and B id. Tasks add up their own texts first."""
    each = alignments.select(F.explode(F.arrays_zip("pairs", "counts")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.counts").alias("n_pair"))
    each = materialise(each.withColumns({"a": F.shiftright("pair", 32).cast("int"), "b": F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).cast("int")}), "pairs")
    most_a, most_b = (each.groupBy(F.col(c).alias(f"_{c}")).agg(F.max("n_pair").alias(f"most_{c}")) for c in "ab")
    found = each.join(most_a, each["a"] == most_a["_a"]).join(most_b, each["b"] == most_b["_b"])
    return materialise(found.select("pair", "a", "b", "n_pair", "most_a", "most_b"), "pair-counts")


def tallied(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **files: str) -> DataFrame:
    """Alignment of each text held against all texts: (id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256).

    ``n_best`` counts links whose pair is the most frequent one of its B id in all texts, ties included; ``count_sum`` adds
    up the pairs' counts over the links. Cases are those of ``align``.

    Texts are encoded once; their numbers are written, then pairs are counted and the counts joined back, by broadcast if
    their size lies within a bound, else by a shuffled join, whose hot pairs adaptive execution splits.
    """
    with small_batches(docs.sparkSession, 1_000):
        rows = materialise(align(docs, id_col, text_col, **files).drop("groups"), "alignments")
    counts = broadcast_if_small(pair_counts(rows).select(F.col("pair").alias("_pair"), "n_pair", (F.col("n_pair") == F.col("most_b")).alias("best")), 64_000_000)
    links = rows.select("row", F.explode(F.arrays_zip("pairs", "counts")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.counts").alias("n"))
    held = links.join(counts, links["pair"] == counts["_pair"])
    per = held.groupBy(F.col("row").alias("_row")).agg(
        F.sum("n").alias("n_links"), F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("n_pair")).alias("count_sum")
    )
    some = rows.join(per, rows["row"] == per["_row"], "left")
    none = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_links", "n_best", "count_sum")]
    return some.select(id_col, "n_a", "n_b", "n_groups", *none, "groups_sha256")
