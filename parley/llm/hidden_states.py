"""Hidden Markov language model: latent states trained by Baum-Welch over Spark partitions, exact text likelihoods."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textarrays as ta
from .rule_ensemble import held_out
from .shared import materialise, remove_table, whole_ids

#: Latent states, passes over all training texts, and chance to stay in a state before the first pass.
STATES, PASSES, STAY = 4, 5, 0.98
#: A word type has emissions of its own from so many training tokens on, however large the corpus is. States of a type that
#: stands in one place only are those of this place and tell nothing of others; a second place is the least that can.
LEAST = 2
#: Rarer types share the emissions of a class by their length (three bits) and their last two bytes (nine bits).
CLASSES = 1 << 12
#: Tokens of a block, of a stretch of a block that is worked on at a time, and of a piece that advances in step with others.
BLOCK_TOKENS, STRETCH, PIECE = 2_500_000, 300_000, 1_024
#: The recursions are scaled at every such place; between them a probability shrinks by a power that doubles hold.
SCALED = 8
#: Rows of one exchange part and blocks of a group, about.
PART_ROWS, GROUP_BLOCKS = 400_000, 256
#: Hash that stands for the end of a text.
END = np.uint64(0xE4D0F7E87ED0C5A1)


def _pack(values: np.ndarray) -> bytes:
    return len(values).to_bytes(8, "little") + pa.compress(values.tobytes(), "zstd", asbytes=True)


def _unpack(packed: bytes, kind: type) -> np.ndarray:
    n = int.from_bytes(packed[:8], "little")
    return np.frombuffer(pa.decompress(packed[8:], n * np.dtype(kind).itemsize, "zstd", asbytes=True), kind) if n else np.zeros(0, kind)


def _pack_rising(values: np.ndarray) -> bytes:
    """Values that mostly rise, as gaps whose bytes of equal weight stand together."""
    gaps = np.diff(values, prepend=values.dtype.type(0))
    return _pack(gaps.view(np.uint8).reshape(-1, values.itemsize).T.ravel())


def _unpack_rising(packed: bytes, kind: type) -> np.ndarray:
    gaps = _unpack(packed, np.uint8).reshape(np.dtype(kind).itemsize, -1).T
    return np.cumsum(np.ascontiguousarray(gaps).view(kind).ravel(), dtype=kind)


# --- corpus as blocks ---------------------------------------------------------------------------------------------


def tokenised(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and shapes of the lower-cased words of each text and of its end, and the number of tokens of each text.

    The shape is the class of a word that is too rare for emissions of its own.
    """
    data, offsets = ta.flat(column)
    data = ta.LOWER[data]
    starts, ends, before = ta.words(data, offsets)
    value = ta.span_hash(ta.prefix_hash(data), starts, ends)
    if len(ends):
        tail = data[ends - 1].astype(np.uint64) * np.uint64(256) + data[np.maximum(ends - 2, starts)]
        shape = (ta.mix(tail) & np.uint64(511)).astype(np.int64) + 512 * np.minimum(ends - starts - 1, 7)
    else:
        shape = np.zeros(0, np.int64)
    return np.insert(value, before[1:], END), np.insert(shape, before[1:], 0), np.diff(before) + 1


_BLOCK = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("n_tokens", pa.list_(pa.int32())), ("tokens", pa.binary()), ("types", pa.binary()), ("shapes", pa.binary()), ("counts", pa.binary()), ("n_types", pa.int64())])


def blocks(docs: DataFrame, parts: int = 7, part: int = 2) -> DataFrame:
    """Texts as blocks of about ``BLOCK_TOKENS`` tokens: a word type is stored once a block, tokens as numbers.

    One row a block: (block, doc_ids, held, n_tokens, tokens, types, shapes, counts, n_types); ``counts`` has a type's
    training tokens. A block is made by one task from consecutive rows and never split, so no text leaves its task. What
    blocks hold has no influence on results but for rounding, since all that is learnt are sums over all blocks.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), parts, part).alias("held"), "text")

    def pack(pieces: list[tuple]) -> pa.RecordBatch:
        ids, held, n, types, tokens, shapes, seen = zip(*pieces)
        kinds, first = np.unique(np.concatenate(types), return_index=True)
        where = [np.searchsorted(kinds, t) for t in types]
        counts = sum(np.bincount(w, weights=c, minlength=len(kinds)) for w, c in zip(where, seen)).astype(np.int64)
        row = {
            "block": [uuid.uuid4().int >> 65], "doc_ids": [pa.concat_arrays(ids).to_pylist()], "held": [np.concatenate(held).tolist()], "n_tokens": [np.concatenate(n).tolist()],
            "tokens": [_pack(np.concatenate([w.astype(np.int32)[t] for w, t in zip(where, tokens)]))], "types": [_pack_rising(kinds)], "shapes": [_pack(np.concatenate(shapes)[first])],
            "counts": [_pack(counts)], "n_types": [len(kinds)],
        }
        return pa.RecordBatch.from_pydict(row, schema=_BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, size = [], 0
        for batch in batches:
            for piece in ta.slices(batch, "text"):
                value, shape, n = tokenised(piece.column("text"))
                held = piece.column("held").to_numpy(zero_copy_only=False)
                types, first, tokens = np.unique(value, return_index=True, return_inverse=True)
                seen = np.bincount(tokens[np.repeat(~held, n)], minlength=len(types))
                pieces.append((piece.column("doc_id"), held, n, types, tokens.astype(np.int32), shape[first].astype(np.int16), seen))
                size += len(value)
                if size >= BLOCK_TOKENS:
                    yield pack(pieces)
                    pieces, size = [], 0
        if size:
            yield pack(pieces)

    schema = "block long, doc_ids array<long>, held array<boolean>, n_tokens array<int>, tokens binary, types binary, shapes binary, counts binary, n_types long"
    return materialise(rows.mapInArrow(run, schema), "blocks")


# --- sums over all blocks -------------------------------------------------------------------------------------------


def _parts(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Parts that a block's sorted keys fall into, and where each one's keys begin; one more is the end."""
    part, first = np.unique((keys >> np.uint64(64 - bits)).astype(np.int64), return_index=True)
    return part, np.append(first, len(keys))


def _sent(block: int, part: np.ndarray, ends: np.ndarray, keys: np.ndarray, values: np.ndarray, plan: Plan, facts: np.ndarray | None = None) -> pa.Table:
    """What a block sends to the exchange: keys, sorted in each part, and a row of values for each; facts go to the first part."""
    n = len(part)
    return pa.Table.from_pydict({
        "block": pa.array([block] * n, pa.int64()), "part": pa.array(part, pa.int64()), "team": pa.array([block % plan.teams] * n, pa.int64()),
        "keys": pa.array([_pack_rising(keys[a:b]) for a, b in zip(ends, ends[1:])], pa.binary()),
        "values": pa.array([plan.packed(values[a:b]) for a, b in zip(ends, ends[1:])], pa.binary()),
        "facts": pa.array([None if facts is None else facts.tolist(), *[None] * (n - 1)], pa.list_(pa.float64())),
    })


_SENT = "block long, part long, team long, keys binary, values binary, facts array<double>"


@dataclass(frozen=True)
class Plan:
    """How an exchange deals out its rows: leading bits of the keys, and teams of blocks.

    Keys are those of types, with whole numbers, or else ranks of kinds in their part, with 32-bit floats.
    """

    bits: int
    teams: int
    ranked: bool = True
    #: Values of a key, of which the last ones are the same in all blocks and are not added up.
    width: int = STATES
    same: int = 0

    def keys(self, packed: bytes) -> np.ndarray:
        return _unpack_rising(packed, np.int32 if self.ranked else np.uint64)

    def values(self, packed: bytes) -> np.ndarray:
        flat = np.frombuffer(packed, np.float32) if self.ranked else _unpack(packed, np.int64)
        return flat.reshape(-1, self.width).astype(float)

    def added(self, table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """Distinct keys of some rows, their summed values, for each row's key its place, and the keys by row."""
        keys = [self.keys(x.as_py()) for x in table.column("keys")]
        values = np.concatenate([self.values(x.as_py()) for x in table.column("values")])
        at = np.concatenate(keys)
        if self.ranked:
            there = np.bincount(at) > 0
            kinds, first, at = np.flatnonzero(there).astype(np.int32), None, (np.cumsum(there) - 1)[at]
        else:
            kinds, first, at = np.unique(at, return_index=True, return_inverse=True)
        columns = [np.bincount(at, weights=values[:, c], minlength=len(kinds)) if c < self.width - self.same else values[first, c] for c in range(self.width)]
        return kinds, np.stack(columns, axis=1), at, keys

    def packed(self, values: np.ndarray) -> bytes:
        return np.ascontiguousarray(values, np.float32).tobytes() if self.ranked else _pack(np.rint(values).astype(np.int64).ravel())


def _facts(table: pa.Table) -> list | None:
    found = [np.array(x) for x in table.column("facts").to_pylist() if x is not None]
    return sum(found[1:], found[0]).tolist() if found else None


def totals(sent: DataFrame, plan: Plan, told, label: str = "totals") -> DataFrame:
    """Sums over all blocks, in two levels: the blocks of a team first, then the teams of a part.

    ``told(keys, totals)`` makes of a part's sums the values that go back and its facts. Returns the written rows (part,
    team, keys, values, facts): these values for the keys that the team has, and with a null team the facts, followed by
    those that blocks sent. A key that all blocks have costs a row a team.
    """

    def by_team(table: pa.Table) -> pa.Table:
        kinds, sums, _, _ = plan.added(table)
        return pa.Table.from_pydict({"part": table.column("part").slice(0, 1), "team": table.column("team").slice(0, 1), "keys": [_pack_rising(kinds)], "values": [plan.packed(sums)], "facts": pa.array([_facts(table)], pa.list_(pa.float64()))})

    def by_part(table: pa.Table) -> pa.Table:
        kinds, sums, at, keys = plan.added(table)
        values, own = told(kinds, sums)
        back = np.split(values[at], np.cumsum([len(k) for k in keys])[:-1])
        facts = [own, *(np.array(x) for x in [_facts(table)] if x is not None)]
        return pa.Table.from_pydict({
            "part": [*table.column("part").to_pylist(), table.column("part")[0].as_py()], "team": pa.array([*table.column("team").to_pylist(), None], pa.int64()),
            "keys": pa.array([*map(_pack_rising, keys), None], pa.binary()), "values": pa.array([*map(plan.packed, back), None], pa.binary()),
            "facts": pa.array([*[None] * len(keys), np.concatenate(facts).tolist()], pa.list_(pa.float64())),
        })

    schema = "part long, team long, keys binary, values binary, facts array<double>"
    teams = sent.groupBy("part", "team").applyInArrow(by_team, schema)
    return materialise(teams.groupBy("part").applyInArrow(by_part, schema), label)


def _collected(found: DataFrame, size: int) -> np.ndarray:
    """Facts added up over the parts; there are ``size`` of them however large the corpus is."""
    rows = found.where("team is null").select(F.posexplode("facts").alias("place", "x")).groupBy("place").agg(F.sum("x").alias("x")).collect()
    out = np.zeros(size)
    for r in rows:
        out[r["place"]] = r["x"]
    return out


def answers(found: DataFrame, places: DataFrame, plan: Plan) -> DataFrame:
    """``totals`` brought back to the blocks, as (block, part, values); ``places`` has the keys of each block and part."""

    def run(own: pa.Table, sums: pa.Table) -> pa.Table:
        keys, values = plan.keys(sums.column("keys")[0].as_py()), plan.values(sums.column("values")[0].as_py())
        back = [plan.packed(values[np.searchsorted(keys, plan.keys(x.as_py()))]) for x in own.column("keys")]
        return pa.Table.from_pydict({"block": own.column("block"), "part": own.column("part"), "values": pa.array(back, pa.binary())})

    right = found.where("team is not null").select("part", "team", "keys", "values")
    return places.groupBy("part", "team").cogroup(right.groupBy("part", "team")).applyInArrow(run, "block long, part long, values binary")


def _values(found: pa.Table, plan: Plan) -> np.ndarray:
    """Values of a block's sorted keys, from the answers of its parts."""
    return np.concatenate([plan.values(x.as_py()) for x in found.sort_by("part").column("values")])


# --- what emits -----------------------------------------------------------------------------------------------------


@dataclass
class Vocabulary:
    """Training tokens, types, and types with emissions of their own; tokens and types of each class of the others; bits of
    the exchange parts."""

    n: int
    v: int
    own: int
    class_tokens: np.ndarray
    class_types: np.ndarray
    bits: int = 4

    @property
    def room(self) -> int:
        """Parts that every state leaves for types: one for each training type and one more for each class."""
        return self.n + self.v + CLASSES


def class_key(shape: np.ndarray) -> np.ndarray:
    """Key that a class of rare types has for ``spread``."""
    return ta.mix(np.asarray(shape).astype(np.uint64) + np.uint64(0xC1A5500000000001))


_CODED = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("n_tokens", pa.list_(pa.int32())), ("n_known", pa.list_(pa.int64())), ("base", pa.list_(pa.float64())), ("within", pa.list_(pa.float64())), ("tokens", pa.binary()), ("own", pa.binary()), ("parts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("ranks", pa.binary()), ("totals", pa.binary()), ("types", pa.binary())])


def own_from(n_train: int) -> int:
    """A ``least`` for callers who want fewer types of their own, about as many as the root of the training tokens.

    Nothing here calls it: a threshold that follows the corpus makes scores depend on a size.
    """
    return max(LEAST, int(np.sqrt(n_train) / 75))


def coded(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, Vocabulary]:
    """Blocks whose tokens are numbers of what emits them: a type of its own or a class of rare types.

    (block, doc_ids, held, n_tokens, n_known, base, within, tokens, own, parts, ends, ranks, totals, types): for each text
    its known tokens, the add-one unigram log10 score, and the log10 odds of its rare types within their classes; keys of
    the types of their own; exchange parts of the kinds and where each one's begin; for each kind its rank in its part,
    training tokens and training types. Types of their own come by key, then classes by number, which are one part more
    and have their number as rank. Counts are those of all training texts.
    """
    corpus = blocks(docs)
    row = corpus.agg(F.sum("n_types").alias("types"), F.count(F.lit(1)).alias("blocks")).first()
    plan = Plan(_bits(row["types"]), _teams(row["blocks"]), ranked=False, width=2, same=1)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                columns = [_unpack(batch.column(c)[k].as_py(), kind) for c, kind in (("counts", np.int64), ("shapes", np.int16))]
                types = _unpack_rising(batch.column("types")[k].as_py(), np.uint64)
                yield from _sent(batch.column("block")[k].as_py(), *_parts(types, plan.bits), types, np.stack(columns, axis=1), plan).to_batches()

    def told(_: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        seen = sums[:, 0] > 0
        rare = seen & (sums[:, 0] < least)
        own = seen & ~rare
        shape = sums[rare, 1].astype(np.int64)
        facts = np.concatenate([[sums[:, 0].sum(), seen.sum(), own.sum()], np.bincount(shape, weights=sums[rare, 0], minlength=CLASSES), np.bincount(shape, minlength=CLASSES)])
        return np.stack([sums[:, 0], np.cumsum(own) - 1], axis=1), facts

    sent = corpus.select("block", "types", "counts", "shapes").mapInArrow(send, _SENT)
    found = totals(sent, plan, told, "counts")
    flat = _collected(found, 3 + 2 * CLASSES).astype(np.int64)
    vocabulary = Vocabulary(int(flat[0]), int(flat[1]), int(flat[2]), flat[3 : 3 + CLASSES], flat[3 + CLASSES :], plan.bits)
    places = sent.select("block", "part", "team", "keys")
    n, v, class_tokens, class_types = vocabulary.n, vocabulary.v, vocabulary.class_tokens, vocabulary.class_types

    def code(own: pa.Table, back: pa.Table) -> pa.Table:
        if not own.num_rows:
            return _CODED.empty_table()
        types, shape = _unpack_rising(own.column("types")[0].as_py(), np.uint64), _unpack(own.column("shapes")[0].as_py(), np.int16).astype(np.int64)
        tokens, counts = _unpack(own.column("tokens")[0].as_py(), np.int32), np.array(own.column("n_tokens")[0].as_py(), np.int64)
        total, rank = _values(back, plan).T
        rare = (total < least) | (total == 0)
        classes, of_rare = np.unique(shape[rare], return_inverse=True)
        kinds = types[~rare]
        of_type = np.empty(len(types), np.int32)
        of_type[~rare], of_type[rare] = np.arange(len(kinds)), len(kinds) + of_rare
        part, ends = _parts(kinds, plan.bits)
        if len(classes):
            part, ends = np.append(part, 1 << plan.bits), np.append(ends, len(kinds) + len(classes))
        of_kind = np.concatenate([total[~rare], class_tokens[classes]]), np.concatenate([np.ones(len(kinds), np.int64), class_types[classes] + 1])
        within = np.where(rare, np.log10((total + 1) / (class_tokens[shape] + class_types[shape] + 1)), 0.0)
        starts = np.cumsum(counts) - counts
        add = lambda per_type: np.add.reduceat(per_type[tokens], starts).tolist()
        return pa.Table.from_pydict({
            "block": own.column("block"), "doc_ids": own.column("doc_ids"), "held": own.column("held"), "n_tokens": own.column("n_tokens"), "n_known": [add((total > 0).astype(np.int64))],
            "base": [add(np.log10((total + 1) / (n + v + 1)))], "within": [add(within)], "tokens": [_pack(of_type[tokens])],
            "own": [_pack_rising(kinds)], "parts": [part.tolist()], "ends": [ends.tolist()], "ranks": [_pack_rising(np.concatenate([rank[~rare], classes]).astype(np.int32))],
            "totals": [_pack(of_kind[0].astype(np.int64))], "types": [_pack(of_kind[1].astype(np.int64))],
        }, schema=_CODED)

    schema = "block long, doc_ids array<long>, held array<boolean>, n_tokens array<int>, n_known array<long>, base array<double>, within array<double>, tokens binary, own binary, parts array<long>, ends array<long>, ranks binary, totals binary, types binary"
    made = corpus.groupBy("block").cogroup(answers(found, places, plan).groupBy("block")).applyInArrow(code, schema)
    made = materialise(made, "coded")
    for table in (corpus, found):
        remove_table(table)
    return made, vocabulary


def _bits(rows: int | None) -> int:
    """Leading key bits that deal rows out to exchange parts of about ``PART_ROWS``."""
    return max(4, min(24, int(np.ceil(np.log2(max(1, (rows or 0) / PART_ROWS))))))


def _teams(n_blocks: int) -> int:
    return max(1, -(-n_blocks // GROUP_BLOCKS))


# --- model --------------------------------------------------------------------------------------------------------


@dataclass
class StateModel:
    """``before``: state ahead of a text's first token; ``step``: state to next state; ``emit``: state to kind of token."""

    before: np.ndarray
    step: np.ndarray
    emit: np.ndarray


class _Pieces:
    """Texts cut into pieces of ``PIECE`` tokens that advance side by side, longest pieces first."""

    def __init__(self, n_tokens: np.ndarray) -> None:
        per_text = -(-n_tokens // PIECE)
        text, place = ta.ragged(per_text)
        first = (np.cumsum(n_tokens) - n_tokens)[text] + place * PIECE
        size = np.minimum(n_tokens[text] - place * PIECE, PIECE)
        order = np.argsort(-size, kind="stable")
        self.first, self.size, self.text = first[order], size[order], text[order]
        self.active = self._active(self.size)
        #: Rows of texts with several pieces; for the j-th piece of those that have one: texts, rows, and rows among these.
        self.several = np.flatnonzero(per_text[self.text] > 1)
        place = place[order][self.several]
        by_place = np.argsort(place, kind="stable")
        cuts = np.searchsorted(place[by_place], np.arange(int(place.max(initial=-1)) + 2))
        self.steps = [(self.text[self.several[x]], self.several[x], x) for x in (by_place[a:b] for a, b in zip(cuts[:-1], cuts[1:]))]

    @staticmethod
    def _active(size: np.ndarray) -> np.ndarray:
        """Number of pieces that still go on at each place."""
        return np.searchsorted(-size, -np.arange(int(size.max(initial=0))), "left")

    def ordered(self, emit: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens place by place: their kinds, the emissions of these (state, token), and where each place begins."""
        ends = np.concatenate([[0], np.cumsum(self.active)])
        row = np.arange(ends[-1]) - np.repeat(ends[:-1], self.active)
        kinds = cls[self.first[row] + np.repeat(np.arange(len(self.active)), self.active)]
        return kinds, np.ascontiguousarray(np.ascontiguousarray(emit.T)[kinds].T), ends

    def transfer(self, model: StateModel, cls: np.ndarray) -> np.ndarray:
        """Scaled matrices from the state before a piece to the state at its end, where a text has several."""
        k, first = len(model.before), self.first[self.several]
        m = np.broadcast_to(np.eye(k), (len(first), k, k)).copy()
        emit = np.ascontiguousarray(model.emit.T)
        for t, n in enumerate(self._active(self.size[self.several])):
            new = (m[:n].reshape(-1, k) @ model.step).reshape(n, k, k) * emit[cls[first[:n] + t]][:, None, :]
            if t % SCALED == 0:
                new /= new.max(axis=(1, 2))[:, None, None]
            m[:n] = new
        return m / m.max(axis=(1, 2), initial=1e-300)[:, None, None]

    def starts(self, model: StateModel, m: np.ndarray, n_texts: int) -> np.ndarray:
        """State ahead of each piece, given the tokens before it: an array (state, piece)."""
        start = np.tile(model.before, (len(self.size), 1))
        ahead = np.tile(model.before, (n_texts, 1))
        for text, row, own in self.steps:
            start[row] = ahead[text]
            new = np.einsum("ni,nij->nj", ahead[text], m[own])
            ahead[text] = new / new.sum(axis=1, keepdims=True)
        return start.T.copy()


def log_likelihood(model: StateModel, cls: np.ndarray, n_tokens: np.ndarray) -> np.ndarray:
    """Natural log of each text's exact probability as a sequence of kinds, by the scaled forward recursion."""
    pieces = _Pieces(n_tokens)
    ahead = pieces.starts(model, pieces.transfer(model, cls), len(n_tokens))
    _, emitted, ends = pieces.ordered(model.emit, cls)
    log, last = np.zeros(len(pieces.size)), len(pieces.active) - 1
    for t, n in enumerate(pieces.active):
        new = (model.step.T @ ahead[:, :n]) * emitted[:, ends[t] : ends[t + 1]]
        rest = pieces.active[t + 1] if t < last else 0
        if t % SCALED == 0:
            total = new.sum(axis=0)
            new /= total
            log[:n] += np.log(total)
        ahead[:, :n] = new
        if rest < n:  # these pieces end here
            log[rest:n] += np.log(new[:, rest:].sum(axis=0))
    return np.bincount(pieces.text, weights=log, minlength=len(n_tokens))


def expected_counts(model: StateModel, cls: np.ndarray, n_tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Baum-Welch counts of some texts: states before texts, state steps, and emissions. Whole texts are sequences."""
    k, pieces = len(model.before), _Pieces(n_tokens)
    m = pieces.transfer(model, cls)
    finish = np.ones((len(pieces.size), k))
    back = np.ones((len(n_tokens), k))
    for text, row, own in reversed(pieces.steps):
        finish[row] = back[text]
        new = np.einsum("nij,nj->ni", m[own], back[text])
        back[text] = new / new.sum(axis=1, keepdims=True)
    start = pieces.starts(model, m, len(n_tokens))
    kinds, emitted, ends = pieces.ordered(model.emit, cls)
    ahead = np.empty((k, len(kinds)))
    at = start
    for t, n in enumerate(pieces.active):
        new = ahead[:, ends[t] : ends[t + 1]]
        np.multiply(model.step.T @ at[:, :n], emitted[:, ends[t] : ends[t + 1]], out=new)
        if t % SCALED == 0:
            new /= new.sum(axis=0)
        at = new
    step = np.zeros((k, k))
    beta = finish.T.copy()
    for t in range(len(pieces.active) - 1, -1, -1):
        n, own = pieces.active[t], slice(ends[t], ends[t + 1])
        out = emitted[:, own] * beta[:, :n]
        into = model.step @ out
        from_ = start[:, :n] if t == 0 else ahead[:, ends[t - 1] : ends[t - 1] + n]
        step += (from_ / (from_ * into).sum(axis=0)) @ out.T
        seen = ahead[:, own]
        seen *= beta[:, :n]
        seen /= seen.sum(axis=0)
        if t % SCALED == 0:
            into /= into.sum(axis=0)
        beta[:, :n] = into
    step *= model.step
    # A text's first piece ends with what lies behind the state before the text.
    begins = np.ones(len(pieces.size), bool)
    for _, row, _ in pieces.steps[1:]:
        begins[row] = False
    before = model.before[:, None] * beta[:, begins]
    before = (before / before.sum(axis=0)).sum(axis=1)
    return before, step, np.stack([np.bincount(kinds, weights=ahead[s], minlength=model.emit.shape[1]) for s in range(k)])


def stretches(n_tokens: np.ndarray) -> Iterator[slice]:
    """Consecutive texts of about ``STRETCH`` tokens, which bounds the memory of the recursions."""
    ends, start = np.cumsum(n_tokens), 0
    while start < len(n_tokens):
        before = ends[start] - n_tokens[start]
        stop = max(start + 1, int(np.searchsorted(ends, before + STRETCH, "right")))
        yield slice(start, stop)
        start = stop


@dataclass
class Training:
    """What the driver holds between passes: ``tokens`` are the expected training tokens of each state. The emissions are
    rows of a table, by exchange part."""

    before: np.ndarray
    step: np.ndarray
    tokens: np.ndarray
    words: Vocabulary

    def model(self, counts: np.ndarray, types: np.ndarray) -> StateModel:
        """The model over some kinds, given their expected tokens (kind, state) and their training types.

        Each state leaves one part for every training type and for one more of each class, so its emissions sum to 1
        over all kinds. With one state and no shared class this is the add-one unigram.
        """
        emit = (counts.T * (self.words.n / np.maximum(self.tokens, 1e-9))[:, None] + types) / self.words.room
        return StateModel(self.before, self.step, emit)


def spread(keys: np.ndarray, total: np.ndarray, seed: int, states: int = STATES) -> np.ndarray:
    """Training tokens of kinds dealt out to states at random, by hashes of their keys: an array (kind, state)."""
    with np.errstate(over="ignore"):
        salts = ta.mix(np.arange(1, 2 * states + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15))
    draw = (ta.mix(keys[:, None] ^ salts) >> np.uint64(11)).astype(float) * 2.0**-53
    weight = -np.log((draw[:, :states] + 1e-12) * (draw[:, states:] + 1e-12))
    return total[:, None] * weight / weight.sum(axis=1, keepdims=True)


def _start(words: Vocabulary) -> Training:
    step = np.full((STATES, STATES), (1 - STAY) / (STATES - 1))
    np.fill_diagonal(step, STAY)
    return Training(np.full(STATES, 1 / STATES), step, np.full(STATES, words.n / STATES), words)


def _block_model(own: pa.Table, found: pa.Table | None, now: Training, plan: Plan, seed: int) -> StateModel:
    """The model over a block's kinds: from the answers of the parts or, before the first pass, by chance."""
    types = _unpack(own.column("types")[0].as_py(), np.int64)
    if found is None:
        kinds = _unpack_rising(own.column("own")[0].as_py(), np.uint64)
        classes = _unpack_rising(own.column("ranks")[0].as_py(), np.int32)[len(kinds) :]
        return now.model(spread(np.concatenate([kinds, class_key(classes)]), _unpack(own.column("totals")[0].as_py(), np.int64), seed), types)
    return now.model(_values(found, plan), types)


def _layout(own: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exchange parts of a block's kinds, where each one's kinds begin and the last ends, and the ranks of all kinds."""
    return np.array(own.column("parts")[0].as_py()), np.array(own.column("ends")[0].as_py()), _unpack_rising(own.column("ranks")[0].as_py(), np.int32)


def _single(table: DataFrame, run, schema: str) -> DataFrame:
    """``run(block, None)`` for each row of a table of blocks, where no answers are there yet."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield from run(pa.Table.from_batches([batch.slice(k, 1)]), None).to_batches()

    return table.mapInArrow(each, schema)


def _with_answers(table: DataFrame, known: DataFrame | None, run, schema: str) -> DataFrame:
    return _single(table, run, schema) if known is None else table.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(run, schema)


def train(corpus: DataFrame, words: Vocabulary, passes: int = PASSES, seed: int = 3) -> tuple[DataFrame | None, Training, Plan]:
    """Baum-Welch over all blocks: expected tokens of all kinds by state as (block, part, values), and the rest of the model.

    Every pass covers all training texts. Blocks meet the expected tokens of their kinds and send their own to be added
    up; what reaches the driver are sums by state. A pass's table and shuffles are given up once the next one is written.
    """
    spark = corpus.sparkSession
    plan = Plan(words.bits, _teams(corpus.count()))
    known, last, now = None, None, _start(words)
    if not words.n or passes < 1:
        return known, now, plan
    size = STATES + STATES * STATES
    left = corpus.select("block", "held", "n_tokens", "tokens", "parts", "ends", "ranks", "types")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                part, ends, ranks = _layout(batch.slice(k, 1))
                yield from _sent(batch.column("block")[k].as_py(), part, ends, ranks, np.zeros((len(ranks), 0)), plan).select(["block", "part", "team", "keys"]).to_batches()

    places = corpus.select("block", "parts", "ends", "ranks").mapInArrow(place, "block long, part long, team long, keys binary")

    def step_of(now: Training):
        def run(own: pa.Table, found: pa.Table | None) -> pa.Table:
            model = _block_model(own, found, now, plan, seed)
            held, n = np.array(own.column("held")[0].as_py(), bool), np.array(own.column("n_tokens")[0].as_py(), np.int64)
            cls = _unpack(own.column("tokens")[0].as_py(), np.int32)[np.repeat(~held, n)]
            n = n[~held]
            ends = np.append(0, np.cumsum(n))
            sums, emit = np.zeros(size), np.zeros(model.emit.shape)
            for part in stretches(n):
                before, step, emitted = expected_counts(model, cls[ends[part.start] : ends[part.stop]], n[part])
                sums += np.concatenate([before, step.ravel()])
                emit += emitted
            return _sent(own.column("block")[0].as_py(), *_layout(own), emit.T, plan, sums)

        return run

    for _ in range(passes):
        table = totals(_with_answers(corpus if known is None else left, known, step_of(now), _SENT), plan, lambda _, sums: (sums, sums.sum(axis=0)), "emissions")
        flat = _collected(table, size + STATES)
        before, step = flat[STATES : 2 * STATES] + 0.1, flat[2 * STATES :].reshape(STATES, STATES) + 0.1
        now = Training(before / before.sum(), step / step.sum(axis=1, keepdims=True), flat[:STATES], words)
        known = answers(table, places, plan)
        if last is not None:
            remove_table(last)
        last = table
        spark.sparkContext._jvm.System.gc()  # Spark deletes the shuffle files of plans that are gone
    return known, now, plan


def score(docs: DataFrame, least: int = LEAST, passes: int = PASSES, seed: int = 3) -> DataFrame:
    """Likelihood of every text: (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score).

    Tokens are the words with A-Z lower-cased and one end. Training texts are those not held out; ``base_score`` is
    the add-one unigram log10 probability, ``score`` the log10 probability under the hidden Markov model by the exact
    forward recursion over the whole text. Types with ``least`` training tokens or more (1: all) have emissions of their
    own, in a corpus of any size; rarer ones share those of a class by length and ending, within which they have the
    add-one odds of their own counts. ``passes`` go over all training texts, whatever their number.

    How rows are partitioned has no influence but for rounding. Null and empty texts have the end as their only token.
    A null id is not held out; ids that are no whole numbers are refused. Repeated rows count as often as they stand
    there; with no training text all counts are 0. An empty table gives an empty result; further columns are ignored.
    """
    whole_ids(docs, "doc_id")
    corpus, words = coded(docs.select("doc_id", "text"), least)
    known, now, plan = train(corpus, words, passes, seed)
    n = words.n

    def run(own: pa.Table, found: pa.Table | None) -> pa.Table:
        model = _block_model(own, found, now, plan, seed)
        counts, tokens = np.array(own.column("n_tokens")[0].as_py(), np.int64), _unpack(own.column("tokens")[0].as_py(), np.int32)
        ends = np.append(0, np.cumsum(counts))
        log = np.concatenate([log_likelihood(model, tokens[ends[p.start] : ends[p.stop]], counts[p]) for p in stretches(counts)])
        within = np.array(own.column("within")[0].as_py())
        return pa.Table.from_pydict({
            "doc_id": own.column("doc_ids")[0].values, "held_out": own.column("held")[0].values, "n_tokens": pa.array(counts),
            "n_known": own.column("n_known")[0].values, "train_tokens": pa.array(np.full(len(counts), n, np.int64)),
            "base_score": own.column("base")[0].values, "score": pa.array(log / np.log(10) + within),
        })

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return _with_answers(corpus if known is None else corpus.drop("own", "parts", "ends", "ranks", "totals"), known, run, schema)
