"""Removal of repeated passages: Burrows-Wheeler transforms of shards, sampled at anchors, merged by interleave refinement.

A byte goes if a string of 100 bytes around it also starts earlier in the corpus. Suffixes are sampled: of each 64
neighbouring 32-byte strings the one with the least hash is an anchor, so every 100-byte string has an anchor that it
shares, at the same place, with all strings equal to it. A shard of documents takes the windows around its anchors as a
collection of strings and builds their transform: for each place of the window the symbols there, in the order of what
follows in the window. Parts of the anchors get the transforms of all shards and merge them. A part keeps the interleave
of the shards' rows, beginning with one shard after the other, and refines it once for each place from the right: the
symbols before the rows, taken from each shard's transform in its own order, deal the rows out anew. Next to the
interleave goes the place where a row first differs from the one before it, the common prefix, which each round derives
from the last one. So the rows at a place that have 100 symbols in common are the intervals of repeated strings. No
suffix is read again by a part, none is sorted there, and no suffix array of the corpus is held in one place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textarrays as ta
from .shared import materialise, whole_ids

#: Bytes of a repeated string, of an anchor, and neighbouring anchors of which the least is taken (GRAM + NEAR <= SPAN + 1).
SPAN, GRAM, NEAR = 100, 32, 64
#: Bytes of text in a shard and anchors in a part, about; and bytes of text that are hashed at a time.
SHARD_BYTES, PART_ANCHORS, SLICE_BYTES = 2_000_000, 400_000, 400_000
#: Of an anchor with more different surroundings than this, the strings around it are dealt out by what they share.
HOT = 20_000
#: Parts of the strings around a hot anchor, by their distance from it.
RANGES = 8
_LATER, _OPEN, _HOT = 1, 2, 4


def _pack(values: np.ndarray) -> bytes:
    return values.nbytes.to_bytes(8, "little") + pa.compress(np.ascontiguousarray(values).tobytes(), "zstd", asbytes=True)


def _unpack(packed: bytes, kind: type) -> np.ndarray:
    n = int.from_bytes(packed[:8], "little")
    return np.frombuffer(pa.decompress(packed[8:], n, "zstd", asbytes=True), kind) if n else np.zeros(0, kind)


class Shard:
    """Documents of a shard in order, with their anchors.

    For anchor i: ``at`` is its place, ``gram`` its hash, ``low`` to ``high`` the starts of the strings that it stands
    for, ``left`` and ``right`` the number of known bytes before it and from it on (cut at the document's ends).
    """

    def __init__(self, ids: np.ndarray, column: pa.Array) -> None:
        data, offsets = ta.flat(column)
        order = np.argsort(ids, kind="stable")
        if len(ids) > 1 and (np.diff(ids[order]) == 0).any():  # rows that repeat an id go by their bytes
            order = np.array(sorted(range(len(ids)), key=lambda k: (ids[k], data[offsets[k] : offsets[k + 1]].tobytes())), np.int64)
        self.ids = ids[order]
        if (order == np.arange(len(order))).all():
            self.data, self.offsets = data, offsets
        else:
            self.data = np.concatenate([data[offsets[k] : offsets[k + 1]] for k in order])
            self.offsets = np.concatenate([[0], np.cumsum(np.diff(offsets)[order])])
        found, start = [], 0
        while start < len(order):
            stop = max(start + 1, int(np.searchsorted(self.offsets, self.offsets[start] + SLICE_BYTES, "right")) - 1)
            found.append(self._anchors(start, stop))
            start = stop
        columns = list(zip(*found)) or [()] * 9
        kinds = (np.int64,) * 6 + (np.uint64,) * 3
        self.at, self.low, self.high, self.left, self.right, self.doc, self.gram, self.around, self.other = (np.concatenate([np.zeros(0, k), *c]).astype(k, copy=False) for c, k in zip(columns, kinds))
        order = np.argsort(self.gram, kind="stable")  # equal anchors stay in the order of documents and places
        # Of anchors with equal surroundings the shard asks for the first only; the others come later in any case.
        new = np.ones(len(order) + 1, bool)
        new[1:-1] = self.gram[order[1:]] != self.gram[order[:-1]]
        again = order[~(new[:-1] & new[1:])]
        by, head = _buckets(self.gram[again], self.around[again], self.other[again])
        self.later = again[by[~head]]
        if len(self.later):
            first = np.ones(len(self.gram), bool)
            first[self.later] = False
            order = order[first[order]]
        self.order = order

    def _anchors(self, first_doc: int, end_doc: int) -> tuple[np.ndarray, ...]:
        """Anchors of some documents; two hashes stand for the known bytes around each and for where they are cut."""
        base = self.offsets[first_doc]
        offsets = self.offsets[first_doc : end_doc + 1] - base
        data = self.data[base : base + offsets[-1]]
        own = np.flatnonzero(np.diff(offsets) >= SPAN)
        if not len(own):
            return (np.zeros(0, np.int64),) * 6 + (np.zeros(0, np.uint64),) * 3
        begins, ends = offsets[own], offsets[own + 1]
        prefix = ta.prefix_hash(data)
        grams = len(data) - GRAM + 1
        with np.errstate(over="ignore"):
            value = ta.mix((prefix[GRAM:] - prefix[:-GRAM]) * ta.powers(len(data) + 1)[1][:grams])
        # The least hash of NEAR neighbours, the last of equal ones: hash and place in one number, minima by blocks.
        room = -(-grams // NEAR) * NEAR + NEAR
        key = np.full(room, np.iinfo(np.uint64).max, np.uint64)
        key[:grams] = (value & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(2**32 - 1) - np.arange(grams, dtype=np.uint64))
        ahead = np.minimum.accumulate(key.reshape(-1, NEAR), axis=1).ravel()
        back = np.minimum.accumulate(key.reshape(-1, NEAR)[:, ::-1], axis=1)[:, ::-1].ravel()
        place = np.minimum(back[: room - NEAR + 1], ahead[NEAR - 1 :]).astype(np.uint32)  # 2**32 - 1 less the place
        # A new anchor begins at a document's first string and wherever the least one changes, as long as strings fit.
        starts = np.zeros(len(place) + 1, np.int8)
        starts[begins] += 1
        starts[ends - SPAN + 1] -= 1
        new = np.empty(len(place), bool)
        new[0], new[1:] = True, place[1:] != place[:-1]
        new[begins] = True
        new &= np.cumsum(starts[:-1], dtype=np.int8) > 0
        low = np.flatnonzero(new)
        doc = np.searchsorted(begins, low, "right") - 1
        high = np.append(low[1:], 0) - 1
        last = np.append(doc[1:] != doc[:-1], True)
        high[last] = ends[doc[last]] - SPAN
        at = (2**32 - 1 - place[low].astype(np.int64)).astype(np.int64)
        left, right = np.minimum(at - begins[doc], NEAR - 1), np.minimum(ends[doc] - at, SPAN)
        cut = (left * 256 + right).astype(np.uint64)
        around = ta.mix(ta.span_hash(prefix, at - left, at + right) ^ cut)
        other = ta.mix(ta.span_hash(ta.prefix_hash(data, ta.OTHER_VALUE), at - left, at + right) ^ cut)
        # Anchors have small hashes, so they are spread anew: parts go by leading bits.
        return at + base, low + base, high + base, left, right, own[doc] + first_doc, ta.mix(value[at]), around, other

    def parts(self, bits: int) -> list[np.ndarray]:
        """Anchors of each part, by leading bits of the hash, in hash order."""
        cuts = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
        return np.split(self.order, np.searchsorted(self.gram[self.order], cuts))


def _shard(table: pa.Table) -> Shard:
    return Shard(table.column("doc_id").to_numpy().astype(np.int64), table.column("text").combine_chunks())


def _buckets(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by the columns, first column first, rows of equal columns staying in order; and where buckets begin."""
    order = np.argsort(columns[0], kind="stable") if len(columns) == 1 else np.lexsort(columns[::-1])
    new = np.ones(len(order), bool)
    if len(order) > 1:
        new[1:] = np.any([c[order[1:]] != c[order[:-1]] for c in columns], axis=0)
    return order, new


def compare(gram: np.ndarray, around: np.ndarray, other: np.ndarray, rank: np.ndarray, hot: int) -> np.ndarray:
    """Flags of anchors: later (not the first with its surroundings), else open if the anchor has several surroundings,
    and hot if it has very many. Anchors of different bytes that share a number only are open without need."""
    flags = np.zeros(len(gram), np.uint8)
    order = np.argsort(gram, kind="stable")
    new = np.ones(len(order) + 1, bool)
    new[1:-1] = gram[order[1:]] != gram[order[:-1]]
    again = order[~(new[:-1] & new[1:])]
    if not len(again):
        return flags
    by, head = _buckets(gram[again], around[again], other[again])
    again = again[by]
    begins = np.flatnonzero(head)
    kind = np.cumsum(head) - 1
    least = np.minimum.reduceat(rank[again], begins)[kind]
    bucket = np.ones(len(again), bool)
    bucket[1:] = gram[again[1:]] != gram[again[:-1]]
    kinds = np.add.reduceat(head.astype(np.int64), np.flatnonzero(bucket))[np.cumsum(bucket) - 1]
    first = rank[again] == least
    flags[again] = np.where(first, (kinds > 1) * _OPEN + (kinds > hot) * _HOT, _LATER)
    return flags


def transform(symbols: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Transform of windows (place, row) whose rows are in order of their parts: for each place, from the last one on, the
    symbols there, rows of a part being in the order of what follows in their windows."""
    out = np.empty_like(symbols)
    order = np.arange(symbols.shape[1])
    high = (np.unique(part, return_inverse=True)[1] if len(part) else part).astype(np.uint32) << np.uint32(8)
    if len(high) and high[-1] < 1 << 16:
        high = high.astype(np.uint16)
    for k in range(len(symbols) - 1, -1, -1):
        out[k] = symbols[k][order]
        order = order[np.argsort(high | out[k], kind="stable")]
    return out


def _nearest(differ: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Least value of ``differ`` over (before, after], for each pair."""
    span = after - before
    level = np.frexp(span)[1] - 1  # of the largest power of two within the span
    table = [differ]
    for k in range(int(level.max(initial=0))):
        table.append(table[-1].copy())
        np.minimum(table[k][: -(1 << k)], table[k][1 << k :], out=table[-1][: -(1 << k)])
    flat, n = np.concatenate(table), len(differ)
    return np.minimum(flat[level * n + before + 1], flat[level * n + after + 1 - (1 << level)])


def later_strings(transforms: list[np.ndarray], near: np.ndarray, far: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and distances (from an anchor's place back to a string's start) of strings that also start earlier.

    ``transforms`` are those of the shards, rows one shard after the other; a row stands for the strings that begin
    ``near`` to ``far`` before its anchor. ``who`` is the interleave: rows in the order of what follows the present place.
    ``differ`` is the place where a row first differs from the row before it.
    """
    sizes = [t.shape[1] for t in transforms]
    n = sum(sizes)
    shard = np.repeat(np.arange(len(sizes)), sizes)
    shard = shard.astype(np.uint16 if len(sizes) <= 1 << 16 else np.uint32)
    who, slot, differ = np.arange(n), np.arange(n), np.full(n, SPAN, np.uint8)
    if n:
        differ[0] = 0
    rows, back = [np.zeros(0, np.int64)], [np.zeros(0, np.uint8)]
    for k in range(NEAR - 1 + SPAN - 1, -1, -1):
        place = k - (NEAR - 1)
        symbol = np.concatenate([t[k] for t in transforms])[slot]
        order = np.argsort(symbol, kind="stable")
        same = np.zeros(n, bool)
        same[1:] = symbol[order[1:]] == symbol[order[:-1]]
        pair = np.flatnonzero(same)
        new = np.full(n, max(place, 0), np.uint8)
        new[:1] = 0
        new[pair] = _nearest(differ, order[pair - 1], order[pair])
        who, shard, differ = who[order], shard[order], new
        slot = np.empty(n, np.int64)
        slot[np.argsort(shard, kind="stable")] = np.arange(n)
        if place > 0:
            continue
        own = np.flatnonzero((near[who] <= -place) & (far[who] >= -place))
        if len(own) < 2:
            continue
        interval = np.cumsum(differ < SPAN + place)[own]  # rows with SPAN common symbols from this place on
        begins = np.flatnonzero(np.append(True, interval[1:] != interval[:-1]))
        found = rank[who[own]]
        first = np.repeat(np.minimum.reduceat(found, begins), np.diff(np.append(begins, len(own))))
        rows.append(who[own[found != first]])
        back.append(np.full(len(rows[-1]), -place, np.uint8))
    return np.concatenate(rows), np.concatenate(back)


def _rank(docs: np.ndarray, message: np.ndarray) -> np.ndarray:
    """Order of anchors by document, message (a document's anchors of a part are in one) and place in it."""
    rank = np.empty(len(docs), np.int64)
    rank[np.lexsort((np.arange(len(docs)), message, docs))] = np.arange(len(docs))
    return rank


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES, part_anchors: int = PART_ANCHORS, hot: int = HOT) -> DataFrame:
    """Remove each byte that a 100-byte string covers which also starts earlier; strings are judged on the input.

    Returns every row as (id, n_bytes, n_removed, n_spans, kept_sha256, kept binary): maximal removed runs, and the
    remaining bytes one after the other. Earlier means a smaller id, or the same id and an earlier start; rows that
    repeat an id go by their bytes and among equal rows one is the first. A null id comes after all others; of rows
    without an id, those of one text have one first. Strings do not cross rows. Null text is empty; texts shorter than 100 bytes stay as they are. An empty table gives an empty result. Ids that are no whole numbers are refused; further columns are ignored.
    """
    whole_ids(docs, id_col)
    last = np.iinfo(np.int64).max
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    # Rows without an id are spread by their text, so that however many there are they are no hot shard.
    spread = F.when(F.col(id_col).isNull(), F.xxhash64(text)).otherwise(F.xxhash64(F.col(id_col).cast("long")))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(last)).alias("doc_id"), text.alias("text"), spread.alias("spread"))
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    bits = max(1, int(np.ceil(np.log2(max(1, total / (NEAR / 2) / part_anchors)))))
    by_shard = rows.select("doc_id", "text", F.pmod("spread", F.lit(shards)).alias("shard")).groupBy("shard")

    def number(gram: np.ndarray) -> np.ndarray:
        """What tells the anchors of a part apart: 32 further bits of their hashes."""
        return ((gram << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)

    def send(key: tuple, table: pa.Table) -> pa.Table:
        shard = _shard(table)
        if not len(shard.at):
            return pa.Table.from_pylist([], schema=_FIRST)
        parts = shard.parts(bits)
        full = [p for p in range(len(parts)) if len(parts[p])]
        return pa.Table.from_pydict({
            "part": full, "shard": [key[0].as_py()] * len(full), "gram": [number(shard.gram[parts[p]]).tobytes() for p in full],
            "around": [shard.around[parts[p]].tobytes() + shard.other[parts[p]].tobytes() for p in full], "docs": [_pack(shard.ids[shard.doc[parts[p]]]) for p in full],
        }, schema=_FIRST)

    def flag(table: pa.Table) -> pa.Table:
        gram = [np.frombuffer(x.as_py(), np.uint32) for x in table.column("gram")]
        sizes = [len(g) for g in gram]
        around = np.concatenate([np.frombuffer(x.as_py(), np.uint64).reshape(2, -1) for x in table.column("around")], axis=1)
        ids = np.concatenate([_unpack(x.as_py(), np.int64) for x in table.column("docs")])
        rank = _rank(ids, np.repeat(table.column("shard").to_numpy(), sizes))
        flags = np.split(compare(np.concatenate(gram), *around, rank, hot), np.cumsum(sizes)[:-1])
        return pa.Table.from_pydict({"shard": table.column("shard"), "part": table.column("part"), "flags": pa.array([_pack(f) for f in flags], pa.binary())})

    sent = by_shard.applyInArrow(send, "part long, shard long, gram binary, around binary, docs binary")
    flags = materialise(sent.groupBy("part").applyInArrow(flag, "shard long, part long, flags binary"), "flags")

    def read_flags(shard: Shard, answers: pa.Table) -> np.ndarray:
        out = np.zeros(len(shard.at), np.uint8)
        rows_ = answers.sort_by("part").to_pydict()
        if rows_["flags"]:
            out[shard.order] = np.concatenate([_unpack(f, np.uint8) for f in rows_["flags"]])
        return out

    def units(shard: Shard, flag_: np.ndarray) -> tuple[np.ndarray, ...]:
        """What goes to be merged, by part: part, anchor, and the least and largest distance of its strings."""
        anchor = shard.order[flag_[shard.order] & _OPEN > 0]
        near, far = (shard.at - shard.high)[anchor], (shard.at - shard.low)[anchor]
        part = (shard.gram[anchor] >> np.uint64(64 - bits)).astype(np.int64)
        hot = flag_[anchor] & _HOT > 0
        found = [(part[~hot], anchor[~hot], near[~hot], far[~hot])]
        for a in range(0, NEAR, NEAR // RANGES) if hot.any() else ():
            # Strings that begin a to b before the anchor all hold the bytes from a before it to SPAN - b behind it.
            b = a + NEAR // RANGES - 1
            own = np.flatnonzero(hot & (near <= b) & (far >= a))
            core = shard.data[shard.at[anchor[own], None] + np.arange(-a, SPAN - b)]
            with np.errstate(over="ignore"):
                value = ta.mix((ta.BYTE_VALUE[core] * ta.powers(SPAN)[0][: core.shape[1]]).sum(axis=1, dtype=np.uint64) + np.uint64(a))
            found.append(((value >> np.uint64(64 - bits)).astype(np.int64), anchor[own], np.maximum(near[own], a), np.minimum(far[own], b)))
        columns = [np.concatenate(c) for c in zip(*found)]
        order = np.argsort(columns[0], kind="stable")
        return tuple(c[order] for c in columns)

    def contexts(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        shard = _shard(table)
        part, anchor, near, far = units(shard, read_flags(shard, answers))
        if not len(anchor):
            return pa.Table.from_pylist([], schema=_SECOND)
        at, left, right = shard.at[anchor], shard.left[anchor], shard.right[anchor]
        window = np.zeros((NEAR - 1 + SPAN, len(at)), np.uint8)
        for k in range(len(window)):
            place = k - (NEAR - 1)
            inside = (place < right) & (place >= -left)
            window[k, inside] = shard.data[at[inside] + place]
        found = transform(window, part)
        full, begins = np.unique(part, return_index=True)
        cuts = list(zip(begins, np.append(begins[1:], len(part))))
        shape = np.stack([near, far], axis=1).astype(np.uint8)
        return pa.Table.from_pydict({
            "part": full, "shard": [key[0].as_py()] * len(full), "docs": [_pack(shard.ids[shard.doc[anchor[a:b]]]) for a, b in cuts],
            "shape": [_pack(shape[a:b]) for a, b in cuts], "symbols": [_pack(found[:, a:b]) for a, b in cuts],
        }, schema=_SECOND)

    def merge(table: pa.Table) -> pa.Table:
        shape = [_unpack(x.as_py(), np.uint8).reshape(-1, 2) for x in table.column("shape")]
        sizes = np.array([len(x) for x in shape])
        ids = np.concatenate([_unpack(x.as_py(), np.int64) for x in table.column("docs")])
        near, far = np.concatenate(shape).T.astype(np.int64)
        rank = _rank(ids, np.repeat(table.column("shard").to_numpy(), sizes))
        rows_, back = later_strings([_unpack(x.as_py(), np.uint8).reshape(NEAR - 1 + SPAN, -1) for x in table.column("symbols")], near, far, rank)
        by_row = np.argsort(rows_, kind="stable")
        rows_, back = rows_[by_row], back[by_row]
        begins = np.cumsum(sizes) - sizes
        cuts = np.searchsorted(rows_, np.append(begins, len(ids)))
        which = [(rows_[a:b] - begins[k]).astype(np.int32) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:]))]
        back_by = [back[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
        return pa.Table.from_pydict({"shard": table.column("shard"), "part": table.column("part"), "which": pa.array(map(_pack, which), pa.binary()), "back": pa.array(map(_pack, back_by), pa.binary())})

    own_flags = flags.groupBy("shard")
    opened = by_shard.cogroup(own_flags).applyInArrow(contexts, "part long, shard long, docs binary, shape binary, symbols binary")
    strings = opened.groupBy("part").applyInArrow(merge, "shard long, part long, which binary, back binary")
    empty = F.lit(None).cast("binary")
    answers = flags.select("shard", "part", "flags", empty.alias("which"), empty.alias("back")).unionByName(strings.select("shard", "part", empty.alias("flags"), "which", "back"))

    def cut(table: pa.Table, answers_: pa.Table) -> pa.Table:
        shard = _shard(table)
        size = len(shard.data)
        edge = np.zeros(size + 1, np.int32)
        if len(shard.at):
            import pyarrow.compute as pc

            flag_ = read_flags(shard, answers_.filter(pc.is_valid(answers_.column("flags"))))
            whole = np.append(np.flatnonzero(flag_ & _LATER > 0), shard.later)
            np.add.at(edge, shard.low[whole], 1)
            np.subtract.at(edge, shard.high[whole] + SPAN, 1)
            part_of, anchor, _, _ = units(shard, flag_)
            found = answers_.filter(pc.is_valid(answers_.column("which"))).to_pydict()
            for part, which, back in zip(found["part"], found["which"], found["back"]):
                own = anchor[np.searchsorted(part_of, part) + _unpack(which, np.int32)]
                start = shard.at[own] - _unpack(back, np.uint8)
                np.add.at(edge, start, 1)
                np.subtract.at(edge, start + SPAN, 1)
        removed = np.cumsum(edge, dtype=np.int32)[:-1] > 0
        heads = removed.copy()
        heads[1:] &= ~removed[:-1]
        full = np.diff(shard.offsets) > 0
        at = shard.offsets[:-1][full]
        heads[at] = removed[at]
        a, b = shard.offsets[:-1], shard.offsets[1:]
        places, begun = np.flatnonzero(removed), np.flatnonzero(heads)
        count, spans = (np.searchsorted(x, b) - np.searchsorted(x, a) for x in (places, begun))
        kept = [shard.data[x:y][~removed[x:y]].tobytes() for x, y in zip(a, b)]
        return pa.Table.from_pydict({
            "doc_id": pa.array(shard.ids), "n_bytes": pa.array(b - a), "n_removed": pa.array(count), "n_spans": pa.array(spans),
            "kept_sha256": [hashlib.sha256(k).hexdigest() for k in kept], "kept": pa.array(kept, pa.binary()),
        })

    out = by_shard.cogroup(answers.groupBy("shard")).applyInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(last))).withColumnRenamed("doc_id", id_col)


_FIRST = pa.schema([("part", pa.int64()), ("shard", pa.int64()), ("gram", pa.binary()), ("around", pa.binary()), ("docs", pa.binary())])
_SECOND = pa.schema([("part", pa.int64()), ("shard", pa.int64()), ("docs", pa.binary()), ("shape", pa.binary()), ("symbols", pa.binary())])
