"""SentencePiece encoding with seeded merge-dropout, and lossless decoding."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textarrays as ta

#: A parameter of every entry point; the file itself stays outside the repository.
MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
#: Share of candidate merges that are skipped.
DROPOUT = 0.1
#: Bytes of text that share their segmented units.
SLICE_BYTES = 1_000_000
#: Units of at most so many symbols advance side by side in matrices; longer ones take an agenda each.
_WIDTHS = (8, 16, 32, 64)
#: Rows of such a matrix.
_ROWS = 50_000
_NEVER = np.int32(2**31 - 1)


@dataclass
class Pieces:
    """A merge-type vocabulary as arrays; at most tens of thousands of pieces, so tasks get it with their code."""

    of_char: np.ndarray  # code point to piece, -1 without one
    byte0: int  # piece of byte 0; bytes follow in order
    blank: int
    slots: np.ndarray  # hashed table of left * size + right of all mergeable pairs, -1 in free slots
    merged: np.ndarray
    rank: np.ndarray  # of the merge, smaller first
    data: np.ndarray  # bytes of all pieces, blanks as spaces
    offsets: np.ndarray

    @property
    def size(self) -> int:
        return len(self.offsets) - 1

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of merging pieces; the rank is ``_NEVER`` where they don't merge."""
        key = left.astype(np.int64) * self.size + right
        slot = _slot(key, len(self.slots))
        held = self.slots[slot]
        rest = np.flatnonzero((held != key) & (held >= 0))
        while len(rest):  # the next slots, as far as they are taken
            slot[rest] = (slot[rest] + 1) & (len(self.slots) - 1)
            held[rest] = self.slots[slot[rest]]
            rest = rest[(held[rest] != key[rest]) & (held[rest] >= 0)]
        return np.where((held == key) & (left >= 0) & (right >= 0), self.rank[slot], _NEVER), self.merged[slot]


def _slot(key: np.ndarray, slots: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - slots.bit_length())).astype(np.int64)


def _hashed(pairs: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """A table for the pairs with at least four slots a pair, and the slot of each pair."""
    table = np.full(1 << (4 * len(pairs) + 1).bit_length(), -1, np.int64)
    where = _slot(np.array(pairs, np.int64), len(table))
    for k, (pair, at) in enumerate(zip(pairs, where.tolist())):
        while table[at] >= 0:
            at = (at + 1) & (len(table) - 1)
        table[at], where[k] = pair, at
    return table, where


def load(model_file: str = MODEL_FILE) -> Pieces:
    """Read a SentencePiece model of the merge type with byte fallback and no text normalisation."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    n = model.get_piece_size()
    text = [model.id_to_piece(i) for i in range(n)]
    plain = {t: i for i, t in enumerate(text) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
    if BLANK not in plain or any(BLANK in t.lstrip(BLANK) for t in plain):
        raise ValueError("blanks must stand at the beginning of pieces only")
    bytes_ = [i for i in range(n) if model.is_byte(i)]
    if bytes_ != list(range(bytes_[0], bytes_[0] + 256)) if bytes_ else True:
        raise ValueError("the model must have all 256 byte pieces in order")
    of_char = np.full(0x110000, -1, np.int32)
    for t, i in plain.items():
        if len(t) == 1 and t != BLANK:
            of_char[ord(t)] = i
    of_char[32] = plain[BLANK]
    # Ranks by falling score; equal scores share a rank and go from left to right.
    scores = sorted({model.get_score(i) for t, i in plain.items() if len(t) > 1}, reverse=True)
    rank = {s: r for r, s in enumerate(scores)}
    found = {}
    for t, i in plain.items():
        for k in range(1, len(t)):
            if t[:k] in plain and t[k:] in plain:
                found[plain[t[:k]] * n + plain[t[k:]]] = (i, rank[model.get_score(i)])
    slots, where = _hashed(list(found))
    merged, ranks = np.zeros(len(slots), np.int32), np.full(len(slots), _NEVER, np.int32)
    merged[where], ranks[where] = [i for i, _ in found.values()], [r for _, r in found.values()]
    raw = [bytes([i - bytes_[0]]) if model.is_byte(i) else t.replace(BLANK, " ").encode() if t in plain else b"" for i, t in enumerate(text)]
    return Pieces(
        of_char, bytes_[0], plain[BLANK], slots, merged, ranks, np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]),
    )


def _place(start: np.ndarray, middle: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the candidate merge of the symbols [start, middle) and [middle, end) of a unit."""
    with np.errstate(over="ignore"):
        place = (start.astype(np.uint64) << np.uint64(42)) ^ (middle.astype(np.uint64) << np.uint64(21)) ^ end.astype(np.uint64)
        return ta.mix(place + np.uint64(1))


def _verdict(key: np.ndarray, place: np.ndarray, dropout: float) -> np.ndarray:
    return (ta.mix(key ^ place) >> np.uint64(11)).astype(float) * 2.0**-53 < dropout


def skipped(key: np.ndarray, start: np.ndarray, middle: np.ndarray, end: np.ndarray, dropout: float) -> np.ndarray:
    """The keyed hash's verdict on candidate merges of the symbols [start, middle) and [middle, end) of their units."""
    if dropout <= 0:
        return np.zeros(np.shape(start), bool)
    return _verdict(key, _place(start, middle, end), dropout)


def agenda(pieces: Pieces, symbols: list[int], key: int, dropout: float) -> list[int]:
    """Segment one unit: the best candidate is taken from the agenda, skipped or merged, until the agenda is empty.

    Candidates are ordered by rank and then from left to right; a candidate that the keyed hash skips never comes back.
    """
    n = len(symbols)
    piece, end = list(symbols), list(range(1, n + 1))
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    queue: list[tuple[int, int, int, int, int]] = []

    def offer(i: int, j: int) -> None:
        if i < 0 or j < 0:
            return
        rank, into = pieces.lookup(np.array([piece[i]]), np.array([piece[j]]))
        if rank[0] != _NEVER:
            heapq.heappush(queue, (int(rank[0]), i, j, end[j], int(into[0])))

    for i in range(n - 1):
        offer(i, i + 1)
    while queue:
        _, i, j, stop, into = heapq.heappop(queue)
        if piece[i] < 0 or after[i] != j or end[j] != stop or end[i] != j:
            continue
        if skipped(np.array([key], np.uint64), np.array([i]), np.array([j]), np.array([stop]), dropout)[0]:
            continue
        piece[i], end[i], after[i], piece[j] = into, stop, after[j], -1
        if after[j] >= 0:
            before[after[j]] = i
        offer(before[i], i)
        offer(i, after[i])
    return [p for p in piece if p >= 0]


def _together(pieces: Pieces, symbols: np.ndarray, key: np.ndarray, dropout: float, taken: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """``agenda`` for all rows of a matrix at once (-1 fills short rows): each round takes each row's best candidate.

    Symbols stay in place, linked to their neighbours, until all rounds are over. Returns the pieces, moved to the left,
    and how many there are in each row. Rows and hashed places of the merges go to the list ``taken``.
    """
    n, width = symbols.shape
    stride = width + 1  # one more place, for the end
    sizes = (symbols >= 0).sum(axis=1)
    matrix = np.full((n, stride), -1, np.int32)
    matrix[:, :width] = symbols
    sym, into = matrix.reshape(-1), np.zeros(n * stride, np.int32)
    after, before = np.tile(np.arange(1, stride + 1), n), np.tile(np.arange(-1, width), n)
    live = np.flatnonzero(sizes > 1)
    base, size, own = live * stride, sizes[live], key[live]
    rank = np.full((len(live), width), _NEVER, np.int32)

    def offer(row: np.ndarray, left: np.ndarray, middle: np.ndarray, end: np.ndarray) -> None:
        """Enter candidates: the symbols [left, middle) and [middle, end) of the rows."""
        at = base[row] + left
        found, piece = pieces.lookup(sym[at], sym[base[row] + middle])
        if dropout > 0:
            fits = np.flatnonzero(found != _NEVER)
            gone = skipped(own[row[fits]], left[fits], middle[fits], end[fits], dropout)
            found[fits[gone]] = _NEVER
        rank[row, left] = found
        into[at] = piece

    row, left = np.nonzero(np.arange(width) < (size - 1)[:, None])
    offer(row, left, left + 1, left + 2)
    while len(live):
        best = rank.argmin(axis=1)
        row = np.arange(len(live))
        open_ = rank[row, best] != _NEVER
        if not open_.all():
            live, base, size, own, rank, best = live[open_], base[open_], size[open_], own[open_], rank[open_], best[open_]
            row = row[: len(live)]
            if not len(live):
                break
        at = base + best
        right = after[at]
        end = after[base + right]
        if taken is not None:
            taken.append((live, _place(best, right, end)))
        sym[at], sym[base + right] = into[at], -1
        after[at], before[base + end] = end, best
        rank[row, right] = rank[row, best] = _NEVER
        prior = before[at]
        one, two = np.flatnonzero(prior >= 0), np.flatnonzero(end < size)
        offer(np.concatenate([one, two]), np.concatenate([prior[one], best[two]]), np.concatenate([best[one], end[two]]), np.concatenate([end[one], after[base[two] + end[two]]]))
    kept = matrix[:, :width] >= 0
    count = kept.sum(axis=1)
    out = np.full((n, width), -1, np.int32)
    out[np.arange(width) < count[:, None]] = matrix[:, :width][kept]
    return out, count


def _segment(pieces: Pieces, symbol: np.ndarray, begin: np.ndarray, size: np.ndarray, key: np.ndarray, dropout: float, taken: list | None = None) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Units [begin, begin + size) of the symbols segmented: their numbers, numbers of ids, and ids one after the other."""
    found = []
    low = 0
    for width in _WIDTHS:
        fits = np.flatnonzero((size > low) & (size <= width))
        low = width
        columns = np.arange(width)
        for at in range(0, len(fits), _ROWS):
            own = fits[at : at + _ROWS]
            inside = columns < size[own][:, None]
            matrix = np.where(inside, symbol[np.minimum(begin[own][:, None] + columns, len(symbol) - 1)], -1)
            merges = None if taken is None else []
            matrix, count = _together(pieces, matrix, key[own], dropout, merges)
            found.append((own, count, matrix[columns < count[:, None]]))
            for row, place in merges or ():
                taken.append((own[row], place))
    for k in np.flatnonzero(size > _WIDTHS[-1]):
        ids = agenda(pieces, symbol[begin[k] : begin[k] + size[k]].tolist(), int(key[k]), dropout)
        found.append((np.array([k]), np.array([len(ids)]), np.array(ids, np.int32)))
    return found


def encode_slice(pieces: Pieces, column: pa.Array, text_key: np.ndarray, dropout: float = DROPOUT) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all texts of a slice, one after the other, and the number of each text's ids.

    A text is led by a blank and falls into units that no merge can cross: blanks with the word behind them, and
    single characters without a piece, which become bytes (so does a literal U+2581). The keyed hash of a unit's merges
    depends on its symbols, its text's key and its place there. Equal units are segmented once without dropout; a unit
    whose hash skips none of the merges made there has that segmentation, any other takes an agenda of its own.
    """
    data, offsets = ta.flat(column)
    chars = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    lead = np.concatenate([[0], np.cumsum(ta.LEAD_BYTE[data])])[offsets]
    full = np.flatnonzero(np.diff(lead) > 0)
    n_texts = len(offsets) - 1
    if not len(full):
        return np.zeros(0, np.int32), np.zeros(n_texts, np.int64)
    points = np.insert(chars, lead[full], 32)
    text_at = lead[full] + np.arange(len(full))
    symbol = pieces.of_char[points]
    blank, odd = symbol == pieces.blank, symbol < 0
    first = np.ones(len(symbol), bool)
    first[1:] = odd[1:] | odd[:-1] | (blank[1:] & ~blank[:-1])
    first[text_at] = True
    starts = np.flatnonzero(first)
    length = np.diff(np.append(starts, len(symbol)))
    before = np.searchsorted(starts, text_at)
    text_of = np.repeat(full, np.diff(np.append(before, len(starts))))
    with np.errstate(over="ignore"):
        up, down = ta.powers(len(symbol) + 1)
        prefix = np.zeros(len(symbol) + 1, np.uint64)
        np.cumsum(ta.mix(points.astype(np.uint64) + np.uint64(1)) * up[: len(symbol)], out=prefix[1:])
        value = ta.mix((prefix[starts + length] - prefix[starts]) * down[starts] + length.astype(np.uint64))
    kinds, sample, inverse = np.unique(value, return_index=True, return_inverse=True)
    begin, size = starts[sample], length[sample]
    odd_kind = odd[begin]
    # With dropout, long units hardly ever come through whole; each takes its own agenda at once.
    whole = np.flatnonzero(~odd_kind & ((size <= _WIDTHS[-1]) | (dropout <= 0)))
    taken: list | None = [] if dropout > 0 else None
    found = [(whole[k], n, ids) for k, n, ids in _segment(pieces, symbol, begin[whole], size[whole], kinds[whole], 0.0, taken)]
    for k in np.flatnonzero(odd_kind):
        raw = np.frombuffer(chr(points[begin[k]]).encode("utf-8", "surrogatepass"), np.uint8)
        found.append((np.array([k]), np.array([len(raw)]), raw.astype(np.int32) + pieces.byte0))
    n_kinds = len(kinds)
    if dropout > 0:
        with np.errstate(over="ignore"):
            place = np.arange(len(starts)) - before[np.searchsorted(full, text_of)]
            key = ta.mix(value + ta.mix(text_key[text_of] + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        of_kind = whole[np.concatenate([k for k, _ in taken])] if taken else np.zeros(0, np.int64)
        merge = np.concatenate([p for _, p in taken])[np.argsort(of_kind, kind="stable")] if taken else np.zeros(0, np.uint64)
        merges = np.bincount(of_kind, minlength=n_kinds)
        own = ~odd_kind[inverse] & (length > _WIDTHS[-1])
        first_merge = np.cumsum(merges) - merges
        for at in range(0, len(starts), 4 * _ROWS):
            kind = inverse[at : at + 4 * _ROWS]
            unit, nth = ta.ragged(merges[kind])
            own[at + unit[_verdict(key[at + unit], merge[first_merge[kind[unit]] + nth], dropout)]] = True
        own = np.flatnonzero(own)
        found += [(n_kinds + k, n, ids) for k, n, ids in _segment(pieces, symbol, starts[own], length[own], key[own], dropout)]
        inverse[own] = n_kinds + np.arange(len(own))
        n_kinds += len(own)
    count, where = np.zeros(n_kinds, np.int64), np.zeros(n_kinds, np.int64)
    order = np.concatenate([k for k, _, _ in found])
    count[order] = np.concatenate([n for _, n, _ in found])
    where[order] = np.cumsum(count[order]) - count[order]
    flat = np.concatenate([ids for _, _, ids in found]).astype(np.int32)
    per_unit = count[inverse]
    unit, place = ta.ragged(per_unit)
    ids = flat[where[inverse[unit]] + place]
    return ids, np.bincount(text_of, weights=per_unit, minlength=n_texts).astype(np.int64)


def decode_ids(pieces: Pieces, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts of ids, without the leading blanks, and the offsets of the texts."""
    size = np.diff(pieces.offsets)[ids]
    unit, place = ta.ragged(size)
    data = pieces.data[pieces.offsets[ids[unit]] + place]
    ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(counts)])]
    led = np.flatnonzero(np.diff(ends) > 0)
    data = np.delete(data, ends[:-1][led])
    return data, np.concatenate([[0], np.cumsum(np.diff(ends) - np.isin(np.arange(len(counts)), led))])


def encode(docs: DataFrame, seed: int = 11, dropout: float = DROPOUT, model_file: str = MODEL_FILE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Segment every whole text: (id, n_tokens, ids array<int>, n_bytes, lossless).

    Each candidate merge is skipped with probability ``dropout`` by a hash keyed with all of seed, id, place and unit, so
    reruns agree while other seeds, ids and places give other segmentations; with a dropout of 0 the ids are the model's
    own. ``lossless`` tells whether decoding gave the text's bytes back; it always should. Null and empty texts have no
    ids. Rows that repeat an id and a text get equal ids; a null id counts as an empty one. Further columns are ignored.
    """
    pieces = load(model_file)
    key = F.xxhash64(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    rows = docs.select(F.col(id_col).alias("id"), key.alias("key"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ta.slices(batch, "text", SLICE_BYTES):
                ids, counts = encode_slice(pieces, part.column("text"), part.column("key").to_numpy().view(np.uint64), dropout)
                data, offsets = ta.flat(part.column("text"))
                back, ends = decode_ids(pieces, ids, counts)
                same = np.diff(ends) == np.diff(offsets)
                if same.all():
                    wrong = np.concatenate([[0], np.cumsum(back != data)])
                    same = wrong[offsets[1:]] == wrong[offsets[:-1]]
                else:
                    same = np.array([back[a:b].tobytes() == data[c:d].tobytes() for a, b, c, d in zip(ends, ends[1:], offsets, offsets[1:])])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_pydict({"id": part.column("id"), "n_tokens": pa.array(counts), "ids": lists, "n_bytes": pa.array(np.diff(offsets)), "lossless": pa.array(same)})

    found = rows.mapInArrow(run, f"id {dict(docs.dtypes)[id_col]}, n_tokens long, ids array<int>, n_bytes long, lossless boolean")
    return found.withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, model_file: str = MODEL_FILE, id_col: str = "doc_id") -> DataFrame:
    """Texts of encoded rows: (id, text). Null ids decode to the empty text."""
    pieces = load(model_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                lists = part.column("ids")
                counts = np.array([len(x.values) if x.is_valid else 0 for x in lists], np.int64)
                data, ends = decode_ids(pieces, lists.flatten().to_numpy().astype(np.int64), counts)
                texts = [data[a:b].tobytes().decode() for a, b in zip(ends, ends[1:])]
                yield pa.RecordBatch.from_pydict({"id": part.column("id"), "text": pa.array(texts, pa.string())})

    found = encoded.select(F.col(id_col).alias("id"), "ids").mapInArrow(run, f"id {dict(encoded.dtypes)[id_col]}, text string")
    return found.withColumnRenamed("id", id_col)
