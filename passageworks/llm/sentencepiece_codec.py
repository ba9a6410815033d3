"""SentencePiece encoding and decoding with byte-pair models, by vectorised merge rounds.

A text is cut into units, each a run of spaces and the following run of other characters. No piece
of the vocabulary holds a space behind another character, so no merge crosses a unit. The distinct
units of a batch lie in one flat array of symbols. Each round ranks all pairs of neighbours, takes
the minimum per unit, merges it in all units at once, and compacts the array, until no pair is left.

Results equal the library's for models of kind BPE with identity normalisation, a leading space,
kept spaces and byte fallback; ``Pieces.read`` refuses any other model. Null texts count as empty.
An empty text has no pieces but the end id, if asked for. Texts of any length are read whole. A
repeated row is encoded like any other, an empty table gives none, and further columns are dropped
by ``encoded`` unless named in ``keep``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from passageworks.llm.store import release, send

SPACE = "▁"
NO_RANK = np.int64(1) << 40
WIDTH = 1 << 32
MEMORY = 1 << 19  # distinct units that a task remembers between batches
MOST_SYMBOLS = 1 << 17  # symbols in one flat array, unless a single unit has more


@dataclass
class Pieces:
    """Tables of a model, bounded by its vocabulary.

    Symbols are ids of pieces; characters that occur only inside pieces, and unknown ones, have
    numbers beyond them. ``slots`` is a hash table of left * WIDTH + right, with one displacement
    for each of its buckets; ``merged`` is the piece a pair makes, ``rank`` its place in the order
    of merges (least first).
    """

    texts: list[str]
    byte_ids: np.ndarray
    control: np.ndarray
    is_byte: np.ndarray
    unknown_id: int
    unknown_text: str
    end_id: int
    characters: dict[str, int]
    slots: np.ndarray
    moved: np.ndarray
    merged: np.ndarray
    rank: np.ndarray

    @staticmethod
    def read(path: str) -> Pieces:
        import sentencepiece as spm

        model = spm.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        texts = [model.id_to_piece(i) for i in range(n)]
        special = np.array([model.is_control(i) or model.is_unknown(i) for i in range(n)])
        is_byte = np.array([model.is_byte(i) for i in range(n)])
        normal = [i for i in range(n) if not (special[i] or is_byte[i])]
        probe = " a  b\tcﬁ ①\n "
        if (
            model.normalize(probe) != SPACE + probe.replace(" ", SPACE)
            or is_byte.sum() != 256
            or any(model.is_unused(i) for i in normal)
            or any(SPACE in texts[i].lstrip(SPACE) for i in normal)
        ):
            raise ValueError("only BPE models with identity normalisation and byte fallback are read")
        byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        symbol = {texts[i]: i for i in normal}
        characters = {c: i for c, i in symbol.items() if len(c) == 1}
        for c in sorted({c for i in normal for c in texts[i]} - set(characters)):
            characters[c] = symbol[c] = n + len(symbol)
        scores = np.array([model.get_score(i) for i in range(n)])
        order = np.unique(-scores[normal], return_inverse=True)[1]
        rank_of = dict(zip(normal, order.tolist(), strict=True))
        made = [
            (symbol[texts[i][:k]] * WIDTH + symbol[texts[i][k:]], i)
            for i in normal
            for k in range(1, len(texts[i]))
            if texts[i][:k] in symbol and texts[i][k:] in symbol
        ]
        pairs = np.array([k for k, _ in made], dtype=np.int64)
        slots, moved, place = _displaced(pairs)
        merged, rank = np.zeros(len(slots), dtype=np.int64), np.full(len(slots), NO_RANK)
        merged[place] = [i for _, i in made]
        rank[place] = [rank_of[i] for _, i in made]
        return Pieces(
            texts, byte_ids, special, is_byte, model.unk_id(), model.decode([model.unk_id()]),
            model.eos_id(), characters, slots, moved, merged, rank,
        )

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NO_RANK if none) and slot of each pair."""
        key = left * WIDTH + right
        bucket, slot = _hashed(key, len(self.moved), len(self.slots))
        slot = (slot + self.moved[bucket]) & (len(self.slots) - 1)
        return np.where(self.slots[slot] == key, self.rank[slot], NO_RANK), slot


def _hashed(key: np.ndarray, buckets: int, slots: int) -> tuple[np.ndarray, np.ndarray]:
    spread = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    spread ^= spread >> np.uint64(29)
    return (
        (spread >> np.uint64(40)).astype(np.int64) & (buckets - 1),
        spread.astype(np.int64) & (slots - 1),
    )


def _displaced(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A table in which each key has a slot of its own: slots, a shift per bucket, slot per key."""
    size = 1 << max(4, (8 * len(keys)).bit_length())
    buckets = size >> 3
    slots, moved = np.full(size, -1, dtype=np.int64), np.zeros(buckets, dtype=np.int64)
    place = np.zeros(len(keys), dtype=np.int64)
    bucket, start = _hashed(keys, buckets, size)
    order = np.argsort(bucket, kind="stable")
    groups = np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(keys) else []
    for group in sorted(groups, key=len, reverse=True):
        for shift in range(size):
            to = (start[group] + shift) & (size - 1)
            if (slots[to] < 0).all() and len(set(to.tolist())) == len(to):
                break
        else:
            raise ValueError("two pairs of the vocabulary have the same hash")
        slots[to], moved[bucket[group[0]]], place[group] = keys[group], shift, to
    return slots, moved, place


def _alternate(hit: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Of hits at neighbouring places, every second one from the left, as overlaps are merged."""
    place = np.arange(len(hit))
    opens = hit & ~np.r_[False, hit[:-1] & same[1:]]
    return hit & ((place - np.maximum.accumulate(np.where(opens, place, 0))) % 2 == 0)


def merge_rounds(symbol: np.ndarray, unit: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """The final symbols of all units, and the unit of each; ``unit`` ascends.

    The order of merges is by rank, then from the left. A round merges all leftmost places of its
    unit's minimum pair at once, unless one of them makes a pair of lower rank, which would come
    next: then the unit merges its first place only.
    """
    out_symbol, out_unit = [], []
    live, live_unit = symbol.astype(np.int64), unit.astype(np.int64)
    while len(live) > 1:
        same = live_unit[1:] == live_unit[:-1]
        rank, place = pieces.look_up(live[:-1], live[1:])
        rank[~same] = NO_RANK
        first = np.flatnonzero(np.r_[True, ~same])
        size = np.diff(np.r_[first, len(live)])
        least = np.minimum.reduceat(np.r_[rank, NO_RANK], first)
        done = np.repeat(least == NO_RANK, size)
        if done.any():
            out_symbol.append(live[done]), out_unit.append(live_unit[done])
            keep = ~done
            live, live_unit = live[keep], live_unit[keep]
            rank, place = np.r_[rank, NO_RANK][keep][:-1], np.r_[place, 0][keep][:-1]
            if not len(live):
                break
            # What ends a unit holds NO_RANK, so neighbours made by dropping units stay apart.
            same = live_unit[1:] == live_unit[:-1]
            size, least = size[least != NO_RANK], least[least != NO_RANK]
            first = np.cumsum(size) - size
        hit = _alternate(rank == np.repeat(least, size)[:-1], same)
        into = pieces.merged[place]
        at = np.flatnonzero(hit)
        # Left neighbour as merged before, right neighbour as it still is.
        merged = live.copy()
        merged[at] = into[at]
        gone = np.zeros(len(live), dtype=bool)
        gone[at + 1] = True
        left = at - 1
        left = np.where((left >= 0) & gone[left], left - 1, left)
        has_left = (left >= 0) & (live_unit[left] == live_unit[at])
        right = np.minimum(at + 2, len(live) - 1)
        has_right = (at + 2 < len(live)) & (live_unit[right] == live_unit[at])
        low = np.minimum(
            np.where(has_left, pieces.look_up(merged[left], into[at])[0], NO_RANK),
            np.where(has_right, pieces.look_up(into[at], live[right])[0], NO_RANK),
        )
        index = np.repeat(np.arange(len(first)), size)
        careful = np.zeros(len(first), dtype=bool)
        careful[index[at][low < least[index[at]]]] = True
        opens = np.r_[True, index[at][1:] != index[at][:-1]]
        at = at[opens | ~careful[index[at]]]
        live[at] = into[at]
        keep = np.ones(len(live), dtype=bool)
        keep[at + 1] = False
        live, live_unit = live[keep], live_unit[keep]
    if len(live):
        out_symbol.append(live), out_unit.append(live_unit)
    if not out_symbol:
        return live, live_unit
    symbols, units = np.concatenate(out_symbol), np.concatenate(out_unit)
    order = np.argsort(units, kind="stable")
    return symbols[order], units[order]


def unit_ids(units: Sequence[str], pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all units (spaces already written as U+2581), and how many each has."""
    text = "".join(units)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kinds, place = np.unique(codes, return_inverse=True)
    beyond = 1 << 31  # characters in no piece
    symbol = np.array([pieces.characters.get(chr(c), beyond + int(c)) for c in kinds], dtype=np.int64)
    lengths = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
    symbols, unit = merge_rounds(symbol[place], np.repeat(np.arange(len(units)), lengths), pieces)
    plain = symbols < len(pieces.texts)
    if not plain.all():  # a character without a piece of its own is written as its bytes
        names = {i: c for c, i in pieces.characters.items() if i >= len(pieces.texts)}
        kinds, place = np.unique(symbols[~plain], return_inverse=True)
        odd = [
            pieces.byte_ids[list((names.get(s) or chr(s - beyond)).encode("utf-8", "replace"))]
            for s in kinds.tolist()
        ]
        size = np.ones(len(symbols), dtype=np.int64)
        size[~plain] = np.array([len(o) for o in odd])[place]
        flat, unit = np.repeat(symbols, size), np.repeat(unit, size)
        flat[np.repeat(~plain, size)] = np.concatenate([odd[i] for i in place.tolist()])
        symbols = flat
    return symbols, np.bincount(unit, minlength=len(units))


_UNIT = re.compile(" *[^ ]+| +$")


def _units(text: str) -> list[str]:
    """The units of a text that begins with the added space.

    A unit that begins with another character stands for itself with one space before it.
    """
    if "  " in text or text[-1] == " ":
        return _UNIT.findall(text)
    return text[1:].split(" ")


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... start[0] + size[0] - 1, start[1], ..."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)


class Encoder:
    """Encodes texts of one task, remembering the ids of recent units in one flat array."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.ids, self.size = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int32)
        self.start = np.zeros(0, dtype=np.int64)

    def _learn(self, units: set[str]) -> None:
        ids, sizes, chunk, symbols = [self.ids], [self.size], [], 0
        for unit in units:
            self.number[unit] = len(self.number)
            chunk.append((unit if unit[:1] == " " else " " + unit).replace(" ", SPACE))
            symbols += len(unit) + 1
            if symbols >= MOST_SYMBOLS:
                made = unit_ids(chunk, self.pieces)
                ids.append(made[0].astype(np.int32)), sizes.append(made[1].astype(np.int32))
                chunk, symbols = [], 0
        if chunk:
            made = unit_ids(chunk, self.pieces)
            ids.append(made[0].astype(np.int32)), sizes.append(made[1].astype(np.int32))
        self.ids, self.size = np.concatenate(ids), np.concatenate(sizes)
        self.start = np.cumsum(self.size, dtype=np.int64) - self.size

    def __call__(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        """The ids of each text, without an end id."""
        split = [_units(" " + t.replace(SPACE, " ")) if t else [] for t in texts]
        if len(self.number) > MEMORY:
            self._forget()
        new = {u for units in split for u in units}.difference(self.number)
        if new:
            self._learn(new)
        out = []
        for units in split:
            at = np.fromiter(map(self.number.__getitem__, units), dtype=np.int64, count=len(units))
            out.append(self.ids[_ranges(self.start[at], self.size[at])])
        return out


def decode(ids: np.ndarray, pieces: Pieces) -> str:
    """The text of a list of ids: control ids give nothing, byte ids what they spell.

    Bytes that spell no character give U+FFFD each; one space at the start is the added one.
    """
    ids = np.asarray(ids, dtype=np.int64)
    ids = ids[~pieces.control[ids] | (ids == pieces.unknown_id)]
    if not len(ids):
        return ""
    kind = pieces.is_byte[ids]
    texts = pieces.texts
    bare = [texts[i] for i in ids.tolist()]
    for i in np.flatnonzero(ids == pieces.unknown_id).tolist():
        bare[i] = pieces.unknown_text
    if kind.any():
        edge = np.flatnonzero(np.diff(np.r_[False, kind, False]))
        for lo, hi in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            raw = bytes(int(t[3:5], 16) for t in bare[lo:hi])
            bare[lo] = _spelled(raw)
            bare[lo + 1 : hi] = [""] * (hi - lo - 1)
    first = bare[0]
    if first[:1] == SPACE and not kind[0]:
        bare[0] = first[1:]
    return "".join(bare).replace(SPACE, " ")


def _spelled(raw: bytes) -> str:
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(raw):
            for size in (1, 2, 3, 4):
                try:
                    out.append(raw[at : at + size].decode("utf-8"))
                    at += size
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


def _chunks(texts: list[str | None], most: int = 1 << 20) -> Iterator[list[str | None]]:
    chunk, size = [], 0
    for t in texts:
        chunk.append(t)
        size += len(t or "")
        if size >= most:
            yield chunk
            chunk, size = [], 0
    if chunk:
        yield chunk


Digest = Callable[[np.ndarray, str], tuple]


def encoded(
    docs: DataFrame,
    pieces: Pieces,
    fields: Sequence[T.StructField],
    result: Digest,
    text: str = "text",
    keep: Sequence[str] = ("doc_id",),
    end: bool = True,
) -> DataFrame:
    """``keep`` and, for each row, what ``result`` makes of its ids and its decoded text.

    Rows are local: nothing is shuffled, a batch is read in parts of a megabyte, and a lost
    task is simply run again. The model's tables are broadcast; they are bounded by the vocabulary.
    """
    schema = T.StructType([*(docs.schema[c] for c in keep), *fields])
    out = pa.schema([_arrow_field(f) for f in fields])
    shared = send(docs.sparkSession, pieces)
    tail = [pieces.end_id] if end else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        model = shared()
        encoder = Encoder(model)
        for batch in batches:
            at = 0
            for chunk in _chunks(batch.column(len(keep)).to_pylist()):
                rows = [result(np.append(ids, tail).astype(np.int64), decode(ids, model)) for ids in encoder(chunk)]
                made = [pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)]
                held = [batch.column(i).slice(at, len(chunk)) for i in range(len(keep))]
                at += len(chunk)
                yield pa.RecordBatch.from_arrays([*held, *made], names=schema.names)

    return docs.select(*keep, text).mapInArrow(run, schema)


def _arrow_field(field: T.StructField) -> pa.Field:
    from pyspark.sql.pandas.types import to_arrow_type

    return pa.field(field.name, to_arrow_type(field.dataType))


_NUMBERS = [str(i) for i in range(1 << 16)]


def digest(ids: np.ndarray, text: str) -> tuple[int, str, str]:
    """Number of ids, hash of the ids as text, hash of the decoded text."""
    if len(ids) and ids.max() < len(_NUMBERS):
        spelled = " ".join([_NUMBERS[i] for i in ids.tolist()])
    else:
        spelled = " ".join(map(str, ids.tolist()))
    return (
        len(ids),
        hashlib.sha256(spelled.encode()).hexdigest(),
        hashlib.sha256(text.encode("utf-8", "replace")).hexdigest(),
    )


DIGEST = [
    T.StructField("n_tokens", T.LongType()),
    T.StructField("ids_sha256", T.StringType()),
    T.StructField("decoded_sha256", T.StringType()),
]


def ids_and_text(ids: np.ndarray, text: str) -> tuple[list[int], str]:
    """The ids and the decoded text themselves, for ``IDS_AND_TEXT``."""
    return ids.tolist(), text


IDS_AND_TEXT = [
    T.StructField("ids", T.ArrayType(T.LongType())),
    T.StructField("decoded", T.StringType()),
]
