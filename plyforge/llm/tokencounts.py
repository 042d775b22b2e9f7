"""Token counts of a sentence-piece byte-pair model by rank-synchronous merging of arrays.

1. A text is normalised as the model file says (white space as U+2581, one of them in front) and
   turned into an array of symbol numbers, one per character.
2. Pre-tokens: the text is cut between two characters that stand side by side in no piece of the
   vocabulary. No merge can cross such a place, so pre-tokens are merged apart; equal ones of a
   slice of texts, compared character by character, are merged once.
3. All pre-tokens lie in one ragged array. In every round each of them looks up its adjacent pairs
   and applies the pair of the lowest rank, in all its places from left to right. Finished ones
   leave the array.
4. One pair at a time, a merge may make a pair of a lower rank, which then comes before the rest.
   Such merges are rare and known from the vocabulary; a pre-token with one stops its round there.
5. The symbols left are counted: one token each, and one per byte for characters outside the
   vocabulary.

No row leaves its task. Memory is a slice of texts and its arrays; a longer text is read in windows
that end between two pre-tokens.

Odd cases: a null text counts as empty and has no tokens; marker strings inside a text are ordinary
characters, as the model's library has it. Repeated rows give equal rows, ties of rank go to the
left, texts of any length are counted whole, and empty tables give none. Of the table only the
named columns are read, so others may have any names.
"""

import struct
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plyforge.llm.batches import FACTOR, _powers, mixed, raw, slices

# The character that stands for a space; kinds of pieces in a model file.
SPACE = "▁"
NORMAL, USER_DEFINED, UNUSED, BYTE = 1, 4, 5, 6

MODEL = "piece_bpe_32k.model"
WINDOW_BYTES = 8 << 20
NEVER = np.int64(1) << 40


def _fields(data: bytes):
    """(field, value) of a serialised message."""
    at = 0

    def number():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        head = number()
        if head & 7 == 2:
            size = number()
            value, at = data[at : at + size], at + size
        elif head & 7 == 5:
            value, at = struct.unpack("<f", data[at : at + 4])[0], at + 4
        elif head & 7 == 1:
            value, at = data[at : at + 8], at + 8
        else:
            value = number()
        yield head >> 3, value


class Model:
    """Symbols, ranked pairs and possible neighbours of a byte-pair model file."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            fields = list(_fields(file.read()))
        spec = dict(_fields(b"".join(value for field, value in fields if field == 3)))
        if spec.get(2) or spec.get(4, 1) or not spec.get(5, 1):
            raise ValueError("the model changes characters or white space")
        self.prefix = bool(spec.get(3, 1))
        pieces = [dict(_fields(value)) for field, value in fields if field == 1]
        kinds = {piece.get(3, NORMAL) for piece in pieces}
        if kinds & {USER_DEFINED, UNUSED} or BYTE not in kinds:
            raise ValueError("the model has pieces of a kind that is not counted here")
        scores = {p[1].decode(): p.get(2, 0.0) for p in pieces if p.get(3, NORMAL) == NORMAL}
        numbers = {piece: number for number, piece in enumerate(scores)}
        for char in sorted({char for piece in scores for char in piece}):
            numbers.setdefault(char, len(numbers))
        self.size = len(numbers)
        self.cost = np.ones(self.size + 1, np.int64)
        self.symbol = np.full(0x110000, -1, np.int32)
        for piece, number in numbers.items():
            if piece not in scores:
                self.cost[number] = len(piece.encode())
            if len(piece) == 1:
                self.symbol[ord(piece)] = number
        ranks = {score: rank for rank, score in enumerate(sorted(set(scores.values()), reverse=True))}
        pairs = {
            (numbers[piece[:i]], numbers[piece[i:]]): (ranks[score], numbers[piece])
            for piece, score in scores.items()
            for i in range(1, len(piece))
            if piece[:i] in numbers and piece[i:] in numbers
        }
        keys = np.array([left * self.size + right for left, right in pairs], np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        values = np.array(list(pairs.values()), np.int64).reshape(-1, 2)[order]
        self.ranks, self.results = values[:, 0], values[:, 1]
        made = np.full(self.size, NEVER)
        made[self.results] = self.ranks
        left, right = self.keys // self.size, self.keys % self.size
        self.overtaken = np.zeros(self.size, bool)  # symbols with a pair of their own rank or lower
        for side in (left, right):
            lower = (made[side] != NEVER) & (self.ranks <= made[side])
            self.overtaken[side[lower]] = True
        self._neighbours(scores)

    def _neighbours(self, pieces):
        """A bit for every two characters that stand side by side in a piece."""
        chars = sorted({char for piece in pieces for char in piece})
        self.letters = len(chars) + 1
        self.letter = np.zeros(0x110000, np.int32)  # 0 for characters of no piece
        self.letter[[ord(char) for char in chars]] = np.arange(1, self.letters)
        couples = {couple for piece in pieces for couple in zip(piece, piece[1:])}
        bits = np.zeros(self.letters**2, bool)
        if couples:
            a, b = (self.letter[[ord(char) for char in side]] for side in zip(*couples))
            bits[a.astype(np.int64) * self.letters + b] = True
        self.together = np.packbits(bits, bitorder="little")

    def joins(self, points: np.ndarray) -> np.ndarray:
        """Whether a piece holds character i and the next one side by side, for all but the last."""
        letters = self.letter[points].astype(np.int64)
        at = letters[:-1] * self.letters + letters[1:]
        return (self.together[at >> 3] >> (at & 7)) & 1 == 1

    def ranked(self, left: np.ndarray, right: np.ndarray) -> tuple:
        """(rank, result) of pairs of symbols; NEVER where they don't merge."""
        keys = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        known = (self.keys[at] == keys) & (left >= 0) & (right >= 0)
        return np.where(known, self.ranks[at], NEVER), self.results[at]


@lru_cache(maxsize=2)
def model(name: str) -> Model:
    return Model(public_tokenizers.path(name))


def _chosen(hits: np.ndarray) -> np.ndarray:
    """From ascending places of pairs those that a pass from left to right merges."""
    first = np.ones(len(hits), bool)
    first[1:] = hits[1:] != hits[:-1] + 1
    run = np.maximum.accumulate(np.where(first, np.arange(len(hits)), 0))
    return hits[(np.arange(len(hits)) - run) % 2 == 0]


def _until_overtaken(vocabulary: Model, symbols, owner, low, places, results) -> np.ndarray:
    """Which merges to keep: in each pre-token those up to the first that makes a lower pair."""
    keep = np.ones(len(places), bool)
    asked = np.flatnonzero(vocabulary.overtaken[results])
    if not len(asked):
        return keep
    at, new = places[asked], results[asked]
    before, after = at - 1, at + 2
    merged_before = np.zeros(len(asked), bool)
    merged_before[asked > 0] = places[asked[asked > 0] - 1] == at[asked > 0] - 2
    previous = np.where(merged_before, results[np.maximum(asked - 1, 0)], symbols[np.maximum(before, 0)])
    has_before = (before >= 0) & (owner[np.maximum(before, 0)] == owner[at])
    last = len(symbols) - 1
    has_after = (after <= last) & (owner[np.minimum(after, last)] == owner[at])
    rank_before, _ = vocabulary.ranked(previous, new)
    rank_after, _ = vocabulary.ranked(new, symbols[np.minimum(after, last)])
    limit = low[owner[at]]
    bad = (has_before & (rank_before <= limit)) | (has_after & (rank_after <= limit))
    if not bad.any():
        return keep
    stop = np.full(len(low), len(symbols), np.int64)
    np.minimum.at(stop, owner[at[bad]], at[bad])
    return places <= stop[owner[places]]


def merged_counts(vocabulary: Model, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Tokens of each pre-token; `symbols` holds them one after the other, none is empty."""
    out = np.zeros(len(sizes), np.int64)
    names = np.arange(len(sizes))
    while len(names):
        owner = np.repeat(np.arange(len(names)), sizes)
        starts = np.cumsum(sizes) - sizes
        rank = np.full(len(symbols), NEVER)
        result = np.zeros(len(symbols), np.int64)
        if len(symbols) > 1:
            inner = np.flatnonzero(owner[1:] == owner[:-1])
            rank[inner], result[inner] = vocabulary.ranked(symbols[inner], symbols[inner + 1])
        low = np.minimum.reduceat(rank, starts)
        done = low == NEVER
        if done.any():
            out[names[done]] = np.add.reduceat(vocabulary.cost[symbols], starts)[done]
        places = _chosen(np.flatnonzero((rank == low[owner]) & (rank < NEVER)))
        new = result[places]
        keep = _until_overtaken(vocabulary, symbols, owner, low, places, new)
        places, new = places[keep], new[keep]
        symbols = symbols.copy()
        symbols[places] = new
        stays = ~done[owner]
        stays[places + 1] = False
        symbols, owner = symbols[stays], owner[stays]
        sizes = np.bincount(owner, minlength=len(names))[~done]
        names = names[~done]
    return out


def _points(data: bytes) -> np.ndarray:
    return np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.int64)


def _distinct(symbols, points, starts, sizes) -> tuple:
    """(first place of each distinct pre-token, its number for every pre-token), compared in full."""
    owner = np.repeat(np.arange(len(starts)), sizes)
    inner = np.arange(len(points)) - np.repeat(starts, sizes)
    weighted = (points + 1).astype(np.uint64) * _powers(int(sizes.max()))[inner]
    hashes = mixed(np.add.reduceat(weighted, starts) + FACTOR * sizes.astype(np.uint64))
    _, first, number = np.unique(hashes, return_index=True, return_inverse=True)
    twin = first[number]
    same = (sizes == sizes[twin]).all()
    if same:
        same = (points == points[(starts[twin])[owner] + inner]).all()
    return (first, number) if same else (np.arange(len(starts)), np.arange(len(starts)))


def pretoken_counts(vocabulary: Model, points: np.ndarray, row_starts: np.ndarray) -> tuple:
    """(starts of pre-tokens, tokens of each) in an array of characters; rows start a new one."""
    opens = np.ones(len(points), bool)
    opens[1:] = ~vocabulary.joins(points)
    opens[row_starts] = True
    starts = np.flatnonzero(opens)
    sizes = np.diff(np.append(starts, len(points)))
    symbols = vocabulary.symbol[points].astype(np.int64)
    first, number = _distinct(symbols, points, starts, sizes)
    length = sizes[first]
    at = np.repeat(starts[first] - (np.cumsum(length) - length), length) + np.arange(length.sum())
    own = symbols[at]
    counts = merged_counts(vocabulary, np.where(own < 0, vocabulary.size, own), length)
    strange = own[np.cumsum(length) - length] < 0  # characters of no piece stand alone
    code = points[starts[first]]
    width = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
    return starts, np.where(strange, width, counts)[number]


def _row_counts(vocabulary: Model, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Tokens of each row of a slice."""
    rows = np.flatnonzero(np.diff(bounds))
    if not len(rows):
        return np.zeros(len(bounds) - 1, np.int64)
    points = _points(data.tobytes())
    places = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[bounds[rows]]
    points[points == 0x20] = ord(SPACE)
    if vocabulary.prefix:
        points = np.insert(points, places, ord(SPACE))
        places = places + np.arange(len(places))
    starts, counts = pretoken_counts(vocabulary, points, places)
    row = np.searchsorted(places, starts, "right") - 1
    out = np.zeros(len(bounds) - 1, np.int64)
    out[rows] = np.add.reduceat(counts, np.searchsorted(row, np.arange(len(rows))))
    return out


def _long_count(vocabulary: Model, data: np.ndarray, window=WINDOW_BYTES) -> int:
    """Tokens of one long text, read in windows that end between two pre-tokens."""
    at, size, total, first = 0, window, 0, vocabulary.prefix
    while at < len(data):
        end = min(at + size, len(data))
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end += 1
        points = _points(data[at:end].tobytes())
        points[points == 0x20] = ord(SPACE)
        if first:
            points = np.insert(points, 0, ord(SPACE))
        if end < len(data):
            gaps = np.flatnonzero(~vocabulary.joins(points)) + 1
            gaps = gaps[gaps > 1]
            if not len(gaps):
                size *= 2
                continue
            used = points[: gaps[-1]]
            real = used[1:] if first else used
            spaces = int(np.count_nonzero(real == ord(SPACE)))
            width = 1 + (real >= 0x80) + (real >= 0x800) + (real >= 0x10000)
            written = int(width.sum())
            if spaces:  # a space is one byte, a U+2581 of the text three
                given = data[at:end].tobytes().decode("utf-8")[: len(real)]
                written = len(given.encode("utf-8"))
            points, at = used, at + written
        else:
            at = end
        total += int(pretoken_counts(vocabulary, points, np.zeros(1, np.int64))[1].sum())
        first, size = False, window
    return total


def row_counts(vocabulary: Model, column, window=WINDOW_BYTES) -> np.ndarray:
    """Tokens of each text of an Arrow column."""
    data, bounds = raw(column)
    if len(bounds) == 2 and len(data) > window:
        return np.array([_long_count(vocabulary, data, window)])
    return _row_counts(vocabulary, data, bounds)


def count_tokens(docs: DataFrame, name=MODEL, doc_id="doc_id", text="text", limit=4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every document; no begin or end tokens."""

    def run(batches):
        vocabulary = model(name)
        for part in slices(batches, "_text"):
            column = part.column("_text")
            n_bytes = np.diff(raw(column)[1])
            counts = [part.column("_id"), pa.array(n_bytes), pa.array(row_counts(vocabulary, column))]
            yield pa.RecordBatch.from_arrays(counts, names=["_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    kind = rows.schema[0].dataType.simpleString()
    counted = rows.mapInArrow(run, f"_id {kind}, n_bytes long, n_tokens long")
    return counted.select(
        F.col("_id").alias(doc_id), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
