"""Arrow batches of texts inside tasks: bounded slices, raw bytes, words as numpy arrays."""

import re

import numpy as np
import pyarrow as pa

SLICE_BYTES = 8 << 20
BLOCK_BYTES = 1 << 20
FACTOR = np.uint64(0x9E3779B97F4A7C15)
MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
MIX_2 = np.uint64(0x94D049BB133111EB)

#: A-Z to a-z; every other byte stays.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Lower-cased bytes of words (digits, letters, all of non-ASCII); 0 for separators.
WORD_BYTES = np.array(
    [b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 0 for b in LOWER], dtype=np.uint8
)
#: Non-space bytes, lower-cased; 0 for white space.
SOLID_BYTES = np.array([0 if b == 32 or 9 <= b <= 13 else b + 1 for b in LOWER], dtype=np.uint16)
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SOLID = re.compile(r"[^\x20\x09-\x0D]+")
_UPPER = {code: code + 32 for code in range(65, 91)}


def lower(text: str) -> str:
    """A-Z in lower case, nothing else."""
    return text.lower() if text.isascii() else text.translate(_UPPER)


def mixed(values: np.ndarray) -> np.ndarray:
    """Each 64-bit value with its bits well spread."""
    values = (values ^ (values >> np.uint64(30))) * MIX_1
    values = (values ^ (values >> np.uint64(27))) * MIX_2
    return values ^ (values >> np.uint64(31))


def raw(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text or binary column and the bounds of its rows; null counts as empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    bounds = np.frombuffer(column.buffers()[1], np.int64)[
        column.offset : column.offset + len(column) + 1
    ]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(batches, column: str, limit=SLICE_BYTES):
    """Slices of the batches whose texts have at most `limit` bytes, or of one longer text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        bounds = raw(batch.column(column))[1]
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(bounds, bounds[start] + limit, "right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end


def _cuts(data, bounds, table):
    """Byte ranges of about a block: whole rows, or parts of a long row cut at separators."""
    start, rows = 0, len(bounds) - 1
    row = 0
    while row < rows:
        end_row = max(int(np.searchsorted(bounds, bounds[row] + BLOCK_BYTES, "right")) - 1, row + 1)
        if end_row > row + 1 or bounds[row + 1] - bounds[row] <= BLOCK_BYTES:
            yield int(bounds[row]), int(bounds[end_row])
            row = end_row
            continue
        start, stop = int(bounds[row]), int(bounds[row + 1])
        while start < stop:
            end = min(start + BLOCK_BYTES, stop)
            while end < stop and table[data[end]]:
                end += 1
            yield start, end
            start = end
        row += 1


_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        steps = np.full(max(n, 4096), FACTOR, np.uint64)
        steps[0] = 1
        _POWERS = np.cumprod(steps)
    return _POWERS


def word_starts(data, bounds, table):
    """For bytes `data` of the rows in `bounds`: mapped bytes and positions where words start."""
    mapped = table[data]
    inside = mapped != 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = bounds[(bounds >= 0) & (bounds < len(data))]
    first[edges] = inside[edges]
    return mapped, np.flatnonzero(first)


def word_hashes(column, table=WORD_BYTES, heads=()):
    """Hashes of all words of the rows in order, and the bounds of each row's words.

    With `heads` also, for each of these ascending lengths, the hashes of the words' first bytes.
    """
    data, bounds = raw(column)
    hashes, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    cut = [[np.zeros(0, np.uint64)] for _ in heads]
    for start, end in _cuts(data, bounds, table):
        part = data[start:end]
        mapped, at = word_starts(part, bounds - start, table)
        if not len(at):
            continue
        lengths = np.diff(np.append(at, len(part)))
        inner = np.arange(at[0], len(part)) - np.repeat(at, lengths)
        powers = _powers(int(lengths.max()))
        weighted = mapped[at[0] :].astype(np.uint64) * powers[inner]
        hashes.append(mixed(np.add.reduceat(weighted, at - at[0]) + FACTOR))
        places.append(at + start)
        total, done = np.zeros(len(at), np.uint64), 0
        for size, out in zip(heads, cut):
            for j in range(done, min(size, len(powers))):
                own = mapped[np.minimum(at + j, len(part) - 1)].astype(np.uint64) * powers[j]
                total += np.where(lengths > j, own, np.uint64(0))
            done = size
            out.append(mixed(total + FACTOR))
    words, rows = np.concatenate(hashes), np.searchsorted(np.concatenate(places), bounds)
    return (words, rows, [np.concatenate(out) for out in cut]) if heads else (words, rows)


def word_places(column, table=WORD_BYTES) -> np.ndarray:
    """The byte at which each word starts, counted over all rows."""
    data, bounds = raw(column)
    places = [np.zeros(0, np.int64)]
    for start, end in _cuts(data, bounds, table):
        places.append(word_starts(data[start:end], bounds - start, table)[1] + start)
    return np.concatenate(places)


def word_counts(column, table=WORD_BYTES) -> np.ndarray:
    """The number of words of each row."""
    data, bounds = raw(column)
    counts = np.zeros(len(bounds) - 1, np.int64)
    for start, end in _cuts(data, bounds, table):
        _, at = word_starts(data[start:end], bounds - start, table)
        row = np.searchsorted(bounds, at + start, "right") - 1
        counts += np.bincount(row, minlength=len(counts))
    return counts


def texts(column) -> list:
    """The rows as strings; null counts as empty."""
    return ["" if value is None else value for value in column.to_pylist()]
