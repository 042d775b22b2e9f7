"""Fill-in-the-middle documents, their cuts found through summaries of shared chunks.

A unit is a word with the white space before it; white space at the end of a text is one unit more.

1. A rolling hash over 16 bytes cuts each text where the hash says so, so equal passages are cut
   alike wherever they stand. Long stretches without such a place are cut every 64 KiB.
2. A task keeps a cache of chunks, compared byte by byte, each with its summary: code points, unit
   ends inside, and whether its first and last bytes are white space.
3. The summaries of a text's chunks add up to its number of units, a border between chunks being a
   unit end when white space follows a word there.
4. The cuts come from hashes of the document's id. The chunk with the wanted unit end is found in
   the running sums, and only that chunk is read again.

No row leaves its task, so there is no shuffle; memory is a slice of texts (or one long text) and
the cache, which is emptied when full.

Odd cases: a null text counts as empty; an empty text and one that holds a marker stay plain, as
does a share of all others. A null id is hashed as an empty one. Repeated rows give equal rows.
Ties (both cuts at one place) give an empty middle. Texts of any length are taken whole. Empty
tables give none. Of the table only the named columns are read, so others may have any names.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plyforge.llm.batches import SOLID_BYTES, raw, slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKERS = tuple(mark.encode() for mark in (PREFIX, SUFFIX, MIDDLE))
WINDOW = 16
CUT_MASK = np.uint64(0x3FF)
LONGEST = 64 << 10
CACHE_BYTES = 32 << 20
SOLID = SOLID_BYTES != 0
GEAR = np.random.default_rng(1997).integers(0, 1 << 63, 256, dtype=np.uint64)
KIND = "n long, form string, prefix_chars long, middle_chars long, output string"


def chunk_ends(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Ends of all chunks of the rows in `bounds`, row ends among them; never inside a character."""
    rolled, width = GEAR[data], 1
    while width < WINDOW:
        rolled[width:] += rolled[:-width] << np.uint64(width)
        width *= 2
    found = np.flatnonzero((rolled >> np.uint64(24)) & CUT_MASK == 0) + 1
    row = np.searchsorted(bounds, found, "left") - 1  # a window must lie in one row
    found = found[found - bounds[row] >= WINDOW]
    ends = np.union1d(found, bounds[1:])
    starts = np.concatenate([bounds[:1], ends[:-1]])
    long = np.flatnonzero(ends - starts > LONGEST)
    if len(long):
        extra = [np.arange(starts[i] + LONGEST, ends[i], LONGEST) for i in long]
        ends = np.union1d(ends, np.concatenate(extra))
    inner = ends < len(data)
    while True:
        split = inner & ((data[np.minimum(ends, len(data) - 1)] & 0xC0) == 0x80)
        if not split.any():
            return np.unique(ends)
        ends = ends + split
        inner = ends < len(data)


def summary(chunk: np.ndarray) -> tuple:
    """(code points, unit ends inside, first byte solid, last byte solid)."""
    solid = SOLID[chunk]
    ends = int(np.count_nonzero(solid[:-1] & ~solid[1:]))
    return int(np.count_nonzero((chunk & 0xC0) != 0x80)), ends, bool(solid[0]), bool(solid[-1])


class Chunks:
    """Summaries of chunks seen before, found by content."""

    def __init__(self, limit=CACHE_BYTES):
        self.known, self.size, self.limit, self.hits = {}, 0, limit, 0

    def of(self, chunk: np.ndarray) -> tuple:
        content = chunk.tobytes()
        found = self.known.get(content)
        if found is not None:
            self.hits += 1
            return found
        if self.size + len(content) > self.limit:
            self.known, self.size = {}, 0
        found = self.known[content] = summary(chunk)
        self.size += len(content)
        return found


class Text:
    """A text as its chunks' summaries; cuts are found by unit number."""

    def __init__(self, data, starts, ends, cache):
        self.data, self.starts, self.ends = data, starts, ends
        parts = [cache.of(data[a:b]) for a, b in zip(starts, ends)]
        chars, inner, first, last = (np.array(column) for column in zip(*parts)) if parts else ([],) * 4
        self.border = np.zeros(len(parts), bool)
        if parts:
            self.border[1:] = last[:-1] & ~first[1:]
        self.found = np.cumsum(inner + self.border) if parts else np.zeros(0, np.int64)
        self.chars = np.concatenate([[0], np.cumsum(chars)]).astype(np.int64)
        self.n = int(self.found[-1]) + 1 if parts else 0

    def after(self, units: int) -> tuple:
        """(byte, code points) where the text has been read up to the end of that many units."""
        if units <= 0:
            return 0, 0
        if units >= self.n:
            return int(self.ends[-1] - self.starts[0]), int(self.chars[-1])
        at = int(np.searchsorted(self.found, units, "left"))
        start, chunk = int(self.starts[at]), self.data[self.starts[at] : self.ends[at]]
        left = units - (int(self.found[at - 1]) if at else 0) - int(self.border[at])
        place = 0
        if left:
            solid = SOLID[chunk]
            place = int(np.flatnonzero(solid[:-1] & ~solid[1:])[left - 1]) + 1
        chars = int(self.chars[at]) + int(np.count_nonzero((chunk[:place] & 0xC0) != 0x80))
        return start - int(self.starts[0]) + place, chars


def _arranged(whole: bytes, text: Text, draws, plain_share: int, spm_share: int) -> tuple:
    """(form, prefix characters, middle characters, output) of one text."""
    first, second, form, order = draws
    if not whole or form % 100 >= plain_share or any(mark in whole for mark in MARKERS):
        return "plain", None, None, whole
    one, two = sorted((first % (text.n + 1), second % (text.n + 1)))
    (a, chars_a), (b, chars_b) = text.after(one), text.after(two)
    head, middle, tail = whole[:a], whole[a:b], whole[b:]
    if order % 100 < spm_share:
        parts, kind = (MARKERS[1], tail, MARKERS[0], head, MARKERS[2], middle), "spm"
    else:
        parts, kind = (MARKERS[0], head, MARKERS[1], tail, MARKERS[2], middle), "psm"
    return kind, chars_a, chars_b - chars_a, b"".join(parts)


def _transform(plain_share: int, spm_share: int):
    def run(batches):
        cache = Chunks()
        for part in slices(batches, "_text"):
            data, bounds = raw(part.column("_text"))
            ends = chunk_ends(data, bounds) if len(data) else np.zeros(0, np.int64)
            starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
            from_chunk = np.searchsorted(starts, bounds[:-1], "left")
            to_chunk = np.searchsorted(ends, bounds[1:], "right")
            draws = list(zip(*(part.column(f"_h{i}").to_pylist() for i in range(1, 5))))
            rows = []
            for row in range(part.num_rows):
                whole = data[bounds[row] : bounds[row + 1]].tobytes()
                own = slice(from_chunk[row], to_chunk[row]) if whole else slice(0, 0)
                text = Text(data, starts[own], ends[own], cache)
                rows.append((text.n, *_arranged(whole, text, draws[row], plain_share, spm_share)))
            n, form, head, middle, output = zip(*rows)
            out = [
                pa.array(n, pa.int64()),
                pa.array(form, pa.string()),
                pa.array(head, pa.int64()),
                pa.array(middle, pa.int64()),
                pa.array(output, pa.binary()).cast(pa.string()),
            ]
            names = ["n", "form", "prefix_chars", "middle_chars", "output"]
            yield pa.RecordBatch.from_arrays([part.column("_id"), *out], names=["_id", *names])

    return run


def draws(doc_id: Column, seed: int) -> list:
    """Four numbers from the hash of the seed and the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [
        F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"_h{i + 1}")
        for i in range(4)
    ]


def fill_in_middle(
    docs: DataFrame, doc_id="doc_id", text="text", seed=42, share=50, spm_share=80
) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every document.

    Of 100 documents about `share` are cut in three, and of those `spm_share` have the suffix first.
    """
    kind = docs.select(F.col(doc_id).alias("_id")).schema[0].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"), *draws(F.col(doc_id), seed))
    cut = rows.mapInArrow(_transform(share, spm_share), f"_id {kind}, {KIND}")
    return cut.withColumnRenamed("_id", doc_id)


def restored(output: Column, form: Column) -> Column:
    """The text that `output` was made of."""
    here = lambda mark, text=output: F.instr(text, mark)
    part = lambda start, end: F.substring(output, start, end - start)
    end = F.length(output) + 1
    p, s, m = here(PREFIX), here(SUFFIX), here(MIDDLE)
    psm = F.concat(part(p + 3, s), part(m + 3, end), part(s + 3, m))
    spm = F.concat(part(p + 3, m), part(m + 3, end), part(s + 3, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
