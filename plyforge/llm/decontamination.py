"""Benchmark decontamination: broadcast n-gram hashes, scan all token windows, verify, remove.

Defined cases: a null or empty text has no words and is clean; null ids and repeated rows pass
through row by row; items without words give no window; an empty benchmark or document table gives
no hits; other columns, of any name, are kept by `decontaminate` and left out by
`find_contamination`; an item given twice counts once.
"""

import hashlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plyforge.llm import batches as B

WORDS = 13
SHARE = 20  # contaminated from one hit word in so many
BENCH_BYTES = 16 << 20  # benchmark texts broadcast at a time
TABLE_BITS = 20

_FOUND = "_found"
_STATE = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("starts", T.ArrayType(T.LongType())),
        T.StructField("ends", T.ArrayType(T.LongType())),
        T.StructField("items", T.ArrayType(T.LongType())),
    ]
)
_ARROW_STATE = pa.struct(
    [
        ("n_words", pa.int64()),
        ("starts", pa.list_(pa.int64())),
        ("ends", pa.list_(pa.int64())),
        ("items", pa.list_(pa.int64())),
    ]
)


def _windows(items, n: int) -> dict[tuple, list]:
    """Each window of the items' words with the items that hold it."""
    found = {}
    for item, text in items:
        words = B.WORD.findall(B.lower(text or ""))
        for at in range(max(len(words) - n + 1, min(len(words), 1))):
            found.setdefault(tuple(words[at : at + n]), set()).add(item)
    return found


class _Lookup:
    """Window hashes by length with a bit table in front, and the windows themselves."""

    def __init__(self, windows: dict[tuple, set]):
        self.windows = windows
        self.by_length = {}
        for length in {len(words) for words in windows}:
            own = [words for words in windows if len(words) == length]
            hashes, _ = B.word_hashes(pa.array([" ".join(words) for words in own]))
            keys = np.unique(self.rolled(hashes, length)[::length])
            table = np.zeros(1 << TABLE_BITS, bool)
            table[keys >> np.uint64(64 - TABLE_BITS)] = True
            self.by_length[length] = keys, table

    @staticmethod
    def rolled(hashes: np.ndarray, length: int) -> np.ndarray:
        """The hash of each run of `length` words."""
        n = len(hashes) - length + 1
        total = np.zeros(max(n, 0), np.uint64)
        for k in range(length if n > 0 else 0):
            total *= B.FACTOR
            total += hashes[k : k + n]
        return B.mixed(total)

    def candidates(self, hashes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        for length, (keys, table) in self.by_length.items():
            rolled = self.rolled(hashes, length)
            at = np.flatnonzero(table[rolled >> np.uint64(64 - TABLE_BITS)])
            near = np.minimum(np.searchsorted(keys, rolled[at]), len(keys) - 1)
            yield length, at[keys[near] == rolled[at]]


def _merged(starts, ends):
    """The union of word ranges, as sorted ranges that do not touch."""
    out = []
    for start, end in sorted(zip(starts, ends)):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [x[0] for x in out], [x[1] for x in out]


def _scan(batches, text, found, lookup):
    for batch in B.slices(batches, text):
        column = batch.column(text)
        hashes, bounds = B.word_hashes(column)
        places = {}
        for length, at in lookup.candidates(hashes):
            row = np.searchsorted(bounds, at, "right") - 1
            inside = at + length <= bounds[row + 1]
            for r, p in zip(row[inside].tolist(), at[inside].tolist()):
                places.setdefault(r, []).append((p - int(bounds[r]), length))
        counts = np.diff(bounds).tolist()
        before = batch.column(found).to_pylist()
        state = []
        for row, old in enumerate(before):
            old = old or {"starts": [], "ends": [], "items": []}
            starts, ends, items = old["starts"], old["ends"], old["items"]
            if row in places:
                words = B.WORD.findall(B.lower(column[row].as_py()))
                items = set(items)
                hit = []
                for at, length in places[row]:
                    holders = lookup.windows.get(tuple(words[at : at + length]))
                    if holders:
                        hit.append((at, at + length))
                        items |= holders
                starts, ends = _merged(
                    starts + [x[0] for x in hit], ends + [x[1] for x in hit]
                )
                items = sorted(items)
            state.append({"n_words": counts[row], "starts": starts, "ends": ends, "items": items})
        at = batch.schema.get_field_index(found)
        yield batch.set_column(at, found, pa.array(state, _ARROW_STATE))


def _item_blocks(benchmark: DataFrame, item: str, text: str, limit: int):
    """The benchmark in blocks of a checked size, each small enough for the driver."""
    rows = benchmark.select(F.col(item).cast("long").alias("item"), F.col(text).alias("text"))
    rows = rows.where("item IS NOT NULL AND text IS NOT NULL").distinct()
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    blocks = max(1, ceil(2 * size / limit)) if size > limit else 1
    for block in range(blocks):
        part = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block)
        yield [tuple(row) for row in part.collect()]


def scanned(
    docs: DataFrame, benchmark: DataFrame, *, text="text", item="item_id", item_text="text",
    n=WORDS, bench_bytes=BENCH_BYTES, found=_FOUND,
) -> DataFrame:
    """All rows and columns of `docs` with `found`: word count, hit word ranges, items.

    One narrow pass: each block of the benchmark is a broadcast of a checked size, and a further
    block is a further map over the same rows, without a shuffle.
    """
    spark = docs.sparkSession
    rows = docs.withColumn(found, F.lit(None).cast(_STATE))
    schema = rows.schema
    for items in _item_blocks(benchmark, item, item_text, bench_bytes):
        shared = spark.sparkContext.broadcast(_windows(items, n))

        def scan(batches, shared=shared):
            yield from _scan(batches, text, found, _Lookup(shared.value))

        rows = rows.mapInArrow(scan, schema)
    return rows


def _n_hit(found):
    return F.aggregate(
        F.zip_with(f"{found}.starts", f"{found}.ends", lambda a, b: b - a),
        F.lit(0).cast("long"),
        lambda total, n: total + n,
    )


def _dirty(found, share):
    n_hit = _n_hit(found)
    return (n_hit > 0) & (share * n_hit >= F.col(f"{found}.n_words"))


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, *, doc_id="doc_id", text="text", item="item_id",
    item_text="text", n=WORDS, share=SHARE, bench_bytes=BENCH_BYTES,
) -> DataFrame:
    """Per row of `docs`: doc_id, n_words, n_hit, items (sorted), spans of hit words, contaminated."""
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = scanned(
        narrow, benchmark, item=item, item_text=item_text, n=n, bench_bytes=bench_bytes
    )
    return rows.select(
        "doc_id",
        F.col(f"{_FOUND}.n_words").alias("n_words"),
        _n_hit(_FOUND).alias("n_hit"),
        F.col(f"{_FOUND}.items").alias("items"),
        F.arrays_zip(
            F.col(f"{_FOUND}.starts").alias("start"), F.col(f"{_FOUND}.ends").alias("end")
        ).alias("spans"),
        _dirty(_FOUND, share).alias("contaminated"),
    )


def _cut_spans(batches, text, found):
    for batch in B.slices(batches, text):
        out = batch.column(text).to_pylist()
        for row, state in enumerate(batch.column(found).to_pylist()):
            if state["starts"]:
                words = list(B.WORD.finditer(B.lower(out[row])))
                kept, at = [], 0
                for start, end in zip(state["starts"], state["ends"]):
                    kept.append(out[row][at : words[start].start()])
                    at = words[end - 1].end()
                out[row] = "".join(kept) + out[row][at:]
        at = batch.schema.get_field_index(text)
        yield batch.set_column(at, text, pa.array(out, batch.schema.field(at).type))


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, *, text="text", item="item_id", item_text="text",
    n=WORDS, share=SHARE, remove="documents", bench_bytes=BENCH_BYTES,
) -> DataFrame:
    """`docs` without contaminated documents, or with `remove="spans"` without their hit words.

    Spans are cut out of every document that has any, whatever its share.
    """
    found = _FOUND
    while found in docs.columns:
        found += "_"
    rows = scanned(
        docs, benchmark, text=text, item=item, item_text=item_text, n=n,
        bench_bytes=bench_bytes, found=found,
    )
    if remove == "spans":
        rows = rows.mapInArrow(lambda batches: _cut_spans(batches, text, found), rows.schema)
    else:
        rows = rows.where(~_dirty(found, share))
    return rows.drop(found)


def items_digest(items) -> F.Column:
    """sha256 of the item ids, sorted as strings and joined by commas."""
    return F.sha2(F.concat_ws(",", F.array_sort(F.transform(items, lambda x: x.cast("string")))), 256)


def brute_force(docs, items, n=WORDS):
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of plain rows, for tests."""
    windows = _windows(items, n)
    out = []
    for doc_id, text in docs:
        words = B.WORD.findall(B.lower(text or ""))
        hit, held = set(), set()
        for length in {len(w) for w in windows}:
            for at in range(len(words) - length + 1):
                holders = windows.get(tuple(words[at : at + length]))
                if holders:
                    hit.update(range(at, at + length))
                    held |= holders
        digest = hashlib.sha256(",".join(sorted(map(str, held))).encode()).hexdigest()
        dirty = len(hit) > 0 and SHARE * len(hit) >= len(words)
        out.append((doc_id, len(words), len(hit), len(held), digest, dirty))
    return out
