"""Suffix-array dedup: bytes covered by strings of LENGTH bytes that also start in an earlier document.

The suffix array is built blockwise. A cover sample of the positions is sorted first, and the order of
all other suffixes follows from the sample's ranks, one bucket at a time:

* The cover is chosen by content: of the PART-byte strings inside each LENGTH-byte string, the leftmost
  with the smallest hash. Equal strings therefore have their sample at the same place in any document,
  which residues of positions (the usual difference cover) would give only for pairs of positions.
* First only the sample is looked at, as sorted 64-bit keys per block of text. A suffix whose sample
  occurs in no other document has no long tie, and takes no further part.
* The rest goes to the bucket of its sample: runs of suffixes with one sample travel as one short string.
  A bucket ranks its sample suffixes once, and then orders the suffixes 1, 2, ... bytes before the
  sample by (byte, rank), each step from the last. Neighbours with LENGTH equal bytes are one class.

A block gives each bucket a string once, with its smallest document, so a passage that very many
documents hold arrives once per block of text. Documents with equal texts are one document here.

Defined cases: null is the empty text; texts shorter than LENGTH lose nothing; rows without an id lose
nothing and nothing is removed because of them; rows with one id never remove bytes of each other;
repeated rows come back as often; an empty table gives no rows; other columns are left out by
`repeated_bytes` and kept by `deduplicate`; long texts are worked through in blocks.
"""

import gc
import hashlib
from math import ceil

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plyforge.llm import batches as B
from plyforge.session import written

LENGTH = 50
PART = 20
WINDOW = LENGTH - PART + 1  # samples a string can have
COLUMNS = LENGTH + WINDOW - 1  # bytes that strings with one sample can cover
CHUNK_BYTES = 1 << 20
BLOCK_BYTES = 1 << 18
BUCKET_BYTES = 8 << 20  # text per bucket

_C1, _C2, _C3 = B.FACTOR, B.MIX_1, B.MIX_2


def _hashes(part: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the PART bytes at each position."""
    n = len(part)
    padded = np.concatenate([part, np.zeros(16, np.uint8)])
    eight = np.empty(n, np.uint64)
    for shift in range(8):
        count = len(range(shift, n, 8))
        eight[shift::8] = padded[shift : shift + 8 * count].view("<u8")
    size = n - PART + 1
    out = eight[:size] * _C1
    out ^= out >> np.uint64(29)
    out += eight[8 : 8 + size]
    out *= _C2
    out ^= out >> np.uint64(32)
    out += eight[PART - 8 : PART - 8 + size]
    out *= _C3
    out ^= out >> np.uint64(29)
    return out


def _sliding(values: np.ndarray, choose) -> np.ndarray:
    """The chosen value of each WINDOW neighbours."""
    width = 1
    while 2 * width <= WINDOW:
        values = choose(values[:-width], values[width:])
        width *= 2
    rest = WINDOW - width
    return choose(values[:-rest], values[rest:]) if rest else values


def _jump(values: np.ndarray, start: np.ndarray, passes) -> np.ndarray:
    """Follow neighbours while `passes(value there, own value)`; both ends stop a search."""
    at, left = start, np.arange(len(values))
    while True:
        there = at[left]
        left = left[passes(values[there], values[left]) & (there > 0) & (there < len(values) - 1)]
        if not len(left):
            return at
        at[left] = at[at[left]]


def samples(data: np.ndarray, bounds: np.ndarray):
    """Blocks of (place, first, last, key): a sample and the first and last string that it covers.

    Places count bytes of `data`; strings that would cross the rows' bounds are left out.
    """
    for start in range(0, len(data), BLOCK_BYTES):
        part = data[start : start + BLOCK_BYTES + LENGTH - 1]
        if len(part) < LENGTH:
            return
        key = _hashes(part)
        least = _sliding(key, np.minimum)
        edge = np.zeros(WINDOW - 1, np.uint64)
        most = _sliding(np.concatenate([edge, least, edge]), np.maximum)
        place = np.flatnonzero(key == most)
        own = np.concatenate([[np.uint64(0)], key[place], [np.uint64(0)]])
        number = np.arange(len(own))
        before = _jump(own, np.maximum(number - 1, 0), lambda there, mine: there > mine)
        after = _jump(own, np.minimum(number + 1, len(own) - 1), lambda there, mine: there >= mine)
        spots = np.concatenate([[-1], place, [len(part)]])
        first = np.maximum(place - WINDOW + 1, spots[before[1:-1]] + 1)
        last = np.minimum(place, spots[after[1:-1]] - WINDOW)
        row = np.searchsorted(bounds, place + start, "right") - 1
        first = np.maximum(first + start, bounds[row])
        last = np.minimum(np.minimum(last, len(least) - 1) + start, bounds[row + 1] - LENGTH)
        keep = first <= last
        # Chosen hashes are small ones; mixed again, they are even over the buckets.
        yield place[keep] + start, first[keep], last[keep], B.mixed(key[place[keep]])


def _all_samples(data, bounds):
    found = [x for x in samples(data, bounds) if len(x[0])]
    if not found:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    return tuple(np.concatenate(x) for x in zip(*found))


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


CHUNKS = "chunk long, ids array<long>, digests array<string>, bounds array<long>, data binary"


def _chunked(batches):
    """Texts as compressed chunks with their ids and digests; the chunk's number holds the task's."""
    number = TaskContext.get().partitionId() << 32
    pack = zstandard.ZstdCompressor(3).compress
    for batch in B.slices(batches, "text", CHUNK_BYTES):
        data, bounds = B.raw(batch.column("text"))
        whole = data.tobytes()
        edges = bounds.tolist()
        digests = [hashlib.md5(whole[a:b]).hexdigest() for a, b in zip(edges[:-1], edges[1:])]
        yield pa.RecordBatch.from_pydict(
            {
                "chunk": pa.array([number], pa.int64()),
                "ids": pa.array([batch.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                "digests": pa.array([digests], pa.list_(pa.string())),
                "bounds": pa.array([edges], pa.list_(pa.int64())),
                "data": pa.array([pack(whole)], pa.binary()),
            }
        )
        number += 1


def chunked(docs: DataFrame, least: int) -> DataFrame:
    """Written chunks of the rows of doc_id and text with an id and at least `least` bytes."""
    rows = docs.where(f"doc_id IS NOT NULL AND octet_length(text) >= {least}")
    return written(rows.mapInArrow(_chunked, CHUNKS), "chunks")


def representatives(chunks: DataFrame) -> DataFrame:
    """The smallest document of each text, by digest."""
    rows = chunks.select(F.explode(F.arrays_zip("ids", "digests")).alias("x"))
    return rows.groupBy(F.col("x.digests").alias("digest")).agg(F.min("x.ids").alias("rep"))


def copies_in(chunks: DataFrame, reps: DataFrame) -> DataFrame:
    """Per chunk the rows whose text an earlier document has as a whole."""
    rows = chunks.select("chunk", F.posexplode(F.arrays_zip("ids", "digests")).alias("at", "x"))
    rows = rows.select("chunk", "at", "x.ids", F.col("x.digests").alias("digest")).join(reps, "digest")
    return rows.where("ids > rep").groupBy("chunk").agg(F.collect_list("at").alias("copies"))


def with_repeated(chunks: DataFrame, repeated: DataFrame, copies: DataFrame) -> DataFrame:
    """Chunks with their repeated keys and the rows to leave out; one shuffle of compressed chunks."""
    keys = repeated.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "keys")).alias("keys"))
    joined = chunks.hint("merge").join(keys, "chunk")
    return joined.join(copies.hint("merge"), "chunk", "left")


def _opened(batch, row):
    data = zstandard.ZstdDecompressor().decompress(batch.column("data")[row].as_py())
    bounds = np.array(batch.column("bounds")[row].as_py(), np.int64)
    ids = np.array(batch.column("ids")[row].as_py(), np.int64)
    return np.frombuffer(data, np.uint8), bounds, ids


def key_rows(key, doc, chunk, buckets) -> pa.RecordBatch:
    """A chunk's distinct keys by bucket, cut to 32 bits, and which of them several documents have.

    Two keys with equal bits only let a unique sample pass to the next step.
    """
    code = _code(key, buckets)
    order = np.argsort(code, kind="stable")
    code, doc = code[order], doc[order]
    start = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))[: len(code)]
    several = np.zeros(0, bool)
    if len(code):
        several = np.minimum.reduceat(doc, start) != np.maximum.reduceat(doc, start)
    code = code[start]
    edges = np.arange(buckets + 1, dtype=np.uint64) << np.uint64(32)
    cut = np.searchsorted(code, edges).tolist()
    used = [b for b in range(buckets) if cut[b] < cut[b + 1]]
    short = code.astype(np.uint32)
    return pa.RecordBatch.from_pydict(
        {
            "bucket": pa.array(used, pa.int64()),
            "chunk": pa.array([chunk] * len(used), pa.int64()),
            "keys": pa.array([short[cut[b] : cut[b + 1]].tobytes() for b in used], pa.binary()),
            "several": pa.array(
                [np.packbits(several[cut[b] : cut[b + 1]]).tobytes() for b in used], pa.binary()
            ),
        }
    )


def _code(keys: np.ndarray, buckets: int) -> np.ndarray:
    """A key's bucket and its lower half."""
    return _bucket(keys, buckets) << np.uint64(32) | keys & np.uint64(0xFFFFFFFF)


def wanted(keys: np.ndarray, replies: list, buckets: int) -> np.ndarray:
    """Which keys are among a chunk's repeated ones."""
    codes = [
        np.frombuffer(x["keys"], np.uint32).astype(np.uint64) | np.uint64(x["bucket"] << 32)
        for x in replies
    ]
    codes = np.sort(np.concatenate(codes))
    code = _code(keys, buckets)
    return codes[np.minimum(np.searchsorted(codes, code), len(codes) - 1)] == code


def _keys(batches, buckets):
    """Per chunk and bucket the sorted sample keys, and which of them several documents have."""
    for batch in batches:
        for row in range(batch.num_rows):
            data, bounds, ids = _opened(batch, row)
            place, _, _, key = _all_samples(data, bounds)
            doc = ids[np.searchsorted(bounds, place, "right") - 1]
            yield key_rows(key, doc, batch.column("chunk")[row].as_py(), buckets)


def release(spark) -> None:
    """Let the driver drop its references to finished steps, so that their shuffle files go."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _groups(batches, name):
    """Rows with equal values of a sorted column."""
    held, key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(name).to_numpy()
        starts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        for a, b in zip([0, *starts.tolist()], [*starts.tolist(), batch.num_rows]):
            if keys[a] != key and held:
                yield pa.Table.from_batches(held)
                held = []
            key = keys[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _repeated(batches):
    """Per chunk and bucket the keys that several documents have, from rows sorted by bucket."""
    for rows in _groups(batches, "bucket"):
        blobs = rows.column("keys").to_pylist()
        sizes = np.array([len(blob) // 4 for blob in blobs])
        key = np.frombuffer(b"".join(blobs), np.uint32)
        several = [
            np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)
            for bits, n in zip(rows.column("several").to_pylist(), sizes.tolist())
        ]
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        equal = ordered[1:] == ordered[:-1]
        hit = np.zeros(len(key), bool)
        hit[order[1:][equal]] = True
        hit[order[:-1][equal]] = True
        hit |= np.concatenate(several)
        ends = np.cumsum(sizes)
        found = [key[e - n : e][hit[e - n : e]].tobytes() for e, n in zip(ends, sizes)]
        batch = pa.RecordBatch.from_arrays(
            [
                rows.column("chunk").combine_chunks(),
                rows.column("bucket").combine_chunks(),
                pa.array(found, pa.binary()),
            ],
            ["chunk", "bucket", "keys"],
        )
        yield batch.filter(pa.array([bool(x) for x in found]))


REPEATED = "chunk long, bucket long, keys binary"


_STRINGS = "chunk long, bucket long, strings binary, docs binary"
#: A string of the array: bytes around its sample (the sample starts at WINDOW - 1), how many bytes
#: before the sample belong to it, and how many strings of LENGTH bytes start in it.
_ROW = np.dtype([("text", np.uint8, COLUMNS), ("left", np.uint8), ("count", np.uint8)])


class _Strings:
    """The strings of a chunk whose samples repeat: once each by bucket, and where they occur."""

    def __init__(self, batch, at, buckets):
        self.data, self.bounds, self.ids = _opened(batch, at)
        place, first, last, key = _all_samples(self.data, self.bounds)
        row = np.searchsorted(self.bounds, place, "right") - 1
        keep = wanted(key, batch.column("keys")[at].as_py(), buckets)
        keep &= ~np.isin(row, batch.column("copies")[at].as_py() or [])
        place, first, last, key = place[keep], first[keep], last[keep], key[keep]
        self.row, self.first, self.count = row[keep], first, last - first + 1
        rows = np.zeros(len(place), _ROW)
        column = np.arange(COLUMNS) - (WINDOW - 1)
        for start in range(0, len(place), 1 << 13):
            part = slice(start, start + (1 << 13))
            spots = place[part, None] + column
            inside = (spots >= first[part, None]) & (spots < last[part, None] + LENGTH)
            rows["text"][part] = np.where(inside, self.data[np.where(inside, spots, 0)], 0)
        rows["left"], rows["count"] = place - first, self.count
        bucket = _bucket(key, buckets)
        raw = rows.view(f"V{_ROW.itemsize}").ravel()
        distinct, self.string = _unique(raw, bucket)
        self.distinct, self.bucket = raw[distinct], bucket[distinct]
        self.least = np.full(len(distinct), np.iinfo(np.int64).max)
        np.minimum.at(self.least, self.string, self.ids[self.row])


def _strings(batches, buckets):
    """Per chunk and bucket the strings and the smallest document of each."""
    pack = zstandard.ZstdCompressor(1).compress
    for batch in batches:
        for at in range(batch.num_rows):
            found = _Strings(batch, at, buckets)
            cut = np.searchsorted(found.bucket, np.arange(buckets + 1, dtype=np.uint64)).tolist()
            used = [b for b in range(buckets) if cut[b] < cut[b + 1]]
            chunk = batch.column("chunk")[at].as_py()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([chunk] * len(used), pa.int64()),
                    pa.array(used, pa.int64()),
                    pa.array([pack(found.distinct[cut[b] : cut[b + 1]].tobytes()) for b in used], pa.binary()),
                    pa.array([pack(found.least[cut[b] : cut[b + 1]].tobytes()) for b in used], pa.binary()),
                ],
                ["chunk", "bucket", "strings", "docs"],
            )


def _unique(raw, bucket):
    """Places of the distinct rows, by bucket and bytes, and the number of each row's."""
    order = np.argsort(raw, kind="stable")
    order = order[np.argsort(bucket[order], kind="stable")]
    ordered = raw[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    inverse = np.empty(len(raw), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return order[new], inverse


def classes(rows: np.ndarray, docs: np.ndarray):
    """For each distance between a start and the sample: rows, and the smallest documents there.

    The document is the smallest that holds the LENGTH bytes which start so far before the sample.
    One distance is one bucket of suffixes; its order follows from the last one's.
    """
    text, left, count = rows["text"], rows["left"].astype(int), rows["count"].astype(int)
    # Ranks of the sample suffixes: the cover that settles all long ties.
    tails = np.ascontiguousarray(text[:, WINDOW - 1 :]).view(f"V{COLUMNS - WINDOW + 1}").ravel()
    order = np.argsort(tails, kind="stable")
    ordered = tails[order]
    rank = np.empty(len(rows), np.int64)
    rank[order] = np.cumsum(np.concatenate([[False], ordered[1:] != ordered[:-1]]))
    live = np.arange(len(rows))
    for distance in range(WINDOW):
        if distance:
            live = live[left[live] >= distance]
            if not len(live):
                return
            byte = text[live, WINDOW - 1 - distance].astype(np.int64)
            mixed = byte * (int(rank.max()) + 1) + rank[live]
            order = np.argsort(mixed, kind="stable")
            ordered = mixed[order]
            rank[live[order]] = np.cumsum(np.concatenate([[False], ordered[1:] != ordered[:-1]]))
        # Strings that start here lie inside rows whose last start is not before it.
        own = live[left[live] - distance < count[live]]
        if not len(own):
            continue
        own = own[np.argsort(rank[own], kind="stable")]
        at = WINDOW - 1 - distance
        body = np.ascontiguousarray(text[own, at : at + LENGTH]).view(f"V{LENGTH}").ravel()
        new = np.concatenate([[True], body[1:] != body[:-1]])
        least = np.minimum.reduceat(docs[own], np.flatnonzero(new))
        yield distance, own, least[np.cumsum(new) - 1]


def _masks(batches):
    """Per chunk and string a bit for each start whose bytes an earlier document holds.

    Bit s is for start s of the string, which lies `left - s` bytes before its sample.
    """
    pack, unpack = zstandard.ZstdCompressor(1).compress, zstandard.ZstdDecompressor().decompress
    for rows in _groups(batches, "bucket"):
        blobs = [unpack(blob) for blob in rows.column("strings").to_pylist()]
        sizes = [len(blob) // _ROW.itemsize for blob in blobs]
        raw = np.frombuffer(b"".join(blobs), f"V{_ROW.itemsize}")
        docs = np.frombuffer(b"".join(unpack(x) for x in rows.column("docs").to_pylist()), np.int64)
        distinct, inverse = _unique(raw, np.zeros(len(raw), np.uint8))
        least = np.full(len(distinct), np.iinfo(np.int64).max)
        np.minimum.at(least, inverse, docs)
        found = raw[distinct].view(_ROW)
        left = found["left"].astype(np.int64)
        masks = np.zeros(len(raw), np.uint64)
        best = np.empty(len(found), np.int64)
        for distance, own, smallest in classes(found, least):
            best.fill(np.iinfo(np.int64).max)
            best[own] = smallest
            hit = np.flatnonzero(best[inverse] < docs)
            masks[hit] |= np.uint64(1) << (left[inverse[hit]] - distance).astype(np.uint64)
        ends = np.cumsum(sizes)
        yield pa.RecordBatch.from_arrays(
            [
                rows.column("chunk").combine_chunks(),
                rows.column("bucket").combine_chunks(),
                pa.array([pack(masks[e - n : e].tobytes()) for e, n in zip(ends, sizes)], pa.binary()),
            ],
            ["chunk", "bucket", "masks"],
        )


def _removed(batches, buckets):
    """Per document its removed byte runs and what is left, from a chunk and its strings' masks.

    The strings are worked out from the chunk again, in the same order, so they need not be kept.
    """
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for at in range(batch.num_rows):
            found = _Strings(batch, at, buckets)
            data, bounds, ids = found.data, found.bounds, found.ids
            replies = sorted(batch.column("replies")[at].as_py(), key=lambda x: x["bucket"])
            masks = np.frombuffer(b"".join(unpack(x["masks"]) for x in replies), np.uint64)
            mask, count, first = masks[found.string], found.count, found.first
            mask = np.where(ids[found.row] > found.least[found.string], ~np.uint64(0), mask)
            change = np.zeros(len(data) + 1, np.int64)  # covered bytes, as starts and ends of runs
            for s in range(WINDOW):
                hit = (s < count) & ((mask >> np.uint64(s)) & np.uint64(1)).astype(bool)
                np.add.at(change, first[hit] + s, 1)
                np.add.at(change, first[hit] + s + LENGTH, -1)
            covered = np.cumsum(change[:-1]) > 0
            digests = batch.column("digests")[at].as_py()
            out = {"rep": [], "digest": [], "starts": [], "ends": [], "sha256": [], "left": []}
            for r, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                own = covered[a:b]
                if not own.any():
                    continue
                edges = np.flatnonzero(np.diff(np.concatenate([[0], own.astype(np.int8), [0]])))
                out["rep"].append(int(ids[r]))
                out["digest"].append(digests[r])
                out["starts"].append(edges[::2].tolist())
                out["ends"].append(edges[1::2].tolist())
                kept = data[a:b][~own].tobytes()
                out["sha256"].append(hashlib.sha256(kept).hexdigest())
                out["left"].append(kept.decode(errors="ignore"))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(out["rep"], pa.int64()),
                    pa.array(out["digest"], pa.string()),
                    pa.array(out["starts"], pa.list_(pa.int64())),
                    pa.array(out["ends"], pa.list_(pa.int64())),
                    pa.array(out["sha256"], pa.string()),
                    pa.array(out["left"], pa.string()),
                ],
                ["rep", "digest", "starts", "ends", "left_sha256", "left_text"],
            )


def _digests(docs, doc_id, text):
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.md5(body.cast("binary")).alias("digest"),
        F.octet_length(body).cast("long").alias("n_bytes"),
        F.sha2(body.cast("binary"), 256).alias("sha256"),
    )


def repeated_bytes(
    docs: DataFrame, *, doc_id="doc_id", text="text", bucket_bytes=BUCKET_BYTES
) -> DataFrame:
    """Per row of `docs`: doc_id, digest, n_bytes, removed byte runs (starts, ends) and what is left.

    `kept_sha256` is that of the remaining bytes, `left_text` what is left without the bytes of
    characters that a cut went through; it is null where nothing is removed.
    """
    spark = docs.sparkSession
    rows = written(_digests(docs, doc_id, text), "digests")
    narrow = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")
    )
    chunks = chunked(narrow, LENGTH)
    reps = written(representatives(chunks), "reps")
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(1, ceil(total / bucket_bytes))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))

    keys = chunks.select("chunk", "ids", "bounds", "data").mapInArrow(
        lambda batches: _keys(batches, buckets), "bucket long, chunk long, keys binary, several binary"
    )
    repeated = (
        keys.repartition(partitions, "bucket")
        .sortWithinPartitions("bucket", "chunk")
        .mapInArrow(_repeated, REPEATED)
    )
    repeated, copies = written(repeated, "repeated"), written(copies_in(chunks, reps), "copies")
    release(spark)
    marked = with_repeated(chunks, repeated, copies)
    masks = (
        marked.mapInArrow(lambda batches: _strings(batches, buckets), _STRINGS)
        .repartition(partitions, "bucket")
        .sortWithinPartitions("bucket", "chunk")
        .mapInArrow(_masks, "chunk long, bucket long, masks binary")
    )
    masks = written(masks, "masks")
    del marked
    release(spark)
    replies = masks.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "masks")).alias("replies"))
    laden = with_repeated(chunks, repeated, copies).join(replies.hint("merge"), "chunk")
    found = laden.mapInArrow(
        lambda batches: _removed(batches, buckets),
        "rep long, digest string, starts array<long>, ends array<long>, left_sha256 string, left_text string",
    )
    # Rows are told apart by id and text; equal rows give one result each.
    found = found.dropDuplicates(["rep", "digest"])
    own = rows.join(reps, "digest", "left").withColumn(
        "copy", F.coalesce((F.col("doc_id") > F.col("rep")) & (F.col("n_bytes") >= LENGTH), F.lit(False))
    )
    found = found.withColumnRenamed("rep", "doc_id")
    whole, none = F.col("copy"), F.array().cast("array<long>")
    sha256 = F.when(whole, F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("left_sha256", "sha256"))
    return own.join(found, ["doc_id", "digest"], "left").select(
        "doc_id",
        "digest",
        "n_bytes",
        F.when(whole, F.array(F.lit(0).cast("long"))).otherwise(F.coalesce("starts", none)).alias("starts"),
        F.when(whole, F.array("n_bytes")).otherwise(F.coalesce("ends", none)).alias("ends"),
        sha256.alias("kept_sha256"),
        F.when(whole, F.lit("")).otherwise(F.col("left_text")).alias("left_text"),
    )


def summary(found: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row of `repeated_bytes`."""
    lengths = F.zip_with("starts", "ends", lambda a, b: b - a)
    return found.select(
        "doc_id",
        "n_bytes",
        F.aggregate(lengths, F.lit(0).cast("long"), lambda total, n: total + n).alias("n_removed"),
        F.size("starts").cast("long").alias("n_spans"),
        "kept_sha256",
    )


def deduplicate(docs: DataFrame, *, doc_id="doc_id", text="text") -> DataFrame:
    """`docs` with the repeated bytes cut out of their texts; all rows and columns stay."""
    found = repeated_bytes(docs, doc_id=doc_id, text=text).where("left_text IS NOT NULL")
    key, new = "_digest", "_left"
    while {key, new} & set(docs.columns):
        key, new = key + "_", new + "_"
    changed = found.select(
        F.col("doc_id").alias("_changed"), F.col("digest").alias(key), F.col("left_text").alias(new)
    ).dropDuplicates(["_changed", key])
    body = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    rows = docs.withColumn(key, F.md5(body)).alias("d")
    changed = changed.hint("merge").alias("c")
    same = (F.col(f"d.`{doc_id}`").cast("long") == F.col("c._changed")) & (
        F.col(f"d.`{key}`") == F.col(f"c.`{key}`")
    )
    joined = rows.join(changed, same, "left")
    columns = [
        F.coalesce(F.col(f"c.`{new}`"), F.col(f"d.`{name}`")).alias(name) if name == text else F.col(f"d.`{name}`")
        for name in docs.columns
    ]
    return joined.select(*columns)
