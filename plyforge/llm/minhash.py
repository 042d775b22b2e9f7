"""Near-duplicate documents by SetSketch registers, banding, joint likelihood and exact checks.

A document's set is its distinct shingles of `SHINGLE` words. Register i of a set holds the smallest
of its elements' i-th hashes on an exponential scale, cut to whole steps of base BASE; registers of a
union are the larger of each pair, and equal registers are the likelier the more alike two sets are.

1. One narrow pass gives each document its set's size, digest and band keys.
2. Documents with equal sets are one class, compared once.
3. Classes that share a band key hang together in a candidate cluster (stars to the smallest id, so a
   bucket of any size gives one edge per member).
4. Clusters are cut into units by size of the set, and large units into blocks. Inside a unit the
   likelihood of both sketches given the two sizes estimates each pair; pairs that can reach the
   threshold are checked on the full sets, the likeliest first, unless they hang together already.
5. Checked links give components.

No pairs are listed: a unit's rows are its members, once per block pair.

Defined cases: a null or empty text has an empty set, links with nothing and is its own component;
rows without an id link with nothing and have no component; texts shorter than a shingle are one
element; repeated rows are equal documents; an empty table gives no rows; other columns are left out
by `near_duplicates` and kept by `deduplicate`; long texts are read whole.
"""

import hashlib
from math import ceil, log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plyforge.llm import batches as B
from plyforge.llm.graph import components
from plyforge.session import written

SHINGLE = 5
PERCENT = 80
BANDS, ROWS = 32, 6
REGISTERS = BANDS * ROWS
BASE = 1.02
DEVIATIONS = 4
BLOCK_ROWS = 512
BLOCK_WORDS = 400_000

_draw = np.random.default_rng(7)
_FLIPS = _draw.integers(0, 1 << 32, REGISTERS, dtype=np.uint32)
_FACTORS = _draw.integers(0, 1 << 31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def shingle_sets(column, n=SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    words, bounds = B.word_hashes(column, B.SOLID_BYTES)
    size = max(len(words) - n + 1, 0)
    rolled = np.zeros(size, np.uint64)
    for k in range(n):
        rolled *= B.FACTOR
        rolled += words[k : k + size]
    rolled = B.mixed(rolled)
    out = []
    for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if end - start >= n:
            out.append(np.unique(rolled[start : end - n + 1]))
        elif end > start:
            total = np.uint64(end - start)
            for word in words[start:end]:
                total = np.uint64((int(total) * int(B.FACTOR) + int(word)) & (2**64 - 1))
            out.append(B.mixed(np.array([total], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """(set, register): whole steps of base BASE down to the smallest hash; sets are not empty."""
    sizes = np.array([len(own) for own in sets])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    short = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    least = np.empty((REGISTERS, len(sets)), np.uint32)
    for i in range(REGISTERS):
        least[i] = np.minimum.reduceat((short ^ _FLIPS[i]) * _FACTORS[i], starts)
    exponential = -np.log1p(-(least.T.astype(np.float64) + 0.5) / 2.0**32)
    return np.floor(1 - np.log(exponential) / log(BASE) + 200).astype(np.uint16)


def band_keys(found: np.ndarray) -> np.ndarray:
    """(set, band): a hash of the band's registers, apart by band."""
    keys = np.zeros((len(found), BANDS), np.uint64)
    parts = found.reshape(len(found), BANDS, ROWS).astype(np.uint64)
    for row in range(ROWS):
        keys = keys * B.FACTOR + parts[:, :, row]
    return B.mixed(keys * np.uint64(BANDS) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def _p(x):
    return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / log(BASE)


def likely(more, less, same, n1, n2, grid=64) -> np.ndarray:
    """The similarity at which counts of larger, smaller and equal registers are likeliest.

    Both set sizes are known, so the only unknown is the similarity, which ends at min / max.
    """
    u, v = n1 / (n1 + n2), n2 / (n1 + n2)
    top = np.minimum(n1, n2) / np.maximum(n1, n2)
    best, at = np.full(len(more), -np.inf), np.zeros(len(more))
    for step in range(grid + 1):
        j = top * (step / grid)
        a, b = _p(u - v * j), _p(v - u * j)
        tiny = 1e-9
        value = (
            more * np.log(a + tiny) + less * np.log(b + tiny) + same * np.log(1 - a - b + tiny)
        )
        better = value > best
        best[better], at[better] = value[better], j[better]
    return at


_SKETCH = "doc_id long, text_key long, n_shingles long, k1 long, k2 long, bands array<long>"


def _sketched(batches, n):
    for batch in B.slices(batches, "text"):
        sets = shingle_sets(batch.column("text"), n)
        sizes = np.array([len(own) for own in sets])
        full = np.flatnonzero(sizes)
        keys = np.zeros((len(sets), BANDS), np.int64)
        for start in range(0, len(full), 2048):
            part = full[start : start + 2048]
            keys[part] = band_keys(registers([sets[i] for i in part]))
        digests = np.array(
            [np.frombuffer(hashlib.md5(own.tobytes()).digest(), np.int64) for own in sets]
        ).reshape(-1, 2)
        offsets = np.concatenate([[0], np.cumsum(np.where(sizes > 0, BANDS, 0))]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("text_key"),
                pa.array(sizes, pa.int64()),
                pa.array(digests[:, 0]),
                pa.array(digests[:, 1]),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[full].ravel())),
            ],
            ["doc_id", "text_key", "n_shingles", "k1", "k2", "bands"],
        )


_UNIT = ["cluster", "band", "x", "y"]


def _units(batches):
    """Rows of each unit task, from batches sorted by unit."""
    held, key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(name).to_numpy() for name in _UNIT], 1)
        starts = np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1
        for a, b in zip([0, *starts.tolist()], [*starts.tolist(), batch.num_rows]):
            own = tuple(keys[a].tolist())
            if own != key and held:
                yield key, pa.Table.from_batches(held)
                held = []
            key = own
            held.append(batch.slice(a, b - a))
    if held:
        yield key, pa.Table.from_batches(held)


def _candidates(found, sizes, left, right, inner, percent):
    """Pairs whose registers do not rule out the threshold, the likeliest first."""
    least = percent / 100
    least -= DEVIATIONS * sqrt(least * (1 - least) / REGISTERS)
    out_i, out_j, out_s = [], [], []
    for place, i in enumerate(left.tolist()):
        others = right[place + 1 :] if inner else right
        low, high = np.minimum(sizes[others], sizes[i]), np.maximum(sizes[others], sizes[i])
        others = others[100 * low >= percent * high]
        if not len(others):
            continue
        same = (found[others] == found[i]).sum(1)
        near = same >= least * REGISTERS
        if not near.any():
            continue
        others, same = others[near], same[near]
        more = (found[i] > found[others]).sum(1)
        guess = likely(more, REGISTERS - more - same, same, float(sizes[i]), sizes[others])
        near = guess >= least
        out_i.append(np.full(int(near.sum()), i))
        out_j.append(others[near])
        out_s.append(guess[near])
    if not out_i:
        return []
    i, j, s = np.concatenate(out_i), np.concatenate(out_j), np.concatenate(out_s)
    order = np.lexsort((j, i, -s))
    return zip(i[order].tolist(), j[order].tolist())


def _alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the threshold."""
    if len(a) < len(b):
        a, b = b, a
    common = int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def _linked(batches, n, percent):
    """Links checked on the full sets, as many as hold each unit's groups together."""
    for (_, band, x, y), rows in _units(batches):
        if rows.num_rows < 2:
            continue
        ids, block = rows.column("rep").to_numpy(), rows.column("block").to_numpy()
        own = rows.column("size_band").to_numpy() == band
        left = np.flatnonzero(block == x)
        right = left if x == y else np.flatnonzero(block == y)
        if not own.any() or not len(left) or not len(right):
            continue
        sets = []
        for batch in B.slices(rows.select(["text"]).to_batches(), "text"):
            sets += shingle_sets(batch.column("text"), n)
        sizes = np.array([len(s) for s in sets], np.float64)
        found = registers(sets)
        root = list(range(len(ids)))

        def top(i):
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        links = []
        for i, j in _candidates(found, sizes, left, right, x == y, percent):
            if not (own[i] or own[j]):
                continue  # both belong to the next unit
            a, b = top(i), top(j)
            if a != b and _alike(sets[i], sets[j], percent):
                root[a] = b
                links.append((i, j))
        if links:
            pairs = np.array(links)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[pairs[:, 0]]), pa.array(ids[pairs[:, 1]])], ["a", "b"]
            )


def near_duplicates(
    docs: DataFrame, *, doc_id="doc_id", text="text", n=SHINGLE, percent=PERCENT,
    block_rows=BLOCK_ROWS, block_words=BLOCK_WORDS,
) -> DataFrame:
    """doc_id, text_key (a hash), n_shingles, component_id and kept of every row of `docs`."""
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    keyed_text = narrow.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    sketch = written(keyed_text.mapInArrow(lambda batches: _sketched(batches, n), _SKETCH), "sketch")
    keyed = sketch.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = written(
        keyed.groupBy("k1", "k2").agg(
            F.min("doc_id").alias("rep"),
            F.max_by("bands", -F.col("doc_id")).alias("bands"),
            F.first("n_shingles").alias("size"),
        ),
        "classes",
    )
    spots = classes.select("rep", F.explode("bands").alias("key"))
    buckets = spots.groupBy("key").agg(F.min("rep").alias("least"), F.max("rep").alias("most"))
    stars = spots.join(buckets.where("least != most").drop("most"), "key").where("rep != least")
    clusters = components(stars.select("rep", "least").distinct(), "rep", "least")

    step = log(100 / percent) if percent < 100 else 1e-9
    members = (
        classes.select("rep", "size")
        .join(clusters, F.col("rep") == F.col("node"))
        .select(
            "rep",
            "size",
            F.col("component").alias("cluster"),
            F.floor(F.log(F.col("size").cast("double")) / F.lit(step) + F.lit(1e-9)).alias("size_band"),
        )
    )
    placed = written(
        members.select("*", F.explode(F.array("size_band", F.col("size_band") - 1)).alias("band")),
        "members",
    )
    units = placed.groupBy("cluster", "band").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("size").alias("words"),
        F.max((F.col("size_band") == F.col("band")).cast("int")).alias("own"),
    )
    units = units.where("rows > 1 AND own = 1").select(
        "cluster",
        "band",
        F.greatest(
            F.ceil(F.col("rows") / block_rows), F.ceil(F.col("words") / block_words)
        ).cast("int").alias("blocks"),
    )
    tasks = (
        placed.join(units, ["cluster", "band"])
        .withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "rep",
            "size_band",
            F.col("block").cast("long"),
            "cluster",
            "band",
            F.least("block", "other").cast("long").alias("x"),
            F.greatest("block", "other").cast("long").alias("y"),
        )
    )
    once = narrow.where("doc_id IS NOT NULL").withColumnRenamed("doc_id", "rep")
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laden = tasks.hint("merge").join(once, "rep").repartition(partitions, *_UNIT).sortWithinPartitions(*_UNIT, "rep")
    links = written(
        laden.mapInArrow(lambda batches: _linked(batches, n, percent), "a long, b long"), "links"
    )
    groups = components(links)
    found = classes.join(groups, F.col("rep") == F.col("node"), "left").select(
        "k1", "k2", F.coalesce("component", "rep").alias("component_id"), F.lit(True).alias("full")
    )
    rows = sketch.withColumn("full", F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    component = F.coalesce("component_id", "doc_id")
    return rows.join(found, ["k1", "k2", "full"], "left").select(
        "doc_id",
        "text_key",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def deduplicate(
    docs: DataFrame, *, doc_id="doc_id", text="text", n=SHINGLE, percent=PERCENT
) -> DataFrame:
    """`docs` with one document of each group: the smallest id. Repeated rows of it all stay."""
    found = near_duplicates(docs, doc_id=doc_id, text=text, n=n, percent=percent)
    gone = found.where("NOT kept").select(F.col("doc_id").alias("_id"), "text_key").distinct()
    same = (F.col(f"d.`{doc_id}`").cast("long") == F.col("g._id")) & (
        F.xxhash64(F.col(f"d.`{text}`").cast("string")) == F.col("g.text_key")
    )
    return docs.alias("d").join(gone.hint("merge").alias("g"), same, "left_anti")
