"""Near-duplicate vectors: cross-polytope hashes after fast Hadamard rotations, multiprobe buckets.

A vector's code in a table is the nearest signed axis after each of `parts` random rotations
(sign flips and Hadamard transforms, three times). Each table also probes the codes with the
closest other axis. Vectors that share a code in any table are compared by cosine in double
precision, so no link below the threshold is made; recall is measured in the tests.

Equal vectors are compared once, as a class. Buckets with more than BLOCK vectors are compared in
blocks, each pair of blocks a row group of its own. A pair that meets in several buckets counts in
the first of them, so links are counted without listing pairs.

Defined cases: vectors that are null, empty, zero or hold null or non-finite parts link with nothing,
and so do rows without an id; vectors of different lengths never link; repeated rows (same id and
vector) count once and come back once; an empty table gives no rows; other columns are left out.
"""

from functools import lru_cache
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plyforge.llm.graph import components
from plyforge.scale import lookup_join
from plyforge.session import written

COSINE = 0.95
TABLES = 12
PROBES = 2
SPARSE = 32  # codes per vector, at least: few vectors share a code by chance
BLOCK = 1024
SEED = 20240229


def hadamard(rows: np.ndarray) -> np.ndarray:
    """The Hadamard transform of each row; their length is a power of two."""
    n, step = rows.shape[1], 1
    while step < n:
        pairs = rows.reshape(len(rows), n // (2 * step), 2, step)
        rows = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2)
        rows = rows.reshape(-1, n)
        step *= 2
    return rows


@lru_cache(maxsize=4)
def _signs(tables: int, parts: int, size: int) -> np.ndarray:
    draw = np.random.default_rng(SEED)
    return draw.choice(np.array([-1.0, 1.0]), (tables, parts, 3, size))


def parts_for(n: int, size: int) -> int:
    """How many axes make a code, so that there are SPARSE codes per vector."""
    return max(1, ceil(log(max(SPARSE * n, 2)) / log(2 * size)))


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision."""
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def codes(rows: np.ndarray, parts: int, tables=TABLES, probes=PROBES) -> np.ndarray:
    """(row, table, code): the home code and the `probes` next ones of each table."""
    size = 1 << max(rows.shape[1] - 1, 1).bit_length()
    padded = np.zeros((len(rows), size))
    padded[:, : rows.shape[1]] = unit(rows)
    signs, at = _signs(tables, parts, size), np.arange(len(rows))
    out = np.empty((len(rows), tables, 1 + probes), np.int64)
    for table in range(tables):
        best, gaps, others = [], [], []
        for part in range(parts):
            turned = padded
            for flip in signs[table, part]:
                turned = hadamard(turned * flip)
            turned /= size**1.5
            strength = np.abs(turned)
            rank = np.argpartition(-strength, min(probes, size - 1), axis=1)[:, : probes + 1]
            rank = np.take_along_axis(
                rank, np.argsort(-np.take_along_axis(strength, rank, 1), axis=1, kind="stable"), 1
            )
            axis = 2 * rank + (np.take_along_axis(turned, rank, 1) < 0)
            force = np.take_along_axis(strength, rank, 1)
            best.append(axis[:, 0])
            others += [(part, axis[:, k]) for k in range(1, axis.shape[1])]
            gaps += [force[:, 0] - force[:, k] for k in range(1, axis.shape[1])]
        base = sum(axis * (2 * size) ** part for part, axis in enumerate(best))
        out[:, table, 0] = base
        shifted = np.stack(
            [base + (axis - best[part]) * (2 * size) ** part for part, axis in others], 1
        )
        nearest = np.argsort(np.stack(gaps, 1), axis=1, kind="stable")[:, :probes]
        for k in range(probes):
            out[:, table, 1 + k] = shifted[at, nearest[:, min(k, nearest.shape[1] - 1)]]
    return out


def _valid(vector):
    """Whether a vector has parts, all finite, and is not zero."""
    ok = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(
        (F.size(vector) > 0) & F.forall(vector, ok) & F.exists(vector, lambda x: x != 0), F.lit(False)
    )


def _matrix(column) -> np.ndarray:
    """A list column without nulls, whose rows have one length, as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _coded(batches, tables, probes):
    """Codes of vectors; the parts of a code follow from how many vectors have the same length."""
    for batch in batches:
        sizes = np.asarray(batch.column("vector").value_lengths())
        for size in np.unique(sizes).tolist():
            rows = batch.filter(pa.array(sizes == size))
            parts = parts_for(rows.column("of_size")[0].as_py(), 1 << max(size - 1, 1).bit_length())
            found = codes(_matrix(rows.column("vector")), parts, tables, probes)
            flat = found.reshape(len(found), -1)
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("rep"),
                    rows.column("n"),
                    rows.column("vector"),
                    pa.ListArray.from_arrays(
                        np.arange(0, flat.size + 1, flat.shape[1], dtype=np.int32), pa.array(flat.ravel())
                    ),
                ],
                ["rep", "n", "vector", "codes"],
            )


_GROUP = ["table", "size", "code", "x", "y"]


def _runs(batches):
    """Row groups with equal keys, from sorted batches."""
    held, key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(name).to_numpy() for name in _GROUP], 1)
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


def _compared(batches, tables, probes, cosine):
    """Per vector of each row group: links that count here, and the smallest vector linked to it."""
    for (table, _, code, x, y), rows in _runs(batches):
        ids = rows.column("rep").to_numpy()
        block = rows.column("block").to_numpy()
        left = np.flatnonzero(block == x)
        right = left if x == y else np.flatnonzero(block == y)
        if len(left) < 1 or len(right) < 1 or len(ids) < 2:
            continue
        units = unit(_matrix(rows.column("vector")))
        weight = rows.column("n").to_numpy()
        own = _matrix(rows.column("codes")).reshape(len(ids), tables, 1 + probes)
        i, j = np.nonzero(units[left] @ units[right].T >= cosine)
        i, j = left[i], right[j]
        once = ids[i] < ids[j] if x == y else ids[i] != ids[j]
        i, j = i[once], j[once]
        if not len(i):
            continue
        first = np.ones(len(i), bool)  # no common code in an earlier table, nor a smaller one here
        for t in range(table + 1):
            for a in range(1 + probes):
                for b in range(1 + probes):
                    same = own[i, t, a] == own[j, t, b]
                    first &= ~same if t < table else ~(same & (own[i, t, a] < code))
        counts = np.zeros(len(ids), np.int64)
        np.add.at(counts, i[first], weight[j[first]])
        np.add.at(counts, j[first], weight[i[first]])
        label = ids.copy()
        while True:  # the smallest vector that links lead to inside this row group
            before = label.copy()
            np.minimum.at(label, i, label[j])
            np.minimum.at(label, j, label[i])
            if (before == label).all():
                break
        keep = (counts > 0) | (label != ids)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[keep]), pa.array(counts[keep]), pa.array(label[keep])],
            ["rep", "links", "label"],
        )


def near_duplicates(
    vectors: DataFrame, *, vec_id="vec_id", vector="embedding", cosine=COSINE, tables=TABLES,
    probes=PROBES, block=BLOCK,
) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector."""
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("vector"))
    keys = F.xxhash64("vector").alias("k1"), F.xxhash64(F.lit(SEED), "vector").alias("k2")
    marked = rows.select(
        "vec_id", *keys, (_valid(F.col("vector")) & F.col("vec_id").isNotNull()).alias("valid")
    )
    known = written(marked.dropDuplicates(["vec_id", "k1", "k2"]), "vectors")
    classes = known.where("valid").groupBy("k1", "k2").agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n")
    )
    reps = (
        rows.where(_valid(F.col("vector")))
        .select(F.col("vec_id").alias("rep"), *keys, "vector")
        .join(classes, ["rep", "k1", "k2"])
        .dropDuplicates(["rep", "k1", "k2"])
    )
    lengths = classes.join(rows.select(*keys, F.size("vector").alias("size")).distinct(), ["k1", "k2"])
    lengths = lengths.groupBy("size").agg(F.count(F.lit(1)).alias("of_size"))
    kind = dict(rows.dtypes)["vector"]
    laden = lookup_join(reps.withColumn("size", F.size("vector")), lengths, "size")
    coded = laden.select("rep", "n", "vector", "of_size").mapInArrow(
        lambda batches: _coded(batches, tables, probes),
        f"rep long, n long, vector {kind}, codes array<long>",
    )
    coded = written(coded, "codes")
    spots = coded.select(
        "rep", F.size("vector").alias("size"), F.posexplode("codes").alias("at", "code")
    ).select(
        "rep", "size", F.floor(F.col("at") / (1 + probes)).cast("int").alias("table"), "code"
    ).distinct()
    spots = written(spots, "spots")
    buckets = spots.groupBy("table", "size", "code").agg(F.count(F.lit(1)).alias("members"))
    buckets = buckets.where("members > 1").withColumn("blocks", F.ceil(F.col("members") / block))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1))
    mine = F.pmod(F.xxhash64("rep", "table"), F.col("blocks")).cast("int")
    meeting = (
        spots.join(buckets, ["table", "size", "code"])
        .select("rep", "table", "size", "code", mine.alias("block"), other.alias("other"))
        .withColumn("x", F.least("block", "other"))
        .withColumn("y", F.greatest("block", "other"))
        .drop("other")
        .join(coded, "rep")
        .select("rep", "n", "vector", "codes", "block", *(F.col(c).cast("long") for c in _GROUP))
    )
    partitions = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grouped = meeting.repartition(partitions, *_GROUP).sortWithinPartitions(*_GROUP, "rep")
    compared = written(
        grouped.mapInArrow(
            lambda batches: _compared(batches, tables, probes, cosine),
            "rep long, links long, label long",
        ),
        "compared",
    )
    counts = compared.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = components(compared.where("rep != label"), "rep", "label")
    found = classes.join(counts, "rep", "left").join(
        groups.withColumnRenamed("node", "rep"), "rep", "left"
    ).select(
        "k1", "k2",
        (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        F.coalesce("component", "rep").alias("component_id"),
        F.lit(True).alias("valid"),
    )
    out = known.join(found, ["k1", "k2", "valid"], "left")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.coalesce("component_id", "vec_id") == F.col("vec_id"), F.lit(True)).alias("kept"),
    )
