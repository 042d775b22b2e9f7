"""Toxicity scores: FTRL-proximal logistic regression over hashed n-grams and skip-grams.

Features of a text are its distinct words and heads of words, word pairs and pairs with one word
between, hashed to 2**BITS places. Training reads a bounded sample of labelled rows; L1 leaves few weights, which are
broadcast. Scoring is one narrow pass.

Defined cases: a null or empty text has no features and scores by the bias; rows with null id or
label do not train, and are scored like all others; of several labels of one id the largest counts;
without any labels of both kinds every score is the share of positive labels, or 0; other columns
are left out by `score` and kept by `reject`.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plyforge.llm import batches as B

BITS = 20
HEADS = (4, 5, 6)  # bytes of a word that count as words of their own
SAMPLE_ROWS = 8_000  # labelled rows that train, at most about so many
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.3, 1.0, 6.0, 1.0
THRESHOLD = 0.3


def features(column) -> tuple[np.ndarray, np.ndarray]:
    """Hashed feature places of all rows in order, and the row of each."""
    words, bounds, heads = B.word_hashes(column, heads=HEADS)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    places, rows = [words, *heads], [row] * (1 + len(heads))
    for gap, factor in ((1, B.MIX_1), (2, B.MIX_2)):
        together = row[gap:] == row[:-gap]
        pair = B.mixed(words[:-gap] * factor + words[gap:])
        places.append(pair[together])
        rows.append(row[gap:][together])
    shift = np.uint64(64 - BITS)
    return (np.concatenate(places) >> shift).astype(np.int64), np.concatenate(rows)


def fitted(texts: pa.Array, labels: np.ndarray, epochs=EPOCHS) -> tuple[np.ndarray, np.ndarray, float]:
    """Places and values of the weights that are not 0, and the bias."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    share = min(max(labels.mean() if len(labels) else 0.0, 1e-6), 1 - 1e-6)
    bias = float(np.log(share / (1 - share)))
    if len(labels) == 0 or labels.min() == labels.max():
        return np.zeros(0, np.int64), np.zeros(0), bias
    rows = []
    for start in range(0, len(texts), 256):
        place, row = features(texts.slice(start, 256))
        keys = np.unique(row << BITS | place)
        cut = np.searchsorted(keys, np.arange(1, min(256, len(texts) - start)) << BITS)
        rows += np.split((keys & ((1 << BITS) - 1)).astype(np.int32), cut)
    bias_n = 0.0
    for _ in range(epochs):
        for place, label in zip(rows, labels.tolist()):
            own_z, own_n = z[place], n[place]
            weight = np.where(
                np.abs(own_z) <= L1,
                0.0,
                -(own_z - np.sign(own_z) * L1) / ((BETA + np.sqrt(own_n)) / ALPHA + L2),
            )
            margin = min(max(weight.sum() + bias, -35.0), 35.0)
            gradient = 1 / (1 + np.exp(-margin)) - label
            square = gradient * gradient
            step = (np.sqrt(own_n + square) - np.sqrt(own_n)) / ALPHA
            z[place] = own_z + gradient - step * weight
            n[place] = own_n + square
            bias_n += square
            bias -= ALPHA / (BETA + np.sqrt(bias_n)) * gradient
    weight = np.where(
        np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
    )
    place = np.flatnonzero(weight)
    return place, weight[place], bias


def scores(column, dense: np.ndarray, bias: float) -> np.ndarray:
    place, row = features(column)
    counts = dense[place] != 0
    keys = np.unique(row[counts] << BITS | place[counts])
    margin = np.bincount(
        keys >> BITS, weights=dense[keys & ((1 << BITS) - 1)], minlength=len(column)
    )
    return 1 / (1 + np.exp(-np.clip(margin[: len(column)] + bias, -35.0, 35.0)))


def training_rows(docs, labels, *, doc_id, text, label, keep, sample_rows) -> DataFrame:
    """A sample of labelled rows by hash of the id, of about `sample_rows` rows at most."""
    own = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_label"))
    own = own.where("_id IS NOT NULL AND _label IS NOT NULL")
    own = own.groupBy("_id").agg(F.max("_label").alias("_label"))
    if keep is not None:
        own = own.where(keep(F.col("_id")))
    rows = own.count()
    order = F.pmod(F.xxhash64("_id"), F.lit(1 << 30))
    if rows > sample_rows:
        own = own.where(order < int((1 << 30) * sample_rows / rows))
    texts = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).dropna(subset=["_id"])
    sampled = texts.join(F.broadcast(own), "_id")  # at most about sample_rows short rows
    return sampled.select("_text", "_label", order.alias("_order"), "_id")


def train(
    docs: DataFrame, labels: DataFrame, *, doc_id="doc_id", text="text", label="toxic", keep=None,
    sample_rows=SAMPLE_ROWS,
) -> tuple[np.ndarray, np.ndarray, float]:
    """Fit on a bounded sample of labelled rows for which `keep(id column)` holds.

    FTRL reads its rows one after the other, so the bounded sample is fitted in one task; only
    weights other than 0, at most 2**BITS, come to the driver.
    """
    sample = training_rows(
        docs, labels, doc_id=doc_id, text=text, label=label, keep=keep, sample_rows=sample_rows
    )

    def fit(batches):
        got = [batch for batch in batches if batch.num_rows]
        if not got:
            return
        rows = pa.Table.from_batches(got).combine_chunks()
        texts = rows.column("_text").cast(pa.large_string()).combine_chunks()
        texts = texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts
        place, value, bias = fitted(texts, rows.column("_label").to_numpy())
        yield pa.RecordBatch.from_pydict(
            {"place": pa.array([-1, *place.tolist()], pa.int64()), "value": [bias, *value.tolist()]}
        )

    ordered = sample.repartition(1).sortWithinPartitions("_order", "_id", "_label", "_text")
    weights = ordered.mapInArrow(fit, "place long, value double").collect()
    bias = next((row["value"] for row in weights if row["place"] < 0), -35.0)
    kept = [row for row in weights if row["place"] >= 0]
    place = np.array([row["place"] for row in kept], np.int64)
    return place, np.array([row["value"] for row in kept], np.float64), bias


def score_column(rows: DataFrame, model, text="text", out="score") -> DataFrame:
    """All rows with the score of their whole text in `out`, which replaces a column of that name."""
    place, value, bias = model
    shared = rows.sparkSession.sparkContext.broadcast(model)
    rows = rows.withColumn(out, F.lit(0.0))

    def work(batches):
        place, value, bias = shared.value
        dense = np.zeros(1 << BITS)
        dense[place] = value
        for batch in B.slices(batches, text):
            at = batch.schema.get_field_index(out)
            found = scores(batch.column(text), dense, bias)
            yield batch.set_column(at, batch.schema.field(at), pa.array(found, pa.float64()))

    return rows.mapInArrow(work, rows.schema)


def score(
    docs: DataFrame, labels: DataFrame, *, doc_id="doc_id", text="text", label="toxic", keep=None,
    threshold=THRESHOLD, sample_rows=SAMPLE_ROWS,
) -> DataFrame:
    """doc_id, score and predicted of every row of `docs`."""
    model = train(
        docs, labels, doc_id=doc_id, text=text, label=label, keep=keep, sample_rows=sample_rows
    )
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return score_column(narrow, model).select(
        "doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def reject(
    docs: DataFrame, labels: DataFrame, *, doc_id="doc_id", text="text", label="toxic", keep=None,
    threshold=THRESHOLD, sample_rows=SAMPLE_ROWS,
) -> DataFrame:
    """`docs` without the rows whose score reaches `threshold`."""
    model = train(
        docs, labels, doc_id=doc_id, text=text, label=label, keep=keep, sample_rows=sample_rows
    )
    out = "_score"
    while out in docs.columns:
        out += "_"
    scored = score_column(docs, model, text, out)
    return scored.where(F.col(out) < threshold).drop(out)


def held_out(doc_id) -> F.Column:
    """The fold that never trains."""
    return F.crc32(doc_id.cast("string")) % 4 == 2
