"""Token stream offsets, training windows, padded batches, running bests."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plyforge.functions.scoring import loss_weights
from plyforge.scale import ROWS_PER_BUCKET, lookup_join, prefix_sum, row_index

# Fixed value: padding id (not the padding token's id).
PAD_ID = 0

STEPS_PER_CHUNK = 100_000


def token_offsets(games: DataFrame, order: str, ids="ids", rows_per_bucket=ROWS_PER_BUCKET) -> DataFrame:
    """Add `start`: the game's first position in the concatenated token stream."""
    return prefix_sum(games, order, F.size(ids), "start", rows_per_bucket)


def training_windows(stream: DataFrame, block: int, stride=1, turn_ids=()) -> DataFrame:
    """(start, x, y, w) from games (start, ids) of one gapless token stream.

    Window i holds tokens i…i+block−1 and, as targets, the tokens one further on. The windows that
    start in one block of the stream need its tokens and those after it up to the last target.
    Where one game holds all of these, its windows are cut on the spot. Only the other blocks, at
    most two for each game and those of games that are shorter, are put together by one shuffle on
    the block number. A group is at most two blocks long.
    """
    size, step = F.lit(block).cast("long"), F.lit(stride).cast("long")
    begin, end = F.col("start"), F.col("start") + F.size("ids")
    # The last window of block k, and the end of what its windows need; nothing if none starts there.
    final = lambda k: F.floor(((k + 1) * size - 1) / step).cast("long") * step
    stop = lambda k: F.when(final(k) >= k * size, final(k) + size + 1).otherwise(k * size)
    blocks = F.sequence(F.greatest(F.floor(begin / size) - 1, F.lit(0)), F.floor((end - 1) / size))
    alone = lambda k: (begin <= k * size) & (end >= stop(k))
    needed = lambda k: stop(k) > F.greatest(k * size, begin)
    part = lambda k: F.struct(
        k.alias("block"),
        F.greatest(k * size, begin).alias("at"),
        F.slice(
            "ids",
            (F.greatest(k * size, begin) - begin + 1).cast("int"),
            (F.least(stop(k), end) - F.greatest(k * size, begin)).cast("int"),
        ).alias("ids"),
    )
    games = stream.where(F.size("ids") > 0)
    cut = lambda test: games.select(
        F.explode(F.transform(F.filter(blocks, lambda k: needed(k) & test(k)), part)).alias("p")
    )
    inside = cut(alone).select("p.block", "p.ids")
    across = (
        cut(lambda k: ~alone(k))
        .select("p.*")
        .groupBy("block")
        .agg(
            F.flatten(
                F.transform(
                    F.sort_array(F.collect_list(F.struct("at", "ids"))), lambda part: part["ids"]
                )
            ).alias("ids")
        )
    )
    joined = inside.unionByName(across)
    first = F.ceil(F.col("block") * size / F.lit(stride)).cast("long") * stride
    last = F.least((F.col("block") + 1) * size - 1, F.col("block") * size + F.size("ids") - size - 1)
    windows = joined.where(first <= last).select(
        "block", "ids", F.explode(F.sequence(first, last, F.lit(stride).cast("long"))).alias("start")
    )
    at = (F.col("start") - F.col("block") * size).cast("int")
    return windows.select(
        "start",
        F.slice("ids", at + 1, block).alias("x"),
        F.slice("ids", at + 2, block).alias("y"),
    ).withColumn("w", loss_weights(F.col("y"), F.lit(list(turn_ids)).cast("array<int>")))


def pad_batches(
    sequences: DataFrame, order: str, batch: int, ids="ids", pad=PAD_ID, rows_per_bucket=ROWS_PER_BUCKET
) -> DataFrame:
    """Add `batch_no`, `length` and `padded`: ids filled up to the longest of their batch."""
    numbered = row_index(sequences, order, "_row", rows_per_bucket)
    placed = numbered.withColumn("batch_no", F.floor(F.col("_row") / batch)).withColumn(
        "length", F.size(ids)
    )
    longest = F.max("length").over(Window.partitionBy("batch_no"))
    fill = F.array_repeat(F.lit(pad), longest - F.col("length"))
    return placed.withColumn("padded", F.concat(ids, fill)).drop("_row")


def best_so_far(
    metrics: DataFrame, value: str, order: str, keys=("run",), mode="min", start=None, span=STEPS_PER_CHUNK
) -> DataFrame:
    """Add `best` (running best with this row) and `is_best` (strictly better than all before).

    `order` is a step number, unique in its run. Steps are put in chunks of `span`; chunk
    bests are scanned first, so a very long run is not one window. `start` is the value the
    first row has to beat.
    """
    keys = list(keys)
    pick, total = (F.least, F.min) if mode == "min" else (F.greatest, F.max)
    placed = metrics.withColumn("_chunk", F.floor(F.col(order) / span))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    chunks = placed.groupBy(*keys, "_chunk").agg(total(value).alias("_chunk_best"))
    carried = chunks.select(
        *keys,
        "_chunk",
        total("_chunk_best").over(earlier(Window.partitionBy(*keys).orderBy("_chunk"))).alias("_carried"),
    )
    inside = total(value).over(earlier(Window.partitionBy(*keys, "_chunk").orderBy(order)))
    begin = F.lit(start).cast("double")
    before = pick(F.col("_carried"), F.col("_inside"), begin)
    better = F.col(value) < F.col("_before") if mode == "min" else F.col(value) > F.col("_before")
    return (
        lookup_join(placed.withColumn("_inside", inside), carried, [*keys, "_chunk"], "left")
        .withColumn("_before", before)
        .withColumn("best", pick(F.col("_before"), F.col(value)))
        .withColumn("is_best", F.coalesce(better, F.col(value).isNotNull()))
        .drop("_chunk", "_carried", "_inside", "_before")
    )
