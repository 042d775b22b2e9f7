"""Oversampling, shuffling, sampling, splitting and prompt building."""

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plyforge.functions.notation import GAME_START, numbered_text, parse_half_moves
from plyforge.functions.scoring import shuffle_key
from plyforge.scale import hash_cut, hash_cuts

# Seed, fewest games without a warning, repeat counts, prompt depths.
SEED = 1997
FEW_GAMES = 50
PRETRAIN_REPEAT = 10
FINETUNE_REPEAT = 20
PROMPT_DEPTHS = (2, 4, 6)


def oversample(df: DataFrame, times: int) -> DataFrame:
    """Repeat every row; `copy` numbers the repeats from 1."""
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(times))))


def seeded_shuffle(df: DataFrame, *ids, seed=SEED) -> DataFrame:
    """The rows in a reproducible random order of their unique ids."""
    return df.withColumn("shuffle_key", shuffle_key(seed, *ids)).orderBy("shuffle_key")


def seeded_sample(df: DataFrame, n: int, *ids, seed=SEED) -> DataFrame:
    """Exactly `n` rows, or all of a shorter table, chosen at random by their unique ids."""
    order = shuffle_key(seed, *ids)
    cut = hash_cut(df, order, n)
    return df.where(F.lit(False) if cut is None else order <= cut)


def tail_holdout(games: DataFrame, order: str) -> DataFrame:
    """Add `split`: the last min(2000, max(100, n // 10)) games are for validation."""
    held = min(2000, max(100, games.count() // 10))
    first = games.select(order).orderBy(F.desc(order)).limit(held).agg(F.min(order)).scalar()
    return games.withColumn(
        "split", F.when(F.col(order) >= first, "validation").otherwise("train")
    )


def pretrain_corpus(
    games: DataFrame, openings: DataFrame, times=PRETRAIN_REPEAT, seed=SEED, validation=None
) -> DataFrame:
    """(order_key, split, pgn): validation games, and shuffled oversampled openings put before
    the training games.

    games: (game_id >= 0, pgn). `validation` has the same columns and other ids; without it the
    last games are held out. `order_key` is unique: negative and random for openings, the game
    id for games.
    """
    if validation is None:
        split = tail_holdout(games, "game_id")
    else:
        split = games.withColumn("split", F.lit("train")).unionByName(
            validation.withColumn("split", F.lit("validation")), allowMissingColumns=True
        )
    split = split.select(F.col("game_id").alias("order_key"), "split", "pgn")
    if split.where(F.col("split") == "train").isEmpty():
        raise ValueError("the holdout takes every game: no training games are left")
    random = F.conv(F.substring(shuffle_key(seed, "opening_id", "copy"), 1, 15), 16, 10)
    opened = oversample(openings, times).select(
        (random.cast("long") - F.lit(1 << 60)).alias("order_key"),
        F.lit("train").alias("split"),
        "pgn",
    )
    return opened.unionByName(split)


def finetune_corpus(
    legal: DataFrame,
    openings: DataFrame,
    anchor: DataFrame,
    times=FINETUNE_REPEAT,
    seed=SEED,
    dedup=False,
) -> DataFrame:
    """(split, source, source_id, copy, shuffle_key, pgn) of legal generated games, openings
    and anchor games.

    The first max(20, n // 10) legal games in random order are for validation; all else is
    training data, read in the order of `shuffle_key`. `dedup` keeps one of equal games. Fewer
    than FEW_GAMES legal games give a warning, and no training data at all an error.
    """
    if dedup:
        legal = legal.groupBy("pgn").agg(F.min("game_id").alias("game_id"))
    order = shuffle_key(seed, F.lit("validation"), "game_id")
    share = lambda n: max(20, n // 10)
    n, (cut,) = hash_cuts(legal, order, lambda n: [share(n)])
    if n < FEW_GAMES:
        warnings.warn(f"only {n} legal games", stacklevel=2)
    if n <= share(n) and openings.isEmpty() and anchor.isEmpty():
        raise ValueError("no training games are left")
    parts = [
        legal.select(
            F.when(order <= cut, "validation").otherwise("train").alias("split"),
            F.lit("generated").alias("source"),
            F.col("game_id").alias("source_id"),
            F.lit(1).alias("copy"),
            "pgn",
        ),
        oversample(openings, times).select(
            F.lit("train").alias("split"),
            F.lit("opening").alias("source"),
            F.col("opening_id").alias("source_id"),
            "copy",
            "pgn",
        ),
        anchor.select(
            F.lit("train").alias("split"),
            F.lit("anchor").alias("source"),
            F.col("game_id").alias("source_id"),
            F.lit(1).alias("copy"),
            "pgn",
        ),
    ]
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return whole.withColumn("shuffle_key", shuffle_key(seed, "source", "source_id", "copy"))


def pair_split(pairs: DataFrame, *ids, share=0.1, seed=SEED) -> DataFrame:
    """Add `split`: the first max(10, share of n) pairs in random order are for validation."""
    order = shuffle_key(seed, *ids)
    total, (cut,) = hash_cuts(pairs, order, lambda n: [max(10, int(n * share))])
    if total < 10:
        raise ValueError(f"too few pairs: {total}")
    return pairs.withColumn("split", F.when(order <= cut, "validation").otherwise("train"))


def prompts(openings: DataFrame, depths=PROMPT_DEPTHS) -> DataFrame:
    """Distinct sorted prompts: each opening line, and its shorter prefixes, after the start token."""
    moves = parse_half_moves(F.col("pgn"))
    cuts = [
        F.when(F.size(moves) > depth, numbered_text(F.slice(moves, 1, depth))) for depth in depths
    ]
    lines = openings.select(F.explode(F.array("pgn", *cuts)).alias("line"))
    return (
        lines.where(F.col("line").isNotNull())
        .select(F.concat(F.lit(GAME_START), F.col("line")).alias("prompt"))
        .distinct()
        .orderBy("prompt")
    )
