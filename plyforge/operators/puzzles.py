"""Puzzle catalogue filters, source-game matching, splits and profiles."""

from math import floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plyforge.functions.notation import numbered_text, words
from plyforge.functions.scoring import shuffle_key
from plyforge.scale import hash_cuts, lookup_join, match_rows

# Default rating band, themes wanted and left out, split seed.
RATING_LOW, RATING_HIGH = 1200, 1900
WANTED_THEMES = ("middlegame",)
UNWANTED_THEMES = ("opening", "endgame")
SPLIT_SEED = 1997

QUANTILE_BINS = 256


def rating_band(df: DataFrame, low=RATING_LOW, high=RATING_HIGH, rating="Rating") -> DataFrame:
    """Ratings inside the inclusive band; a rating that is not a number drops the row."""
    value = F.col(rating)
    if dict(df.dtypes)[rating] == "string":
        value = F.trim(value).try_cast("int")
    return df.where(value.between(low, high))


def _has_theme(themes: str, wanted) -> Column:
    return F.arrays_overlap(words(F.coalesce(F.col(themes), F.lit(""))), F.lit(list(wanted)))


def require_themes(df: DataFrame, wanted=WANTED_THEMES, themes="Themes") -> DataFrame:
    """At least one wanted theme; an empty list asks for nothing."""
    return df.where(_has_theme(themes, wanted)) if wanted else df


def exclude_themes(df: DataFrame, unwanted=UNWANTED_THEMES, themes="Themes") -> DataFrame:
    return df.where(~_has_theme(themes, unwanted)) if unwanted else df


def new_only(candidates: DataFrame, existing: DataFrame, key="puzzle_id") -> DataFrame:
    """Candidates whose id is not in `existing`."""
    return lookup_join(candidates, existing.select(key).distinct(), key, "left_anti")


def uci_to_san(df: DataFrame, legal_moves: DataFrame) -> DataFrame:
    """Add `best_san` for (position, best_uci); null when that move is not legal there.

    `legal_moves` holds (position, uci, san), each move once.
    """
    names = legal_moves.select("position", F.col("uci").alias("best_uci"), F.col("san").alias("best_san"))
    return lookup_join(df, names, ["position", "best_uci"], "left")


def attach_source_game(puzzles: DataFrame, games: DataFrame) -> DataFrame:
    """Add the columns of the puzzle's game; null when the game is missing.

    The game table is cut to the wanted ids before it is joined.
    """
    return match_rows(puzzles, games, "game_id")


def position_context(
    puzzles: DataFrame, game_positions: DataFrame, games: DataFrame, include_start=True
) -> DataFrame:
    """Add `ply` and `pgn_context`: the moves before the game first reaches the position.

    puzzles: (…, game_id, position); game_positions: (game_id, ply, position) with ply 0 for
    the start; games: (game_id, moves, …), whose further columns are added too. Without
    `include_start` only positions after a move count. Both columns are null when the game
    never reaches the position.
    """
    on = ["game_id", "position"]
    reached = game_positions if include_start else game_positions.where(F.col("ply") > 0)
    first_ply = lambda rows: rows.groupBy(*on).agg(F.min("ply").alias("ply"))
    placed = match_rows(puzzles, reached, on, shrink=first_ply)
    with_moves = attach_source_game(placed, games.withColumnRenamed("moves", "_moves"))
    before = F.expr("slice(_moves, 1, ply)")
    text = F.when(F.col("ply").isNotNull(), numbered_text(before))
    return with_moves.withColumn("pgn_context", text).drop("_moves")


def attempt_outcome() -> Column:
    """Why a candidate was written or skipped; the first failing check decides."""
    return (
        F.when(F.col("best_uci").isNull(), "no move")
        .when(F.col("best_san").isNull(), "move not legal")
        .when(~F.col("has_game"), "no source game")
        .when(F.col("pgn_context").isNull(), "position not found")
        .otherwise("written")
    )


def skip_reasons(attempts: DataFrame) -> DataFrame:
    """Number of candidates per outcome."""
    return attempts.groupBy(attempt_outcome().alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def split_80_10_10(df: DataFrame, key="puzzle_id", seed=SPLIT_SEED) -> DataFrame:
    """Add `split`: one fifth, rounded up, is held out; half of it, rounded up, is the test set."""
    order = shuffle_key(seed, key)
    held = lambda n: -(-n // 5)
    total, (test, validation) = hash_cuts(df, order, lambda n: [-(-held(n) // 2), held(n)])
    if total == 0:
        return df.withColumn("split", F.lit("train"))
    return df.withColumn(
        "split", F.when(order <= test, "test").when(order <= validation, "validation").otherwise("train")
    )


def theme_histogram(df: DataFrame, themes="themes", k=20) -> DataFrame:
    """The `k` most frequent themes; equal counts in name order."""
    return (
        df.select(F.explode(themes).alias("theme"))
        .groupBy("theme")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "theme")
        .limit(k)
    )


def values_at(df: DataFrame, ranks: dict, ends: dict) -> dict:
    """{(column, rank): value} for ranks counted from 0 among the finite values of each column.

    `ends` holds the smallest and largest of them. Every pass counts the values of all open ranges
    in `QUANTILE_BINS` parts and goes on with the part that holds a rank, between the smallest and
    largest value found in it, until these are equal. The number of passes depends on the values
    and not on the number of columns.
    """
    finite = lambda name: F.col(name).cast("double")
    cells = F.array(*(F.struct(F.lit(name).alias("column"), finite(name).alias("value")) for name in ends))
    values = df.select(F.explode(cells).alias("c")).select("c.*").where("abs(value) < double('infinity')")
    open_ranks = {(name, rank): (*ends[name], rank) for name, own in ranks.items() for rank in own}
    found = {}
    while True:
        for target in [target for target, (low, high, _) in open_ranks.items() if low == high]:
            found[target] = open_ranks.pop(target)[0]
        if not open_ranks:
            return found
        parts = sorted({(name, low, high) for (name, _), (low, high, _) in open_ranks.items()})
        spans = df.sparkSession.createDataFrame(parts, "column string, low double, high double")
        inside = values.join(F.broadcast(spans), "column").where("value BETWEEN low AND high")
        share = (F.col("value") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2)
        part = F.least(F.floor(share * QUANTILE_BINS), F.lit(QUANTILE_BINS - 1)).alias("part")
        counted = inside.groupBy("column", "low", "high", part).agg(
            F.count(F.lit(1)).alias("n"), F.min("value").alias("least"), F.max("value").alias("most")
        )
        bins = {}
        for row in counted.collect():
            bins.setdefault((row["column"], row["low"], row["high"]), []).append(row)
        for (name, rank), (low, high, left) in list(open_ranks.items()):
            for row in sorted(bins[name, low, high], key=lambda row: row["part"]):
                if left < row["n"]:
                    open_ranks[name, rank] = (row["least"], row["most"], left)
                    break
                left -= row["n"]


def describe_numeric(df: DataFrame, columns) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact quartiles, one row per column.

    Quartiles are interpolated linearly; infinite values and NaN count at the ends of the order.
    """
    shares = (0.25, 0.5, 0.75)
    value = lambda name: F.col(name).cast("double")
    is_finite = lambda name: F.abs(value(name)) < float("inf")
    row = df.agg(
        *[
            F.struct(
                F.count(name).alias("count"),
                F.avg(name).alias("mean"),
                F.stddev_samp(name).alias("std"),
                F.min(name).cast("double").alias("min"),
                F.max(name).cast("double").alias("max"),
                F.count_if(value(name) == float("-inf")).alias("below"),
                F.count_if(is_finite(name)).alias("finite"),
                F.count_if(value(name) == float("inf")).alias("above"),
                F.min(F.when(is_finite(name), value(name))).alias("low"),
                F.max(F.when(is_finite(name), value(name))).alias("high"),
            ).alias(name)
            for name in columns
        ]
    ).first()
    places = {name: [(row[name]["count"] - 1) * share for share in shares] for name in columns if row[name]["count"]}
    around = lambda name, place: (floor(place), min(floor(place) + 1, row[name]["count"] - 1))
    ranks = {
        name: {r - row[name]["below"] for place in own for r in around(name, place)} for name, own in places.items()
    }
    ranks = {name: {r for r in own if 0 <= r < row[name]["finite"]} for name, own in ranks.items()}
    ends = {name: (row[name]["low"], row[name]["high"]) for name, own in ranks.items() if own}
    found = values_at(df, ranks, ends) if ends else {}

    def at(name, rank):
        rank -= row[name]["below"]
        if rank < 0:
            return float("-inf")
        if rank < row[name]["finite"]:
            return found[name, rank]
        return float("inf") if rank < row[name]["finite"] + row[name]["above"] else float("nan")

    def quartile(name, place):
        low, high = (at(name, rank) for rank in around(name, place))
        return low if low == high or place == floor(place) else low + (high - low) * (place - floor(place))

    rows = []
    for name in columns:
        own = row[name]
        quartiles = [quartile(name, place) for place in places.get(name, [])] or [None] * 3
        rows.append((name, own["count"], own["mean"], own["std"], own["min"], *quartiles, own["max"]))
    kinds = "column string, count long, mean double, std double, min double, q25 double, q50 double, q75 double, max double"
    return df.sparkSession.createDataFrame(rows, kinds)


def dataset_card_stats(df: DataFrame, rating="rating", themes="themes", k=8) -> DataFrame:
    """Total, truncated mean rating, rating range and the `k` leading themes."""
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "theme")))
    leading = theme_histogram(df, themes, k).agg(
        F.array_join(F.transform(ranked, lambda entry: entry["theme"]), ", ")
    )
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.avg(rating).cast("int").alias("mean_rating"),
        F.min(rating).alias("min_rating"),
        F.max(rating).alias("max_rating"),
    ).withColumn("top_themes", leading.scalar())
