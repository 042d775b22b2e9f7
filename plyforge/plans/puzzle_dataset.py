"""Puzzle catalogue to puzzle records."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plyforge.functions.notation import game_id_from_url, position_key, words
from plyforge.operators.corpus import seeded_sample
from plyforge.operators.puzzles import (
    RATING_HIGH,
    RATING_LOW,
    UNWANTED_THEMES,
    WANTED_THEMES,
    attempt_outcome,
    exclude_themes,
    new_only,
    position_context,
    rating_band,
    require_themes,
    uci_to_san,
)
from plyforge.session import checkpointed


def select_candidates(
    catalogue: DataFrame,
    existing: DataFrame,
    low=RATING_LOW,
    high=RATING_HIGH,
    wanted=WANTED_THEMES,
    unwanted=UNWANTED_THEMES,
) -> DataFrame:
    """Catalogue rows in the rating band with the right themes that are not in `existing`.

    The cheap filters run in the scan, before the id check.
    """
    banded = exclude_themes(require_themes(rating_band(catalogue, low, high), wanted), unwanted)
    known = existing.select(F.col("puzzle_id").alias("PuzzleId"))
    return new_only(banded, known, "PuzzleId")


def puzzle_attempts(
    candidates: DataFrame,
    legal_moves: DataFrame,
    game_positions: DataFrame,
    games: DataFrame,
    include_start=True,
) -> DataFrame:
    """Each candidate with its record columns and the `outcome` of the checks.

    legal_moves: (position, uci, san); game_positions: (game_id, ply, position);
    games: (game_id, moves). Positions are four-field keys.
    """
    attempts = candidates.select(
        F.col("PuzzleId").alias("puzzle_id"),
        game_id_from_url(F.col("GameUrl")).alias("game_id"),
        F.col("Rating").cast("int").alias("rating"),
        words(F.col("Themes")).alias("themes"),
        F.col("FEN").alias("fen"),
        position_key(F.col("FEN")).alias("position"),
        F.get(words(F.col("Moves")), 0).alias("best_uci"),
    )
    return outcomes(attempts, legal_moves, game_positions, games, include_start)


def outcomes(
    attempts: DataFrame,
    legal_moves: DataFrame,
    game_positions: DataFrame,
    games: DataFrame,
    include_start=True,
) -> DataFrame:
    """Add best_san, has_game, ply, pgn_context and outcome to (game_id, position, best_uci)."""
    named = uci_to_san(attempts, legal_moves)
    known = games.select("game_id", "moves", F.lit(True).alias("has_game"))
    placed = position_context(named, game_positions, known, include_start)
    return placed.withColumn("has_game", F.coalesce("has_game", F.lit(False))).withColumn(
        "outcome", attempt_outcome()
    )


def puzzle_records(attempts: DataFrame) -> DataFrame:
    """The written attempts in record form."""
    return attempts.where(F.col("outcome") == "written").select(
        "puzzle_id",
        "game_id",
        "rating",
        "themes",
        "pgn_context",
        "fen",
        F.col("best_uci").alias("best_move_uci"),
        F.col("best_san").alias("best_move_san"),
    )


def puzzle_dataset(
    catalogue: DataFrame,
    existing: DataFrame,
    legal_moves: DataFrame,
    game_positions: DataFrame,
    games: DataFrame,
    count=500,
    seed=1997,
    **filters,
) -> DataFrame:
    """A random `count` of the new candidates, checked and turned into records."""
    candidates = select_candidates(catalogue, existing, **filters)
    chosen = checkpointed(seeded_sample(candidates, count, "PuzzleId", seed=seed))
    return puzzle_records(puzzle_attempts(chosen, legal_moves, game_positions, games))
