"""Probe positions and the evaluation of generated moves."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plyforge.functions.notation import next_move, numbered_text, parse_half_moves
from plyforge.operators.corpus import SEED, seeded_sample
from plyforge.operators.evaluation import (
    accuracy_summary,
    centipawn_loss,
    keep_last,
    legal_answers,
    puzzle_accuracy,
    remaining_work,
    screen,
    screen_summary,
    tally_answers,
    valid_keys,
)
from plyforge.scale import lookup_join

# Probe positions and their plies.
PROBE_POSITIONS = 20
PROBE_PLIES = (4, 8)


def probe_positions(openings: DataFrame, n=PROBE_POSITIONS, plies=PROBE_PLIES, seed=SEED) -> DataFrame:
    """(name, pgn, ply, family): prefixes of `n // len(plies)` random openings that are long
    enough for the deepest ply."""
    parsed = openings.withColumn("_moves", parse_half_moves(F.col("pgn"), "evaluation"))
    long_enough = parsed.where(F.size("_moves") >= max(plies))
    sampled = seeded_sample(long_enough, n // len(plies), "opening_id", seed=seed)
    return sampled.withColumn("ply", F.explode(F.lit(list(plies)))).select(
        F.format_string("%s (%dply)", "name", "ply").alias("name"),
        numbered_text(F.expr("slice(_moves, 1, ply)")).alias("pgn"),
        "ply",
        F.col("name").alias("family"),
    )


def answers_from_text(generations: DataFrame, probes: DataFrame) -> DataFrame:
    """Add `move` to generated texts: the first move beyond the position's `prefix`.

    generations: (…, position, text); probes: (position, prefix).
    """
    return lookup_join(generations, probes.select("position", "prefix"), "position").withColumn(
        "move", next_move(F.col("prefix"), F.col("text"))
    )


def evaluate(
    answers: DataFrame,
    legal_moves: DataFrame,
    best: DataFrame,
    move_scores: DataFrame,
    specialists=(),
    n_gens=None,
) -> DataFrame:
    """Per-model summary of (model, position, move) answers.

    Equal answers are tallied first, so the joins see each distinct answer once.
    """
    judged = centipawn_loss(legal_answers(tally_answers(answers), legal_moves), best, move_scores)
    return screen_summary(screen(judged, specialists, n_gens))


def evaluate_puzzles(answers: DataFrame, legal_moves: DataFrame, n_gens=None) -> tuple:
    """(results, summary) of answers (model, puzzle_id, position, move, expected).

    Results have one row per model and puzzle, the summary one per model.
    """
    keys = ("model", "puzzle_id", "position", "move", "expected")
    judged = legal_answers(tally_answers(answers, keys), legal_moves)
    results = puzzle_accuracy(judged, n_gens)
    return results, accuracy_summary(results)


def resume_run(
    existing: DataFrame,
    grid: DataFrame,
    puzzles: DataFrame,
    models: DataFrame,
    required,
    order: str,
    keys=("puzzle_id", "model"),
) -> tuple:
    """(kept, remaining): finished rows of this run, and the grid rows still to do.

    Of equal keys the last row counts. Without a required column the run starts fresh.
    """
    if not set(required) <= set(existing.columns):
        return existing.limit(0), grid
    kept = valid_keys(keep_last(existing, list(keys), order), models, puzzles)
    return kept, remaining_work(grid, kept, required, keys)
