"""Openings and scored candidates to preference pairs, and pairs to token ids."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plyforge.functions.notation import GAME_START, numbered_text, parse_half_moves
from plyforge.functions.scoring import truncate_left
from plyforge.operators.pairs import BAD_LOSS, GOOD_LOSS, PAIRS_PER_POSITION, SEED, pair_candidates
from plyforge.operators.replay import reached_positions, unique_positions
from plyforge.operators.tokens import piece_encoder, split_pieces
from plyforge.scale import keep_keys, lookup_join
from plyforge.session import written

# Fixed value: plies of an opening line that are looked at.
MAX_HALF_MOVES = 30


def opening_positions(
    openings: DataFrame, transitions: DataFrame, start, max_half_moves=MAX_HALF_MOVES
) -> DataFrame:
    """(position, game_id, ply, context): each position of the lines once, first line first,
    if at least two moves lead out of it."""
    games = openings.select(
        F.col("opening_id").alias("game_id"), parse_half_moves(F.col("pgn")).alias("moves")
    )
    return branching_positions(games, transitions, start, max_half_moves)


def branching_positions(games: DataFrame, transitions: DataFrame, start, max_half_moves) -> DataFrame:
    """The same for (game_id, moves)."""
    reached = reached_positions(games, transitions, start, max_half_moves)
    first = unique_positions(reached.select("position", "game_id", "ply"))
    open_ended = (
        transitions.groupBy(F.col("state").cast("string").alias("position"))
        .agg(F.count(F.lit(1)).alias("n_moves"))
        .where(F.col("n_moves") >= 2)
    )
    kept = lookup_join(keep_keys(first, open_ended, "position"), games.select("game_id", "moves"), "game_id")
    played = F.expr("slice(moves, 1, ply)")
    kept = kept.select("position", "game_id", "ply", numbered_text(played).alias("context"))
    return written(kept, "positions")


def preference_pairs(
    positions: DataFrame,
    candidates: DataFrame,
    n=PAIRS_PER_POSITION,
    seed=SEED,
    good=GOOD_LOSS,
    bad=BAD_LOSS,
) -> DataFrame:
    """(position, context, chosen, rejected, cp_chosen, cp_rejected) for unique positions."""
    wanted = keep_keys(candidates, positions, "position")
    pairs = pair_candidates(wanted, n, seed, good, bad)
    return lookup_join(pairs, positions.select("position", "context"), "position")


def tokenize_pairs(
    pairs: DataFrame, merges: DataFrame, vocabulary: DataFrame, block: int, key="pair_id"
) -> DataFrame:
    """(key, chosen_ids, chosen_move_len, rejected_ids, rejected_move_len).

    The three texts of a pair are encoded where the pair is. A move's ids are what follows the
    context's; pairs without such ids, or whose move is longer than `block`, are dropped.
    """
    context = F.concat(F.lit(GAME_START), F.coalesce("context", F.lit("")))
    gap = F.when(F.coalesce("context", F.lit("")) != "", F.lit(" ")).otherwise(F.lit(""))
    encode = piece_encoder(merges, vocabulary)
    ids = lambda text: encode(split_pieces(text, specials=True))
    rows = pairs.select(
        key,
        ids(context).alias("_context"),
        ids(F.concat(context, gap, "chosen")).alias("_chosen"),
        ids(F.concat(context, gap, "rejected")).alias("_rejected"),
    )
    length = lambda side: F.size(side) - F.size("_context")
    cut = lambda side: truncate_left(F.col(side), block, length(side))
    return (
        rows.where((length("_chosen") > 0) & (length("_rejected") > 0))
        .select(
            key,
            cut("_chosen").alias("chosen_ids"),
            length("_chosen").alias("chosen_move_len"),
            cut("_rejected").alias("rejected_ids"),
            length("_rejected").alias("rejected_move_len"),
        )
        .where(F.col("chosen_ids").isNotNull() & F.col("rejected_ids").isNotNull())
    )
