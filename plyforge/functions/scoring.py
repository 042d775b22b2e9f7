"""Column functions over token ids, log-probabilities and scores."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Score given to a forced mate, and the weight of a turn-number target.
MATE_SCORE = 10_000
TURN_WEIGHT = 0.15


def shuffle_key(seed, *ids) -> Column:
    """A reproducible random order: md5 of `seed:id[:id…]`. The ids must identify the row."""
    parts = [F.col(i) if isinstance(i, str) else i for i in ids]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[part.cast("string") for part in parts]))


def score_cp(cp: Column, mate_in: Column) -> Column:
    """Centipawns for the side to move; mate in n is ±(10000 − n), being mated (0) is −10000."""
    return (
        F.when(mate_in > 0, MATE_SCORE - mate_in)
        .when(mate_in <= 0, -MATE_SCORE - mate_in)
        .otherwise(cp)
    )


def loss_weights(targets: Column, turn_ids: Column, weight=TURN_WEIGHT) -> Column:
    """One weight per target token: `weight` for turn numbers, else 1."""
    return F.transform(
        targets,
        lambda token: F.when(F.array_contains(turn_ids, token), F.lit(weight)).otherwise(F.lit(1.0)),
    )


def truncate_left(ids: Column, block: int, move_len: Column) -> Column:
    """Keep the last `block` ids; null when the move itself no longer fits."""
    kept = F.when(F.size(ids) > block, F.slice(ids, -block, block)).otherwise(ids)
    return F.when(F.size(kept) >= move_len, kept)


def move_logprob(logps: Column, move_len: Column) -> Column:
    """Sum of the last `move_len` token log-probabilities.

    Null when the move fills the whole sequence: its first token then has no prediction.
    """
    tail = F.slice(logps, F.size(logps) - move_len + 1, move_len)
    total = F.aggregate(tail, F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return F.when(F.size(logps) > move_len, total)


def softplus(x: Column) -> Column:
    """log(1 + e^x) without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))
