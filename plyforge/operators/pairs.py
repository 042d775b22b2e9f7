"""Preference pairs from scored candidate moves (position, pv_rank, move, cp)."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plyforge.functions.scoring import shuffle_key
from plyforge.scale import lookup_join
from plyforge.session import written

# Largest loss of a good move, smallest loss of a bad one, pairs kept.
GOOD_LOSS = 30
BAD_LOSS = 50
PAIRS_PER_POSITION = 3
SEED = 1997


def best_candidate(candidates: DataFrame) -> DataFrame:
    """(position, best_cp): the score of the first-ranked line."""
    return candidates.groupBy("position").agg(F.min_by("cp", "pv_rank").alias("best_cp"))


def candidate_losses(candidates: DataFrame, good=GOOD_LOSS, bad=BAD_LOSS) -> DataFrame:
    """Add `loss` to the best line and `side`: good, bad, or null between the two bands."""
    best = F.min_by("cp", "pv_rank").alias("best_cp")
    known = written(candidates.groupBy("position").agg(best, F.count(F.lit(1)).alias("n")), "best")
    rows = candidates.where(F.col("cp").isNotNull())
    scored = lookup_join(rows, known.drop("n"), "position", counts=known.select("position", "n"))
    loss = F.col("best_cp") - F.col("cp")
    return scored.withColumn("loss", loss).withColumn(
        "side", F.when(F.col("loss") <= good, "good").when(F.col("loss") >= bad, "bad")
    )


def pair_candidates(
    candidates: DataFrame, n=PAIRS_PER_POSITION, seed=SEED, good=GOOD_LOSS, bad=BAD_LOSS
) -> DataFrame:
    """(position, chosen, rejected, cp_chosen, cp_rejected): up to `n` random good × bad pairs
    per position.

    Good and bad moves are each put in random order. Pair k takes good k mod G and bad
    (k mod G + k div G) mod B, which visits all G·B pairs once, so each pair is as likely as
    any other and none beyond the first `n` moves of a side is ever needed: a position with
    very many candidates is cut before the shuffle and its pairs are never listed.
    """
    sides = candidate_losses(candidates, good, bad).where(F.col("side").isNotNull())
    sides = written(sides.select("position", "side", "pv_rank", "move", "cp"), "sides")
    totals = sides.groupBy("position").agg(
        F.count_if(F.col("side") == "good").alias("n_good"),
        F.count_if(F.col("side") == "bad").alias("n_bad"),
    )
    order = shuffle_key(seed, "position", "move")
    ranked = sides.withColumn(
        "_rank", F.row_number().over(Window.partitionBy("position", "side").orderBy(order, "pv_rank"))
    ).where(F.col("_rank") <= n)
    entry = F.struct("_rank", "move", "cp")
    lists = ranked.groupBy("position").agg(
        F.sort_array(F.collect_list(F.when(F.col("side") == "good", entry))).alias("_good"),
        F.sort_array(F.collect_list(F.when(F.col("side") == "bad", entry))).alias("_bad"),
    )
    both = lists.join(totals.where((F.col("n_good") > 0) & (F.col("n_bad") > 0)), "position")
    last = F.least(F.lit(n).cast("long"), F.col("n_good") * F.col("n_bad")) - 1
    numbered = both.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    at_good = F.expr("cast(_k % n_good as int)")
    at_bad = F.expr("cast((_k % n_good + _k div n_good) % n_bad as int)")
    return numbered.select(
        "position",
        F.get("_good", at_good)["move"].alias("chosen"),
        F.get("_bad", at_bad)["move"].alias("rejected"),
        F.get("_good", at_good)["cp"].alias("cp_chosen"),
        F.get("_bad", at_bad)["cp"].alias("cp_rejected"),
    )


def cap_per_position(pairs: DataFrame, *ids, n=PAIRS_PER_POSITION, seed=SEED) -> DataFrame:
    """At most `n` random rows per position of an existing pair table with unique `ids`.

    Spark keeps `n` rows per position in each task before the shuffle, so a hot position
    stays small.
    """
    order = Window.partitionBy("position").orderBy(shuffle_key(seed, *ids))
    return pairs.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= n).drop("_rank")
