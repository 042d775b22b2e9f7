"""Model evaluation: work grid, legality, score loss, accuracy and summaries.

Answers are rows (model, position, sample_idx, move). Identical answers can be tallied first
(`tally_answers`), which adds a count column `n`; every aggregate here accepts both forms.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plyforge.functions.notation import normalise_san, san_key
from plyforge.scale import fits_broadcast, keep_keys, lookup_join

# Fixed value: score loss from which a move counts as a blunder.
BLUNDER_LOSS = 200
SAMPLE_CHUNK = 1000


def eval_grid(positions: DataFrame, models: DataFrame, n_gens: int) -> DataFrame:
    """Every position × model × generation; `models` has a column `model`, one row per model.

    The grid is all of these rows by its meaning; a short list of models goes to the positions.
    """
    names = models.select("model").distinct()
    if fits_broadcast(names):
        names = F.broadcast(names)
    return positions.crossJoin(names).withColumn(
        "sample_idx", F.explode(F.sequence(F.lit(0), F.lit(n_gens - 1)))
    )


def tally_answers(answers: DataFrame, keys=("model", "position", "move")) -> DataFrame:
    """Collapse equal answers to one row with a count, so hot positions shrink before a join."""
    return answers.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def _weight(df: DataFrame) -> Column:
    return F.col("n") if "n" in df.columns else F.lit(1)


def legal_answers(answers: DataFrame, legal_moves: DataFrame) -> DataFrame:
    """Add `is_legal`: the move is one of the position's moves; null and empty are not.

    `legal_moves` holds (position, move), each once. A final check or mate sign is optional.
    """
    known = legal_moves.select(
        "position", san_key(F.col("move")).alias("_san"), F.lit(True).alias("is_legal")
    )
    keyed = answers.withColumn("_san", san_key(F.col("move")))
    joined = lookup_join(keyed, known, ["position", "_san"], "left").drop("_san")
    return joined.withColumn("is_legal", F.coalesce("is_legal", F.lit(False)))


def move_losses(best: DataFrame, move_scores: DataFrame) -> DataFrame:
    """Loss of every scored move, once per move: max(0, best + score of the opponent after it)."""
    return lookup_join(move_scores, best, "position").select(
        "position",
        san_key(F.col("move")).alias("_san"),
        F.greatest(F.lit(0), F.col("best_cp") + F.col("cp_after")).alias("cpl"),
    )


def centipawn_loss(answers: DataFrame, best: DataFrame, move_scores: DataFrame) -> DataFrame:
    """Add `cpl` to answers with `is_legal`; null for an illegal move."""
    keyed = answers.withColumn("_san", san_key(F.col("move")))
    joined = lookup_join(keyed, move_losses(best, move_scores), ["position", "_san"], "left")
    return joined.withColumn("cpl", F.when(F.col("is_legal"), F.col("cpl"))).drop("_san")


def screen(
    answers: DataFrame,
    specialists=(),
    n_gens=None,
    blunder=BLUNDER_LOSS,
    keys=("model", "position"),
) -> DataFrame:
    """Rates per model and position. Blunders are counted over all generations."""
    n = _weight(answers)
    total = F.sum(n) if n_gens is None else F.max(F.lit(n_gens).cast("long"))
    legal = F.coalesce(F.sum(F.when(F.col("is_legal"), n)), F.lit(0))
    scored = F.sum(F.when(F.col("cpl").isNotNull(), n))
    blunders = F.coalesce(F.sum(F.when(F.col("cpl") >= blunder, n)), F.lit(0))
    return answers.groupBy(*keys).agg(
        F.first(F.col("model").isin(list(specialists))).alias("is_specialist"),
        total.alias("n_gens"),
        legal.alias("n_legal"),
        (legal / total).alias("legality_rate"),
        F.try_divide(F.sum(F.col("cpl") * n).cast("double"), scored).alias("mean_cpl"),
        (blunders / total).alias("blunder_rate"),
    )


def screen_summary(screened: DataFrame) -> DataFrame:
    """Mean of the per-position rates for each model, best loss first."""
    return (
        screened.groupBy("model")
        .agg(
            F.avg("legality_rate").alias("legality_rate"),
            F.avg("mean_cpl").alias("mean_cpl"),
            F.avg("blunder_rate").alias("blunder_rate"),
            F.first("is_specialist", ignorenulls=True).alias("is_specialist"),
        )
        .orderBy(F.asc_nulls_last("mean_cpl"), "model")
    )


def promote(summary: DataFrame, baseline: str) -> DataFrame:
    """Models with a lower mean loss than the baseline model; none without a baseline loss."""
    limit = summary.where(F.col("model") == baseline).agg(F.max("mean_cpl")).scalar()
    return summary.where((F.col("model") != baseline) & (F.col("mean_cpl") < limit))


def final_summary(screened: DataFrame, fen: DataFrame, pgn: DataFrame) -> DataFrame:
    """The screening summary with both puzzle accuracies, best loss first."""
    base = screened.select("model", "legality_rate", "mean_cpl", "blunder_rate")
    fen = fen.select("model", F.col("top1_acc").alias("fen_acc"))
    pgn = pgn.select("model", F.col("top1_acc").alias("pgn_acc"))
    return (
        base.join(fen, "model", "left")
        .join(pgn, "model", "left")
        .orderBy(F.asc_nulls_last("mean_cpl"), "model")
    )


def puzzle_accuracy(answers: DataFrame, n_gens=None, keys=("model", "puzzle_id")) -> DataFrame:
    """Legal moves and hits per model and puzzle.

    A hit is a legal move equal to `expected` after dropping check and mate signs.
    """
    n = _weight(answers)
    total = F.sum(n) if n_gens is None else F.max(F.lit(n_gens).cast("long"))
    legal = F.coalesce(F.sum(F.when(F.col("is_legal"), n)), F.lit(0))
    hit = F.col("is_legal") & (normalise_san(F.col("move")) == normalise_san(F.col("expected")))
    hits = F.coalesce(F.sum(F.when(hit, n)), F.lit(0))
    return answers.groupBy(*keys).agg(
        total.alias("n_gens"),
        legal.alias("n_legal"),
        hits.alias("n_hits"),
        (legal / total).alias("legality_rate"),
        (hits / total).alias("top1_acc"),
    )


def sample_moves(answers: DataFrame, keys=("model", "puzzle_id"), chunk=SAMPLE_CHUNK) -> DataFrame:
    """The produced moves in order, as lists of at most `chunk` moves numbered by `chunk_no`.

    A run with up to `chunk` generations per puzzle has one list, number 0, per group.
    """
    part = F.floor(F.col("sample_idx") / chunk).cast("long")
    pairs = F.sort_array(F.collect_list(F.struct("sample_idx", "move")))
    return (
        answers.withColumn("chunk_no", part)
        .groupBy(*keys, "chunk_no")
        .agg(F.transform(pairs, lambda pair: pair["move"]).alias("sample_moves"))
    )


def puzzle_results(
    answers: DataFrame, n_gens=None, keys=("model", "puzzle_id"), chunk=SAMPLE_CHUNK
) -> DataFrame:
    """Accuracy rows with their moves, one row per list of at most `chunk` moves (`chunk_no`).

    Counts and lists come from the same answers: those before `n_gens`, or all of them.
    """
    if n_gens is not None:
        answers = answers.where(F.col("sample_idx") < n_gens)
    lists = sample_moves(answers, keys, chunk)
    return puzzle_accuracy(answers, n_gens, keys).join(lists, list(keys))


def accuracy_summary(results: DataFrame) -> DataFrame:
    return (
        results.groupBy("model")
        .agg(F.avg("top1_acc").alias("top1_acc"), F.avg("legality_rate").alias("legality_rate"))
        .orderBy(F.desc("top1_acc"), "model")
    )


def valid_keys(results: DataFrame, models: DataFrame, puzzles: DataFrame) -> DataFrame:
    """Rows whose model and puzzle belong to the current run."""
    return keep_keys(keep_keys(results, models, "model"), puzzles, "puzzle_id")


def remaining_work(grid: DataFrame, done: DataFrame, required, keys=("puzzle_id", "model")):
    """Grid rows without a finished result; all of them when `done` lacks a required column."""
    if not set(required) <= set(done.columns):
        return grid
    return lookup_join(grid, done.select(*keys).distinct(), list(keys), "left_anti")


def keep_last(df: DataFrame, keys, order: str) -> DataFrame:
    """The row with the greatest `order` for each key, by a partial aggregate."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    others = [name for name in df.columns if name not in keys]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("_last"))
    return last.select(*keys, "_last.*").select(*df.columns)


def merge_results(existing: DataFrame, new: DataFrame, keys=("puzzle_id", "model")) -> DataFrame:
    """Resumed rows and new rows together; a new row replaces an old one with the same key."""
    both = existing.withColumn("_run", F.lit(0)).unionByName(new.withColumn("_run", F.lit(1)))
    return keep_last(both, list(keys), "_run").drop("_run")


def restore_order(df: DataFrame, puzzles: DataFrame, models: DataFrame) -> DataFrame:
    """Sort by the places given in (puzzle_id, puzzle_order) and (model, model_order)."""
    placed = lookup_join(lookup_join(df, puzzles, "puzzle_id", "left"), models, "model", "left")
    return placed.orderBy("puzzle_order", "model_order")
