"""Validation metrics over scored pairs and token log-probabilities."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plyforge.functions.scoring import softplus
from plyforge.scale import row_index

# Preference temperature, batch size, batches looked at.
BETA = 0.1
PAIR_BATCH = 16
PAIR_BATCHES = 30
LOSS_BATCHES = 50


def _batched(df: DataFrame, order: str, batch: int, max_batches) -> DataFrame:
    """Add `batch_no` in the unique `order`; only the first `max_batches` batches are kept."""
    if max_batches is None:
        numbered = row_index(df, order, "_row")
    else:  # the metric reads a fixed number of rows, so this window has a bounded size
        first = df.orderBy(order).limit(batch * max_batches)
        numbered = first.withColumn("_row", F.row_number().over(Window.orderBy(order)) - 1)
    return numbered.withColumn("batch_no", F.floor(F.col("_row") / batch))


def preference_metrics(
    scored: DataFrame, order="pair_id", beta=BETA, batch=PAIR_BATCH, max_batches=PAIR_BATCHES
) -> DataFrame:
    """(reward_accuracy, preference_loss): mean over batches of each batch's mean.

    scored: policy_chosen, policy_rejected, ref_chosen, ref_rejected log-probabilities.
    """
    reward_chosen = beta * (F.col("policy_chosen") - F.col("ref_chosen"))
    reward_rejected = beta * (F.col("policy_rejected") - F.col("ref_rejected"))
    gap = beta * (
        (F.col("policy_chosen") - F.col("policy_rejected"))
        - (F.col("ref_chosen") - F.col("ref_rejected"))
    )
    rows = _batched(scored, order, batch, max_batches)
    per_batch = rows.groupBy("batch_no").agg(
        F.avg((reward_chosen > reward_rejected).cast("double")).alias("accuracy"),
        F.avg(softplus(-gap)).alias("loss"),
    )
    return per_batch.agg(
        F.coalesce(F.avg("accuracy"), F.lit(0.0)).alias("reward_accuracy"),
        F.coalesce(F.avg("loss"), F.lit(float("inf"))).alias("preference_loss"),
    )


def weighted_nll(
    sequences: DataFrame, batch: int, order="seq_id", max_batches=LOSS_BATCHES
) -> DataFrame:
    """(loss): mean over batches of the mean of −logp × w over all tokens of the batch.

    sequences: `logps` and `weights`, arrays of equal length.
    """
    terms = F.zip_with("logps", "weights", lambda p, w: -p.cast("double") * w.cast("double"))
    total = F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x)
    rows = _batched(sequences.select(order, total.alias("nll"), F.size("logps").alias("n")), order, batch, max_batches)
    per_batch = rows.groupBy("batch_no").agg((F.sum("nll") / F.sum("n")).alias("loss"))
    return per_batch.agg(F.coalesce(F.avg("loss"), F.lit(float("inf"))).alias("loss"))
