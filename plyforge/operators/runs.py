"""Round logs and the stop rule of a chain of rounds."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Log patterns, target rate, smallest gain, most rounds.
PASS_RATE = r"\((\d+\.\d+)% pass rate\)"
VAL_LOSS = r"Best val loss:\s*(\d+\.\d+)"
TARGET_RATE = 80.0
MIN_GAIN = 3.0
MAX_ROUNDS = 10


def logged_number(line: Column, pattern: str) -> Column:
    """The number in the pattern's first group; null without a match."""
    return F.nullif(F.regexp_extract(line, pattern, 1), F.lit("")).cast("double")


def round_metrics(lines: DataFrame, keys=("run",), order="line_no") -> DataFrame:
    """(keys, pass_rate, val_loss): the first match of each in the run's log, or null."""
    rate, loss = logged_number(F.col("line"), PASS_RATE), logged_number(F.col("line"), VAL_LOSS)
    found = lines.select(*keys, order, rate.alias("rate"), loss.alias("loss"))
    first = lambda name: F.min_by(name, F.when(F.col(name).isNotNull(), F.col(order)))
    return found.groupBy(*keys).agg(first("rate").alias("pass_rate"), first("loss").alias("val_loss"))


def round_progress(
    rounds: DataFrame,
    keys=("chain",),
    target=TARGET_RATE,
    min_gain=MIN_GAIN,
    max_rounds=MAX_ROUNDS,
    start_round=1,
) -> DataFrame:
    """Add delta_pp, status and stop_reason to rounds (keys, round, exit_code, pass_rate, …).

    The gain of a round is taken over the last completed round before it, also over one before
    `start_round`, from which a resumed chain goes on. Rounds after the first stop are dropped.
    The reason of a stop is a code; its numbers are in exit_code, pass_rate and delta_pp.
    """
    rate = F.col("pass_rate")
    chain = Window.partitionBy(*keys).orderBy("round")
    failed, unread = F.col("exit_code") != 0, rate.isNull()
    finished = F.when(~failed, rate)
    last = F.last(finished, ignorenulls=True).over(chain.rowsBetween(Window.unboundedPreceding, -1))
    delta = rounds.where(F.col("round") < start_round + max_rounds).withColumn(
        "delta_pp", rate - last
    )
    delta = delta.where(F.col("round") >= start_round)
    status = F.when(failed, "failed").when(unread, "parse_error").otherwise("completed")
    reason = (
        F.when(failed, "exit_code")
        .when(unread, "no_pass_rate")
        .when(rate >= target, "target_reached")
        .when(F.col("delta_pp") < min_gain, "small_gain")
    )
    judged = delta.withColumn("status", status).withColumn("stop_reason", reason)
    stops = F.count("stop_reason").over(chain.rowsBetween(Window.unboundedPreceding, -1))
    return judged.withColumn("_stops", stops).where(F.col("_stops") == 0).drop("_stops")
