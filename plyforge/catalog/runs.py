"""Run-history queries: each user is a chain, with `events` of a day as a round."""

from pyspark.sql import functions as F

from plyforge.catalog.registry import query, table
from plyforge.operators import runs


def rounds(spark, sf):
    """(chain, round, exit_code, pass_rate, val_loss): one round per user and day."""
    day = F.dayofmonth("ts")
    made = table(spark, sf, "events").groupBy(F.col("user_id").alias("chain"), day.alias("round")).agg(
        F.sum(F.when(F.col("event_type") == "purchase", 1).otherwise(0)).alias("hits"),
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("value"), 4).alias("val_loss"),
        F.max("event_id").alias("last"),
    )
    rate = F.when(F.col("last") % 17 != 0, F.col("round") * 9 + F.floor(F.col("hits") * 10 / F.col("n")) / 2)
    exit_code = F.when(F.col("last") % 29 == 0, 3).otherwise(0)
    return made.select("chain", "round", exit_code.alias("exit_code"), rate.alias("pass_rate"), "val_loss")


ROUNDS = """WITH made AS (
  SELECT user_id AS chain, dayofmonth(ts) AS round, count(*) FILTER (event_type = 'purchase') AS hits, count(*) AS n,
    round(avg(value), 4) AS val_loss, max(event_id) AS last FROM events GROUP BY ALL),
rounds AS (
  SELECT chain, round, CASE WHEN last % 29 = 0 THEN 3 ELSE 0 END AS exit_code,
    CASE WHEN last % 17 <> 0 THEN (round * 9 + (hits * 10 // n) / 2)::DOUBLE END AS pass_rate, val_loss FROM made)"""


def progress_sql(start):
    """The rounds from `start` on, each compared with the last completed one before it."""
    return (
        ROUNDS
        + f""", d AS (SELECT *, pass_rate - last_value(CASE WHEN exit_code = 0 THEN pass_rate END IGNORE NULLS)
    OVER (PARTITION BY chain ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS delta_pp FROM rounds),
j AS (SELECT *, CASE WHEN exit_code <> 0 THEN 'failed' WHEN pass_rate IS NULL THEN 'parse_error' ELSE 'completed' END AS status,
  CASE WHEN exit_code <> 0 THEN 'exit_code' WHEN pass_rate IS NULL THEN 'no_pass_rate'
    WHEN pass_rate >= 80 THEN 'target_reached' WHEN delta_pp < 3 THEN 'small_gain' END AS stop_reason
  FROM d WHERE round BETWEEN {start} AND {start + 9}),
s AS (SELECT *, count(stop_reason) OVER (PARTITION BY chain ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS stops FROM j)
SELECT chain, round::INTEGER AS round, exit_code, pass_rate, val_loss, delta_pp, status, stop_reason FROM s WHERE stops = 0"""
    )


@query("round_progress", progress_sql(1))
def _(spark, sf):
    return runs.round_progress(rounds(spark, sf))


@query("round_progress_resumed", progress_sql(4))
def _(spark, sf):
    return runs.round_progress(rounds(spark, sf), start_round=4)


def log_lines(spark, sf):
    """(run, line_no, line): logs with metric lines among others."""
    n = F.col("event_id")
    line = (
        F.when(n % 9 == 0, F.format_string("  Generated: 5  Legal: 2  (%d.%d%% pass rate)", n % 100, n % 10))
        .when(n % 13 == 0, F.format_string("Best val loss:  %d.%04d", n % 4, n % 10000))
        .when(n % 5 == 0, F.lit("(50% pass rate) Best val loss: none"))
        .otherwise(F.concat(F.lit("step "), n, F.lit(" "), "event_type"))
    )
    return table(spark, sf, "events").select(F.col("user_id").alias("run"), n.alias("line_no"), line.alias("line"))


LOG_LINES = """WITH lines AS (SELECT user_id AS run, event_id AS line_no,
  CASE WHEN event_id % 9 = 0 THEN printf('  Generated: 5  Legal: 2  (%d.%d%% pass rate)', event_id % 100, event_id % 10)
    WHEN event_id % 13 = 0 THEN printf('Best val loss:  %d.%04d', event_id % 4, event_id % 10000)
    WHEN event_id % 5 = 0 THEN '(50% pass rate) Best val loss: none' ELSE 'step ' || event_id || ' ' || event_type END AS line FROM events),
m AS (SELECT run, line_no, nullif(regexp_extract(line, '\\((\\d+\\.\\d+)% pass rate\\)', 1), '')::DOUBLE AS p,
  nullif(regexp_extract(line, 'Best val loss:\\s*(\\d+\\.\\d+)', 1), '')::DOUBLE AS v FROM lines)
SELECT run, min_by(p, line_no) FILTER (p IS NOT NULL) AS pass_rate, min_by(v, line_no) FILTER (v IS NOT NULL) AS val_loss FROM m GROUP BY run"""


@query("round_metrics", LOG_LINES)
def _(spark, sf):
    return runs.round_metrics(log_lines(spark, sf))
