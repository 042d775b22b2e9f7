"""Replay and preference-pair queries over `conversations`, `events` and `lineitem`."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from plyforge.catalog.corpus import sql_numbered, sql_shuffle_key
from plyforge.catalog.registry import query, table
from plyforge.functions.notation import numbered_text
from plyforge.operators import pairs as pr
from plyforge.operators import replay as rp
from plyforge.plans import preferences as plan


def role_games(spark, sf):
    """(game_id, moves): the roles of a conversation in turn order."""
    listed = F.sort_array(F.collect_list(F.struct("turn", "role")))
    return (
        table(spark, sf, "conversations")
        .groupBy(F.col("conv_id").alias("game_id"))
        .agg(F.transform(listed, lambda entry: entry["role"]).alias("moves"))
    )


def role_steps(spark, sf):
    """The steps that occur in the conversations, without the one from the start to `system`."""
    before = F.lag("role", 1, "start").over(Window.partitionBy("conv_id").orderBy("turn"))
    steps = table(spark, sf, "conversations").select(
        before.alias("state"), F.col("role").alias("move"), F.col("role").alias("next_state")
    )
    return steps.distinct().where((F.col("state") != "start") | (F.col("move") != "system"))


ROLES = """
WITH RECURSIVE turns AS (
  SELECT conv_id AS game_id, turn AS ply, role AS move, lag(role, 1, 'start') OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations),
steps AS (SELECT DISTINCT before AS state, move FROM turns WHERE before <> 'start' OR move <> 'system'),
walk AS (
  SELECT t.game_id, t.ply, 'start' AS state_before, t.move, t.move AS state_after FROM turns t JOIN steps s ON s.state = 'start' AND s.move = t.move WHERE t.ply = 0
  UNION ALL
  SELECT t.game_id, t.ply, w.state_after, t.move, t.move FROM walk w JOIN turns t ON t.game_id = w.game_id AND t.ply = w.ply + 1
  JOIN steps s ON s.state = w.state_after AND s.move = t.move),
valid AS (
  SELECT g.game_id, g.n >= 2 AND coalesce(w.n, 0) = g.n AS is_legal
  FROM (SELECT game_id, count(*) AS n FROM turns GROUP BY 1) g LEFT JOIN (SELECT game_id, count(*) AS n FROM walk GROUP BY 1) w USING (game_id))
"""


@query("replay", ROLES + "SELECT game_id, ply::INTEGER AS ply, state_before, move, state_after FROM walk")
def _(spark, sf):
    return rp.replay(role_games(spark, sf), role_steps(spark, sf), "start")


@query("valid_sequences", ROLES + "SELECT * FROM valid")
def _(spark, sf):
    texts = role_games(spark, sf).select(
        "game_id", F.concat(F.lit("[g_start]"), numbered_text(F.col("moves")), F.lit(" 1-0[g_end]")).alias("text")
    )
    return rp.valid_sequences(texts, role_steps(spark, sf), "start", 2)


@query(
    "pass_rate",
    ROLES + "SELECT count(*) FILTER (is_legal) AS legal, count(*) FILTER (NOT is_legal) AS illegal, round(100.0 * count(*) FILTER (is_legal) / count(*), 6) AS pass_rate FROM valid",
)
def _(spark, sf):
    checked = rp.valid_moves(role_games(spark, sf), role_steps(spark, sf), "start", 2)
    return rp.pass_rate(checked).withColumn("pass_rate", F.round("pass_rate", 6))


def event_games(spark, sf):
    """(game_id, moves): a user's event types in order."""
    listed = F.sort_array(F.collect_list(F.struct("event_id", "event_type")))
    return (
        table(spark, sf, "events")
        .groupBy(F.col("user_id").alias("game_id"))
        .agg(F.transform(listed, lambda entry: entry["event_type"]).alias("moves"))
    )


def supplier_steps(spark, sf, missing=23):
    """(state, move, next_state): suppliers as states, event types as moves, some steps missing."""
    suppliers = table(spark, sf, "supplier").select("s_suppkey")
    total = suppliers.count()
    kinds = table(spark, sf, "events").select(F.col("event_type").alias("move")).distinct()
    steps = suppliers.crossJoin(kinds)  # the relation has all of these steps by its meaning
    size = F.length("move")
    kept = steps.where((F.col("s_suppkey") + size) % missing != 0)
    return kept.select(
        F.col("s_suppkey").cast("string").alias("state"),
        "move",
        ((F.col("s_suppkey") * 3 + size) % total).cast("string").alias("next_state"),
    )


SUPPLIER_STEPS = """
WITH RECURSIVE steps AS (
  SELECT s_suppkey AS state, e.event_type AS move, (s_suppkey * 3 + length(e.event_type)) % (SELECT count(*) FROM supplier) AS next_state
  FROM supplier, (SELECT DISTINCT event_type FROM events) e WHERE (s_suppkey + length(e.event_type)) % 23 <> 0),
turns AS (SELECT user_id AS game_id, event_type AS move, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS ply FROM events),
walk AS (
  SELECT t.game_id, t.ply, 1::BIGINT AS state_before, t.move, s.next_state AS state_after FROM turns t JOIN steps s ON s.state = 1 AND s.move = t.move WHERE t.ply = 0
  UNION ALL
  SELECT t.game_id, t.ply, w.state_after, t.move, s.next_state FROM walk w JOIN turns t ON t.game_id = w.game_id AND t.ply = w.ply + 1
  JOIN steps s ON s.state = w.state_after AND s.move = t.move),
reached AS (
  SELECT game_id, ply, state_before AS position FROM walk
  UNION SELECT w.game_id, w.ply + 1, w.state_after FROM walk w JOIN turns t ON t.game_id = w.game_id AND t.ply = w.ply + 1
  UNION SELECT game_id, 0, 1 FROM turns WHERE ply = 0),
firsts AS (SELECT position, min_by({'game_id': game_id, 'ply': ply}, {'game_id': game_id, 'ply': ply}) AS f FROM reached WHERE ply < 30 GROUP BY position)
"""


@query(
    "replay_lookup",
    SUPPLIER_STEPS + "SELECT game_id, ply::INTEGER AS ply, state_before::VARCHAR AS state_before, move, state_after::VARCHAR AS state_after FROM walk",
)
def replay_lookup(spark, sf):
    return rp.replay(event_games(spark, sf), supplier_steps(spark, sf), 1)


@query(
    "replay_join",
    SUPPLIER_STEPS.replace("% 23", "% 3") + "SELECT game_id, ply::INTEGER AS ply, state_before::VARCHAR AS state_before, move, state_after::VARCHAR AS state_after FROM walk",
)
def replay_join(spark, sf):
    return rp.replay(event_games(spark, sf), supplier_steps(spark, sf, missing=3), 1)


@query(
    "unique_positions",
    SUPPLIER_STEPS + "SELECT position::VARCHAR AS position, f.game_id AS game_id, f.ply::INTEGER AS ply FROM firsts",
)
def _(spark, sf):
    reached = rp.reached_positions(event_games(spark, sf), supplier_steps(spark, sf), 1)
    return rp.unique_positions(reached.select("game_id", "ply", "position"))


def candidates(spark, sf):
    """(position, pv_rank, move, cp): the lines of an order, best price first."""
    place = Window.partitionBy("l_orderkey").orderBy(
        F.desc("l_extendedprice"), "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_shipdate"
    )
    return (
        table(spark, sf, "lineitem")
        .withColumn("pv_rank", F.row_number().over(place))
        .select(
            F.col("l_orderkey").alias("position"),
            "pv_rank",
            F.concat(F.lit("m"), "l_partkey", F.lit("-"), "pv_rank").alias("move"),
            F.floor(F.col("l_extendedprice") / 100).cast("int").alias("cp"),
        )
    )


CANDIDATES = """candidates AS (
  SELECT l_orderkey AS position, floor(l_extendedprice / 100)::INTEGER AS cp,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_suppkey, l_linenumber, l_quantity, l_discount, l_tax, l_shipdate) AS pv_rank,
    'm' || l_partkey || '-' || pv_rank AS move FROM lineitem)"""
LOSSES = """best AS (SELECT position, min_by(cp, pv_rank) AS best_cp FROM candidates GROUP BY position),
losses AS (
  SELECT c.*, b.best_cp, b.best_cp - c.cp AS loss,
    CASE WHEN b.best_cp - c.cp <= 30 THEN 'good' WHEN b.best_cp - c.cp >= 50 THEN 'bad' END AS side
  FROM candidates c JOIN best b USING (position)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY position, side ORDER BY """ + sql_shuffle_key(1997, "position", "move") + """) - 1 AS r,
    count(*) FILTER (side = 'good') OVER (PARTITION BY position) AS n_good,
    count(*) FILTER (side = 'bad') OVER (PARTITION BY position) AS n_bad FROM losses),
pairs AS (
  SELECT g.position, g.move AS chosen, b.move AS rejected, g.cp AS cp_chosen, b.cp AS cp_rejected
  FROM ranked g, range(0, 3) t(k), ranked b
  WHERE b.position = g.position AND g.side = 'good' AND b.side = 'bad' AND t.k < g.n_good * g.n_bad
    AND g.r = t.k % g.n_good AND b.r = (t.k % g.n_good + t.k // g.n_good) % g.n_bad)
"""


@query("best_candidate", f"WITH {CANDIDATES} SELECT position, min_by(cp, pv_rank) AS best_cp FROM candidates GROUP BY position")
def _(spark, sf):
    return pr.best_candidate(candidates(spark, sf))


@query("candidate_losses", f"WITH {CANDIDATES}, {LOSSES} SELECT position, pv_rank::INTEGER AS pv_rank, move, cp, best_cp, loss, side FROM losses")
def _(spark, sf):
    return pr.candidate_losses(candidates(spark, sf))


@query("pair_candidates", f"WITH {CANDIDATES}, {LOSSES} SELECT * FROM pairs")
def pair_candidates(spark, sf):
    return pr.pair_candidates(candidates(spark, sf))


@query(
    "cap_per_position",
    f"""SELECT user_id AS position, event_id FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY {sql_shuffle_key(1997, 'event_id')}) <= 3""",
)
def _(spark, sf):
    rows = table(spark, sf, "events").select(F.col("user_id").alias("position"), "event_id")
    return pr.cap_per_position(rows, "event_id")


def supplier_candidates(spark, sf):
    """(position, pv_rank, move, cp): a supplier's parts by quantity sold, one line per part."""
    sold = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").cast("int").alias("cp"))
    place = Window.partitionBy("l_suppkey").orderBy(F.desc("cp"), "l_partkey")
    return sold.select(
        F.col("l_suppkey").cast("string").alias("position"),
        F.row_number().over(place).alias("pv_rank"),
        F.concat(F.lit("m"), "l_partkey").alias("move"),
        "cp",
    )


PREFERENCES = (
    SUPPLIER_STEPS
    + """, sold AS (SELECT l_suppkey, l_partkey, sum(l_quantity)::INTEGER AS cp FROM lineitem GROUP BY ALL),
open AS (SELECT f.position, f.f.game_id AS game_id, f.f.ply AS ply FROM firsts f WHERE (SELECT count(*) FROM steps s WHERE s.state = f.position) >= 2),
candidates AS (
  SELECT l_suppkey::VARCHAR AS position, row_number() OVER (PARTITION BY l_suppkey ORDER BY cp DESC, l_partkey) AS pv_rank, 'm' || l_partkey AS move, cp
  FROM sold WHERE l_suppkey IN (SELECT position FROM open)), """
    + LOSSES
    + f""", contexts AS (
  SELECT o.position::VARCHAR AS position, coalesce({sql_numbered('list(t.move ORDER BY t.ply)')}, '') AS context
  FROM open o LEFT JOIN turns t ON t.game_id = o.game_id AND t.ply < o.ply GROUP BY o.position)
SELECT position, coalesce(context, '') AS context, chosen, rejected, cp_chosen, cp_rejected FROM pairs JOIN contexts USING (position)"""
)


@query("preference_pairs", PREFERENCES)
def preference_pairs(spark, sf):
    positions = plan.branching_positions(event_games(spark, sf), supplier_steps(spark, sf), 1, 30)
    return plan.preference_pairs(positions, supplier_candidates(spark, sf))
