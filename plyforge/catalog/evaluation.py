"""Evaluation queries: `events` as answers of models (event types) to positions (users)."""

from pyspark.sql import functions as F

from plyforge.catalog.registry import query, table
from plyforge.operators import evaluation as ev
from plyforge.plans.evaluation import (
    answers_from_text,
    evaluate,
    evaluate_puzzles,
    probe_positions,
    resume_run,
)
from plyforge.catalog.corpus import OPENINGS_SQL, openings, sql_half_moves, sql_numbered, sql_shuffle_key


def answers(spark, sf):
    """(model, position, sample_idx, move); some answers are null, empty or carry a sign."""
    n = F.col("event_id")
    move = (
        F.when(n % 37 == 0, F.lit(None))
        .when(n % 41 == 0, F.lit(""))
        .when(n % 5 == 0, F.concat(F.lit("m"), n % 12, F.lit("#")))
        .otherwise(F.concat(F.lit("m"), n % 12))
    )
    return table(spark, sf, "events").select(
        F.col("event_type").alias("model"), F.col("user_id").alias("position"), n.alias("sample_idx"), move.alias("move")
    )


def move_grid(spark, sf):
    """(position, k) of the legal moves m0…m(5 + position % 7)."""
    users = table(spark, sf, "events").select(F.col("user_id").alias("position")).distinct()
    return users.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), 5 + F.col("position") % 7)))


def legal_moves(spark, sf):
    return move_grid(spark, sf).select("position", F.concat(F.lit("m"), "k").alias("move"))


def move_scores(spark, sf):
    cp_after = (-((F.col("position") * 31 + F.col("k") * 17) % 400)).cast("int")
    return move_grid(spark, sf).select("position", F.concat(F.lit("m"), "k").alias("move"), cp_after.alias("cp_after"))


def best_scores(spark, sf):
    return move_scores(spark, sf).groupBy("position").agg(F.max(-F.col("cp_after")).alias("best_cp"))


def models(spark, sf):
    """The registered models."""
    return table(spark, sf, "events").select(F.col("event_type").alias("model")).distinct()


def judged(spark, sf):
    legal = ev.legal_answers(answers(spark, sf), legal_moves(spark, sf))
    return ev.centipawn_loss(legal, best_scores(spark, sf), move_scores(spark, sf))


def puzzle_answers(spark, sf):
    legal = ev.legal_answers(answers(spark, sf), legal_moves(spark, sf))
    expected = F.concat(F.lit("m"), F.col("position") % 9, F.lit("+"))
    return legal.withColumn("expected", expected).withColumnRenamed("position", "puzzle_id")


def results(spark, sf):
    return ev.puzzle_accuracy(puzzle_answers(spark, sf))


def rounded(df, *names):
    return df.withColumns({name: F.round(name, 8) for name in names})


BASE = """
WITH answers AS (
  SELECT event_type AS model, user_id AS position, event_id AS sample_idx,
         CASE WHEN event_id % 37 = 0 THEN NULL WHEN event_id % 41 = 0 THEN ''
              WHEN event_id % 5 = 0 THEN 'm' || (event_id % 12) || '#'
              ELSE 'm' || (event_id % 12) END AS move
  FROM events),
users AS (SELECT DISTINCT user_id AS position FROM events),
move_scores AS (
  SELECT u.position, 'm' || t.k AS move, (-((u.position * 31 + t.k * 17) % 400))::INTEGER AS cp_after
  FROM users u, range(0, 12) t(k) WHERE t.k <= 5 + u.position % 7),
best AS (SELECT position, max(-cp_after) AS best_cp FROM move_scores GROUP BY position),
judged AS (
  SELECT a.model, a.position, a.sample_idx, a.move, s.move IS NOT NULL AS is_legal,
         CASE WHEN s.move IS NOT NULL THEN greatest(0, b.best_cp + s.cp_after) END AS cpl
  FROM answers a
  LEFT JOIN move_scores s ON s.position = a.position AND s.move = regexp_replace(a.move, '[+#]$', '')
  LEFT JOIN best b ON b.position = a.position),
screened AS (
  SELECT model, position, model IN ('click', 'view') AS is_specialist, count(*) AS n_gens,
         count(*) FILTER (is_legal) AS n_legal,
         count(*) FILTER (is_legal) / count(*) AS legality_rate,
         sum(cpl) / count(cpl) AS mean_cpl,
         count(*) FILTER (cpl >= 200) / count(*) AS blunder_rate
  FROM judged GROUP BY model, position),
summary AS (
  SELECT model, avg(legality_rate) AS legality_rate, avg(mean_cpl) AS mean_cpl,
         avg(blunder_rate) AS blunder_rate, bool_or(is_specialist) AS is_specialist
  FROM screened GROUP BY model),
puzzle_answers AS (
  SELECT model, position AS puzzle_id, sample_idx, move, is_legal, 'm' || (position % 9) || '+' AS expected
  FROM judged),
results AS (
  SELECT model, puzzle_id, count(*) AS n_gens, count(*) FILTER (is_legal) AS n_legal,
         count(*) FILTER (is_legal AND rtrim(move, '+#') = rtrim(expected, '+#')) AS n_hits,
         count(*) FILTER (is_legal) / count(*) AS legality_rate,
         count(*) FILTER (is_legal AND rtrim(move, '+#') = rtrim(expected, '+#')) / count(*) AS top1_acc
  FROM puzzle_answers GROUP BY model, puzzle_id),
accuracy AS (
  SELECT model, avg(top1_acc) AS top1_acc, avg(legality_rate) AS legality_rate FROM results GROUP BY model)
"""
RATES = "round(legality_rate, 8) AS legality_rate, round(mean_cpl, 8) AS mean_cpl, round(blunder_rate, 8) AS blunder_rate"
RESULT = "model, puzzle_id, n_gens, n_legal, n_hits, round(legality_rate, 8) AS legality_rate, round(top1_acc, 8) AS top1_acc"


@query("legal_answers", BASE + "SELECT model, position, sample_idx, move, is_legal FROM judged")
def _(spark, sf):
    return ev.legal_answers(answers(spark, sf), legal_moves(spark, sf))


@query("centipawn_loss", BASE + "SELECT * FROM judged")
def _(spark, sf):
    return judged(spark, sf)


@query("tally_answers", BASE + "SELECT model, position, move, count(*) AS n FROM answers GROUP BY ALL")
def _(spark, sf):
    return ev.tally_answers(answers(spark, sf))


@query("screen", BASE + f"SELECT model, position, is_specialist, n_gens, n_legal, {RATES} FROM screened")
def _(spark, sf):
    screened = ev.screen(judged(spark, sf), ["click", "view"])
    return rounded(screened, "legality_rate", "mean_cpl", "blunder_rate")


@query("screen_summary", BASE + f"SELECT model, {RATES}, is_specialist FROM summary")
def _(spark, sf):
    screened = ev.screen(judged(spark, sf), ["click", "view"])
    return rounded(ev.screen_summary(screened), "legality_rate", "mean_cpl", "blunder_rate")


@query("evaluate", BASE + f"SELECT model, {RATES}, is_specialist FROM summary")
def evaluate_query(spark, sf):
    summary = evaluate(
        answers(spark, sf),
        legal_moves(spark, sf),
        best_scores(spark, sf),
        move_scores(spark, sf),
        ["click", "view"],
    )
    return rounded(summary, "legality_rate", "mean_cpl", "blunder_rate")


@query(
    "promote",
    BASE
    + f"""SELECT model, {RATES}, is_specialist FROM summary
WHERE model <> 'purchase' AND mean_cpl < (SELECT mean_cpl FROM summary WHERE model = 'purchase')""",
)
def _(spark, sf):
    summary = ev.screen_summary(ev.screen(judged(spark, sf), ["click", "view"]))
    return rounded(ev.promote(summary, "purchase"), "legality_rate", "mean_cpl", "blunder_rate")


@query("puzzle_accuracy", BASE + f"SELECT {RESULT} FROM results")
def _(spark, sf):
    return rounded(results(spark, sf), "legality_rate", "top1_acc")


@query(
    "sample_moves",
    BASE
    + """SELECT model, puzzle_id, sample_idx // 1000 AS chunk_no,
string_agg(coalesce(move, 'None'), '|' ORDER BY sample_idx) AS sample_moves
FROM puzzle_answers GROUP BY ALL""",
)
def _(spark, sf):
    lists = ev.sample_moves(puzzle_answers(spark, sf))
    return lists.withColumn("sample_moves", F.array_join("sample_moves", "|", "None"))


@query(
    "accuracy_summary",
    BASE + "SELECT model, round(top1_acc, 8) AS top1_acc, round(legality_rate, 8) AS legality_rate FROM accuracy",
)
def _(spark, sf):
    return rounded(ev.accuracy_summary(results(spark, sf)), "top1_acc", "legality_rate")


@query(
    "final_summary",
    BASE
    + """SELECT s.model, round(s.legality_rate, 8) AS legality_rate, round(s.mean_cpl, 8) AS mean_cpl,
round(s.blunder_rate, 8) AS blunder_rate, round(f.top1_acc, 8) AS fen_acc, round(p.top1_acc, 8) AS pgn_acc
FROM summary s
LEFT JOIN (SELECT model, avg(top1_acc) AS top1_acc FROM results WHERE puzzle_id % 2 = 0 AND model <> 'signup' GROUP BY model) f USING (model)
LEFT JOIN accuracy p USING (model)""",
)
def _(spark, sf):
    found = results(spark, sf)
    even = found.where((F.col("puzzle_id") % 2 == 0) & (F.col("model") != "signup"))
    whole = ev.final_summary(
        ev.screen_summary(ev.screen(judged(spark, sf))),
        ev.accuracy_summary(even),
        ev.accuracy_summary(found),
    )
    return rounded(whole, "legality_rate", "mean_cpl", "blunder_rate", "fen_acc", "pgn_acc")


@query(
    "eval_grid",
    """SELECT u.position, m.model, t.g::INTEGER AS sample_idx
FROM (SELECT DISTINCT user_id AS position FROM events) u,
     (SELECT DISTINCT event_type AS model FROM events) m, range(0, 5) t(g)""",
)
def _(spark, sf):
    users = table(spark, sf, "events").select(F.col("user_id").alias("position")).distinct()
    return ev.eval_grid(users, models(spark, sf), 5)


@query(
    "remaining_work",
    """SELECT u.puzzle_id, m.model FROM (SELECT DISTINCT user_id AS puzzle_id FROM events) u,
     (SELECT DISTINCT event_type AS model FROM events) m
WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = u.puzzle_id AND e.event_type = m.model AND e.user_id % 3 = 0)""",
)
def _(spark, sf):
    users = table(spark, sf, "events").select(F.col("user_id").alias("puzzle_id")).distinct()
    grid = ev.eval_grid(users, models(spark, sf), 1).drop("sample_idx")
    done = results(spark, sf).where(F.col("puzzle_id") % 3 == 0)
    return ev.remaining_work(grid, done, ["puzzle_id", "model", "n_hits"])


@query(
    "resume_run",
    """WITH done AS (SELECT user_id AS puzzle_id, event_type AS model, max_by(value, event_id) AS value FROM events
  WHERE event_id % 5 = 0 AND event_type <> 'error' AND user_id % 4 <> 0 GROUP BY ALL),
grid AS (SELECT u.puzzle_id, m.model FROM (SELECT DISTINCT user_id AS puzzle_id FROM events WHERE user_id % 4 <> 0) u,
  (SELECT DISTINCT event_type AS model FROM events WHERE event_type <> 'error') m)
SELECT puzzle_id, model, value, d.puzzle_id IS NOT NULL AS finished FROM grid LEFT JOIN done d USING (puzzle_id, model)""",
)
def _(spark, sf):
    events = table(spark, sf, "events").select(
        F.col("user_id").alias("puzzle_id"), F.col("event_type").alias("model"), "value", "event_id"
    )
    puzzles = events.where(F.col("puzzle_id") % 4 != 0).select("puzzle_id").distinct()
    names = models(spark, sf).where("model != 'error'")
    grid = ev.eval_grid(puzzles, names, 1).drop("sample_idx")
    existing = events.where(F.col("event_id") % 5 == 0)
    kept, remaining = resume_run(existing, grid, puzzles, names, ["value"], "event_id")
    finished = kept.drop("event_id").withColumn("finished", F.lit(True))
    return finished.unionByName(remaining.withColumns({"value": F.lit(None).cast("double"), "finished": F.lit(False)}))


@query(
    "keep_last",
    """SELECT user_id AS puzzle_id, event_type AS model, max_by(value, event_id) AS value, max(event_id) AS event_id
FROM events GROUP BY ALL""",
)
def _(spark, sf):
    rows = table(spark, sf, "events").select(
        F.col("user_id").alias("puzzle_id"), F.col("event_type").alias("model"), "value", "event_id"
    )
    return ev.keep_last(rows, ["puzzle_id", "model"], "event_id")


@query(
    "merge_results",
    BASE
    + f"""SELECT {RESULT}, CASE WHEN puzzle_id % 4 = 0 THEN 'new' ELSE 'old' END AS run FROM results
WHERE puzzle_id % 4 = 0 OR puzzle_id % 3 = 0""",
)
def _(spark, sf):
    found = rounded(results(spark, sf), "legality_rate", "top1_acc")
    old = found.where(F.col("puzzle_id") % 3 == 0).withColumn("run", F.lit("old"))
    new = found.where(F.col("puzzle_id") % 4 == 0).withColumn("run", F.lit("new"))
    return ev.merge_results(old, new)


@query(
    "valid_keys",
    BASE
    + f"""SELECT {RESULT} FROM results WHERE model <> 'error'
AND puzzle_id IN (SELECT user_id FROM events WHERE event_type = 'signup' AND value > 100)""",
)
def _(spark, sf):
    events = table(spark, sf, "events")
    kept = events.where(F.col("event_type") != "error").select(F.col("event_type").alias("model"))
    wanted = events.where((F.col("event_type") == "signup") & (F.col("value") > 100))
    found = ev.valid_keys(results(spark, sf), kept, wanted.select(F.col("user_id").alias("puzzle_id")))
    return rounded(found, "legality_rate", "top1_acc")


@query(
    "restore_order",
    BASE
    + """SELECT model, puzzle_id, n_hits, puzzle_order, model_order FROM results
JOIN (SELECT user_id AS puzzle_id, -max(event_id) AS puzzle_order FROM events GROUP BY 1) USING (puzzle_id)
JOIN (SELECT event_type AS model, min(event_id) AS model_order FROM events GROUP BY 1) USING (model)""",
)
def _(spark, sf):
    events = table(spark, sf, "events")
    puzzles = events.groupBy(F.col("user_id").alias("puzzle_id")).agg((-F.max("event_id")).alias("puzzle_order"))
    names = events.groupBy(F.col("event_type").alias("model")).agg(F.min("event_id").alias("model_order"))
    found = results(spark, sf).select("model", "puzzle_id", "n_hits")
    return ev.restore_order(found, puzzles, names)


@query(
    "puzzle_results",
    BASE
    + f"""SELECT {RESULT}, chunk_no, sample_moves FROM results JOIN (
SELECT model, puzzle_id, sample_idx // 50 AS chunk_no, string_agg(coalesce(move, 'None'), '|' ORDER BY sample_idx) AS sample_moves
FROM puzzle_answers GROUP BY ALL) USING (model, puzzle_id)""",
)
def _(spark, sf):
    found = ev.puzzle_results(puzzle_answers(spark, sf), chunk=50)
    return rounded(found, "legality_rate", "top1_acc").withColumn(
        "sample_moves", F.array_join("sample_moves", "|", "None")
    )


@query("evaluate_text", BASE + f"SELECT model, {RATES}, is_specialist FROM summary")
def _(spark, sf):
    """The same answers, as texts that go on from each position's prefix."""
    given = answers(spark, sf)
    prefix = F.concat(F.lit("1.a"), "position", F.lit(" b 2.c"))
    probes = given.select("position", prefix.alias("prefix")).distinct()
    text = F.concat(F.lit("[g_start]"), prefix, F.lit(" "), F.coalesce("move", F.lit("")), F.lit(" 3.zz 1-0"))
    told = F.when(F.coalesce("move", F.lit("")) != "", text).otherwise(prefix)
    told = given.select("model", "position", "sample_idx", told.alias("text"))
    found = answers_from_text(told, probes)
    summary = evaluate(found, legal_moves(spark, sf), best_scores(spark, sf), move_scores(spark, sf), ["click", "view"])
    return rounded(summary, "legality_rate", "mean_cpl", "blunder_rate")


@query(
    "evaluate_puzzles",
    BASE + "SELECT model, round(top1_acc, 8) AS top1_acc, round(legality_rate, 8) AS legality_rate FROM accuracy",
)
def _(spark, sf):
    expected = F.concat(F.lit("m"), F.col("position") % 9, F.lit("+"))
    given = answers(spark, sf).withColumn("puzzle_id", F.col("position")).withColumn("expected", expected)
    return rounded(evaluate_puzzles(given, legal_moves(spark, sf))[1], "top1_acc", "legality_rate")


PROBES = f"""
WITH {OPENINGS_SQL},
parsed AS (SELECT *, {sql_half_moves('pgn', 'evaluation')} AS moves FROM openings),
sampled AS (
  SELECT * FROM parsed WHERE len(moves) >= 8 ORDER BY {sql_shuffle_key(1997, 'opening_id')} LIMIT 10)
SELECT name || ' (' || t.ply || 'ply)' AS name, {sql_numbered('moves[1:t.ply]')} AS pgn,
       t.ply::INTEGER AS ply, name AS family
FROM sampled, (VALUES (4), (8)) t(ply)
"""


@query("probe_positions", PROBES)
def _(spark, sf):
    return probe_positions(openings(spark, sf))
