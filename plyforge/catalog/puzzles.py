"""Puzzle queries: `part` as the catalogue, `events` of a user as a game."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from plyforge.catalog.corpus import sql_numbered, sql_shuffle_key
from plyforge.catalog.registry import query, table
from plyforge.operators import puzzles as pz
from plyforge.plans import puzzle_dataset as plan
from plyforge.session import scratch_path
from plyforge.sources.puzzles import parse_fen_lines, parse_fen_puzzles, read_fen_lines

KINDS = ["click", "error", "purchase", "signup", "view"]


def catalogue(spark, sf):
    """Catalogue rows: some without moves, with illegal moves, unknown games or positions."""
    p = F.col("p_partkey")
    kind = F.get(F.lit(["start", *KINDS[:4]]), (p % 5).cast("int"))
    place = F.when(p % 5 == 0, kind).otherwise(F.concat(kind, F.lit("/"), p % 4))
    return table(spark, sf, "part").select(
        p.alias("PuzzleId"),
        F.concat(place, F.lit(" w KQkq - 3 "), p).alias("FEN"),
        F.when(p % 11 == 0, "").otherwise(F.concat(F.lit("u"), p % 7, F.lit(" u1"))).alias("Moves"),
        F.col("p_size").alias("Rating"),
        F.col("p_name").alias("Themes"),
        F.concat(F.lit("https://games.example/g"), F.floor(p / 12), F.lit("/black#36")).alias("GameUrl"),
    )


def game_rows(spark, sf):
    ply = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    return table(spark, sf, "events").select(
        F.concat(F.lit("g"), "user_id").alias("game_id"),
        ply.alias("ply"),
        F.concat("event_type", F.lit("/"), F.col("event_id") % 3, F.lit(" w KQkq -")).alias("position"),
        F.concat("event_type", F.col("event_id") % 4).alias("move"),
    )


def game_positions(spark, sf):
    rows = game_rows(spark, sf)
    starts = rows.where(F.col("ply") == 1).select(
        "game_id", F.lit(0).alias("ply"), F.lit("start w KQkq -").alias("position")
    )
    return rows.select("game_id", "ply", "position").unionByName(starts)


def games(spark, sf):
    """(game_id, moves); a game is one user's events."""
    listed = F.sort_array(F.collect_list(F.struct("ply", "move")))
    return game_rows(spark, sf).groupBy("game_id").agg(
        F.transform(listed, lambda entry: entry["move"]).alias("moves")
    )


def legal_moves(spark, sf):
    keys = game_positions(spark, sf).select("position").distinct()
    grid = keys.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(5))))
    return grid.select("position", F.concat(F.lit("u"), "k").alias("uci"), F.concat(F.lit("S"), "k").alias("san"))


def existing(spark, sf):
    return table(spark, sf, "part").where(F.col("p_partkey") % 10 == 0).select(F.col("p_partkey").alias("puzzle_id"))


def attempts(spark, sf, candidates=None):
    return plan.puzzle_attempts(
        catalogue(spark, sf) if candidates is None else candidates,
        legal_moves(spark, sf),
        game_positions(spark, sf),
        games(spark, sf),
    )


CATALOGUE = """
WITH catalogue AS (
  SELECT p_partkey AS PuzzleId,
    CASE p_partkey % 5 WHEN 0 THEN 'start' WHEN 1 THEN 'click/' || (p_partkey % 4) WHEN 2 THEN 'error/' || (p_partkey % 4)
      WHEN 3 THEN 'purchase/' || (p_partkey % 4) ELSE 'signup/' || (p_partkey % 4) END || ' w KQkq -' AS key,
    CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE 'u' || (p_partkey % 7) END AS best_uci,
    p_size AS Rating, p_name AS Themes, 'g' || (p_partkey // 12) AS game_id FROM part),
rows AS (
  SELECT 'g' || user_id AS game_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS ply,
    event_type || '/' || (event_id % 3) || ' w KQkq -' AS key, event_type || (event_id % 4) AS move FROM events),
positions AS (SELECT game_id, ply, key FROM rows UNION ALL SELECT DISTINCT game_id, 0, 'start w KQkq -' FROM rows),
games AS (SELECT game_id, list(move ORDER BY ply) AS moves FROM rows GROUP BY game_id),
legal AS (SELECT key, 'u' || t.k AS uci, 'S' || t.k AS san FROM (SELECT DISTINCT key FROM positions), range(0, 6) t(k)),
first AS (SELECT game_id, key, min(ply) AS ply FROM positions GROUP BY ALL),
attempts AS (
  SELECT c.*, l.san AS best_san, g.game_id IS NOT NULL AS has_game, f.ply, g.moves,
    CASE WHEN c.best_uci IS NULL THEN 'no move' WHEN l.san IS NULL THEN 'move not legal'
      WHEN g.game_id IS NULL THEN 'no source game' WHEN f.ply IS NULL THEN 'position not found' ELSE 'written' END AS outcome
  FROM catalogue c LEFT JOIN legal l ON l.key = c.key AND l.uci = c.best_uci
  LEFT JOIN games g ON g.game_id = c.game_id
  LEFT JOIN first f ON f.game_id = c.game_id AND f.key = c.key)
"""
CONTEXT = f"CASE WHEN ply IS NOT NULL THEN {sql_numbered('moves[1:ply]')} END AS pgn_context"
CANDIDATES = """FROM catalogue WHERE Rating BETWEEN 10 AND 40
AND len(list_intersect(string_split(Themes, ' '), ['widget', 'red', 'hot', 'small'])) > 0
AND len(list_intersect(string_split(Themes, ' '), ['rod', 'old'])) = 0 AND PuzzleId % 10 <> 0"""


@query("rating_band", "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 40")
def _(spark, sf):
    return pz.rating_band(table(spark, sf, "part"), 10, 40, "p_size").select("p_partkey", "p_size")


@query(
    "rating_band_text",
    "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 40 AND p_partkey % 3 <> 0",
)
def _(spark, sf):
    text = F.when(F.col("p_partkey") % 3 == 0, "unrated").otherwise(F.col("p_size").cast("string"))
    rated = table(spark, sf, "part").select("p_partkey", text.alias("Rating"))
    return pz.rating_band(rated, 10, 40).select("p_partkey")


@query("require_themes", "SELECT p_partkey FROM part WHERE len(list_intersect(string_split(p_name, ' '), ['red', 'widget'])) > 0")
def _(spark, sf):
    return pz.require_themes(table(spark, sf, "part"), ["red", "widget"], "p_name").select("p_partkey")


@query("exclude_themes", "SELECT p_partkey FROM part WHERE len(list_intersect(string_split(p_name, ' '), ['red', 'widget'])) = 0")
def _(spark, sf):
    return pz.exclude_themes(table(spark, sf, "part"), ["red", "widget"], "p_name").select("p_partkey")


@query("new_only", "SELECT p_partkey AS puzzle_id, p_size FROM part WHERE p_partkey % 10 <> 0")
def _(spark, sf):
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("puzzle_id"), "p_size")
    return pz.new_only(parts, existing(spark, sf))


@query("uci_to_san", CATALOGUE + "SELECT PuzzleId AS puzzle_id, best_uci, best_san FROM attempts")
def _(spark, sf):
    from plyforge.functions.notation import position_key, words

    moves = catalogue(spark, sf).select(
        F.col("PuzzleId").alias("puzzle_id"),
        position_key(F.col("FEN")).alias("position"),
        F.get(words(F.col("Moves")), 0).alias("best_uci"),
    )
    return pz.uci_to_san(moves, legal_moves(spark, sf)).select("puzzle_id", "best_uci", "best_san")


@query(
    "attach_source_game",
    "SELECT o_orderkey, o_custkey AS game_id, c_name, c_mktsegment FROM orders LEFT JOIN customer ON c_custkey = o_custkey + 100",
)
def _(spark, sf):
    puzzles = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("game_id"))
    source = table(spark, sf, "customer").select((F.col("c_custkey") - 100).alias("game_id"), "c_name", "c_mktsegment")
    return pz.attach_source_game(puzzles, source)


@query("position_context", CATALOGUE + f"SELECT PuzzleId AS puzzle_id, ply::INTEGER AS ply, {CONTEXT} FROM attempts")
def _(spark, sf):
    return attempts(spark, sf).select("puzzle_id", "ply", "pgn_context")


@query(
    "position_context_after_move",
    CATALOGUE
    + f"SELECT PuzzleId AS puzzle_id, nullif(ply, 0)::INTEGER AS ply, CASE WHEN ply > 0 THEN {sql_numbered('moves[1:ply]')} END AS pgn_context FROM attempts",
)
def _(spark, sf):
    found = plan.puzzle_attempts(
        catalogue(spark, sf), legal_moves(spark, sf), game_positions(spark, sf), games(spark, sf), include_start=False
    )
    return found.select("puzzle_id", "ply", "pgn_context")


@query("skip_reasons", CATALOGUE + "SELECT outcome, count(*) AS n FROM attempts GROUP BY outcome")
def _(spark, sf):
    return pz.skip_reasons(attempts(spark, sf))


@query("puzzle_candidates", CATALOGUE + f"SELECT PuzzleId AS puzzle_id, Rating AS rating {CANDIDATES}")
def _(spark, sf):
    found = plan.select_candidates(
        catalogue(spark, sf), existing(spark, sf), 10, 40, ["widget", "red", "hot", "small"], ["rod", "old"]
    )
    return found.select(F.col("PuzzleId").alias("puzzle_id"), F.col("Rating").alias("rating"))


@query(
    "puzzle_dataset",
    CATALOGUE
    + f""", chosen AS (SELECT PuzzleId {CANDIDATES} ORDER BY {sql_shuffle_key(1997, 'PuzzleId')} LIMIT 500)
SELECT PuzzleId AS puzzle_id, game_id, Rating AS rating, replace(Themes, ' ', '|') AS themes, {CONTEXT},
  key || ' 3 ' || PuzzleId AS fen, best_uci AS best_move_uci, best_san AS best_move_san
FROM attempts WHERE outcome = 'written' AND PuzzleId IN (SELECT PuzzleId FROM chosen)""",
)
def puzzle_dataset(spark, sf):
    records = plan.puzzle_dataset(
        catalogue(spark, sf),
        existing(spark, sf),
        legal_moves(spark, sf),
        game_positions(spark, sf),
        games(spark, sf),
        low=10,
        high=40,
        wanted=["widget", "red", "hot", "small"],
        unwanted=["rod", "old"],
    )
    return records.withColumn("themes", F.array_join("themes", "|"))


@query(
    "split_80_10_10",
    f"""WITH r AS (SELECT p_partkey AS puzzle_id, row_number() OVER (ORDER BY {sql_shuffle_key(1997, 'p_partkey')}) AS r,
ceil(count(*) OVER () / 5) AS held FROM part)
SELECT puzzle_id, CASE WHEN r <= ceil(held / 2) THEN 'test' WHEN r <= held THEN 'validation' ELSE 'train' END AS split FROM r""",
)
def _(spark, sf):
    return pz.split_80_10_10(table(spark, sf, "part").select(F.col("p_partkey").alias("puzzle_id")))


@query(
    "theme_histogram",
    "SELECT theme, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS theme FROM part) GROUP BY theme ORDER BY n DESC, theme LIMIT 20",
)
def _(spark, sf):
    return pz.theme_histogram(table(spark, sf, "part").select(F.split("p_name", " ").alias("themes")))


def _describe_sql(name, source):
    return f"""SELECT '{name}' AS "column", count({name}) AS count, round(avg({name}), 6) AS mean, round(stddev_samp({name}), 6) AS std,
min({name})::DOUBLE AS min, round(quantile_cont({name}::DOUBLE, 0.25), 6) AS q25, round(quantile_cont({name}::DOUBLE, 0.5), 6) AS q50,
round(quantile_cont({name}::DOUBLE, 0.75), 6) AS q75, max({name})::DOUBLE AS max FROM {source}"""


@query(
    "describe_numeric",
    _describe_sql("p_size", "part") + " UNION ALL " + _describe_sql("p_retailprice", "part"),
)
def _(spark, sf):
    found = pz.describe_numeric(table(spark, sf, "part"), ["p_size", "p_retailprice"])
    return found.withColumns({c: F.round(c, 6) for c in ("mean", "std", "q25", "q50", "q75")})


@query(
    "dataset_card_stats",
    """SELECT count(*) AS total, trunc(avg(p_size))::INTEGER AS mean_rating, min(p_size) AS min_rating, max(p_size) AS max_rating,
(SELECT string_agg(theme, ', ' ORDER BY n DESC, theme) FROM (
  SELECT theme, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS theme FROM part)
  GROUP BY theme ORDER BY n DESC, theme LIMIT 8)) AS top_themes FROM part""",
)
def _(spark, sf):
    parts = table(spark, sf, "part").select(F.col("p_size").alias("rating"), F.split("p_name", " ").alias("themes"))
    return pz.dataset_card_stats(parts)


def fen_texts(spark, sf):
    """One text per part with a full puzzle, and others without citation or solution."""
    p = F.col("p_partkey")
    text = F.concat(
        F.when(p % 4 != 0, F.concat(F.lit("Cite "), "p_name", F.lit("\n"))).otherwise(""),
        F.lit("a/b/c/d/e/f/g/h w - - 0 "), p, F.lit("\n"),
        F.when(p % 2 == 0, "\n  \n").otherwise(""),
        F.lit("1. "), "p_type", F.lit("x 2. y\n"),
        F.when(p % 3 == 0, "x/b/c/d/e/f/g/h b - - 1 2\n\nno answer\n").otherwise("\nplain / line w x\n"),
        F.lit("  Last one \n"),
        F.lit(" 8/8/8/8/8/8/8/"), "p_size", F.lit(" b - - 5 6 \r\n"),
        F.when(p % 5 == 0, "").otherwise(F.concat(F.lit("\n3. Q"), "p_size", F.lit("+"))),
    )
    return table(spark, sf, "part").select(p.alias("source"), text.alias("text"))


FEN_PUZZLES = """WITH texts AS (SELECT p_partkey AS source,
  CASE WHEN p_partkey % 4 <> 0 THEN 'Cite ' || p_name || chr(10) ELSE '' END || 'a/b/c/d/e/f/g/h w - - 0 ' || p_partkey || chr(10)
  || CASE WHEN p_partkey % 2 = 0 THEN chr(10) || '  ' || chr(10) ELSE '' END || '1. ' || p_type || 'x 2. y' || chr(10)
  || CASE WHEN p_partkey % 3 = 0 THEN 'x/b/c/d/e/f/g/h b - - 1 2' || chr(10) || chr(10) || 'no answer' || chr(10)
       ELSE chr(10) || 'plain / line w x' || chr(10) END
  || '  Last one ' || chr(10) || ' 8/8/8/8/8/8/8/' || p_size || ' b - - 5 6 ' || chr(13) || chr(10)
  || CASE WHEN p_partkey % 5 = 0 THEN '' ELSE chr(10) || '3. Q' || p_size || '+' END AS text FROM part),
parts AS (SELECT source, string_split(text, chr(10)) AS l FROM texts),
lines AS (SELECT source, t.i, trim(l[t.i], ' ' || chr(13) || chr(9)) AS line,
  CASE WHEN t.i > 1 THEN trim(l[t.i - 1], ' ' || chr(13) || chr(9)) ELSE '' END AS citation
  FROM parts, range(1, 30) t(i) WHERE t.i <= len(l)),
next AS (SELECT source, i, line AS fen, citation, lead(line) OVER (PARTITION BY source ORDER BY i) AS solution FROM lines WHERE line <> '')
SELECT source, citation, fen, solution, regexp_extract(solution, '\\d+\\.\\s+(\\S+)', 1) AS best_move FROM next
WHERE length(fen) - length(replace(fen, '/', '')) = 7 AND (contains(fen, ' w ') OR contains(fen, ' b '))
AND regexp_extract(solution, '\\d+\\.\\s+(\\S+)', 1) <> '' AND citation <> ''"""


@query("parse_fen_puzzles", FEN_PUZZLES)
def _(spark, sf):
    return parse_fen_puzzles(fen_texts(spark, sf))


@query(
    "read_fen_puzzles",
    FEN_PUZZLES.replace("AS source,\n  CASE", "AS source,\n  '--- ' || p_partkey || chr(10) || CASE").replace(
        "SELECT source, citation", "SELECT citation"
    ),
)
def _(spark, sf):
    """The same texts one after the other in files, each under a line of its own."""
    path = scratch_path(spark, "fens")
    marked = F.concat(F.lit("--- "), "source", F.lit("\n"), "text")
    texts = fen_texts(spark, sf).select("source", marked.alias("text"))
    texts.repartitionByRange(2, "source").sortWithinPartitions("source").select("text").write.text(path)
    return parse_fen_lines(read_fen_lines(spark, path)).drop("source")
