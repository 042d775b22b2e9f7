"""Notation, corpus assembly and sampling queries over `documents` and `benchmark`."""

from pyspark.sql import functions as F

from plyforge.catalog.registry import documents, query, table
from plyforge.functions import notation as nt
from plyforge.functions.fixed import SEED_OPENINGS
from plyforge.operators import corpus as co
from plyforge.sources import games as src

# SQL spellings of the column functions.
WORDS = "list_filter(regexp_split_to_array({}, '\\s+'), lambda x: x <> '')"
BLANK = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)"


def sql_numbered(moves):
    return (
        f"array_to_string(list_transform({moves}, lambda x, i: CASE WHEN i % 2 = 1 "
        f"THEN ((i + 1) // 2)::VARCHAR || '.' || x ELSE x END), ' ')"
    )


def sql_split(text):
    return f"list_filter(regexp_split_to_array({text}, '\\s+'), lambda x: x <> '')"


def sql_strip(text):
    return f"trim({text}, {BLANK})"


def sql_strip_result(text, dialect):
    pattern = (
        r"\b(1-0|0-1|1/2-1/2|\*)\s*$" if dialect == "finetune" else r"\s*(1-0|0-1|1/2-1/2|\*)\s*$"
    )
    return sql_strip(f"regexp_replace({text}, '{pattern}', '')")


def sql_half_moves(text, dialect="plain"):
    if dialect != "plain":
        bare = sql_strip(f"replace(replace({text}, '[g_start]', ''), '[g_end]', '')")
        text = sql_strip_result(bare, dialect)
    pattern = r"\d+\.+" if dialect == "evaluation" else r"\d+\.+\s*"
    return sql_split(f"regexp_replace({text}, '{pattern}', ' ', 'g')")


def sql_shuffle_key(seed, *ids):
    parts = " || ':' || ".join(f"({i})::VARCHAR" for i in ids)
    return f"md5('{seed}:' || {parts})"


def word_list(column="text"):
    """All of a text but its white space."""
    return nt.words(F.col(column))


RESULTS = ["", " 1-0", " *", " 1/2-1/2", "*", "\n0-1\n"]
SQL_RESULTS = "CASE doc_id % 6 WHEN 0 THEN '' WHEN 1 THEN ' 1-0' WHEN 2 THEN ' *' WHEN 3 THEN ' 1/2-1/2' WHEN 4 THEN '*' ELSE chr(10) || '0-1' || chr(10) END"
GAMES_SQL = f"games AS (SELECT doc_id AS game_id, {sql_numbered(WORDS.format('text'))} || {SQL_RESULTS} AS pgn FROM documents)"


def games(spark, sf):
    """(game_id, pgn): all words of a document as numbered moves, with a result mark."""
    mark = F.get(F.lit(RESULTS), (F.col("doc_id") % 6).cast("int"))
    return documents(spark, sf, "doc_id", "text").select(
        F.col("doc_id").alias("game_id"), F.concat(nt.numbered_text(word_list()), mark).alias("pgn")
    )


def raw_openings(spark, sf):
    """(opening_id, name, pgn) with a space after each number, from `benchmark`."""
    spaced = F.regexp_replace(nt.numbered_text(word_list()), r"(\d+)\.", "$1. ")
    return table(spark, sf, "benchmark").select(
        F.col("item_id").alias("opening_id"), F.concat(F.lit("line "), "item_id").alias("name"), spaced.alias("pgn")
    )


def openings(spark, sf):
    return src.read_openings(raw_openings(spark, sf))


_SEEDS = ", ".join("({}, '{}', '{}')".format(i, n.replace("'", "''"), p) for i, (n, p) in enumerate(SEED_OPENINGS))
OPENINGS_SQL = f"""openings AS (
  SELECT item_id AS opening_id, 'line ' || item_id AS name, {sql_numbered(WORDS.format('text'))} AS pgn FROM benchmark
  UNION ALL
  SELECT (SELECT max(item_id) FROM benchmark) + 1 + i, n, p FROM (VALUES {_SEEDS}) s(i, n, p))"""


# Sources


@query(
    "read_games",
    f"""WITH c AS (
  SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '' WHEN doc_id % 4 = 1 THEN '  ' WHEN doc_id % 4 = 2 THEN NULL ELSE '1.e4 ' || source END AS a,
         CASE WHEN doc_id % 3 = 0 THEN NULL ELSE lang END AS b, text FROM documents),
g AS (SELECT doc_id, {sql_strip("coalesce(nullif(a, ''), nullif(b, ''), nullif(text, ''))")} AS pgn FROM c)
SELECT doc_id, pgn FROM g WHERE pgn <> '' ORDER BY doc_id LIMIT 700""",
)
def _(spark, sf):
    n = F.col("doc_id")
    first = F.when(n % 4 == 0, "").when(n % 4 == 1, "  ").when(n % 4 == 3, F.concat(F.lit("1.e4 "), "source"))
    second = F.when(n % 3 != 0, F.col("lang"))
    wide = table(spark, sf, "documents").select(
        "doc_id", first.alias("pgn"), second.alias("PGN"), "text"
    )
    return src.read_games(wide, "doc_id", limit=700)


@query("read_openings", f"WITH {OPENINGS_SQL} SELECT * FROM openings")
def _(spark, sf):
    return openings(spark, sf)


@query("read_corpus", "SELECT text FROM documents")
def _(spark, sf):
    return src.read_corpus(spark, f"{sf}/documents.parquet", "text")


# Column functions

for _dialect in ("plain", "finetune", "evaluation"):

    @query(
        f"half_moves_{_dialect}",
        f"WITH {GAMES_SQL} SELECT game_id, array_to_string({sql_half_moves('pgn', _dialect)}, '|') AS moves FROM games",
    )
    def _(spark, sf, dialect=_dialect):
        moves = nt.parse_half_moves(F.col("pgn"), dialect)
        return games(spark, sf).select("game_id", F.array_join(moves, "|").alias("moves"))


@query(
    "strip_result",
    f"""WITH {GAMES_SQL} SELECT game_id, {sql_strip_result('pgn', 'finetune')} AS finetune,
{sql_strip_result('pgn', 'evaluation')} AS evaluation FROM games""",
)
def _(spark, sf):
    return games(spark, sf).select(
        "game_id",
        nt.strip_result(F.col("pgn"), "finetune").alias("finetune"),
        nt.strip_result(F.col("pgn"), "evaluation").alias("evaluation"),
    )


@query(
    "wrap_special",
    f"""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '  [g_start]' || text ELSE chr(10) || text || ' ' END AS t FROM documents),
s AS (SELECT doc_id, {sql_strip('t')} AS t FROM t)
SELECT doc_id, CASE WHEN starts_with(t, '[g_start]') THEN t ELSE '[g_start]' || t || '[g_end]' END AS wrapped FROM s""",
)
def _(spark, sf):
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("  [g_start]"), "text")).otherwise(
        F.concat(F.lit("\n"), "text", F.lit(" "))
    )
    return table(spark, sf, "documents").select("doc_id", nt.wrap_special(text).alias("wrapped"))


@query("numbered_text", f"SELECT doc_id, {sql_numbered(WORDS.format('text'))} AS pgn FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", nt.numbered_text(word_list()).alias("pgn"))


@query(
    "canonical_context",
    f"WITH {GAMES_SQL} SELECT game_id, {sql_numbered(sql_half_moves('pgn', 'evaluation'))} AS context FROM games",
)
def _(spark, sf):
    return games(spark, sf).select("game_id", nt.canonical_context(F.col("pgn")).alias("context"))


@query(
    "position_key",
    """SELECT event_id, event_type || '/' || user_id || ' ' || (CASE WHEN event_id % 2 = 0 THEN 'w' ELSE 'b' END)
|| ' KQkq -' AS key FROM events""",
)
def _(spark, sf):
    side = F.when(F.col("event_id") % 2 == 0, "w").otherwise("b")
    fen = F.concat_ws(
        " ", F.concat("event_type", F.lit("/"), "user_id"), side, F.lit("KQkq"), F.lit("-"), F.col("event_id") % 50, F.col("event_id")
    )
    return table(spark, sf, "events").select("event_id", nt.position_key(fen).alias("key"))


@query(
    "game_id_from_url",
    "SELECT page_id, string_split(string_split(url, '/')[4], '#')[1] AS game_id FROM pages",
)
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", nt.game_id_from_url(F.col("url")).alias("game_id"))


@query(
    "normalise_san",
    f"""SELECT event_id, {sql_strip("rtrim(coalesce(CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type || CASE event_id % 4 WHEN 0 THEN '+' WHEN 1 THEN '#' WHEN 2 THEN '+#' ELSE '' END END, ''), '+#')")} AS san FROM events""",
)
def _(spark, sf):
    n = F.col("event_id")
    sign = F.get(F.lit(["+", "#", "+#", ""]), (n % 4).cast("int"))
    move = F.when(n % 7 != 0, F.concat("event_type", sign))
    return table(spark, sf, "events").select("event_id", nt.normalise_san(move).alias("san"))


@query(
    "next_move",
    f"""WITH {GAMES_SQL}, p AS (SELECT game_id, pgn, {sql_half_moves('pgn', 'evaluation')} AS moves FROM games)
SELECT game_id, moves[len(moves) // (1 + game_id % 3) + 1] AS next_move FROM p""",
)
def _(spark, sf):
    parsed = games(spark, sf).withColumn("moves", nt.parse_half_moves(F.col("pgn"), "evaluation"))
    shown = F.expr("slice(moves, 1, cast(size(moves) div (1 + game_id % 3) as int))")
    prefix = parsed.withColumn("prefix", nt.numbered_text(shown))
    return prefix.select("game_id", nt.next_move(F.col("prefix"), F.col("pgn")).alias("next_move"))


@query(
    "first_move_token",
    f"""WITH t AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN ' 12. ' WHEN 1 THEN '3...' ELSE '4. 5.' END || text AS t FROM documents)
SELECT doc_id, {sql_split(f"regexp_replace({sql_strip('t')}, '^' || chr(92) || 'd+' || chr(92) || '.+' || chr(92) || 's*', '')")}[1] AS first,
list_filter(list_transform({sql_split('t')}, lambda x: regexp_replace(x, '^\\d+\\.+', '')), lambda x: x <> '')[1] AS completion FROM t""",
)
def _(spark, sf):
    lead = F.get(F.lit([" 12. ", "3...", "4. 5."]), (F.col("doc_id") % 3).cast("int"))
    text = F.concat(lead, "text")
    return table(spark, sf, "documents").select(
        "doc_id",
        nt.first_move_token(text).alias("first"),
        nt.first_completion_token(text).alias("completion"),
    )


_MARKED = "regexp_replace(pgn, '({})', chr(1) || '\\1' || chr(1), 'g')"


@query(
    "pretokenize",
    f"""WITH {GAMES_SQL} SELECT game_id,
array_to_string(list_filter(string_split({_MARKED.format(nt.TRAINER_PIECES)}, chr(1)), lambda x: x <> ''), '|') AS pieces,
array_to_string(regexp_extract_all(pgn, '{nt.NOTEBOOK_PIECES}'), '|') AS found FROM games""",
)
def _(spark, sf):
    return games(spark, sf).select(
        "game_id",
        F.array_join(nt.pretokenize(F.col("pgn")), "|").alias("pieces"),
        F.array_join(nt.find_pieces(F.col("pgn")), "|").alias("found"),
    )


_PARTS = sql_half_moves("pgn")


@query(
    "prompts",
    f"""WITH {OPENINGS_SQL}, p AS (SELECT pgn, {_PARTS} AS moves FROM openings)
SELECT DISTINCT '[g_start]' || pgn AS prompt FROM p
UNION SELECT '[g_start]' || {sql_numbered('moves[1:t.k]')} FROM p, (VALUES (2), (4), (6)) t(k) WHERE t.k < len(moves)""",
)
def _(spark, sf):
    return co.prompts(openings(spark, sf))


# Corpus assembly


@query(
    "min_half_moves",
    f"WITH {GAMES_SQL}, p AS (SELECT game_id, {sql_half_moves('pgn', 'finetune')} AS moves FROM games) SELECT game_id, len(moves)::INTEGER AS n FROM p WHERE len(moves) >= 60",
)
def _(spark, sf):
    from plyforge.operators.replay import min_half_moves

    parsed = games(spark, sf).select("game_id", nt.parse_half_moves(F.col("pgn"), "finetune").alias("moves"))
    return min_half_moves(parsed, 60).select("game_id", F.size("moves").alias("n"))


@query("oversample", "SELECT item_id, text, t.c::INTEGER AS copy FROM benchmark, range(1, 11) t(c)")
def _(spark, sf):
    return co.oversample(table(spark, sf, "benchmark"), 10)


@query(
    "seeded_shuffle",
    f"SELECT doc_id, {sql_shuffle_key(7, 'doc_id')} AS shuffle_key FROM documents",
)
def _(spark, sf):
    return co.seeded_shuffle(table(spark, sf, "documents").select("doc_id"), "doc_id", seed=7)


@query(
    "seeded_sample",
    f"SELECT event_id, user_id FROM events ORDER BY {sql_shuffle_key(7, 'event_id')} LIMIT 1234",
)
def _(spark, sf):
    return co.seeded_sample(table(spark, sf, "events").select("event_id", "user_id"), 1234, "event_id", seed=7)


_HELD = "(SELECT least(2000, greatest(100, count(*) // 10)) FROM documents)"


@query(
    "tail_holdout",
    f"""SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id DESC) <= {_HELD} THEN 'validation' ELSE 'train' END AS split
FROM documents""",
)
def _(spark, sf):
    return co.tail_holdout(table(spark, sf, "documents").select("doc_id"), "doc_id")


@query(
    "pretrain_corpus",
    f"""WITH {OPENINGS_SQL}
SELECT ('0x' || substr({sql_shuffle_key(1997, 'opening_id', 't.c')}, 1, 15))::BIGINT - 1152921504606846976 AS order_key, 'train' AS split, pgn
FROM openings, range(1, 11) t(c)
UNION ALL
SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id DESC) <= {_HELD} THEN 'validation' ELSE 'train' END, {sql_strip('text')}
FROM documents""",
)
def _(spark, sf):
    texts = src.read_games(table(spark, sf, "documents").select(F.col("doc_id").alias("game_id"), "text"), "game_id")
    return co.pretrain_corpus(texts, openings(spark, sf))


@query(
    "finetune_corpus",
    f"""WITH {OPENINGS_SQL},
legal AS (SELECT doc_id AS game_id, text AS pgn FROM documents WHERE n_chars > 500),
placed AS (SELECT *, row_number() OVER (ORDER BY {sql_shuffle_key(1997, "'validation'", 'game_id')}) AS r,
           greatest(20, count(*) OVER () // 10) AS held FROM legal),
rows AS (
SELECT CASE WHEN r <= held THEN 'validation' ELSE 'train' END AS split, 'generated' AS source, game_id AS source_id, 1 AS copy, pgn FROM placed
UNION ALL SELECT 'train', 'opening', opening_id, t.c::INTEGER, pgn FROM openings, range(1, 21) t(c)
UNION ALL SELECT 'train', 'anchor', doc_id, 1, text FROM documents WHERE n_chars <= 500)
SELECT *, {sql_shuffle_key(1997, 'source', 'source_id', 'copy')} AS shuffle_key FROM rows""",
)
def _(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("game_id"), F.col("text").alias("pgn"), "n_chars")
    legal = docs.where(F.col("n_chars") > 500).drop("n_chars")
    anchor = docs.where(F.col("n_chars") <= 500).drop("n_chars")
    return co.finetune_corpus(legal, openings(spark, sf), anchor)


@query(
    "pair_split",
    f"""SELECT event_id, CASE WHEN row_number() OVER (ORDER BY {sql_shuffle_key(1997, 'event_id')}) <=
greatest(10, (SELECT count(*) // 10 FROM events)) THEN 'validation' ELSE 'train' END AS split FROM events""",
)
def _(spark, sf):
    return co.pair_split(table(spark, sf, "events").select("event_id"), "event_id")
