"""File, streaming and plug-in queries: tables are written, taken in again and compared."""

from pyspark.sql import functions as F

from plyforge.catalog import puzzles as pzc
from plyforge.catalog.corpus import sql_shuffle_key
from plyforge.catalog.pairs import CANDIDATES, LOSSES, candidates
from plyforge.catalog.registry import query, table
from plyforge.catalog.runs import LOG_LINES, log_lines
from plyforge.catalog.tokens import SHOWN_MERGES, TRAINED, text_vocabulary
from plyforge.operators import pairs as pr
from plyforge.operators import plugins
from plyforge.operators.puzzles import split_80_10_10
from plyforge.plans.puzzle_dataset import puzzle_records
from plyforge.session import scratch_path
from plyforge.sources import games as src_games
from plyforge.sources import puzzles as src
from plyforge.sources import tables as tables
from plyforge.streaming import jobs
from plyforge.streaming.logs import file_system

PART_ROWS = """SELECT p_partkey::VARCHAR AS PuzzleId, p_name AS Themes, CASE WHEN p_partkey % 8 = 0 THEN NULL ELSE p_size END AS Rating,
'x, "' || p_brand || '"' AS OpeningTags FROM part"""


@query("read_puzzle_csv", PART_ROWS)
def _(spark, sf):
    path = scratch_path(spark, "catalogue")
    p = F.col("p_partkey")
    rating = F.when(p % 8 == 0, "unrated").otherwise(F.col("p_size").cast("string"))
    tag = F.concat(F.lit('x, "'), "p_brand", F.lit('"'))
    rows = table(spark, sf, "part").select(
        p.alias("a"), F.lit("fen").alias("b"), F.lit("u1").alias("c"), rating.alias("d"), F.lit(1).alias("e"),
        F.lit(2).alias("f"), F.lit(3).alias("g"), F.col("p_name").alias("h"), F.lit("url").alias("i"), tag.alias("j"),
    )
    rows.write.options(header=True, quote='"', escape='"').csv(path)
    return src.read_puzzle_csv(spark, path).select("PuzzleId", "Themes", "Rating", "OpeningTags")


@query("read_game_csv", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE lang || ',' || source END AS PGN FROM documents")
def _(spark, sf):
    path = scratch_path(spark, "games")
    text = F.when(F.col("doc_id") % 3 == 0, "None").otherwise(F.concat_ws(",", "lang", "source"))
    rows = table(spark, sf, "documents").select("doc_id", text.alias("PGN"))
    rows.write.options(header=True, quote='"', escape='"').csv(path)
    return src_games.read_game_csv(spark, path, "doc_id long, PGN string")


@query(
    "puzzles_jsonl",
    pzc.CATALOGUE
    + f"""SELECT PuzzleId::VARCHAR AS puzzle_id, game_id, Rating AS rating, replace(Themes, ' ', '|') AS themes, {pzc.CONTEXT},
  key || ' 3 ' || PuzzleId AS fen, best_uci AS best_move_uci, best_san AS best_move_san FROM attempts WHERE outcome = 'written'""",
)
def _(spark, sf):
    path = scratch_path(spark, "records")
    records = puzzle_records(pzc.attempts(spark, sf)).withColumn("puzzle_id", F.col("puzzle_id").cast("string"))
    for rest in (0, 1):
        src.write_puzzles_jsonl(records.where(F.col("rating") % 2 == rest), path)
    return src.read_puzzles_jsonl(spark, path).withColumn("themes", F.array_join("themes", "|"))


@query("pairs_table", f"WITH {CANDIDATES}, {LOSSES} SELECT position::VARCHAR AS context, chosen, rejected, cp_chosen, cp_rejected FROM pairs")
def _(spark, sf):
    path = scratch_path(spark, "pairs")

    def build():
        pairs = pr.pair_candidates(candidates(spark, sf))
        return pairs.withColumnRenamed("position", "context").withColumn("context", F.col("context").cast("string"))

    tables.pairs_table(spark, path, build)
    return tables.pairs_table(spark, path, build=None)


@query(
    "write_splits",
    f"""WITH r AS (SELECT p_partkey AS puzzle_id, row_number() OVER (ORDER BY {sql_shuffle_key(1997, 'p_partkey')}) AS r,
ceil(count(*) OVER () / 5) AS held FROM part)
SELECT CASE WHEN r <= ceil(held / 2) THEN 'test' WHEN r <= held THEN 'validation' ELSE 'train' END AS split, count(*) AS n FROM r GROUP BY 1""",
)
def _(spark, sf):
    path = scratch_path(spark, "splits")
    src.write_splits(split_80_10_10(table(spark, sf, "part").select(F.col("p_partkey").alias("puzzle_id"))), path)
    return spark.read.parquet(path).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("write_results", "SELECT user_id, event_type, value, CASE WHEN event_id % 4 <> 0 THEN props END AS props FROM events")
def _(spark, sf):
    path = scratch_path(spark, "results")
    props = F.when(F.col("event_id") % 4 != 0, F.col("props")).alias("props")
    tables.write_results(table(spark, sf, "events").select("user_id", "event_type", "value", props), path)
    return tables.read_results(spark, path, "user_id long, event_type string, value double, props string")


@query("merge_files", f"{TRAINED} {SHOWN_MERGES} FROM merges")
def _(spark, sf):
    path = scratch_path(spark, "merges")
    tables.write_merges(text_vocabulary(spark, sf)[0], path)
    return tables.read_merges(spark, path)


# Streaming


@query(
    "sync_puzzles_stream",
    pzc.CATALOGUE
    + f"""SELECT PuzzleId::VARCHAR AS puzzle_id, game_id, Rating AS rating, {pzc.CONTEXT}, best_san AS best_move_san FROM attempts WHERE outcome = 'written'""",
)
def sync_puzzles_stream(spark, sf):
    """Two arrivals with common rows, the second after a restart."""
    folder = scratch_path(spark, "sync")
    rows = pzc.catalogue(spark, sf)

    def build(fresh):
        records = puzzle_records(pzc.attempts(spark, sf, fresh))
        return records.withColumn("puzzle_id", F.col("puzzle_id").cast("string"))

    for arrived in (F.col("PuzzleId") % 3 < 2, F.col("PuzzleId") % 3 > 0):
        rows.where(arrived).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
        jobs.sync_puzzles_stream(stream, f"{folder}/out", f"{folder}/checkpoint", build)
    found = src.read_puzzles_jsonl(spark, f"{folder}/out")
    return found.select("puzzle_id", "game_id", "rating", "pgn_context", "best_move_san")


@query(
    "resume_eval_stream",
    """SELECT user_id AS puzzle_id, event_type AS model,
CASE WHEN count(*) FILTER (event_id % 2 = 0) > 0 THEN max_by(value, event_id) FILTER (event_id % 2 = 0) ELSE max_by(value, event_id) END AS value,
CASE WHEN count(*) FILTER (event_id % 2 = 0) > 0 THEN max(event_id) FILTER (event_id % 2 = 0) ELSE max(event_id) END AS event_id
FROM events GROUP BY ALL""",
)
def resume_eval_stream(spark, sf):
    """Results that arrive in two parts; a finished key keeps its first result."""
    folder = scratch_path(spark, "resume")
    rows = table(spark, sf, "events").select(
        F.col("user_id").alias("puzzle_id"), F.col("event_type").alias("model"), "value", "event_id"
    )
    for rest in (0, 1):
        rows.where(F.col("event_id") % 2 == rest).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
        jobs.resume_eval_stream(stream, f"{folder}/out", f"{folder}/checkpoint", "event_id")
    return spark.read.parquet(f"{folder}/out")


def _write_logs(lines, place):
    """One file `run=…/log` per run, in place of an earlier, shorter one; rows (run, value) are sorted by run."""

    def write(batches):
        system, root = file_system(place)
        last, file = None, None
        for batch in batches:
            for run, value in zip(batch.column("run").to_pylist(), batch.column("value").to_pylist()):
                if file is None or run != last:
                    if file is not None:
                        file.close()
                    folder = f"{root}/run={'__HIVE_DEFAULT_PARTITION__' if run is None else run}"
                    system.create_dir(folder)
                    last, file = run, system.open_output_stream(f"{folder}/log", buffer_size=1 << 16)
                file.write(f"{value or ''}\n".encode())
            yield batch.slice(0, 0)
        if file is not None:
            file.close()

    lines.mapInArrow(write, lines.schema).write.format("noop").mode("overwrite").save()


@query("round_log_stream", LOG_LINES.replace("SELECT run, min_by", "SELECT run::VARCHAR AS run, min_by"))
def round_log_stream(spark, sf):
    """Logs by run, one file each, that have grown when the stream runs for the second time."""
    folder = scratch_path(spark, "logs")
    lines = log_lines(spark, sf).repartition("run").sortWithinPartitions("run", "line_no")
    shown = lines.select("run", F.col("line").alias("value"), "line_no")
    half = (shown.agg(F.max("line_no")).first()[0] or 0) // 2
    for part in (shown.where(F.col("line_no") < half), shown):
        _write_logs(part.select("run", "value"), f"{folder}/in")
        jobs.round_log_stream(spark, f"{folder}/in", f"{folder}/out", f"{folder}/checkpoint")
    return jobs.round_summary(spark, f"{folder}/out")


# Plug-ins


def _echo(prompts, samples):
    return [
        RuntimeError("model error") if sample == 2 else f"{sample}:{prompt[::-1]}"
        for prompt, sample in zip(prompts, samples)
    ]


@query(
    "batch_generate",
    "SELECT item_id AS prompt_id, t.s::INTEGER AS sample_idx, CASE WHEN t.s <> 2 THEN t.s || ':' || reverse(text) END AS text, CASE WHEN t.s = 2 THEN 'RuntimeError: model error' END AS error FROM benchmark, range(0, 4) t(s)",
)
def _(spark, sf):
    prompts = table(spark, sf, "benchmark").select(F.col("item_id").alias("prompt_id"), F.col("text").alias("prompt"))
    return plugins.batch_generate(prompts, 4, _echo)


def _lines(positions, k):
    return [
        RuntimeError("engine error")
        if position % 7 == 0
        else [(f"m{(position + i) % 50}", 100 - 10 * i) for i in range(k + 2)]
        for position in positions
    ]


@query(
    "batch_candidates",
    """SELECT position, t.i::INTEGER AS pv_rank, 'm' || ((position + t.i - 1) % 50) AS move, (110 - 10 * t.i)::INTEGER AS cp, NULL::VARCHAR AS error
FROM (SELECT DISTINCT user_id AS position FROM events WHERE user_id % 7 <> 0), range(1, 6) t(i)
UNION ALL SELECT DISTINCT user_id, NULL, NULL, NULL, 'RuntimeError: engine error' FROM events WHERE user_id % 7 = 0""",
)
def _(spark, sf):
    positions = table(spark, sf, "events").select(F.col("user_id").alias("position")).distinct()
    return plugins.batch_candidates(positions, _lines)
