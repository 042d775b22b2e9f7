"""Puzzle catalogue, puzzle records and FEN puzzle texts."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plyforge.functions.notation import strip_blanks

# Column names of the catalogue and of the records.
CATALOGUE_SCHEMA = (
    "PuzzleId string, FEN string, Moves string, Rating int, RatingDeviation int, "
    "Popularity int, NbPlays int, Themes string, GameUrl string, OpeningTags string"
)
RECORD_SCHEMA = (
    "puzzle_id string, game_id string, rating int, themes array<string>, pgn_context string, "
    "fen string, best_move_uci string, best_move_san string"
)


def read_puzzle_csv(spark: SparkSession, path: str) -> DataFrame:
    """Plain or compressed CSV; the header row gives way to the fixed names.

    A compressed file is read by one task, so its rows are spread before further work.
    """
    rows = (
        spark.read.schema(CATALOGUE_SCHEMA)
        .options(header=True, quote='"', escape='"', mode="PERMISSIVE")
        .csv(path)
    )
    if path.endswith((".zst", ".gz", ".bz2")):
        return rows.repartition(spark.sparkContext.defaultParallelism)
    return rows


def read_puzzles_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Puzzle records, one JSON object per line; blank lines give no row."""
    reader = spark.read.schema(RECORD_SCHEMA)
    names = [field.split()[0] for field in RECORD_SCHEMA.split(", ")]
    return reader.json(path).select(*names).where(F.col("puzzle_id").isNotNull())


def write_puzzles_jsonl(records: DataFrame, path: str) -> None:
    """Append records."""
    records.write.mode("append").json(path)


def write_splits(df: DataFrame, path: str) -> None:
    """One folder per value of `split`."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def _is_fen(line: Column) -> Column:
    slashes = F.length(line) - F.length(F.replace(line, F.lit("/"), F.lit("")))
    return (slashes == 7) & (line.contains(" w ") | line.contains(" b "))


def _with_best_move(puzzles: DataFrame) -> DataFrame:
    """Complete puzzles with the first numbered move of their solution."""
    best = F.regexp_extract("solution", r"\d+\.\s+(\S+)", 1)
    found = puzzles.withColumn("best_move", best)
    return found.where((F.col("best_move") != "") & (F.col("citation") != ""))


def read_fen_lines(spark: SparkSession, path: str) -> DataFrame:
    """(source, split, place, line): the lines of text files of any size, by split of the scan."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("source"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("place"),
        strip_blanks(F.col("value")).alias("line"),
    )


def parse_fen_lines(lines: DataFrame) -> DataFrame:
    """The puzzles of `parse_fen_puzzles` in (source, split, place, line).

    A split is worked through alone, and a short row per split stitches the borders: its last line
    may be the citation of the next split's first line, and its first line that is not blank the
    solution of a position that the splits before left open. What follows a line is looked up from
    the back: a frame that grows is carried on from row to row, one that shrinks is read anew each time.
    """
    back = Window.partitionBy("source", "split").orderBy(F.desc("place"))
    filled = F.when(F.col("line") != "", F.col("line"))
    following = F.last(filled, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1))
    placed = lines.select("*", F.lead("line").over(back).alias("_before"), following.alias("_after"))
    fens = placed.where(_is_fen(F.col("line")))
    by_place = lambda name, pick: pick(name, F.when(F.col(name).isNotNull(), F.col("place")))
    ends = lines.withColumn("_filled", filled).groupBy("source", "split").agg(
        F.max_by("line", "place").alias("_last"), by_place("_filled", F.min_by).alias("_first")
    )
    splits = Window.partitionBy("source").orderBy(F.desc("split"))
    borders = ends.select(
        "source",
        "split",
        F.lead("_last").over(splits).alias("_cited"),
        F.last("_first", ignorenulls=True).over(splits.rowsBetween(Window.unboundedPreceding, -1)).alias("_solved"),
    )
    rows = fens.join(borders, ["source", "split"]).select(
        "source",
        F.coalesce("_before", "_cited", F.lit("")).alias("citation"),
        F.col("line").alias("fen"),
        F.coalesce("_after", "_solved", F.lit("")).alias("solution"),
    )
    return _with_best_move(rows)


def parse_fen_puzzles(texts: DataFrame) -> DataFrame:
    """Puzzles in (source, text): a FEN line, its citation before it, its solution after it.

    The line before the FEN is the citation and the next non-blank line the solution, whose
    first numbered move is the best move. Incomplete puzzles are dropped. Works inside each
    row, so there is no shuffle.
    """
    lines = F.transform(F.split("text", "\n"), strip_blanks)
    cited = texts.withColumn("_lines", lines).withColumn(
        "_cited",
        F.transform(
            "_lines",
            lambda line, i: F.struct(
                line.alias("line"),
                F.when(i > 0, F.get(F.col("_lines"), i - 1)).otherwise("").alias("citation"),
            ),
        ),
    )
    filled = cited.withColumn("_filled", F.filter("_cited", lambda entry: entry["line"] != ""))
    found = filled.withColumn(
        "_found",
        F.transform(
            "_filled",
            lambda entry, i: F.struct(
                entry["citation"].alias("citation"),
                entry["line"].alias("fen"),
                F.coalesce(F.get(F.col("_filled"), i + 1)["line"], F.lit("")).alias("solution"),
            ),
        ),
    )
    puzzles = F.filter("_found", lambda p: _is_fen(p["fen"]))
    return _with_best_move(found.select("source", F.explode(puzzles).alias("p")).select("source", "p.*"))
