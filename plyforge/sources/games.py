"""Games and openings."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plyforge.functions.fixed import SEED_OPENINGS
from plyforge.functions.notation import opening_spacing, strip_blanks
from plyforge.scale import order_cut

# Fixed value: where a game's text may be, in order of preference.
TEXT_COLUMNS = ("pgn", "PGN", "text")


def read_games(df: DataFrame, order: str, limit=None) -> DataFrame:
    """(order, pgn): the first non-empty text column, trimmed; games without text are dropped.

    `limit` keeps the first games in `order`, a unique number. A text of blanks counts as
    text when the column is chosen, and is dropped after.
    """
    places = {name: i for i, name in enumerate(df.columns)}
    plain = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    texts = [F.col(f"_c{places[name]}") for name in TEXT_COLUMNS if name in places]
    chosen = F.coalesce(*[F.nullif(text, F.lit("")) for text in texts])
    games = plain.select(
        F.col(f"_c{places[order]}").alias(order), strip_blanks(chosen).alias("pgn")
    ).where(F.col("pgn") != "")
    if limit is None:
        return games
    if games.count() <= limit:
        return games
    return games.where(F.col(order) <= order_cut(games, order, limit))


def read_openings(df: DataFrame) -> DataFrame:
    """(opening_id, name, pgn) in the compact spacing, with the seed openings at the end."""
    listed = df.select("opening_id", "name", opening_spacing(F.col("pgn")).alias("pgn"))
    seeds = df.sparkSession.createDataFrame(
        [(i, *seed) for i, seed in enumerate(SEED_OPENINGS)], "place long, name string, pgn string"
    )
    after = F.coalesce(df.agg(F.max("opening_id")).scalar() + 1, F.lit(0))
    return listed.unionByName(
        seeds.select((F.col("place") + after).alias("opening_id"), "name", "pgn")
    )


def read_game_csv(spark: SparkSession, path: str, schema: str, null="None") -> DataFrame:
    """CSV with a header and its own null marker."""
    return spark.read.schema(schema).options(header=True, nullValue=null, quote='"', escape='"').csv(path)


def read_corpus(spark: SparkSession, path: str, column: str) -> DataFrame:
    """One text column of a columnar corpus."""
    return spark.read.parquet(path).select(column)
