"""Result files, merge tables and the cached pair table."""

from pyspark.sql import DataFrame, SparkSession

MERGE_SCHEMA = "rank int, left string, right string, token string"
PAIR_SCHEMA = "context string, chosen string, rejected string, cp_chosen int, cp_rejected int"


def write_results(df: DataFrame, path: str) -> None:
    """Result CSV with a header; list columns must be joined to text first."""
    df.write.mode("overwrite").option("header", True).csv(path)


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def write_merges(merges: DataFrame, path: str) -> None:
    """The ranked merge list; both sides keep their own column since symbols may hold spaces."""
    merges.select("rank", "left", "right", "token").write.mode("overwrite").parquet(path)


def read_merges(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MERGE_SCHEMA).parquet(path).orderBy("rank")


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def children(spark: SparkSession, path: str) -> list:
    """Names in a folder that a reader takes, in order; none if there is no such folder."""
    if not exists(spark, path):
        return []
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    entries = place.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(place)
    names = [entry.getPath().getName() for entry in entries]
    return sorted(name for name in names if not name.startswith(("_", ".")))


def has_data(spark: SparkSession, path: str) -> bool:
    """Whether a folder holds files that a reader takes."""
    return bool(children(spark, path))


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a finished Spark write is at `path`."""
    return exists(spark, f"{path}/_SUCCESS")


def pairs_table(spark: SparkSession, path: str, build, rebuild=False) -> DataFrame:
    """The pair table at `path`; `build()` makes it when it is missing or on request."""
    if rebuild or not is_complete(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.schema(PAIR_SCHEMA).parquet(path)


def read_pairs_json(spark: SparkSession, path: str) -> DataFrame:
    """Pairs stored as one JSON array."""
    return spark.read.schema(PAIR_SCHEMA).option("multiLine", True).json(path)
