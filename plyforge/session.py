"""Session settings and the shared checkpoint folder."""

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


LOCAL_CHECKPOINTS = "/tmp/checkpoints"
_NOTES = []


def local_session(cpus="*", app="plyforge", partitions=8, **conf) -> SparkSession:
    """A session for tests and benchmarks; on a cluster the submitter brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder for written intermediate rows.

    It is the cluster's `spark.checkpoint.dir`. Only a local run without that setting, where the
    driver's disk is all there is, gets a folder named after the application.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
            folder = f"{LOCAL_CHECKPOINTS}/{context.applicationId}"
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Write `df` to the checkpoint folder and continue from the written rows."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new place for a table in the checkpoint folder."""
    path = f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"
    for notes in _NOTES:
        notes.append(path)
    return path


@contextmanager
def noted_scratch():
    """The list of all places taken inside, so that they can be given back later."""
    notes = []
    _NOTES.append(notes)
    try:
        yield notes
    finally:
        _NOTES.remove(notes)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as a table in the checkpoint folder and read it back by column."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, buckets: int, name: str) -> DataFrame:
    """`written`, with the rows of each task put in buckets by `key`; joins on it do not shuffle them."""
    spark, table = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd").option("path", scratch_path(spark, name))
    writer.bucketBy(buckets, key).saveAsTable(table)
    rows = spark.table(table)
    rows.schema  # resolved, so that it outlives the name; the files stay
    spark.sql(f"DROP TABLE {table}")
    return rows


def removed(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
