"""A training corpus in five stages, each over all that the one before kept.

Each stage's rows are to be written and read again by the next, which then deletes what the stages
before it left in the scratch folder, so that disk is needed for one stage at a time.

Defined cases, in all stages: a null text counts as empty and stays null; rows without an id stay
and are compared with nothing; texts of any length are taken whole; of equal documents the smallest
id stays; repeated rows stay or go together; an empty table gives none; other columns, of any name,
pass through all stages but the last.
"""

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plyforge.llm import decontamination, minhash, packing, suffixes, toxicity
from plyforge.llm.registry import table
from plyforge.session import noted_scratch, removed, written

_LEFT = []


def frugal(stage):
    """A stage that gives back the scratch tables of earlier stages that its input doesn't read."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = "\n".join(docs.inputFiles()) if _LEFT else ""
        for path in [path for path in _LEFT if path.rsplit("/", 1)[1] not in read]:
            removed(spark, path)
            _LEFT.remove(path)
        with noted_scratch() as made:
            out = stage(spark, docs, sf_dir)
        _LEFT.extend(made)
        return out

    return run


@frugal
def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the threshold."""
    labels = table(spark, sf_dir, "labels")
    return toxicity.reject(docs, labels, keep=lambda doc_id: ~toxicity.held_out(doc_id))


@frugal
def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return minhash.deduplicate(docs).select(*docs.columns)


@frugal
def cut_repeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes that an earlier document holds; their length follows the text."""
    cut = suffixes.deduplicate(docs)
    if "n_chars" not in docs.columns:
        return cut
    kind = dict(docs.dtypes)["n_chars"]
    length = F.when(F.col("text").isNotNull(), F.length("text").cast(kind)).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", length)


@frugal
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no more than traces of benchmark items."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


@frugal
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents in sequences of at most 2048."""
    return packing.pack(docs).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("toxicity", reject_toxic),
    ("minhash near-dedup", one_of_each_group),
    ("suffix-array dedup", cut_repeated),
    ("benchmark decontamination", drop_contaminated),
    ("packing", packed),
]

#: The learned score, the components and the token ids are not SQL; tests use plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each stage's rows are written and read again by the next."""
    docs, given = table(spark, sf_dir, "documents"), []
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            with noted_scratch() as made:
                docs = written(docs, f"stage{number}")
            for path in given:
                removed(spark, path)
            given = made
    return docs
