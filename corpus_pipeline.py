"""A training corpus from raw documents, in five stages.

Every stage reads the documents that the stage before wrote and returns the columns of documents;
the last one adds the shard and the slot. Documents that a stage keeps pass unchanged, but for
the mix, which repeats documents and cuts one per source.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from opinweave.llm import decontam, langid, mixing, neardup, sharding
from opinweave.llm.common import table
from opinweave.plans.workspace import new_folder

#: Documents whose language is less certain than this are rejected.
LEAST_SCORE = 0.5
N_SHARDS = 40


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters, or in no language with certainty."""
    labelled = langid.predict(docs, langid.train(docs))
    good = (F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)
    return labelled.where(good).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group: five-word shingles, similarity 0.8."""
    return neardup.one_of_each(docs, k=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten words in a row of a benchmark item, or a whole shorter one."""
    return decontam.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats, drops and cuts documents so that the sources have their target weights, shard by shard."""
    return mixing.mixed_documents(docs)


def shard_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds ``shard`` and ``slot``: a reproducible shuffle into equal shards."""
    return sharding.shard(docs, N_SHARDS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard_documents),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of ``sf_dir`` after all stages, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = new_folder(spark, "pipeline")
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


# Fitted languages, hashed signatures and the seeded permutation have no SQL form.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
