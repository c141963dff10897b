"""File streams: the row labellers are stateless, so they run on streams unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.labels import bin_score, sentiment_from_scores, toxicity_from_scores
from ..operators.labellers import with_cleaned, with_lexicon_scores, with_theme
from ..plans.workspace import new_folder
from ..sources.readers import ingest_landing


def score_reviews(df: DataFrame, text: str = "content") -> DataFrame:
    """Cleaned text, theme, sentiment and toxicity of each review; batch or stream."""
    scored = with_lexicon_scores(with_theme(with_cleaned(df, text)))
    points = ("negative_score", "positive_score")
    return scored.select(
        *(c for c in scored.columns if c not in points),
        sentiment_from_scores(*points).alias("sentiment"),
        toxicity_from_scores(*points).alias("toxicity_score"),
    ).withColumn("toxicity_category", bin_score("toxicity_score"))


def landing_stream(spark: SparkSession, path: str, fmt: str, schema: str, pattern: str | None = None) -> DataFrame:
    """Stream of new files in a landing directory."""
    reader = spark.readStream.format(fmt).schema(schema)
    if pattern is not None:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path)


def table_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Stream of a Parquet table, which is one file or a folder of files.

    A stream takes a folder or a pattern, but not the path of one file; a pattern that only the path
    itself matches stands for both.
    """
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")


def append_to(stream: DataFrame, path: str, checkpoint: str, fmt: str = "parquet"):
    """Append all available input to a table folder, exactly once; returns the query."""
    return (
        stream.writeStream.format(fmt)
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )


def ingest_stream(stream: DataFrame, path: str, checkpoint: str, fmt: str = "csv"):
    """Collected records with only their text, appended as files."""
    return append_to(ingest_landing(stream), path, checkpoint, fmt)


def incremental_scoring(
    stream: DataFrame, text: str = "content", path: str | None = None, partitions: int | None = None
) -> DataFrame:
    """Score everything a file stream holds now and return the table that was written.

    ``partitions`` spreads each batch where the files have fewer row groups than cores.
    """
    spark = stream.sparkSession
    if partitions is not None:
        stream = stream.repartition(partitions)
    target = path or new_folder(spark, "scored")
    scored = score_reviews(stream, text)
    append_to(scored, target, new_folder(spark, "stream")).awaitTermination()
    return spark.read.schema(scored.schema).parquet(target)  # without input there are no files to take it from
