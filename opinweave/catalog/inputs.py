"""Shared inputs of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as tx
from ..operators import labellers as lab
from ..sources.balance import spread

# Emotion keywords for the test tables, whose texts are invented words: function words of
# their four languages, so that every emotion occurs.
PROBE_EMOTIONS = {
    "joy": {"the": 1.0, "le": 0.5, "y": 0.5},
    "love": {"and": 1.0, "la": 1.5, "por": 1.0},
    "surprise": {"of": 1.0, "des": 1.0, "en": 0.5},
    "anger": {"to": 1.5, "der": 1.0, "que": 0.5},
    "sadness": {"in": 1.0, "die": 1.5, "los": 1.0},
    "fear": {"is": 1.5, "und": 0.5, "par": 1.0},
    "optimism": {"for": 1.0, "el": 1.5, "une": 0.5},
    "disgust": {"with": 2.0, "das": 2.0, "las": 2.0},
    "neutral": {},
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def reviews(spark: SparkSession, sf: str) -> DataFrame:
    """``id, app, content`` from the documents."""
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.col("source").alias("app"), F.col("text").alias("content")
    )
    return spread(docs)


def cleaned(spark: SparkSession, sf: str) -> DataFrame:
    return lab.with_cleaned(reviews(spark, sf))


def themed(spark: SparkSession, sf: str) -> DataFrame:
    return lab.with_theme(cleaned(spark, sf))


def sentiment(spark: SparkSession, sf: str) -> DataFrame:
    return lab.with_sentiment_label(lab.with_lexicon_sentiment(cleaned(spark, sf)))


def theme_and_sentiment(spark: SparkSession, sf: str) -> DataFrame:
    return lab.with_sentiment_label(lab.with_lexicon_sentiment(themed(spark, sf)))


def emotions(spark: SparkSession, sf: str) -> DataFrame:
    return lab.with_emotion(cleaned(spark, sf), lab.lexicon_emotion_scorer(PROBE_EMOTIONS))


def theme_and_emotion(spark: SparkSession, sf: str) -> DataFrame:
    return lab.with_emotion(themed(spark, sf), lab.lexicon_emotion_scorer(PROBE_EMOTIONS))


def toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return lab.with_toxicity(cleaned(spark, sf))


def theme_and_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return lab.with_toxicity(themed(spark, sf).where("theme is not null"))


def event_scores(spark: SparkSession, sf: str) -> DataFrame:
    """``event_type, value, score`` where some scores lie above 1."""
    events = table(spark, sf, "events")
    return events.select("event_id", "event_type", "value", (F.col("value") / 20.0).alias("score"))


def marks(spark: SparkSession, sf: str) -> DataFrame:
    """``id, quality, toxic, y``: ``y`` is 0 if toxic, else 2 if of good quality, else 1."""
    y = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 1, 2).otherwise(1)
    return table(spark, sf, "labels").withColumnRenamed("doc_id", "id").withColumn("y", y)


def labelled_reviews(spark: SparkSession, sf: str) -> DataFrame:
    """Cleaned reviews that have a label; only those are cleaned."""
    return lab.with_cleaned(reviews(spark, sf).join(marks(spark, sf), "id"))


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """``id, y`` and one column per scorer: keywords, text length, word count."""
    rows = lab.with_lexicon_sentiment(labelled_reviews(spark, sf), out="keywords")
    left = F.pmod(tx.word_count("cleaned_text"), F.lit(4))
    return rows.select(
        "id",
        "y",
        "keywords",
        F.when(F.length("content") > 1000, 0).otherwise(2).alias("length"),
        F.when(left == 3, -1).otherwise(left).alias("words"),
    )


SCORERS = ["keywords", "length", "words"]


def vocabulary(spark: SparkSession, sf: str, min_docs: int = 2) -> DataFrame:
    """Words that occur in at least ``min_docs`` English documents."""
    docs = spread(table(spark, sf, "documents").where("lang = 'en'").select("text"))
    words = docs.select(F.explode(F.array_distinct(tx.english_tokens("text"))).alias("word"))
    return words.groupBy("word").count().where(F.col("count") >= min_docs).select("word")


def tokens(spark: SparkSession, sf: str) -> DataFrame:
    """``id, word``, one row per word."""
    return cleaned(spark, sf).select("id", F.explode(tx.space_tokens("cleaned_text")).alias("word"))


def embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings")
