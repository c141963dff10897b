"""The report jobs: label once, keep the labelled rows, aggregate them several ways."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from ..functions import lexicons as lex
from ..operators import aggregates as agg, labellers as lab
from ..operators.filters import filter_notnull
from ..operators import pseudo_labels as ps
from ..operators.learners import LEARNERS, fit_and_predict, hashing_embedder, model_grid, train_sequence_classifier
from ..operators.evaluation import class_count, classification_metrics, leaderboard, metric_long_form
from ..operators.features import stratified_split, tfidf_model, tfidf_vocabulary, with_tfidf

Report = dict[str, DataFrame]
THEME_SENTIMENT_ORDER = ["Positive", "Neutral", "Negative"]


def theme_sentiment_pct(reviews: DataFrame, text: str = "content") -> DataFrame:
    """Sentiment percentages per theme: one scan, one projection stage, one shuffle."""
    cleaned = lab.with_cleaned(reviews, text)
    labelled = lab.with_lexicon_sentiment(filter_notnull(lab.with_theme(cleaned), "theme"))
    named = lab.with_sentiment_label(labelled)
    return agg.crosstab_row_pct(named, "theme", "sentiment_label", THEME_SENTIMENT_ORDER)


def kept(df: DataFrame) -> DataFrame:
    """Labels are costly next to the aggregates, so they are computed once."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def sentiment_report(labelled: DataFrame) -> Report:
    """From ``app, sentiment, sentiment_label``."""
    return {
        "distribution": agg.label_distribution(labelled, "sentiment_label"),
        "distribution_ordered": agg.label_distribution_ordered(labelled),
        "by_app": agg.crosstab_counts(labelled, "app", "sentiment_label"),
        "per_app": agg.per_group_distribution(labelled, "app", "sentiment_label"),
        "negative_rate": agg.negative_rate(labelled),
    }


def theme_sentiment_report(labelled: DataFrame) -> Report:
    """From ``theme, sentiment_label``; only rows with both count."""
    both = filter_notnull(labelled, "theme", "sentiment_label")
    return {
        "heatmap": agg.crosstab_row_pct(both, "theme", "sentiment_label", THEME_SENTIMENT_ORDER),
        "counts": agg.crosstab_counts(both, "theme", "sentiment_label", THEME_SENTIMENT_ORDER),
        "distribution": agg.label_distribution(both, "theme"),
        "per_theme": agg.per_group_distribution(both, "theme", "sentiment_label"),
    }


def emotion_report(labelled: DataFrame, by: str = "app", labels=tuple(lex.EMOTIONS)) -> Report:
    """From ``emotion, emotion_confidence`` and ``app`` or ``theme``."""
    return {
        "distribution": agg.label_distribution(labelled, "emotion"),
        "row_pct": agg.crosstab_row_pct(labelled, by, "emotion", labels),
        "counts": agg.crosstab_counts(labelled, by, "emotion", labels),
        "per_group": agg.per_group_distribution(labelled, by, "emotion"),
        "confidence": agg.histogram_by_label(labelled, "emotion", "emotion_confidence"),
        "mean_confidence": agg.avg_confidence_by_label(labelled, "emotion", "emotion_confidence"),
    }


def toxicity_report(scored: DataFrame, by: str = "app") -> Report:
    """From ``toxicity_score, toxicity_category`` and ``app`` or ``theme``."""
    return {
        "summary": agg.summary_stats(scored, "toxicity_score"),
        "bins": agg.bin_counts(scored, "toxicity_score"),
        "mean": agg.group_mean_desc(scored, by, "toxicity_score"),
        "row_pct": agg.crosstab_toxicity_pct(scored, by),
    }


def theme_toxicity_report(
    reviews: DataFrame, scorer: lab.Scorer | None = None, text: str = "content"
) -> Report:
    """Toxicity per theme and subtheme; unclassified rows are dropped before scoring."""
    cleaned = lab.with_theme(lab.with_cleaned(reviews, text))
    scored = kept(
        lab.with_toxicity(filter_notnull(cleaned, "theme"), scorer).select(
            "theme", "subtheme", "toxicity_score", "toxicity_category"
        )
    )
    by_sub = agg.group_mean_count(scored, "subtheme", "toxicity_score")
    return {
        **toxicity_report(scored, "theme"),
        "top_subthemes": agg.top_k(by_sub, "mean", 15, "subtheme"),
        "coverage": agg.coverage(cleaned, "theme"),
    }


def word_cloud_report(labelled: DataFrame, group: str, by: str = "sentiment", k: int = 100) -> DataFrame:
    """Term weights per sentiment label or theme."""
    rows = filter_notnull(labelled, group)
    return agg.top_terms_per_group(rows, group, "cleaned_text", lex.stopwords(by), k)


def split_rows(df: DataFrame, label: str = "y", id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """Training and test rows; stratified if there is more than one class."""
    df = kept(df)
    classes = df.agg(F.count_distinct(label).alias("n")).first()["n"]
    marked = stratified_split(df, label if classes > 1 else None, id_col)
    return marked.where("split = 'train'"), marked.where("split = 'test'")


def tfidf_rows(train: DataFrame, test: DataFrame, text: str = "cleaned_text", max_features: int = 100):
    """Training and test rows with TF-IDF ``features`` fitted on the training texts."""
    model = tfidf_model(tfidf_vocabulary(train, text, max_features))
    return with_tfidf(train, model, text), with_tfidf(test, model, text)


def train_on_tfidf(
    df: DataFrame, learner: str = "Logistic Regression", label: str = "y", id_col: str = "id", **settings
) -> DataFrame:
    """One learner on scaled TF-IDF features: ``model, accuracy, precision, recall, f1``."""
    a, b = tfidf_rows(*split_rows(df, label, id_col))
    columns = [label, "features"]
    a, b = kept(a.select(columns)), kept(b.select(columns))
    scored = fit_and_predict(a, b, LEARNERS[learner], label=label, **settings)
    keyed = scored.select(F.lit(learner).alias("model"), F.col(label).alias("y"), "yhat")
    return classification_metrics(keyed, ("model",))


def pseudo_label_report(
    df: DataFrame, embed: Callable[[DataFrame, str], DataFrame] | None = None, text: str = "cleaned_text"
) -> DataFrame:
    """Labels without ground truth: ``id, pseudo_label, ground_truth``, from ``id``, text, ``sentiment``.

    Clusters are named by seed words. If that names one class only, rows are labelled by their
    similarity to a centre: the mean of the rows that the lexicon calls positive, else a few
    positive phrases. A sequence classifier fitted on these labels gives the final one, and the
    lexicon label stands in where it gives none.
    """
    embed = embed or hashing_embedder(256)
    spark = df.sparkSession
    rows = kept(embed(df, text))
    negative = ps.seed_vector(spark, lex.NEGATIVE_SEEDS, embed)
    positive = ps.seed_vector(spark, lex.POSITIVE_SEEDS, embed)
    labelled = ps.kmeans_pseudo_labels(rows, negative, positive).drop("cluster")
    if class_count(labelled, "pseudo_label") < 2:
        liked = rows.where("sentiment = 2")
        centre = ps.seed_vector(spark, lex.POSITIVE_PHRASES, embed)
        if not liked.isEmpty():
            centre = ps.mean_vector(liked, "embedding")
        labelled = ps.similarity_pseudo_labels(rows, centre).drop("similarity")
    scored = train_sequence_classifier(labelled.drop("embedding"), text=text, fallback="sentiment")
    return scored.select("id", "sentiment", "pseudo_label", "ground_truth")


def training_report(
    df: DataFrame,
    embeddings: dict[str, Callable[[DataFrame, str], DataFrame]],
    learners=None,
    label: str = "y",
    id_col: str = "id",
) -> Report:
    """Grid results, leaderboard and the long form of its metrics."""
    train, test = split_rows(df, label, id_col)
    results = model_grid(train, test, embeddings, learners, label=label)
    return {
        "results": results,
        "leaderboard": leaderboard(results),
        "metrics": metric_long_form(results, "model", "embedding"),
    }
