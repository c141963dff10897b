"""Row labellers: theme, sentiment, emotion and toxicity. None of them shuffles."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.accumulators import Accumulator
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import labels as fn, lexicons as lex
from ..functions.text import clean_text
from .staged import computed

log = logging.getLogger(__name__)
TEXT = "cleaned_text"


def with_cleaned(df: DataFrame, text: str = "content") -> DataFrame:
    return computed(df, **{TEXT: clean_text(text)})


def theme_scores(df: DataFrame, text: str = TEXT, pairs=tuple(lex.THEME_PAIRS)) -> DataFrame:
    """One row per review and theme pair that scores above 0: ``ord, theme, subtheme, score``.

    The pairs are literals, so the review x theme loop is a generator inside each task and
    no join.
    """
    rest = [c for c in df.columns if c != text]
    points = computed(df, _points=fn.theme_points(text, pairs))
    long = points.select(*rest, F.posexplode("_points").alias("ord", "score")).where("score > 0")
    return long.select(
        *rest,
        "ord",
        F.get(F.lit([t for t, _ in pairs]), F.col("ord")).alias("theme"),
        F.get(F.lit([s for _, s in pairs]), F.col("ord")).alias("subtheme"),
        "score",
    )


def with_theme(df: DataFrame, text: str = TEXT, pairs=tuple(lex.THEME_PAIRS)) -> DataFrame:
    """Adds ``theme`` and ``subtheme`` (NULL where no keyword occurs)."""
    picked = computed(df, _theme=fn.theme_struct(text, pairs))
    return picked.select(*df.columns, "_theme.theme", "_theme.subtheme")


def with_lexicon_scores(df: DataFrame, text: str = TEXT) -> DataFrame:
    """Adds ``negative_score`` and ``positive_score``."""
    points = computed(df, _points=fn.lexicon_points(text))
    scored = computed(points, _points=fn.length_bonus("_points", text))
    return scored.select(
        *df.columns,
        F.col("_points.negative").alias("negative_score"),
        F.col("_points.positive").alias("positive_score"),
    )


def with_lexicon_sentiment(df: DataFrame, text: str = TEXT, out: str = "sentiment") -> DataFrame:
    scored = with_lexicon_scores(df, text)
    code = fn.sentiment_from_scores("negative_score", "positive_score")
    return scored.select(*df.columns, code.alias(out))


def with_sentiment_label(df: DataFrame, code: str = "sentiment") -> DataFrame:
    return df.withColumn("sentiment_label", fn.label_decode(code))


def coalesce_labels(df: DataFrame, model: str, fallback: str, out: str = "ground_truth") -> DataFrame:
    """The model's label, or the keyword label where the model gave none (NULL or -1)."""
    valid = F.when(F.col(model) != -1, F.col(model))
    return df.withColumn(out, F.coalesce(valid, F.col(fallback)))


# -------------------------------------------------------------------- scorers

Scorer = Callable[[DataFrame, str], DataFrame]
"""Adds ``score`` columns to a frame given the name of its text column."""


def expression_scorer(make: Callable[[Column], Column], out: str) -> Scorer:
    """Scorer from a ``Column -> Column`` function; stays in the JVM."""
    return lambda df, text: computed(df, **{out: make(F.col(text))})


def udf_scorer(udf, out: str) -> Scorer:
    """Scorer from a vectorised user function (``pandas_udf`` or ``predict_batch_udf``).

    Use the iterator form so that a model is loaded once per task.
    """
    return lambda df, text: df.withColumn(out, udf(F.col(text)))


def batch_scorer(
    load: Callable[[], Callable[[list[str]], Sequence]],
    out: str,
    failed: float,
    kind: str = "double",
    batch_size: int = 32,
    failures: Accumulator | None = None,
) -> Scorer:
    """Scorer from a model that takes a list of texts and may fail.

    ``load`` gives the model's predict function, once per task. A batch on which it raises gets
    ``failed`` for its texts, those after it are scored again; where the model cannot be loaded all
    get it. A short answer is filled up with ``failed``, a long one is cut, a missing answer is
    ``failed``. Null texts are empty. ``failures`` counts the texts without an answer.
    """
    arrow = {"double": pa.float64(), "int": pa.int32()}[kind]

    def answered(predict, texts: list[str], told: set[str]) -> list:
        try:
            said = list(predict(texts))[: len(texts)]
            # what is no number fails its batch as well
            said = pa.array([failed if x is None else x for x in said], arrow).to_pylist()
        except Exception as e:  # whatever a model raises costs its batch only
            if not told:
                log.warning("a batch of %d texts failed: %s", len(texts), e)
            told.add(type(e).__name__)
            said = []
        if failures is not None:
            failures.add(len(texts) - len(said))
        return said + [failed] * (len(texts) - len(said))

    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            predict = load()
        except Exception as e:
            log.warning("the model cannot be loaded: %s", e)
            predict = None
        told: set[str] = set()
        for batch in batches:
            texts = [t or "" for t in batch.to_pylist()]
            said = []
            for i in range(0, len(texts), batch_size):
                said += answered(predict, texts[i : i + batch_size], told)
            yield pa.array(said, arrow)

    scored.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    udf = F.arrow_udf(scored, kind)
    return lambda df, text: df.withColumn(out, udf(F.col(text)))


def model_scorer(model, features: Scorer, out: str, keep: Column | None = None) -> Scorer:
    """Scorer from a fitted MLlib model and the step that builds its ``features``."""

    def score(df: DataFrame, text: str) -> DataFrame:
        picked = keep if keep is not None else F.col("prediction").cast("int")
        return model.transform(features(df, text)).select(*df.columns, picked.alias(out))

    return score


def with_class_sentiment(
    df: DataFrame, scorer: Scorer, classes: Mapping[int, int], text: str = TEXT
) -> DataFrame:
    """Class index of any scorer (column ``class_idx``) as ``sentiment``; unmapped is -1."""
    scored = scorer(df, text)
    return scored.withColumn(
        "sentiment", F.coalesce(fn.label_remap("class_idx", classes), F.lit(-1))
    ).drop("class_idx")


def lexicon_emotion_scorer(keywords: Mapping = lex.EMOTION_KEYWORDS) -> Scorer:
    return expression_scorer(lambda c: fn.emotion_scores(c, keywords), "emotion_scores")


def with_emotion(
    df: DataFrame,
    scorer: Scorer | None = None,
    text: str = TEXT,
    order: Sequence[str] = tuple(lex.EMOTIONS),
) -> DataFrame:
    """Adds ``emotion``, ``emotion_confidence`` and ``emotion_scores`` (label -> probability)."""
    scored = (scorer or lexicon_emotion_scorer())(df, text)
    top = computed(scored, _top=fn.argmax_map("emotion_scores", order))
    return top.select(
        *df.columns,
        F.col("_top.label").alias("emotion"),
        F.col("_top.score").alias("emotion_confidence"),
        "emotion_scores",
    )


def lexicon_toxicity_scorer() -> Scorer:
    def score(df: DataFrame, text: str) -> DataFrame:
        scored = with_lexicon_scores(df, text)
        tox = fn.toxicity_from_scores("negative_score", "positive_score")
        return scored.select(*df.columns, tox.alias("toxicity_score"))

    return score


def with_toxicity(df: DataFrame, scorer: Scorer | None = None, text: str = TEXT) -> DataFrame:
    """Adds ``toxicity_score`` (0.0 where the scorer failed) and ``toxicity_category``."""
    scored = (scorer or lexicon_toxicity_scorer())(df, text)
    return scored.withColumn(
        "toxicity_score", F.coalesce(F.col("toxicity_score"), F.lit(0.0))
    ).withColumn("toxicity_category", fn.bin_score("toxicity_score"))


def first_scorer(*scorers: Scorer | None) -> Scorer:
    """The first scorer that is there: primary, then alternative, else an error."""
    for scorer in scorers:
        if scorer is not None:
            return scorer
    raise ValueError("no scorer is available")
