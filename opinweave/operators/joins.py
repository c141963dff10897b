"""Joins and set operations over review tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions.labels import lookup
from .skew import BROADCAST_ROWS, attach, text_key


def attach_labels(
    reviews: DataFrame,
    labelled: DataFrame,
    on: str = "cleaned_text",
    label: str = "sentiment_label",
    limit: int = 10 * BROADCAST_ROWS,
) -> DataFrame:
    """Left join of the distinct (text, label) pairs; a text with two labels fans out.

    128 bits stand for a text, so no text is shuffled unless its column is asked for. The labelled
    side is broadcast if it has at most ``limit`` rows; else a frequent text is a hot key on the
    review side only, which adaptive execution splits.
    """
    key = [F.when(F.col(on).isNotNull(), k).alias(f"_k{i}") for i, k in enumerate(text_key(on), 1)]
    labels = labelled.where(F.col(on).isNotNull()).select(*key, label).distinct()
    rest = [c for c in reviews.columns if c != on]
    return attach(reviews.select("*", *key), labels, ["_k1", "_k2"], "left", limit).select(on, *rest, label)


def vocab_lookup(tokens: DataFrame, vocab: DataFrame, word: str = "word") -> DataFrame:
    """Tokens that are in the vocabulary."""
    return attach(tokens, vocab.select(word).distinct(), [word], "left_semi")


def stopword_removal(tokens: DataFrame, stop: DataFrame, word: str = "word") -> DataFrame:
    """Tokens that are no stop-words."""
    return attach(tokens, stop.select(word).distinct(), [word], "left_anti")


def lookup_map(df: DataFrame, key: str, table: Mapping, default, out: str) -> DataFrame:
    """Adds the value of a literal map for a key, or the default."""
    return df.withColumn(out, lookup(key, table, default))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Bag union by column name; columns that a frame lacks are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def distinct_rows(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).distinct() if columns else df.distinct()


def set_union(a: DataFrame, b: DataFrame, column: str = "word") -> DataFrame:
    return a.select(column).union(b.select(column)).distinct()
