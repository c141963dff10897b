"""Report aggregates. Each is one map-side combined shuffle on low-cardinality keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.labels import bin_score, label_decode
from ..functions.lexicons import SENTIMENT_NAMES, TOXICITY_BINS
from ..functions.text import report_tokens
from .skew import attach, exact_percentiles

SENTIMENT_LABELS = list(SENTIMENT_NAMES.values())
BIN_NAMES = [name for _, name in TOXICITY_BINS]


def _pct(n: Column, total: Column) -> Column:
    return n * F.lit(100.0) / total


def label_distribution(df: DataFrame, label: str) -> DataFrame:
    """``label, n, pct`` by falling count; rows without a label count in the total only."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    # the window runs over one row per label
    total = F.sum("n").over(Window.partitionBy())
    return (
        counts.withColumn("pct", _pct(F.col("n"), total))
        .where(F.col(label).isNotNull())
        .orderBy(F.desc("n"), label)
    )


def label_distribution_ordered(df: DataFrame, code: str = "sentiment") -> DataFrame:
    """``label, n, pct`` in the order Negative, Neutral, Positive."""
    counts = label_distribution(df, code).where(F.col(code).isin(list(SENTIMENT_NAMES)))
    return counts.orderBy(code).select(label_decode(code).alias("label"), "n", "pct")


def _all_labels(df: DataFrame, label: str) -> list[str]:
    """The labels that occur, by name: a label column has few values."""
    found = df.where(F.col(label).isNotNull()).select(label).distinct().collect()
    return sorted(r[label] for r in found)


def crosstab_counts(
    df: DataFrame, row: str, label: str, labels: Sequence[str] | None = tuple(SENTIMENT_LABELS)
) -> DataFrame:
    """One row per ``row`` value, one count column per label, by falling row total.

    With ``labels=None`` every label that occurs has a column. A label outside a given list has
    none, but counts in the row total.
    """
    labels = _all_labels(df, label) if labels is None else labels
    counts = df.where(F.col(row).isNotNull() & F.col(label).isNotNull()).groupBy(row).agg(
        *(F.count_if(F.col(label) == v).alias(v) for v in labels), F.count(F.lit(1)).alias("_total")
    )
    return counts.orderBy(F.desc("_total"), row).drop("_total")


def crosstab_row_pct(
    df: DataFrame, row: str, label: str, labels: Sequence[str] | None = None
) -> DataFrame:
    """Percentages of all labelled rows of a ``row`` value, a column per label; rows by name.

    With ``labels=None`` every label that occurs has a column; a label outside a given list
    counts in the whole.
    """
    labels = _all_labels(df, label) if labels is None else labels
    counts = df.where(F.col(row).isNotNull() & F.col(label).isNotNull()).groupBy(row).agg(
        *(_pct(F.count_if(F.col(label) == v), F.count(F.lit(1))).alias(v) for v in labels)
    )
    return counts.orderBy(row)


def crosstab_toxicity_pct(df: DataFrame, row: str, category: str = "toxicity_category") -> DataFrame:
    """Row percentages of Low, Medium and High; scores outside the bins do not count."""
    return crosstab_row_pct(df, row, category, BIN_NAMES)


def per_group_distribution(df: DataFrame, group: str, label: str) -> DataFrame:
    """``group, label, n, pct`` with the percentage of the group's rows."""
    counts = df.groupBy(group, label).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(group))
    return (
        counts.withColumn("pct", _pct(F.col("n"), total))
        .where(F.col(group).isNotNull() & F.col(label).isNotNull())
        .orderBy(group, F.desc("n"), label)
    )


def summary_stats(df: DataFrame, value: str) -> DataFrame:
    """``mean, median, max, min``; the median is exact and interpolated."""
    median = exact_percentiles(df, value, [0.5])
    return df.agg(
        F.avg(value).alias("mean"),
        F.lit(None if median is None else median[0]).cast("double").alias("median"),
        F.max(value).alias("max"),
        F.min(value).alias("min"),
    )


def group_mean_desc(df: DataFrame, group: str, value: str) -> DataFrame:
    means = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.avg(value).alias("mean"))
    return means.orderBy(F.desc("mean"), group)


def group_mean_count(df: DataFrame, group: str, value: str) -> DataFrame:
    means = df.where(F.col(group).isNotNull()).groupBy(group).agg(
        F.avg(value).alias("mean"), F.count(value).alias("n")
    )
    return means.orderBy(F.desc("mean"), group)


def avg_confidence_by_label(df: DataFrame, label: str, confidence: str) -> DataFrame:
    return group_mean_desc(df, label, confidence)


def bin_counts(df: DataFrame, score: str, bins: Sequence[tuple[float, str]] = tuple(TOXICITY_BINS)) -> DataFrame:
    """``ord, category, n, pct`` in bin order with empty bins; pct is of all rows."""
    category = bin_score(score, bins)
    names = [name for _, name in bins]
    totals = df.agg(
        F.count(F.lit(1)).alias("_total"),
        *(F.count_if(category == v).alias(f"_{i}") for i, v in enumerate(names)),
    )
    rows = F.array(
        *(
            F.struct(F.lit(i).alias("ord"), F.lit(v).alias("category"), F.col(f"_{i}").alias("n"))
            for i, v in enumerate(names)
        )
    )
    long = totals.select("_total", F.inline(rows))
    return long.select("ord", "category", "n", _pct(F.col("n"), F.col("_total")).alias("pct"))


def histogram_by_label(df: DataFrame, label: str, value: str, bins: int = 20) -> DataFrame:
    """Equal-width bins between each label's own extremes: ``label, bin, lo, hi, n``.

    The last bin is closed; a label with one value only gets the range value +- 0.5.
    """
    known = df.where(F.col(label).isNotNull() & F.col(value).isNotNull()).select(label, value)
    extremes = known.groupBy(label).agg(F.min(value).alias("_a"), F.max(value).alias("_b"))
    flat = F.col("_a") == F.col("_b")
    ranges = extremes.select(
        label,
        F.when(flat, F.col("_a") - 0.5).otherwise(F.col("_a")).alias("_lo"),
        F.when(flat, F.col("_b") + 0.5).otherwise(F.col("_b")).alias("_hi"),
    ).persist(StorageLevel.MEMORY_AND_DISK)  # one row per label, read twice below
    width = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    slot = F.least(F.floor((F.col(value) - F.col("_lo")) / width), F.lit(bins - 1)).cast("int")
    counts = (
        attach(known, ranges, [label], "inner")
        .withColumn("bin", slot)
        .groupBy(label, "bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    spine = ranges.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return spine.join(counts, [label, "bin"], "left").select(
        label,
        "bin",
        (F.col("_lo") + F.col("bin") * width).alias("lo"),
        (F.col("_lo") + (F.col("bin") + 1) * width).alias("hi"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def exploded_terms(df: DataFrame, group: str, text: str, stop) -> DataFrame:
    """``group, term``, one row per token that is reported."""
    return df.select(group, F.explode(report_tokens(text, stop)).alias("term"))


def term_frequency(df: DataFrame, group: str, text: str, stop) -> DataFrame:
    """``group, term, n`` over all texts of a group."""
    terms = exploded_terms(df.where(F.col(group).isNotNull()), group, text, stop)
    return terms.groupBy(group, "term").agg(F.count(F.lit(1)).alias("n"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).where(F.col(column).isNotNull()).distinct()


def count_distinct(df: DataFrame, *columns: str) -> DataFrame:
    return df.agg(*(F.count_distinct(c).alias(f"n_{c}") for c in columns))


def coverage(df: DataFrame, column: str) -> DataFrame:
    """``classified, total, share`` of rows with a value."""
    counts = df.agg(F.count(column).alias("classified"), F.count(F.lit(1)).alias("total"))
    return counts.withColumn(
        "share", F.when(F.col("total") > 0, F.col("classified").cast("double") / F.col("total"))
    )


def negative_rate(df: DataFrame, code: str = "sentiment") -> DataFrame:
    """``negative, total, pct`` of reviews."""
    counts = df.agg(
        F.count_if(F.col(code) == 0).alias("negative"), F.count(F.lit(1)).alias("total")
    )
    return counts.withColumn(
        "pct", F.when(F.col("total") > 0, _pct(F.col("negative"), F.col("total")))
    )


# ------------------------------------------------------------ sorts and top-k


def sort_desc(df: DataFrame, value: str, *ties: str) -> DataFrame:
    return df.orderBy(F.desc(value), *ties)


def sort_by_key(df: DataFrame, *keys: str) -> DataFrame:
    return df.orderBy(*keys)


def top_k(df: DataFrame, value: str, k: int, *ties: str) -> DataFrame:
    return df.orderBy(F.desc(value), *ties).limit(k)


def top_terms_per_group(
    df: DataFrame, group: str, text: str, stop, k: int = 100
) -> DataFrame:
    """The ``k`` most frequent terms of each group: ``group, term, n, weight, rank``.

    Every task keeps its own best ``k`` per group before the shuffle, so a large group does
    not reach one task whole. ``weight`` is the frequency relative to the group's highest.
    """
    counts = term_frequency(df, group, text, stop)
    order = Window.partitionBy(group).orderBy(F.desc("n"), "term")
    top = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    highest = F.max("n").over(Window.partitionBy(group))
    return top.withColumn("weight", F.col("n").cast("double") / highest)


def argmax_row(df: DataFrame, value: str, *ties: str) -> DataFrame:
    """The row with the highest value, the first one by ``ties``."""
    return top_k(df, value, 1, *ties)
