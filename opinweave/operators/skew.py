"""Checked broadcasts, exact percentiles, and ranks by hash."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Row, Window, functions as F

BROADCAST_ROWS = 100_000


def bounded_rows(df: DataFrame, limit: int) -> list[Row] | None:
    """All rows if there are at most ``limit``, else ``None``; never reads more than that."""
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


def broadcast_if_small(dim: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame | None:
    """The frame with a broadcast hint if it has at most ``limit`` rows, else ``None``.

    The rows that the check reads are kept, so a derived dimension is not computed twice.
    """
    head = dim.limit(limit + 1).persist(StorageLevel.MEMORY_AND_DISK)
    if head.count() <= limit:
        return F.broadcast(head)
    head.unpersist()
    return None


def attach(
    df: DataFrame,
    dim: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    limit: int = BROADCAST_ROWS,
) -> DataFrame:
    """Join a dimension: broadcast after a size check, else by a shuffle.

    A hot key of the shuffle is left to adaptive execution, which splits its rows whatever
    their other columns hold.
    """
    small = broadcast_if_small(dim, limit)
    return df.join(dim if small is None else small, list(keys), how)


def text_key(text: str) -> list[Column]:
    """128 bits that stand for a text."""
    return [F.xxhash64(text).alias("_k1"), F.xxhash64(F.lit(1), F.col(text)).alias("_k2")]


# ------------------------------------------------------------ exact percentiles


def exact_percentiles(df: DataFrame, value: str, probs: Sequence[float]) -> list[float] | None:
    """Linear-interpolated percentiles, exact, like ``approxQuantile`` an action.

    NULL and NaN values do not count.

    A quantile sketch brackets each percentile; only the distinct values inside a bracket
    (about ``n / accuracy`` of them) are sorted. Nothing else is shuffled.
    """
    values = df.select(F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    values = values.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n = values.count()
        if n == 0:
            return None
        accuracy = min(max(10_000, 2 * math.isqrt(n)), 2_000_000)
        return [_percentile(values, n, p, accuracy) for p in probs]
    finally:
        values.unpersist()


def _percentile(values: DataFrame, n: int, p: float, accuracy: int) -> float:
    rank = p * (n - 1)
    k, part = math.floor(rank), rank - math.floor(rank)
    slack = 2.0 / accuracy + 2.0 / n
    while True:
        lo_p, hi_p = p - slack, p + slack
        edges = values.agg(
            F.percentile_approx("v", max(lo_p, 0.0), accuracy).alias("lo"),
            F.percentile_approx("v", min(hi_p, 1.0), accuracy).alias("hi"),
        ).first()
        lo = edges["lo"] if lo_p > 0 else -math.inf
        hi = edges["hi"] if hi_p < 1 else math.inf
        below = values.where(F.col("v") < lo).count()
        inside = values.where(F.col("v").between(lo, hi)).groupBy("v").count()
        running = inside.select(
            "v", (F.sum("count").over(Window.orderBy("v")) + F.lit(below)).alias("upto")
        )
        found = running.agg(
            F.min(F.when(F.col("upto") > k, F.col("v"))).alias("a"),
            F.min(F.when(F.col("upto") > k + (part > 0), F.col("v"))).alias("b"),
        ).first()
        if below <= k and found["a"] is not None and found["b"] is not None:
            return found["a"] + (found["b"] - found["a"]) * part
        if lo_p <= 0 and hi_p >= 1:
            raise RuntimeError("the values changed between two passes")
        slack *= 4


# ------------------------------------------------------------ ranks by hash


def hash_order(id_col: Column | str, seed: int = 42) -> Column:
    """A fixed pseudo-random order of rows: md5 of id and seed."""
    id_col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat(id_col.cast("string"), F.lit(f":{seed}")))


def hash_buckets(df: DataFrame, label: str, digits: int = 4) -> DataFrame:
    """Rows per label and md5 prefix, with the count before each: ``bucket, n, before``.

    At most ``16 ** digits`` rows per label, whatever the number of input rows.
    """
    counts = df.groupBy(label, F.substring("_order", 1, digits).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n")
    )
    w = Window.partitionBy(label).orderBy("bucket")
    return counts.withColumn("before", F.sum("n").over(w) - F.col("n"))
