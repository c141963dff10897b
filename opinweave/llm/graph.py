"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import cut


def _least(links: DataFrame) -> DataFrame:
    """Every node's least neighbour, itself included."""
    return links.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least"))


def _pairs(*pairs: tuple[str, str]) -> Column:
    return F.inline(F.array(*[F.struct(F.col(a).alias("a"), F.col(b).alias("b")) for a, b in pairs]))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select(_pairs(("a", "b"), ("b", "a")))
    return both.join(_least(both), "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    return down.join(_least(down), "a").select(_pairs(("b", "least"), ("a", "least")))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root``: the least node of the component of every node that has a link.

    Alternates large-star and small-star steps until no link changes, a few more rounds than the
    logarithm of the longest path. A hub's neighbours are never gathered: its least neighbour
    is a combined aggregate, joined back. Each round is written to the checkpoint folder.
    """
    now = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct()
    before = None
    while True:
        now = cut(_small_star(_large_star(now)).where("a <> b").distinct())
        state = now.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first()
        if state == before:
            break
        before = state
    named = F.inline(
        F.array(*[F.struct(F.col(c).alias("node"), F.col("b").alias("root")) for c in ("a", "b")])
    )
    return now.select(named).distinct()
