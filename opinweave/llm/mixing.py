"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Each source has a number of words to give (its target). A source gives all its documents once
per whole epoch, and of a last, partial epoch the first documents in a seeded order, the last
of them cut, so that the words taken are exactly the rounded target. The draws of a source in
order form blocks. The tree splits the block quotas of all sources: the root holds every block,
each node draws, from a multivariate hypergeometric law, how many blocks of each source go to
its left half of the output shards, and the leaves are the shards. A shard's blocks of a source
are then a range of the source's permuted sequence, so shards are disjoint; inside a shard, a
seeded hash orders the draws.

Texts are read once, for their words and their place in the seeded order; the sums, the quotas and
the report work on that written table of numbers.

Cases: a null source is a source of its own, after all others; a null or blank text has no
words and is never drawn; documents with the same id are told apart by their texts, so rows
without ids spread as others do; rows equal in id and text are interchangeable and share one
place in the order; an empty table gives an empty result; columns with the names of the results
are replaced in ``mix``, all others pass. Per source one row reaches the driver, with its target:
sources are configuration, a few thousand at most.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .common import SPACE, set_aside, sheltered, word_count, written

WEIGHTS = (3.0, 1.0, 2.0)
RESULTS = ("size", "source_size", "target", "draws")
#: Rows of one (source, hash prefix) that one task orders, about.
BUCKET_ROWS = 50_000
#: Blocks in the tree at most; beyond, a block is several draws.
TREE_BLOCKS = 100_000_000


def targets(sizes: Sequence[int], weights: Sequence[float], share: float, cap: float) -> list[float]:
    """Words per source: ``share`` of all by weight, none above ``cap`` times its own size."""
    open_, left = list(range(len(sizes))), share * sum(sizes)
    out = [0.0] * len(sizes)
    while open_:
        total = sum(weights[i] for i in open_)
        for i in open_:
            out[i] = left * weights[i] / total
        full = [i for i in open_ if out[i] > cap * sizes[i]]
        if not full:
            break
        for i in full:
            out[i] = cap * sizes[i]
            left -= out[i]
        open_ = [i for i in open_ if i not in set(full)]
    return out


def split_quotas(quotas: np.ndarray, n_shards: int, seed: int) -> np.ndarray:
    """Blocks of every source (row) for every shard (column).

    Row sums are the quotas; column sums differ by one at most per level of the tree.
    """
    out = np.zeros((len(quotas), n_shards), np.int64)
    todo = [(0, n_shards, np.asarray(quotas, np.int64))]
    while todo:
        lo, hi, held = todo.pop()
        if hi - lo == 1:
            out[:, lo] = held
            continue
        mid = (lo + hi) // 2
        take = int(held.sum()) * (mid - lo) // (hi - lo)
        draw = np.random.default_rng([seed, lo, hi])
        left = draw.multivariate_hypergeometric(held, take, method="marginals")
        todo += [(lo, mid, left), (mid, hi, held - left)]
    return out


def _sized(docs: DataFrame, seed: int) -> DataFrame:
    """With ``size`` and ``_key``, the place in the seeded order of a source."""
    parts = F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.md5("text"), F.lit(""))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))
    return docs.withColumns({"size": word_count("text"), "_key": key})


@sheltered
def mix(
    docs: DataFrame,
    share: float = 1.5,
    weights: Sequence[float] = WEIGHTS,
    cap: float = 2.0,
    n_shards: int = 16,
    seed: int = 7,
) -> DataFrame:
    """All columns of ``docs`` with ``size``, ``source_size``, ``target`` and ``draws``.

    ``draws`` is an array of ``(epoch, words, shard, place)``: the document is written once per
    entry, with its first ``words`` words, to ``shard``, in the order of ``place``. It is empty
    for documents that the mix leaves out. ``weights`` repeat over the sources by code point.
    """
    rows = _sized(docs.drop(*RESULTS), seed)
    light = written(rows.select("source", "size", "_key"))
    return _drawn(rows, light, share, weights, cap, n_shards, seed).drop("_key")


def _drawn(
    rows: DataFrame,
    light: DataFrame,
    share: float = 1.5,
    weights: Sequence[float] = WEIGHTS,
    cap: float = 2.0,
    n_shards: int = 16,
    seed: int = 7,
) -> DataFrame:
    """``rows`` with the results of ``mix``; ``light`` holds their ``source, size, _key``."""
    drawable = (F.col("size") > 0).cast("long")
    sums = light.groupBy("source").agg(
        F.sum("size").alias("words"), F.sum(drawable).alias("n"), F.count(F.lit(1)).alias("rows")
    )
    # UTF-8 bytes sort as code points do
    sources = sorted(
        ((r["source"], r["words"], r["n"], r["rows"]) for r in sums.collect()),
        key=lambda r: (r[0] is None, (r[0] or "").encode("utf-8", "surrogatepass")),
    )
    sizes = [s[1] for s in sources]
    wanted = targets(sizes, [weights[i % len(weights)] for i in range(len(sources))], share, cap)
    plan = []
    for i, ((source, words, n, _), target) in enumerate(zip(sources, wanted, strict=True)):
        epochs, rest = divmod(round(target), words) if words else (0, 0)
        plan.append((i, source, words, target, epochs, rest, n))
    by_source = light.sparkSession.createDataFrame(
        plan,
        schema="_index INT, _source STRING, source_size BIGINT, target DOUBLE, _epochs BIGINT,"
        " _rest BIGINT, _n BIGINT",
    )

    # the seeded order of each source, found by hash prefix: no task orders a whole source
    digits = 2
    while max((s[3] for s in sources), default=0) > BUCKET_ROWS * 16**digits:
        digits += 1

    def placed(of: DataFrame) -> DataFrame:
        same = F.col("source").eqNullSafe(F.col("_source"))
        return of.join(F.broadcast(by_source), same).withColumn("_bucket", F.substring("_key", 1, digits))

    light = placed(light)
    buckets = light.groupBy("_index", "_bucket").agg(
        F.sum("size").alias("_words"), F.sum(drawable).alias("_rows")
    )
    earlier = Window.partitionBy("_index").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select(
        "_index",
        "_bucket",
        F.coalesce(F.sum("_words").over(earlier), F.lit(0)).alias("_words0"),
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_rows0"),
    )
    inside = Window.partitionBy("_index", "_bucket").orderBy("_key")
    inside = inside.rowsBetween(Window.unboundedPreceding, -1)
    cuts = light.join(buckets, ["_index", "_bucket"])
    cuts = cuts.withColumn("_before", F.col("_words0") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    # what the partial epoch takes, in how many draws: one row per source
    partial = cuts.where("_before < _rest and size > 0").groupBy("_index").count()
    extra = dict(partial.collect())
    quotas = np.array([p[4] * p[6] + extra.get(p[0], 0) for p in plan], np.int64)
    block = max(1, int(quotas.sum()) // TREE_BLOCKS + 1)
    shares = split_quotas(-(-quotas // block), n_shards, seed)
    firsts = np.cumsum(shares, axis=1) - shares
    stride = int(firsts.max(initial=0)) + int(shares.max(initial=0)) + 2
    flat = (firsts + np.arange(len(plan))[:, None] * stride).ravel()

    @F.pandas_udf("int")
    def shard_of(index: pd.Series, draw: pd.Series) -> pd.Series:
        """The leaf that holds a draw; -1 for draws that the tree gave to none."""
        at = index.to_numpy() * stride + draw.to_numpy() // block
        leaf = np.searchsorted(flat, at, side="right") - 1
        held = at < flat[leaf] + shares.ravel()[leaf]
        return pd.Series(np.where(held, leaf % n_shards, -1))

    columns = rows.columns
    ranked = placed(rows).join(buckets, ["_index", "_bucket"])
    before = F.col("_words0") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    rank = F.col("_rows0") + F.coalesce(F.sum(drawable).over(inside), F.lit(0))
    ranked = ranked.select("*", before.alias("_before"), rank.alias("_rank"))
    part = F.greatest(F.lit(0), F.least("size", F.col("_rest") - F.col("_before"))).cast("long")
    # at most one whole draw per epoch (two where the cap is 2) and one cut draw
    most = int(max((p[4] for p in plan), default=0)) + 1
    draws = F.array(
        *[
            F.struct(
                F.lit(e).alias("epoch"),
                F.when(F.col("_epochs") > e, F.col("size"))
                .when(F.col("_epochs") == e, part)
                .otherwise(F.lit(0))
                .alias("words"),
                shard_of("_index", F.lit(e) * F.col("_n") + F.col("_rank")).alias("shard"),
                F.xxhash64(F.lit(seed), F.lit(e), "_key").alias("place"),
            )
            for e in range(most)
        ]
    )
    taken = F.filter(draws, lambda d: (d["words"] > 0) & (d["shard"] >= 0))
    return ranked.select(*columns, "source_size", "target", taken.alias("draws"))


def drawn_documents(mixed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per draw: the ``columns`` of the document, ``shard`` and ``place``.

    A cut document keeps its first words, joined by one space; ``n_chars`` follows its text.
    """
    rows = mixed.withColumn("_draw", F.explode("draws"))
    words = F.filter(F.split("text", f"[{SPACE}]+"), lambda w: w != "")
    short = F.array_join(F.slice(words, 1, F.col("_draw.words").cast("int")), " ")
    is_cut = F.col("_draw.words") < F.col("size")
    rows = rows.withColumn("text", F.when(is_cut, short).otherwise(F.col("text")))
    if "n_chars" in columns:
        cut_length = F.length("text").cast("long")
        rows = rows.withColumn("n_chars", F.when(is_cut, cut_length).otherwise(F.col("n_chars")))
    return rows.select(*columns, F.col("_draw.shard").alias("_shard"), F.col("_draw.place").alias("_place"))


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: the columns of ``docs``, a row per draw, shard by shard in shuffled order.

    A task holds slices of shards, each a range of ``place``, and its rows follow shard and place.
    """
    held = set_aside(docs, RESULTS)
    back = dict(zip(held.columns, docs.columns, strict=True))
    drawn = drawn_documents(mix(held, **settings), held.columns)
    laid = drawn.repartition("_shard", F.shiftright("_place", 48)).sortWithinPartitions("_shard", "_place")
    return laid.select(*held.columns).withColumnsRenamed(back)


def shard_quotas(mixed: DataFrame) -> DataFrame:
    """``source, shard, n_draws, words``: what the leaves of the tree hold of every source."""
    draws = mixed.select("source", F.explode("draws").alias("d"))
    return draws.groupBy("source", F.col("d.shard").alias("shard")).agg(
        F.count(F.lit(1)).alias("n_draws"), F.sum("d.words").alias("words")
    )


def mix_report(docs: DataFrame, **settings) -> DataFrame:
    """What the leaves of the tree take of every document; texts are read once and not moved."""
    seed = settings.get("seed", 7)
    light = written(_sized(docs.select("doc_id", "source", "text"), seed).drop("text"))
    mixed = _drawn(light, light, **settings)
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda a, d: a + d["words"])
    return mixed.select("doc_id", "size", "source_size", "target", taken.alias("taken"))
