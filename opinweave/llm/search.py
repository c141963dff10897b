"""Exact search of the ``k`` highest inner products, every query row against all rows.

A vector is a sparse row: the position of a component is its term, ``floor(256 * x)`` its weight.
Rows are dealt by hash into blocks of candidates and parts of queries. Where a block meets a part,
one task turns the block into posting lists (term -> rows and weights) and takes the queries term
at a time: the weighted postings of a term are scattered into dense score arrays. Partition
selection leaves ``k`` candidates of the block for every query; a window merges the blocks.

A cell holds about ``BLOCK`` candidates and ``PART`` queries whatever the table's size. Queries are
repeated once per block and candidates once per part, so a row travels ``n / BLOCK`` or
``n_queries / PART`` times; no pair of rows leaves its task but the ``k`` best. Sums are exact:
32-bit or 64-bit integers where the largest possible sum fits, Python's integers else (scores
beyond the long range are held at its ends and are equal there).

Cases: vectors that are null or hold a null, a NaN or an infinity take no part; an empty vector
has the score 0 with all; of vectors of different lengths the common terms count; a null id is no
query and comes last among ties; rows that repeat an id or a vector are rows of their own, and a
query leaves out only its own row; with fewer than ``k`` other rows all are returned; an empty
table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import cut

SCALE = 256
#: Candidates of a block, at most but for the chance of the hash; fewer where that spreads the work better.
BLOCK, LEAST_BLOCK = 16_384, 512
#: Queries of a part, and those whose score arrays are held at a time.
PART, AT_A_TIME = 4096, 64
LONG = (1 << 63) - 1


def usable(vector: str) -> Column:
    """Whether a vector has finite components only."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.col(vector).isNotNull() & F.forall(vector, finite)


def weights(values: np.ndarray) -> np.ndarray:
    """``floor(256 * x)`` as integers of 64 bits, or as Python's where those are too short."""
    with np.errstate(over="ignore"):
        scaled = np.floor(values * SCALE)
    if not len(scaled) or np.abs(scaled).max() < 1 << 62:
        return scaled.astype(np.int64)
    whole = [int(s) if math.isfinite(s) else int(v) * SCALE for s, v in zip(scaled, values, strict=True)]
    return np.array(whole, object)


def _entries(vectors: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``row, term, weight`` of all components that are not 0, by row."""
    lists = vectors.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    lengths = np.diff(lists.offsets.to_numpy().astype(np.int64))
    values = weights(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    row = np.repeat(np.arange(len(lengths)), lengths)
    term = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    some = np.flatnonzero(values)
    return row[some], term[some], values[some]


def _postings(row, term, weight) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Rows and weights of every term."""
    order = np.argsort(term, kind="stable")
    row, term, weight = row[order], term[order], weight[order]
    starts = np.flatnonzero(np.diff(term, prepend=-1))
    ends = np.append(starts, len(term))[1:]
    return {int(term[a]): (row[a:b], weight[a:b]) for a, b in zip(starts, ends, strict=True)}


def best_of_block(postings, size: int, own: np.ndarray, queries, n_queries: int, k: int):
    """``query, row, score`` of the ``k`` rows of a block with the highest scores for each query.

    ``own`` is each query's own row in the block or -1. Of equal scores the earlier row is better.
    """
    row, term, weight = queries
    top = lambda w: int(np.abs(w).max()) if len(w) else 0
    highest = max((top(w) for _, w in postings.values()), default=0) * top(weight) * max(len(postings), 1)
    kind = np.int32 if highest < 1 << 31 else np.int64 if (highest + 2) * size < 1 << 62 else object
    wide = np.int64 if kind is not object and (highest + 2) * size < 1 << 62 else object
    starts = np.searchsorted(row, np.arange(n_queries + AT_A_TIME))
    found = []
    for first in range(0, n_queries, AT_A_TIME):
        n = min(AT_A_TIME, n_queries - first)
        a, b = starts[first], starts[first + n] if first + n < len(starts) else len(row)
        scores = np.zeros((size, n), kind)
        wanted = _postings(row[a:b] - first, term[a:b], weight[a:b])
        for t, (some, said) in wanted.items():
            if t in postings:
                rows, held = postings[t]
                sparse = np.zeros(n, kind)
                sparse[some] = said
                scores[rows] += np.multiply.outer(held.astype(kind), sparse)
        if kind is object:
            scores = np.maximum(np.minimum(scores, LONG), -LONG - 1)
        # one number orders by score, then by row
        keys = np.ascontiguousarray(scores.T).astype(wide) * size + (size - 1 - np.arange(size))
        mine = np.flatnonzero(own[first : first + n] >= 0)
        lowest = -(highest + 1) * size
        keys[mine, own[first + mine]] = lowest
        if size > k:
            keys = np.partition(keys, size - k, axis=1)[:, size - k :]
        query, at = np.nonzero(keys > lowest - 1)
        key = keys[query, at]
        real = np.flatnonzero(key != lowest)
        query, key = query[real], key[real]
        found.append((first + query, (size - 1 - key % size).astype(np.int64), key // size))
    return [np.concatenate(c) for c in zip(*found, strict=True)]


def top_k(
    vectors: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for the rows where ``queries`` holds, the ``k`` best of all others."""
    rows = vectors.where(usable(vector)).select(
        F.monotonically_increasing_id().alias("tag"),
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(queries, F.lit(False)).alias("asks"),
        F.col(vector).alias("x"),
    )
    rows = cut(rows)
    n, n_asked = rows.agg(F.count(F.lit(1)), F.count_if("asks")).first()
    slots = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(math.ceil(n / BLOCK), min(slots, n // LEAST_BLOCK), 1)
    parts = max(math.ceil(n_asked / PART), 1)
    block = F.pmod(F.xxhash64("tag"), F.lit(blocks)).cast("int").alias("block")
    part = F.pmod(F.xxhash64("tag", F.lit("part")), F.lit(parts)).cast("int").alias("part")
    every = lambda count, name: F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias(name)
    held = rows.select(block, every(parts, "part"), "tag", "id", "x").groupBy("block", "part")
    asked = rows.where("asks").select(every(blocks, "block"), part, "tag", "id", "x").groupBy("block", "part")

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        n_held, n_asked = left.num_rows, right.num_rows
        if not n_held or not n_asked:
            return _found([], [], [], [])
        left = left.sort_by([("id", "ascending"), ("tag", "ascending")])  # nulls come last
        tags, asking = left["tag"].to_numpy(), right["tag"].to_numpy()
        by_tag = np.argsort(tags)
        at = by_tag[np.minimum(np.searchsorted(tags, asking, sorter=by_tag), n_held - 1)]
        own = np.where(tags[at] == asking, at, -1)
        query, row, score = best_of_block(
            _postings(*_entries(left["x"])), n_held, own, _entries(right["x"]), n_asked, k
        )
        return _found(asking[query], right["id"].take(query), left["id"].take(row), score.astype(np.int64))

    schema = "tag BIGINT, query_id BIGINT, vec_id BIGINT, score BIGINT"
    found = held.cogroup(asked).applyInArrow(best, schema)
    order = Window.partitionBy("tag").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _found(tag, query_id, vec_id, score) -> pa.Table:
    columns = {"tag": tag, "query_id": query_id, "vec_id": vec_id, "score": score}
    cast = lambda c: c.cast(pa.int64()) if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, pa.int64())
    return pa.table({name: cast(c) for name, c in columns.items()})


def search_report(vectors: DataFrame) -> DataFrame:
    """The five nearest rows of every row whose id is divisible by 50."""
    return top_k(vectors, F.pmod(F.col("vec_id").cast("long"), F.lit(50)) == 0, 5)
