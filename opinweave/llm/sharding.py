"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Every row gets a number from 0 in the order of its key. A keyed Feistel network permutes
``[0, n)``: numbers that leave the range are permuted again until they are back (cycle
walking). The permuted number gives the shard (its remainder) and the slot (its quotient), so
counts differ by one at most, slots have no gaps, and where a row lies can be computed, in both
directions, from its number alone.

Cases: a null key sorts first; rows with the same key, also repeated rows, are told apart by a
hash of their other columns and else interchangeable; a null text has no bytes; an empty table
gives an empty result; input columns named ``shard`` or ``slot`` are replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import cut, mix64, sheltered

ROUNDS = 6
#: Bytes that a stored row takes besides its text.
ROW_BYTES = 16


def _keys(seed: int) -> np.ndarray:
    start = np.uint64(seed & 0xFFFFFFFFFFFFFFFF)
    steps = np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix64(steps + start)


def _half_bits(n: int) -> int:
    return max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)


def _network(x: np.ndarray, keys: np.ndarray, half: int, back: bool) -> np.ndarray:
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    left, right = x >> shift, x & mask
    for key in keys[::-1] if back else keys:
        if back:
            left, right = right ^ (mix64(left + key) & mask), left
        else:
            left, right = right, left ^ (mix64(right + key) & mask)
    return (left << shift) | right


def permuted(x: np.ndarray, n: int, seed: int, back: bool = False) -> np.ndarray:
    """The images of the numbers ``x`` under the seed's permutation of ``[0, n)``, or its inverse."""
    keys, half = _keys(seed), _half_bits(n)
    out = _network(np.asarray(x).astype(np.uint64), keys, half, back)
    outside = np.flatnonzero(out >= n)
    while outside.size:
        out[outside] = _network(out[outside], keys, half, back)
        outside = outside[out[outside] >= n]
    return out.astype(np.int64)


def numbered(df: DataFrame, key: str, out: str) -> tuple[DataFrame, int]:
    """Rows with their number in the order of ``key``, and how many there are.

    The rows are range-partitioned and sorted, written once, and counted by partition; only
    these counts (one per partition) reach the driver.
    """
    rest = F.xxhash64(*[c for c in df.columns if c != key])
    ranged = df.withColumn("_tie", rest).repartitionByRange(F.col(key).asc_nulls_first(), "_tie")
    ordered = ranged.sortWithinPartitions(F.col(key).asc_nulls_first(), "_tie")
    rows = cut(ordered.withColumn("_at", F.monotonically_increasing_id()).drop("_tie"))
    part = F.shiftright("_at", 33).cast("int")
    counts = dict(rows.groupBy(part.alias("p")).count().collect())
    before, total = [], 0
    for p in range(max(counts, default=-1) + 1):
        before.append(total)
        total += counts.get(p, 0)
    first = F.array(*map(F.lit, before or [0])).cast("array<bigint>")
    number = F.element_at(first, part + 1) + F.col("_at").bitwiseAND((1 << 33) - 1)
    return rows.withColumn(out, number).drop("_at"), total


@sheltered
def shard(
    docs: DataFrame, n_shards: int, key: str = "doc_id", seed: int = 2024
) -> DataFrame:
    """All columns of ``docs`` with ``shard`` (int) and ``slot`` (long); ``key`` must not start with ``_``."""
    if n_shards < 1:
        raise ValueError("a table needs one shard at least")
    rows, n = numbered(docs.drop("shard", "slot"), key, "_row")

    @F.pandas_udf("long")
    def place(row: pd.Series) -> pd.Series:
        return pd.Series(permuted(row.to_numpy(), n, seed))

    at = rows.withColumn("_at", place("_row")).drop("_row")
    return at.select(
        "*",
        F.pmod("_at", F.lit(n_shards)).cast("int").alias("shard"),
        F.expr(f"_at div {n_shards}").alias("slot"),
    ).drop("_at")


def text_size(text: str | Column) -> Column:
    """Stored bytes of a row with this text."""
    text = F.col(text) if isinstance(text, str) else text
    return (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long")


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, its rows in the order of their slots."""
    by_shard = sharded.repartition("shard").sortWithinPartitions("shard", "slot")
    by_shard.write.partitionBy("shard").parquet(path)


def shard_report(docs: DataFrame, n_shards: int, seed: int = 2024) -> DataFrame:
    """Size, checksum and place of every document, without moving the texts."""
    light = docs.select(
        "doc_id",
        text_size("text").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
    )
    return shard(light, n_shards, seed=seed).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
