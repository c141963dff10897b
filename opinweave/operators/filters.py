"""Row filters."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as tx
from ..functions.labels import sql_text
from ..functions.lexicons import NA_TOKENS
from .skew import BROADCAST_ROWS, attach, text_key
from .staged import computed

INLINE_WORDS = 20_000
#: Words of a vocabulary, some 10 bytes each, that travel with a function.
SHIPPED_WORDS = 2_000_000


def drop_missing_text(df: DataFrame, text: str = "content") -> DataFrame:
    """Rows with a text; NULL and the literal NA cells go."""
    return df.where(F.col(text).isNotNull() & ~F.col(text).isin(NA_TOKENS)).withColumn(
        text, F.col(text).cast("string")
    )


def english_share(df: DataFrame, vocab: DataFrame, text: str) -> DataFrame:
    """``(_k1, _k2, share)``: share of letter-only tokens of a text in the distinct ``vocab``.

    The share depends on the text alone, so rows fold to one per text before the shuffle, and
    ids may repeat or be missing.
    """
    tokens = df.where(~tx.has_bengali(text)).select(
        *text_key(text), F.explode(tx.english_tokens(text)).alias("word")
    )
    known = vocab.withColumn("_hit", F.lit(1))
    joined = attach(tokens, known, ["word"], "left", 10 * BROADCAST_ROWS)
    return joined.groupBy("_k1", "_k2").agg(F.avg(F.coalesce("_hit", F.lit(0))).alias("share"))


def shipped_share(words: pa.Array) -> Callable[[Column], Column]:
    """Share of a list's strings that are in ``words``, NULL for an empty or missing list.

    All tokens of a batch are looked up at once in a hash table of the words.
    """

    @F.arrow_udf("double")
    def share(tokens: pa.Array) -> pa.Array:
        said = tokens.flatten()
        known = pc.is_in(said, value_set=words.cast(said.type)).to_numpy(zero_copy_only=False)
        upto = np.append(0, np.cumsum(known))
        counts = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(counts)
        hits = upto[ends] - upto[ends - counts]
        return pa.array(hits / np.maximum(counts, 1), mask=counts == 0)

    return share


def filter_english(
    df: DataFrame,
    vocab: DataFrame,
    text: str = "content",
    min_share: float = 0.8,
    inline_words: int = INLINE_WORDS,
    shipped_words: int = SHIPPED_WORDS,
) -> DataFrame:
    """Rows without Bengali script whose share of vocabulary words is at least ``min_share``.

    A vocabulary of at most ``inline_words`` words becomes a hash set inside the filter, one of at
    most ``shipped_words`` travels with a vectorised function; no row is shuffled. A larger one is
    joined to the exploded tokens, and the texts that pass are joined back. All ways keep the same
    rows; NULL words do not count.
    """
    known = vocab.select(F.lower("word").alias("word")).where("word is not null").distinct()
    known = known.persist(StorageLevel.MEMORY_AND_DISK)
    tokens = F.when(F.col(text).isNotNull() & ~tx.has_bengali(text), tx.english_tokens(text))
    n = known.limit(max(inline_words, shipped_words) + 1).count()
    if n <= inline_words:
        words = ", ".join(sql_text(r["word"]) for r in known.collect()) or "NULL"
        staged = computed(df, _tokens=tokens)
        hits = F.expr(f"size(filter(_tokens, t -> t IN ({words})))")
        share = F.when(F.size("_tokens") > 0, hits.cast("double") / F.size("_tokens"))
        kept = staged.where(share >= F.lit(min_share)).drop("_tokens")
    elif n <= shipped_words:
        share = shipped_share(known.toArrow()["word"].combine_chunks())
        kept = df.withColumn("_share", share(tokens)).where(F.col("_share") >= F.lit(min_share)).drop("_share")
    else:
        passed = english_share(df, known, text).where(F.col("share") >= F.lit(min_share))
        keyed = df.select("*", *text_key(text))
        return keyed.join(passed, ["_k1", "_k2"], "left_semi").select(*df.columns)
    known.unpersist()
    return kept


def mark_english(kept: DataFrame) -> DataFrame:
    """The kept rows with ``is_english`` set."""
    return kept.withColumn("is_english", F.lit(True))


def filter_label(df: DataFrame, column: str, label) -> DataFrame:
    return df.where(F.col(column) == F.lit(label))


def filter_notnull(df: DataFrame, *columns: str) -> DataFrame:
    return df.dropna(how="any", subset=list(columns))


def filter_in_set(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    return df.where(F.col(column).isin(list(values)))


def filter_valid_prediction(df: DataFrame, column: str = "yhat") -> DataFrame:
    return df.where(F.col(column).isNotNull() & (F.col(column) != -1))


def filter_nonblank(df: DataFrame, text: str) -> DataFrame:
    return df.where(~tx.is_blank(text))


def filter_threshold(df: DataFrame, column: str, low: float = 90.0) -> DataFrame:
    return df.where(F.col(column) >= F.lit(low))


