"""Splits, samples, TF-IDF, scalers and token sequences."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.lexicons import ENGLISH_STOPWORDS
from ..functions.text import space_tokens, word_ngrams, words
from ..functions.vectors import l2_normalize
from .skew import BROADCAST_ROWS, hash_buckets, hash_order
from .staged import computed

# ------------------------------------------------------------ split and sample


def _largest_remainder(counts: dict, total: int) -> dict:
    """Whole quotas per label that add up to ``total``, in proportion to the counts."""
    n = sum(counts.values())
    exact = {k: total * c / n for k, c in counts.items()}
    quota = {k: math.floor(v) for k, v in exact.items()}
    rest = total - sum(quota.values())
    for k in sorted(exact, key=lambda k: (quota[k] - exact[k], k))[:rest]:
        quota[k] += 1
    return quota


def _label_counts(df: DataFrame, label: str) -> dict:
    return {r[label]: r["count"] for r in df.groupBy(label).count().collect()}


def _split_limits(keyed: DataFrame, group: str, test_share: float) -> dict:
    """Per label the last ``(md5, id)`` that belongs to the test set."""
    counts = _label_counts(keyed, group)
    quota = _largest_remainder(counts, math.ceil(test_share * sum(counts.values())))
    wanted = {k: q for k, q in quota.items() if q > 0}
    if not wanted:
        return {}
    need = F.create_map(*(F.lit(x) for pair in wanted.items() for x in pair))[F.col(group)]
    cut = hash_buckets(keyed, group).where(
        (F.col("before") < need) & (F.col("before") + F.col("n") >= need)
    )
    # one row per label
    edge = keyed.withColumn("bucket", F.substring("_order", 1, 4)).join(
        F.broadcast(cut), [group, "bucket"]
    )
    order = Window.partitionBy(group, "bucket").orderBy("_order", "_id")
    place = F.col("before") + F.row_number().over(order)
    last = edge.withColumn("_rank", place).where(F.col("_rank") == need)
    return {r[group]: (r["_order"], r["_id"]) for r in last.select(group, "_order", "_id").collect()}


def stratified_split(
    df: DataFrame,
    label: str | None = "y",
    id_col: str = "id",
    test_share: float = 0.2,
    seed: int = 42,
) -> DataFrame:
    """Adds ``split`` (``train`` or ``test``); exact quotas, the same for any partitioning.

    Rows are ordered by md5 of id and seed; the first ones of each label are the test set.
    The cut is found from counts per md5 prefix and one prefix's rows, so the frame itself is
    neither shuffled nor sorted. Without stratification (``label=None``) all rows are one
    group; with it, rows without a label go.
    """
    if label:
        df = df.where(F.col(label).isNotNull())
    group = label or "_all"
    rows = df if label else df.withColumn("_all", F.lit(0))
    keyed = rows.select(group, F.col(id_col).alias("_id"), hash_order(id_col, seed).alias("_order"))
    keyed = keyed.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        limits = _split_limits(keyed, group, test_share)
    finally:
        keyed.unpersist()

    order_now = hash_order(id_col, seed)
    in_test = F.lit(False)
    for key, (top, last_id) in limits.items():
        here = (order_now < top) | ((order_now == top) & (F.col(id_col) <= last_id))
        in_test = in_test | (((F.col(label) == F.lit(key)) if label else F.lit(True)) & here)
    return df.withColumn("split", F.when(in_test, "test").otherwise("train"))


def stratified_sample(
    df: DataFrame, label: str = "y", id_col: str = "id", size: int = 1024, seed: int = 42
) -> DataFrame:
    """``size`` rows drawn with replacement, in proportion to the labels.

    Adds ``draw``, the number of the draw within its label. Draw ``j`` takes the row whose
    place in the label's md5 order is ``(j * 2654435761 + seed) mod n``. Only the md5
    prefixes that hold a drawn row are ranked. Rows without a label are never drawn.
    """
    df = df.where(F.col(label).isNotNull())
    keyed = df.withColumn("_order", hash_order(id_col, seed))
    counts = _label_counts(keyed, label)
    quota = _largest_remainder(counts, min(size, sum(counts.values())))
    label_type = df.schema[label].dataType.simpleString()
    quotas = df.sparkSession.createDataFrame(
        [(key, q, counts[key]) for key, q in quota.items() if q > 0],
        f"`{label}` {label_type}, quota INT, n BIGINT",
    )
    draw = F.explode(F.sequence(F.lit(0), F.col("quota") - 1)).alias("draw")
    drawn = quotas.select(label, "n", draw).select(
        label, "draw", ((F.col("draw") * F.lit(2654435761) + F.lit(seed)) % F.col("n")).alias("place")
    )

    # place -> md5 prefix: the last prefix that starts at or before the place
    starts = hash_buckets(keyed, label).select(
        label, F.col("before").alias("place"), F.lit(None).cast("int").alias("draw"), "bucket", "before"
    )
    merged = starts.unionByName(drawn, allowMissingColumns=True)
    w = Window.partitionBy(label).orderBy("place", F.col("draw").asc_nulls_first())
    placed = (
        merged.withColumn("bucket", F.last("bucket", ignorenulls=True).over(w))
        .withColumn("before", F.last("before", ignorenulls=True).over(w))
        .where(F.col("draw").isNotNull())
        .select(label, "draw", "bucket", (F.col("place") - F.col("before")).alias("_rank"))
    )
    # both have at most `size` rows
    small = F.broadcast if size <= BROADCAST_ROWS else lambda d: d
    used = placed.select(label, "bucket").distinct()
    rows = keyed.withColumn("bucket", F.substring("_order", 1, 4)).join(
        small(used), [label, "bucket"], "left_semi"
    )
    order = Window.partitionBy(label, "bucket").orderBy("_order", id_col)
    ranked = rows.withColumn("_rank", (F.row_number().over(order) - 1).cast("bigint"))
    return ranked.join(small(placed), [label, "bucket", "_rank"]).select(*df.columns, "draw")


# ------------------------------------------------------------ TF-IDF


def default_stop_words() -> list[str]:
    """Stop-words left out of TF-IDF terms if no other list is given."""
    return ENGLISH_STOPWORDS


#: Words whose pairs are counted by number; with more of them all pairs are counted as strings.
PAIRED_WORDS = 20_000


def _numbered(said: pa.Array, stop: pa.Array, chosen: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``row, term`` of each chosen word and pair of neighbours, after short words and stop-words are taken out.

    With ``m`` chosen words the term of word ``i`` is ``i``, that of ``i`` before ``j`` is ``m + i * m + j``.
    """
    flat = said.flatten()
    short = np.less(pc.utf8_length(flat).to_numpy(zero_copy_only=False), 2)
    known = pa.concat_arrays([stop, chosen]).cast(flat.type)  # the first of equals counts
    place = pc.fill_null(pc.index_in(flat, value_set=known), len(known)).to_numpy(zero_copy_only=False).astype(np.int64)
    stays = ~short & (place >= len(stop))
    row = np.repeat(np.arange(len(said)), pc.list_value_length(said).to_numpy(zero_copy_only=False))[stays]
    place, m = place[stays] - len(stop), len(chosen)
    single = place < m
    pair = (row[1:] == row[:-1]) & single[1:] & single[:-1]
    rows = np.concatenate([row[single], row[1:][pair]])
    return rows, np.concatenate([place[single], m + place[:-1][pair] * m + place[1:][pair]])


def _said(text: str):
    return words(F.coalesce(F.col(text), F.lit("")))


def _paired_totals(train: DataFrame, text: str, chosen: list[str], stop: Sequence[str]) -> DataFrame:
    """``term, cf, df`` of the chosen words and their pairs; the row without a term has the number of texts."""
    stops, m = pa.array(sorted(stop), pa.string()), len(chosen)
    names = pa.array(chosen, pa.string())

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, term = _numbered(batch.column(0), stops, names)
            both, cf = np.unique(row + term * batch.num_rows, return_counts=True)
            found, at = np.unique(both // max(batch.num_rows, 1), return_index=True)
            first = names.take(pa.array(np.where(found < m, found, (found - m) // m)))
            last = names.take(pa.array(np.where(found < m, found, (found - m) % m)))
            term = pc.if_else(pa.array(found < m), first, pc.binary_join_element_wise(first, last, " "))
            cf = np.append(np.add.reduceat(cf, at) if len(at) else cf, 0)
            df = np.append(np.diff(np.append(at, len(both))), batch.num_rows)
            columns = [pa.concat_arrays([term.cast(pa.string()), pa.nulls(1, pa.string())]), pa.array(cf, pa.int64()), pa.array(df, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["term", "cf", "df"])

    counted = train.select(_said(text).alias("said")).mapInArrow(totals, "term STRING, cf BIGINT, df BIGINT")
    return counted.groupBy("term").agg(F.sum("cf").alias("cf"), F.sum("df").alias("df"))


def _every_total(train: DataFrame, text: str, stop: Sequence[str]) -> DataFrame:
    """The same of all words and pairs, in one pass that counts them per task before the shuffle."""
    # in a sorted array the first of a run of equal terms stands for the text
    grams = computed(train.select(text), _grams=F.sort_array(word_ngrams(text, stop)))
    before = F.concat(
        F.array(F.lit(None).cast("string")),
        F.slice("_grams", F.lit(1), F.greatest(F.size("_grams") - 1, F.lit(0))),
    )
    marked = F.zip_with(
        "_grams",
        before,
        lambda a, b: F.struct(
            a.alias("term"), F.when(b.isNull() | (a != b), F.lit(1)).otherwise(F.lit(0)).alias("first")
        ),
    )
    # one row without a term per text counts the texts in the same pass
    text_row = F.array(F.struct(F.lit(None).cast("string").alias("term"), F.lit(1).alias("first")))
    rows = F.when(F.size("_grams") > 0, F.concat(marked, text_row)).otherwise(text_row)
    return grams.select(F.inline(rows)).groupBy("term").agg(F.count(F.lit(1)).alias("cf"), F.sum("first").alias("df"))


def tfidf_vocabulary(
    train: DataFrame,
    text: str = "cleaned_text",
    max_features: int = 100,
    min_df: int = 2,
    max_df: float = 0.95,
    stop: Sequence[str] | None = None,
) -> DataFrame:
    """``term, cf, df, idf`` of the most frequent terms, at most ``max_features``.

    A pair is at most as frequent as either of its words. So single words are counted first, and
    then only pairs of frequent words: if enough terms are at least as frequent as the rarest of
    these, no other term can be among the result; if not, more words are taken. Nothing is
    grouped by (text, term).
    """
    stop = default_stop_words() if stop is None else stop
    every = train.select(F.explode(_said(text)).alias("word")).where(F.length("word") >= 2)
    if stop:
        every = every.where(~F.col("word").isin(sorted(stop)))
    frequent = every.groupBy("word").agg(F.count(F.lit(1)).alias("cf"))
    # a term is in at most as many texts as it has occurrences
    frequent = frequent.where(F.col("cf") >= min_df).persist(StorageLevel.MEMORY_AND_DISK)
    wanted = 4 * max_features
    try:
        while True:
            last = frequent.orderBy(F.desc("cf")).limit(wanted).agg(F.count(F.lit(1)).alias("n"), F.min("cf").alias("cf")).first()
            whole = last["n"] < wanted
            some = [] if last["n"] == 0 else frequent.where(F.col("cf") >= last["cf"]).limit(PAIRED_WORDS + 1).collect()
            counted = len(some) <= PAIRED_WORDS
            totals = _paired_totals(train, text, sorted(r["word"] for r in some), stop) if counted else _every_total(train, text, stop)
            top, least = _top_terms(totals, max_features, min_df, max_df)
            if whole or not counted or (least is not None and least >= last["cf"]):
                return top
            wanted *= 8
    finally:
        frequent.unpersist()


def _top_terms(totals: DataFrame, max_features: int, min_df: int, max_df: float) -> tuple[DataFrame, int | None]:
    """The vocabulary of the totals, and the occurrences of its last term if it is full."""
    totals = totals.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n = totals.where(F.col("term").isNull()).agg(F.max("df")).first()[0] or 0
        kept = totals.where(
            F.col("term").isNotNull() & (F.col("df") >= min_df) & (F.col("df") <= F.lit(max_df * n))
        )
        idf = F.log((F.lit(1.0) + F.lit(n)) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)
        top = kept.orderBy(F.desc("cf"), "term").limit(max_features).withColumn("idf", idf)
        # at most `max_features` rows
        rows = top.collect()
        least = rows[-1]["cf"] if rows and len(rows) == max_features else None
        return totals.sparkSession.createDataFrame(rows, top.schema), least
    finally:
        totals.unpersist()


def tfidf_model(vocabulary: DataFrame) -> list[tuple[str, float]]:
    """The vocabulary on the driver, by term; it has at most ``max_features`` rows."""
    return [(r["term"], r["idf"]) for r in vocabulary.select("term", "idf").orderBy("term").collect()]


def _term_counts(terms: Sequence[str], stop: Sequence[str]):
    """A function of a text's words: how often it says each of the terms."""
    parts = [t.split(" ") for t in terms]
    chosen = sorted({w for p in parts if len(p) <= 2 for w in p})
    at, m = {w: i for i, w in enumerate(chosen)}, len(chosen)
    # a term of more words is never said
    numbers = np.array([at[p[0]] if len(p) == 1 else m + at[p[0]] * m + at[p[1]] if len(p) == 2 else -1 for p in parts], np.int64)
    known, which = np.unique(numbers, return_inverse=True)
    stops, names, width = pa.array(sorted(stop), pa.string()), pa.array(chosen, pa.string()), len(terms)

    @F.arrow_udf("array<int>")
    def counts(said: pa.Array) -> pa.Array:
        row, term = _numbered(said, stops, names)
        place = np.minimum(np.searchsorted(known, term), len(known) - 1)
        hit = known[place] == term
        found = np.bincount(row[hit] * len(known) + place[hit], minlength=len(said) * len(known))
        grid = found.reshape(len(said), len(known))[:, which].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(said) + 1, dtype=np.int32) * width), pa.array(grid.ravel()))

    return counts


def with_tfidf(
    df: DataFrame,
    model: Sequence[tuple[str, float]],
    text: str = "cleaned_text",
    stop: Sequence[str] | None = None,
    out: str = "features",
) -> DataFrame:
    """Adds the unit-length TF-IDF vector over the model's terms; no shuffle."""
    stop = default_stop_words() if stop is None else stop
    terms = [t for t, _ in model]
    if not terms:
        raise ValueError("the TF-IDF vocabulary is empty")
    idf = F.lit([float(w) for _, w in model])
    weighted = computed(df.withColumn("_counts", _term_counts(terms, stop)(_said(text))), _weights=F.zip_with("_counts", idf, lambda c, w: c * w))
    unit = l2_normalize("_weights")
    return weighted.withColumn(out, unit).drop("_counts", "_weights")


# ------------------------------------------------------------ scalers


def _column_stats(train: DataFrame, features: str) -> dict:
    stats = Summarizer.metrics("count", "mean", "variance", "min", "max")
    row = train.select(
        stats.summary(array_to_vector(F.col(features).cast("array<double>"))).alias("s")
    ).first()["s"]
    n = row["count"]
    # the summary divides by n - 1; the scalers use the population variance
    spread = [math.sqrt(v * (n - 1) / n) if n > 1 else 0.0 for v in row["variance"]]
    return {"mean": list(row["mean"]), "std": spread, "min": list(row["min"]), "max": list(row["max"])}


def _shift_scale(df: DataFrame, features: str, shift, scale, out: str) -> DataFrame:
    centred = F.zip_with(
        F.col(features).cast("array<double>"), F.lit([float(x) for x in shift]), lambda x, m: x - m
    )
    scaled = F.zip_with(centred, F.lit([float(x) or 1.0 for x in scale]), lambda x, s: x / s)
    return df.withColumn(out, scaled)


def standard_scaler(train: DataFrame, features: str = "features"):
    """Zero mean and unit population variance by the training rows; a transform."""
    s = _column_stats(train, features)
    return lambda df, out="scaled": _shift_scale(df, features, s["mean"], s["std"], out)


def minmax_scaler(train: DataFrame, features: str = "features"):
    """[0, 1] by the training range; other rows may lie outside. Constant columns give 0."""
    s = _column_stats(train, features)
    width = [b - a for a, b in zip(s["min"], s["max"])]
    return lambda df, out="scaled": _shift_scale(df, features, s["min"], width, out)


# ------------------------------------------------------------ token sequences


#: Texts that are first looked through for a vocabulary.
FIRST_TEXTS = 1_000
#: Texts whose tokens a task looks up at once.
TEXTS_AT_ONCE = 1024


def _first_texts(rows: DataFrame, words: int) -> DataFrame:
    """Of ``_id, _text`` the rows up to an id by which at least ``words`` different words were seen, or all."""
    n = FIRST_TEXTS
    while True:
        top = rows.select("_id").orderBy("_id").limit(n)
        at = top.agg(F.count(F.lit(1)).alias("n"), F.max("_id").alias("last")).first()
        if at["n"] < n:
            return rows
        few = rows.where(F.col("_id").isNull() if at["last"] is None else F.col("_id").isNull() | (F.col("_id") <= F.lit(at["last"])))
        if few.select(F.explode(space_tokens("_text"))).distinct().limit(words).count() == words:
            return few
        n *= 8


def build_vocabulary(
    df: DataFrame, id_col: str = "id", text: str = "cleaned_text", max_words: int = 10_000
) -> DataFrame:
    """``word, idx`` in first-seen order from 2 on; 0 is padding and 1 an unknown word.

    At most ``max_words`` entries with those two. Texts after those that fill the vocabulary cannot
    change it, so they are not split into words.
    """
    rows = _first_texts(df.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")), max_words - 2)
    first = rows.select("_id", F.posexplode(F.array_distinct(space_tokens("_text"))).alias("_pos", "word"))
    seen = first.groupBy("word").agg(F.min(F.struct("_id", "_pos")).alias("_at"))
    early = seen.orderBy("_at", "word").limit(max_words - 2)
    # the window runs over the limited rows only
    idx = F.row_number().over(Window.orderBy("_at", "word")) + 1
    return early.select("word", idx.alias("idx"))


def with_sequences(
    df: DataFrame,
    vocabulary: DataFrame,
    text: str = "cleaned_text",
    length: int = 256,
    max_words: int = 10_000,
    out: str = "ids",
) -> DataFrame:
    """Adds the first ``length`` tokens as ids, 1 for unknown words, padded with 0.

    The vocabulary has at most ``max_words`` entries by its definition, so it travels with the
    function that looks up all words of a batch at once; no row is shuffled, and ids may repeat or
    be missing.
    """
    rows = vocabulary.select("word", "idx").limit(max_words + 1).toArrow()
    if rows.num_rows > max_words:
        raise ValueError(f"the vocabulary has more than {max_words} words")
    words, numbers = rows["word"].combine_chunks(), np.append(rows["idx"].to_numpy(), 1).astype(np.int32)

    @F.arrow_udf("array<int>")
    def encoded(tokens: pa.Array) -> pa.Array:
        ids = np.zeros((len(tokens), length), np.int32)
        for at in range(0, len(tokens), TEXTS_AT_ONCE):
            some = tokens.slice(at, TEXTS_AT_ONCE)
            said = some.flatten()
            place = pc.fill_null(pc.index_in(said, value_set=words.cast(said.type)), len(words))
            counts = pc.fill_null(pc.list_value_length(some), 0).to_numpy(zero_copy_only=False)
            ids[at : at + len(some)][np.arange(length) < counts[:, None]] = numbers[place.to_numpy(zero_copy_only=False)]
        return pa.ListArray.from_arrays(pa.array(np.arange(len(tokens) + 1, dtype=np.int32) * length), pa.array(ids.ravel()))

    return df.withColumn(out, encoded(F.slice(space_tokens(text), 1, length)))


def encode_sequences(
    df: DataFrame, vocabulary: DataFrame, id_col: str = "id", text: str = "cleaned_text", length: int = 256
) -> DataFrame:
    """``id, ids`` of every row."""
    return with_sequences(df.select(id_col, text), vocabulary, text, length).select(id_col, "ids")
