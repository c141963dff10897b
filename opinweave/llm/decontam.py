"""Benchmark decontamination by a prefix-filtered set join.

An item becomes windows of ``window`` consecutive words (one, if it is shorter), a window a set
of shingles. All occurrences of item shingles in the corpus are found in one pass, and counted.
A window occurs only where all its shingles do, so the necessary prefix in the order of rarity
is its rarest shingle: only that one is joined. The shingle's offset bounds where the window
starts, the window's length where it ends, and the words of the document there must then be the
window's words.

Everything is DataFrame functions; shingles are compared as hashes first, words decide. The item
side is broadcast if a count shows that it is small, else both sides are shuffled.

Cases: a null text has no words and an item without words no windows; a null item id is written
as an empty string; a document is known by its id and text, so ids may be null or repeat; equal
rows get equal results; extra columns are ignored; an empty table on either side leaves every
document clean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.skew import broadcast_if_small
from ..operators.staged import computed
from .common import cut, sheltered

WINDOW = 10
SHINGLE = 5
#: Item rows that may be broadcast, of a few dozen bytes each.
BROADCAST_ROWS = 1_000_000
_UPPER = "".join(map(chr, range(65, 91)))
#: ASCII characters that belong to no word.
_OTHER = "".join(c for c in map(chr, range(128)) if not c.isalnum())


def words(text: str | Column) -> Column:
    """Lower-cased runs of digits, letters and non-ASCII characters; none for a null text."""
    text = F.col(text) if isinstance(text, str) else text
    spaced = F.translate(text, _UPPER + _OTHER, _UPPER.lower() + " " * len(_OTHER))
    # one plain character to split at needs no regular expression
    return F.coalesce(F.array_remove(F.split(spaced, " "), ""), F.array().cast("array<string>"))


def _shingles(all_words: str, k: int) -> Column:
    """Hashes of the runs of ``k`` words, by their first word's place."""
    at = F.sequence(F.lit(0), F.size(all_words) - k)
    run = F.transform(at, lambda i: F.xxhash64(*[F.get(F.col(all_words), i + j) for j in range(k)]))
    return F.when(F.size(all_words) >= k, run).otherwise(F.array().cast("array<bigint>"))


def _windows(items: DataFrame, window: int) -> DataFrame:
    """``item, text, n``: the distinct windows of every item, ``n`` words long."""
    rows = computed(items.select("item_id", "text"), w=words("text"))
    rows = rows.where(F.size("w") > 0).withColumn("n", F.least(F.size("w"), F.lit(window)))
    starts = F.sequence(F.lit(1), F.size("w") - F.col("n") + 1)
    texts = F.transform(starts, lambda i: F.array_join(F.slice("w", i, F.col("n")), " "))
    item = F.coalesce(F.col("item_id").cast("string"), F.lit(""))
    return rows.select(item.alias("item"), F.explode(texts).alias("text"), "n").distinct()


def _attached(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    small = broadcast_if_small(right, BROADCAST_ROWS)
    return left.join(right if small is None else small, on, how)


def hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """``text, doc_id, text_key, start, n, item``: every occurrence of a window in a document."""
    item_windows = cut(_windows(items, window))
    texts = item_windows.select("text", "n").distinct()
    k_of = F.least(F.col("n"), F.lit(shingle))
    rows = texts.select("text", "n", F.split("text", " ").alias("w"), k_of.alias("k"))
    lengths = sorted(r[0] for r in rows.select("k").distinct().collect())  # at most `shingle`
    empty = "text STRING, doc_id BIGINT, text_key BIGINT, start INT, n INT, item STRING"
    if not lengths:
        return docs.sparkSession.createDataFrame([], empty)
    pieces = [
        rows.where(F.col("k") == k).select(
            "text", "n", F.lit(k).alias("k"), F.posexplode(_shingles("w", k)).alias("offset", "shingle")
        )
        for k in lengths
    ]
    parts = pieces[0]
    for more in pieces[1:]:
        parts = parts.unionByName(more)
    parts = cut(parts)

    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    doc_words = computed(keyed, w=words("text"))
    found = None
    for k in lengths:
        at = doc_words.select(
            "doc_id", "text_key", F.size("w").alias("n_words"), F.posexplode(_shingles("w", k)).alias("at", "shingle")
        )
        wanted = parts.where(F.col("k") == k).select("shingle").distinct()
        one = _attached(at, wanted, "shingle").withColumn("k", F.lit(k))
        found = one if found is None else found.unionByName(one)
    found = cut(found)

    rarity = found.groupBy("k", "shingle").agg(F.count(F.lit(1)).alias("count"))
    ranked = parts.join(rarity, ["k", "shingle"], "left").groupBy("text", "n", "k")
    rarest = ranked.agg(
        F.min(F.struct("count", "offset", "shingle")).alias("first"),
        F.count(F.when(F.col("count").isNull(), 1)).alias("missing"),
    ).where("missing = 0")
    prefix = rarest.select("n", "k", F.col("first.offset").alias("offset"), F.col("first.shingle").alias("shingle"))
    start = F.col("at") - F.col("offset")
    near = found.join(prefix.distinct(), ["k", "shingle"]).select("doc_id", "text_key", start.alias("start"), "n", "n_words")
    near = near.where((F.col("start") >= 0) & (F.col("start") + F.col("n") <= F.col("n_words")))
    by_doc = near.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "n")).alias("at"))
    by_doc = by_doc.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "at")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))
    full = computed(keyed.join(by_doc, same).select("doc_id", "text_key", "at", "text"), w=words("text"))
    said = F.transform(
        "at",
        lambda s: F.struct(
            s["start"].alias("start"), s["n"].alias("n"), F.array_join(F.slice("w", s["start"] + 1, s["n"]), " ").alias("text")
        ),
    )
    said = full.select("doc_id", "text_key", F.explode(said).alias("s"))
    said = said.select("doc_id", "text_key", "s.start", "s.n", "s.text")
    return _attached(said, item_windows.select("item", "text"), "text")


def contamination(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE
) -> DataFrame:
    """``doc_id, text_key`` of every row of ``docs`` with its words, and what items left there.

    ``n_words``; ``n_hit``, the words inside a window of an item; ``items``, the ids found, as
    sorted strings.
    """
    found = hits(docs, items, window, shingle)
    spans = F.sort_array(F.collect_set(F.struct("start", (F.col("start") + F.col("n")).alias("end"))))
    by_doc = found.groupBy("doc_id", "text_key").agg(
        spans.alias("spans"), F.sort_array(F.collect_set("item")).alias("items")
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, s: F.struct(
            (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(a["end"], s["start"]))).alias("n"),
            F.greatest(a["end"], s["end"]).alias("end"),
        ),
        lambda a: a["n"].cast("long"),
    )
    by_doc = by_doc.select(
        F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), covered.alias("n_hit"), "items"
    )
    n_words = F.size(words("text")).cast("long")
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), n_words.alias("n_words"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))
    none = F.array().cast("array<string>")
    return rows.join(by_doc, same, "left").select(
        "doc_id",
        "text_key",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", none).alias("items"),
    )


@sheltered
def clean_documents(docs: DataFrame, items: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs``, all columns, in which no window of an item occurs."""
    found = hits(docs, items, **settings).select(
        F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")
    )
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_key"))
    return docs.join(found.distinct(), same, "left_anti")


def contamination_report(docs: DataFrame, items: DataFrame, **settings) -> DataFrame:
    rows = contamination(docs, items, **settings)
    return rows.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
