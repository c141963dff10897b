"""Removal of repeated lines by an exact set-similarity join.

A line is the set of its words. A line goes if an earlier line (smaller document id, or before in
the same one) has a Jaccard similarity of ``percent`` hundredths with it; all lines are judged on
the input. Lines with equal sets are one class, combined in the tasks that read them, so the
number of copies of a line does not matter; a class is kept where it first occurs, unless a
similar class occurs before.

Words are ordered by rarity: a sketch counts them in a fixed number of hash buckets, and the order
is by count, then hash. Two sets that are similar enough share one of their first words in that
order, of which there are ``n - ceil(t * n) + 1`` (prefix filter). Classes are joined on these
words; their sizes (length filter) and the places of the shared word (positional filter) must
leave room for enough common words, and so must a bitmap of each set. Before that join each class is
compared with a few first classes that share some words with it, and what has a similar earlier
class by then looks for no other: near copies of a line mostly cost a bounded number of pairs each. What
this misses the join finds. The words themselves decide. All of it is DataFrame functions; hashes
only find candidates and classes.

Cases: a null text has no lines; a line without words is always kept; rows with a null id come
first; rows with one id and different texts are ordered by a hash of the text; rows that repeat
id and text get one result, that of the first; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.skew import attach
from ..operators.staged import computed
from .common import SPACE, freed_shuffles, sheltered, written

PERCENT = 80
#: Hash buckets of the word counts: a table of 2 MB whatever the corpus.
BUCKETS = 1 << 18
FIRST_ID = -(1 << 63)
BLANKS = " \t\v\f\r"
#: The level of words that occur once.
ONCE = 4
#: Sets of so many words have bitmaps of 192 bits, smaller ones of 64.
LONG = 64
#: Rounds in which candidates are found, each by its share of the words, which it shuffles alone.
PASSES = 2
#: Rare words of a class of which every two are looked up together.
RAREST = 3
#: With how many classes that share such words a class is compared.
FIRSTS = 4
#: Documents with candidate lines, some dozen bytes each, that may be broadcast.
BROADCAST_ROWS = 250_000


def _words(line: str | Column) -> Column:
    return F.array_remove(F.split(line, f"[{SPACE}]+"), "")


def _keyed(docs: DataFrame) -> DataFrame:
    """``doc, key, text``: the order of documents."""
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST_ID))
    return docs.select(doc.alias("doc"), F.xxhash64("text").alias("key"), "text")


def _bucket(token: Column) -> Column:
    return token.bitwiseAND(BUCKETS - 1)


def _lines(keyed: DataFrame) -> DataFrame:
    """``set, at, tokens``: lines with words, 64 bits of all their words' hashes, their place, and 31 bits of each hash."""
    lines = keyed.select("doc", "key", F.posexplode(F.split("text", "\n")).alias("line", "said"))
    hashes = F.array_distinct(F.transform(F.split("said", f"[{SPACE}]+"), lambda w: F.xxhash64(w)))
    hashes = F.sort_array(F.array_remove(hashes, F.xxhash64(F.lit(""))))
    rows = computed(lines, hashed=hashes).where(F.size("hashed") > 0)
    return rows.select(
        F.xxhash64("hashed").alias("set"), F.struct("doc", "key", "line").alias("at"),
        F.transform("hashed", lambda h: h.bitwiseAND(0x7FFFFFFF).cast("int")).alias("tokens"),
    )


def rarity(lines: DataFrame) -> Column:
    """A fixed array: for every bucket how often its words occur, in quarters of a power of two.

    Words that occur once are at level ``ONCE`` at most.
    """
    counts = lines.select(F.explode("tokens").alias("t")).groupBy(_bucket(F.col("t")).alias("bucket"))
    level = F.floor(F.log2(F.count(F.lit(1)) + 1) * 4).cast("int")
    with freed_shuffles(lines.sparkSession):
        found = counts.agg(level.alias("level")).toArrow()  # at most BUCKETS rows
    levels = ["0"] * BUCKETS
    for bucket, at in zip(found["bucket"].to_pylist(), found["level"].to_pylist(), strict=True):
        levels[bucket] = str(at)
    return F.split(F.lit(",".join(levels)), ",").cast("array<bigint>")  # folded to a constant


def _odd(tokens: str, keep: Callable[[Column], Column] | None = None) -> Column:
    """A bit for each remainder of 64, set if an odd number of the tokens (that ``keep`` takes) has it."""
    none, one = F.lit(0).cast("long"), F.lit(1).cast("long")

    def add(bits: Column, t: Column) -> Column:
        bit = F.call_function("shiftleft", one, t)  # by the last six bits
        return bits.bitwiseXOR(bit if keep is None else F.when(keep(t), bit).otherwise(none))

    return F.aggregate(tokens, none, add)


def _classes(keyed: DataFrame, percent: int) -> DataFrame:
    """``class, doc, key, line, n, bits, m1, m2, prefix, rare, low``: distinct word sets, numbered by where they occur first.

    ``bits`` is a bitmap of 64 bits; for sets of ``LONG`` words or more it is the sum of the three
    parts of one of 192, of which ``m1`` and ``m2`` are two. ``prefix`` has the rarest words,
    by which a class is found, null for words that no other line has; ``rare`` the rarest of the others, ``low``
    the words with the lowest hashes, which do not depend on how often a family has its words.
    """
    lines = _lines(keyed).persist(StorageLevel.DISK_ONLY)
    levels, low = rarity(lines), 0x7FFFFFFF
    # never null, so arrays are sorted as plain numbers
    order = F.sort_array(F.transform("tokens", lambda t: F.shiftleft(F.coalesce(F.get(levels, _bucket(t)), F.lit(0).cast("long")), 32) + t))
    word = lambda o: o.bitwiseAND(low).cast("int")
    shared = lambda o: F.shiftright(o, 32) > ONCE
    n = F.size("tokens")
    needed = F.floor((n * percent + 99) / 100).cast("int")
    rows = computed(lines, order=order)
    part = lambda j: F.when(n >= LONG, _odd("tokens", lambda t: F.shiftright(t, 6) % 3 == j)).otherwise(F.lit(0).cast("long"))
    rows = rows.select("set", "at", F.struct(
        n.alias("n"), _odd("tokens").alias("bits"), *(part(j).alias(f"m{j}") for j in (1, 2)),
        F.transform(F.slice("order", 1, n - needed + 1), lambda o: F.when(shared(o), word(o))).alias("prefix"),
        F.transform(F.slice(F.filter(F.slice("order", 1, n - needed + 3 * RAREST), shared), 1, RAREST), word).alias("rare"),
        F.slice("tokens", 1, RAREST + 1).alias("low"),
    ).alias("is"))
    rows = written(rows)  # later plans, which the driver keeps as text, are without the levels
    lines.unpersist()
    found = rows.groupBy("set").agg(F.min("at").alias("at"), F.first("is").alias("is"))
    placed = found.select("at.*", "is.*").orderBy("doc", "key", "line")
    return written(placed.select(F.monotonically_increasing_id().alias("class"), "*"))


def _apart(x: str, y: str) -> Column:
    """By how many words two classes differ at least, by their bitmaps."""
    def ones(*names: str) -> Column:
        both = F.lit(0).cast("long")
        for c in names:
            both = both.bitwiseXOR(F.col(f"{x}.{c}")).bitwiseXOR(F.col(f"{y}.{c}"))
        return F.bit_count(both)

    wide = ones("bits", "m1", "m2") + ones("m1") + ones("m2")
    return F.when(F.least(F.col(f"{x}.n"), F.col(f"{y}.n")) >= LONG, wide).otherwise(ones("bits"))


def _near(x: str, y: str, percent: int) -> Column:
    """If sizes and bitmaps of two classes leave room for enough common words."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    return (
        (100 * F.least(n, m) >= percent * F.greatest(n, m))
        & ((100 + percent) * _apart(x, y) <= (100 - percent) * (n + m))
    )


def _promising(classes: DataFrame, percent: int) -> DataFrame:
    """``late, early``: for a class the most similar, by bitmaps, of the first classes that share some words.

    These are two of its rarest words, or three of the four with the lowest hashes. Classes that
    share them are dealt to ``FIRSTS`` parts, of each the first is compared.

    Near copies of a line are found by this, one pair for each; what it misses the candidates have.
    """
    get = lambda i: F.get("rare", F.lit(i))
    signs = [F.when(get(j).isNotNull(), F.xxhash64(get(i), get(j))) for j in range(RAREST) for i in range(j)]
    low = [[F.get("low", F.lit(i)) for i in range(RAREST + 1) if i != j] for j in range(RAREST + 1)]
    signs += [F.when(words[-1].isNotNull(), F.xxhash64(*words)) for words in low]
    signed = classes.select("class", F.explode(F.array(*signs)).alias("sign")).where("sign is not null")
    part = F.pmod(F.xxhash64("class"), F.lit(FIRSTS))
    firsts = signed.groupBy("sign", part.alias("part")).agg(F.min("class").alias("early"))
    pairs = signed.join(firsts.select("sign", "early"), "sign").where(F.col("class") > F.col("early"))
    pairs = written(pairs.select(F.col("class").alias("late"), "early").distinct())
    maps = classes.select("class", "n", "bits", "m1", "m2")
    both = pairs.join(maps.alias("x"), F.col("late") == F.col("x.class")).join(maps.alias("y"), F.col("early") == F.col("y.class"))
    near = both.where(_near("x", "y", percent)).select("late", "early", _apart("x", "y").alias("apart"))
    best = near.groupBy("late").agg(F.min_by("early", F.struct("apart", "early")).alias("early"))
    return written(best)


def _candidates(classes: DataFrame, settled: DataFrame, percent: int) -> DataFrame:
    """``late, early``: classes that share a rare word and may be similar enough, the later one not settled.

    Of two similar sets the smaller shares with the larger one of its first
    ``n - ceil(2 t n / (1 + t)) + 1`` words already, so only those look for partners.
    """
    known = classes.join(settled.select(F.col("late").alias("class"), F.lit(True).alias("gone")), "class", "left")
    fields = ["class", "n", "bits", "m1", "m2", F.col("gone").isNotNull().alias("gone")]
    rows = known.select(*fields, F.posexplode("prefix").alias("place", "word")).where("word is not null")
    n, m = F.col("l.n"), F.col("r.n")
    a, b = F.col("l.class"), F.col("r.class")
    looks = n - F.floor((2 * percent * n + 99 + percent) / (100 + percent)).cast("int")
    rest = F.least(n - F.col("l.place"), m - F.col("r.place"))  # the shared word and those after it
    fits = (
        (F.col("l.word") == F.col("r.word"))
        & (F.col("l.place") <= looks)
        & ((n < m) | ((n == m) & (a < b)))
        & ~F.when(a < b, F.col("r.gone")).otherwise(F.col("l.gone"))
        & ((100 + percent) * rest >= percent * (n + m))
        & _near("l", "r", percent)
    )
    found = []
    for i in range(PASSES):
        some = rows.where(F.col("word") % PASSES == i)
        pairs = some.alias("l").join(some.alias("r"), fits)
        found.append(written(pairs.select(F.greatest(a, b).alias("late"), F.least(a, b).alias("early")).distinct()))
    return written(reduce(DataFrame.union, found).distinct())


def _sets(keyed: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """``class, words`` of all classes in the pairs; rows that repeat id and text say the same."""
    ends = pairs.select(F.explode(F.array("late", "early")).alias("class")).distinct()
    by_doc = classes.select("class", "doc", "key", "line").join(ends, "class").groupBy("doc", "key").agg(
        F.collect_list(F.struct("line", "class")).alias("wanted")
    )
    texts = computed(attach(keyed, by_doc, ["doc", "key"], "inner", BROADCAST_ROWS), lines=F.split("text", "\n"))
    found = texts.select("lines", F.explode("wanted").alias("w"))
    words = F.array_distinct(_words(F.get(F.col("lines"), F.col("w.line"))))
    return found.select(F.col("w.class").alias("class"), words.alias("words")).dropDuplicates(["class"])


def _similar(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """``late`` of the pairs whose word sets are similar."""
    x = sets.select(F.col("class").alias("early"), F.col("words").alias("u"))
    y = sets.select(F.col("class").alias("late"), F.col("words").alias("v"))
    both = pairs.join(x, "early").join(y, "late").withColumn("c", F.size(F.array_intersect("u", "v")))
    enough = 100 * F.col("c") >= percent * (F.size("u") + F.size("v") - F.col("c"))
    return written(both.where(enough).select("late").distinct())


def later_copies(keyed: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """``late``: the classes that have a similar one before them.

    One similar class is enough. So near copies are first compared with the first of their kind
    alone, a pair for each; only classes that this does not settle look for all earlier partners.
    """
    def similar(pairs: DataFrame) -> DataFrame:
        sets = _sets(keyed, classes, pairs).persist(StorageLevel.DISK_ONLY)
        found = _similar(sets, pairs, percent)
        sets.unpersist()
        return found

    settled = similar(_promising(classes, percent))
    return settled.union(similar(_candidates(classes, settled, percent)))


def kept_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``doc, key, line``: the places of the lines with words that stay."""
    keyed = _keyed(docs)
    classes = _classes(keyed, percent)
    later = later_copies(keyed, classes, percent).withColumnRenamed("late", "class")
    return classes.select("class", "doc", "key", "line").join(later, "class", "left_anti").drop("class")


def _stay(docs: DataFrame, percent: int) -> DataFrame:
    """``_doc, _key, _stay``: the numbers of the lines that stay, for every text that has one."""
    stay = kept_lines(docs, percent).groupBy("doc", "key").agg(F.collect_list("line").alias("_stay"))
    return stay.withColumnsRenamed({"doc": "_doc", "key": "_key"})


def _named(docs: DataFrame) -> DataFrame:
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST_ID))
    return docs.withColumns({"_doc": doc, "_key": F.xxhash64("text")})


@sheltered
def remove_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """All columns of ``docs``, the text without its repeated lines."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(x.alias("said"), i.alias("i")))
    stays = F.filter(
        lines, lambda x: F.coalesce(F.array_contains("_stay", x["i"]), F.lit(False)) | ~x["said"].rlike(f"[^{SPACE}]")
    )
    text = F.array_join(F.transform(stays, lambda x: x["said"]), "\n")
    rows = _named(docs).join(_stay(docs, percent), ["_doc", "_key"], "left")
    return rows.withColumn("text", F.when(F.col("text").isNotNull(), text)).select(*docs.columns)


def line_report(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Lines of every document, how many have words, and the numbers of those that stay."""
    split = F.split("text", "\n")
    with_words = F.size(F.filter(split, lambda x: F.trim(x, F.lit(BLANKS)) != ""))
    counted = _named(docs.select("doc_id", "text")).select(
        "doc_id",
        "_doc",
        "_key",
        F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(split)).cast("long").alias("n_lines"),
        F.when(F.col("text").isNull(), F.lit(0)).otherwise(with_words).cast("long").alias("_said"),
    )
    rows = counted.join(_stay(docs, percent), ["_doc", "_key"], "left")
    stay = F.sort_array(F.coalesce("_stay", F.array().cast("array<int>")))
    return rows.select(
        "doc_id", "n_lines", (F.col("_said") - F.size(stay)).alias("n_removed"), F.array_join(stay, ",").alias("kept_lines")
    )
