"""Near-duplicate groups with an LSH forest.

Every document is a set of word shingles; equal sets are one class from the start, whatever the
number of copies. A class has a MinHash signature, cut into `TREES` runs of `DEEPEST` values:
each run is a sorted order of its own, a tree of the forest. Classes whose longest common prefix
in some tree reaches `SHALLOWEST` values share a region. A region of more than `REGION` classes
goes one value deeper, as far as `DEEPEST`, so depth adapts to how dense a region is.

* Small regions give candidate pairs, if the whole signatures agree well enough (five standard
  deviations below the threshold, so the filter loses nothing that matters).
* Regions that stay large at the deepest level hold many similar texts. Overlapping ones form a
  family, whose classes are compared exactly, block against block, as a matrix product: no pair
  is emitted but a spanning forest of the links that each two blocks have.

* Classes of a region that goes deeper may part there, so they get `MORE` trees besides, of
  `DEEPEST` values, whose regions are treated as all others.

Links are confirmed on the full sets, and the groups are the components of the links. A pair at
the threshold meets in no tree with a chance of at most ``(1 - t**3)**20 + (1 - t**6)**48`` (1.0e-6
at 0.8, 5.5e-9 at 0.85), the first term where its regions are small, the second where they are large.

Cases: a null or blank text has no shingles and is a group of its own; fewer words than a
shingle make one shingle; rows with a null id join groups and take their id, alone they have a
null component; rows with repeated ids are rows of their own with their texts' groups; an empty
table gives an empty result. Shingles are compared as 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import bounded_batches, cut, merged, mix64, sheltered, small_batches
from .graph import components
from .shingling import Powers, minhash, shingles, word_hashes

TREES, DEEPEST, SHALLOWEST = 20, 6, 3
WIDTH = TREES * DEEPEST
REGION = 32
BLOCK = 256
MULTIPLIERS = (mix64(np.arange(WIDTH, dtype=np.uint64) + np.uint64(77)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
#: So many that all trees at the deepest level miss no more than `TREES` at the shallowest.
MORE = 28
MORE_MULTIPLIERS = (
    mix64(np.arange(MORE * DEEPEST, dtype=np.uint64) + np.uint64(1_000_003)) >> np.uint64(32)
).astype(np.uint32) | np.uint32(1)
LEVELS = [f"h{d}" for d in range(SHALLOWEST, DEEPEST + 1)]


def _fingerprint(s: np.ndarray) -> int:
    """Of a whole set."""
    return int(mix64(s ^ np.uint64(0x5851F42D4C957F2D)).sum() + np.uint64(len(s))) if len(s) else 0


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _shingle_sets(batch: pa.RecordBatch, k: int, powers: Powers) -> list[np.ndarray]:
    texts = batch.column(batch.schema.get_field_index("text")).fill_null("")
    return shingles(*word_hashes(texts, powers), k)


def _row_key(docs: DataFrame) -> Column:
    """Of a row with all its columns."""
    return F.xxhash64(*docs.columns)


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """``doc_id, text_key, row_key, n_shingles, node, signature`` of every row; ``node`` stands for the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in small_batches(batches, "text", 1 << 20):
            sets = _shingle_sets(batch, k, powers)
            signed = minhash([s for s in sets if len(s)], MULTIPLIERS)
            rows = iter(signed)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    batch.column(2),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_signed(_fingerprint(s)) if len(s) else None for s in sets], pa.int64()),
                    pa.array([next(rows).tobytes() if len(s) else None for s in sets], pa.binary()),
                ],
                ["doc_id", "text_key", "row_key", "n_shingles", "node", "signature"],
            )

    keys = F.xxhash64("text").alias("text_key"), _row_key(docs).alias("row_key")
    rows = docs.select(F.col("doc_id").cast("long"), *keys, "text")
    return rows.mapInArrow(
        run, "doc_id BIGINT, text_key BIGINT, row_key BIGINT, n_shingles BIGINT, node BIGINT, signature BINARY"
    )


def _prefixes(values: np.ndarray, first: int) -> Iterator[np.ndarray]:
    """For runs of values (classes x trees x depth) the hashes of their prefixes, depth by depth."""
    n, trees, depth = values.shape
    h = np.broadcast_to(mix64(np.arange(first, first + trees, dtype=np.uint64)), (n, trees))
    for d in range(depth):
        h = mix64(h * np.uint64(3) + values[:, :, d].astype(np.uint64))
        yield h


def _tree_rows(classes: DataFrame) -> DataFrame:
    """``node, h3..h6``: for every tree the hashes of the signature's prefixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            raw = b"".join(batch.column(1).to_pylist())
            values = np.frombuffer(raw, np.uint16).reshape(n, TREES, DEEPEST)
            columns = [np.repeat(batch.column(0).to_numpy(), TREES)]
            columns += [h.ravel().view(np.int64) for h in list(_prefixes(values, 1))[SHALLOWEST - 1 :]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["node", *LEVELS])

    kinds = ", ".join(f"{c} BIGINT" for c in ["node", *LEVELS])
    return classes.select("node", "signature").mapInArrow(run, kinds)


def _more_prefixes(sets: list[np.ndarray]) -> list[bytes]:
    """Per set the hashes of its `MORE` trees at the deepest level."""
    values = minhash(sets, MORE_MULTIPLIERS).reshape(len(sets), MORE, DEEPEST)
    *_, h = _prefixes(values, TREES + 1)
    return [row.tobytes() for row in h]


def _more_regions(docs: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """``region, n, node`` of some classes in further trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64)
            node = np.repeat(batch.column(0).to_numpy(), MORE)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(node)], ["region", "node"])

    rows = cut(_sets(docs, nodes, k, _more_prefixes).mapInArrow(run, "region BIGINT, node BIGINT"))
    shared = rows.groupBy("region").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return rows.join(shared, "region").select("region", "n", "node")


def _regions(classes: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """``region, n, node``: the region of every class in every tree where it has company."""
    rows = _tree_rows(classes)
    shared = rows.groupBy("h3").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    open_ = cut(rows.join(shared, "h3"))
    done = open_.where(F.col("n") <= REGION).select(F.col("h3").alias("region"), "n", "node")
    open_ = open_.where(F.col("n") > REGION).drop("n")
    if not open_.isEmpty():
        crowded = classes.select("node", "doc").join(open_.select("node").distinct(), "node")
        done = done.union(_more_regions(docs, crowded, k))
    for level in LEVELS[1:]:
        sizes = open_.groupBy(level).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        open_ = open_.join(sizes, level)
        ready = F.lit(True) if level == LEVELS[-1] else F.col("n") <= REGION
        done = done.union(open_.where(ready).select(F.col(level).alias("region"), "n", "node"))
        open_ = open_.where(~ready).drop("n")
    return cut(merged(done))


def _candidates(regions: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """``a, b``: pairs of small regions whose signatures agree well enough."""
    t = percent / 100
    least = math.floor(WIDTH * t - 5 * math.sqrt(WIDTH * t * (1 - t)))
    small = regions.where(F.col("n") <= REGION).select("region", "node")
    rows = small.join(classes.select("node", "signature"), "node")
    rows = rows.repartition("region").sortWithinPartitions("region", "node")

    def pairs(region: np.ndarray, node: np.ndarray, signed: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k in range(1, REGION):
            i = np.flatnonzero(region[:-k] == region[k:])
            if not len(i):
                return
            i = i[(signed[i] == signed[i + k]).sum(1) >= least]
            yield pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(node[i + k])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        region, node = np.zeros(0, np.int64), np.zeros(0, np.int64)
        signed = np.zeros((0, WIDTH), np.uint16)
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint16).reshape(-1, WIDTH)
            region = np.concatenate([region, batch.column(0).to_numpy()])
            node = np.concatenate([node, batch.column(1).to_numpy()])
            signed = np.concatenate([signed, new])
            end = int(np.flatnonzero(region != region[-1])[-1]) + 1 if (region != region[-1]).any() else 0
            yield from pairs(region[:end], node[:end], signed[:end])
            region, node, signed = region[end:], node[end:], signed[end:]  # may go on
        yield from pairs(region, node, signed)

    found = rows.select("region", "node", "signature").mapInArrow(run, "a BIGINT, b BIGINT")
    return found.distinct()


def _whole(sets: list[np.ndarray]) -> list[bytes]:
    return [s.tobytes() for s in sets]


def _sets(
    docs: DataFrame, nodes: DataFrame, k: int, form: Callable[[list[np.ndarray]], list[bytes]] = _whole
) -> DataFrame:
    """``node, words``: the full sets of some classes, or another form of them, read again from one text of each."""
    texts = docs.select("doc_id", "text").join(
        nodes.select(F.col("doc").alias("_doc")).distinct(), F.col("doc_id").eqNullSafe(F.col("_doc")), "left_semi"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in small_batches(batches, "text", 1 << 20):
            sets = [s for s in _shingle_sets(batch, k, powers) if len(s)]
            ids = pa.array([_signed(_fingerprint(s)) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(form(sets), pa.binary())], ["node", "words"])

    rows = texts.mapInArrow(run, "node BIGINT, words BINARY")
    return rows.join(nodes.select("node"), "node", "left_semi").dropDuplicates(["node"])


def _is_linked(common: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    return 100 * common >= percent * (n + m - common)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    left = sets.select(F.col("node").alias("a"), F.col("words").alias("u"))
    right = sets.select(F.col("node").alias("b"), F.col("words").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in small_batches(iter([whole]), "u", 4 << 20):
                keep = []
                for u, v in zip(batch.column("u"), batch.column("v"), strict=True):
                    x, y = (np.frombuffer(z.as_buffer(), np.uint64) for z in (u, v))
                    both = np.sort(np.concatenate([x, y]), kind="stable")
                    common = np.count_nonzero(both[1:] == both[:-1])
                    keep.append(bool(_is_linked(common, len(x), len(y), percent)))
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    rows = pairs.join(left, "a").join(right, "b").select("a", "b", "u", "v")
    return rows.mapInArrow(run, "a BIGINT, b BIGINT")


def common_counts(sets: list[np.ndarray], most: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all sets, as a matrix product over shared members."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, member, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.cumsum(count > 1) - 1
    keep = count[member] > 1
    owner, member = owner[keep], rank[member[keep]]
    order = np.argsort(member, kind="stable")
    owner, member = owner[order], member[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, int(member[-1]) + 1 if len(member) else 0, most):
        lo, hi = np.searchsorted(member, [at, at + most])
        held = np.zeros((len(sets), most), np.float32)
        held[owner[lo:hi], member[lo:hi] - at] = 1
        out += held @ held.T
    return out.astype(np.int64)


def spanning(n: int, pairs: np.ndarray) -> list[tuple[int, int]]:
    """Those of the pairs that join parts which earlier ones left apart."""
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for i, j in pairs.tolist():
        a, b = find(i), find(j)
        if a != b:
            root[a] = b
            out.append((i, j))
    return out


def _family_links(large: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links among the classes of large regions, block against block."""
    hubs = large.groupBy("region").agg(F.min("node").alias("hub"))
    edges = large.join(hubs, "region").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    families = components(edges)
    sizes = families.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    members = families.join(sizes, "root").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    members = members.join(sets, "node")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    rows = members.select("root", "node", "words", "block", other)
    rows = rows.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))

    def verify(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("node")
        sets = [np.frombuffer(w, np.uint64) for w in group["words"]]
        size = np.array([len(s) for s in sets])
        linked = _is_linked(common_counts(sets), size[:, None], size[None, :], percent)
        node = group["node"].to_numpy()
        found = spanning(len(sets), np.argwhere(np.triu(linked, 1)))
        return pd.DataFrame({"a": [node[i] for i, _ in found], "b": [node[j] for _, j in found]}, dtype="int64")

    rows = rows.select("root", "lo", "hi", "node", "words")
    return rows.groupBy("root", "lo", "hi").applyInPandas(verify, "a BIGINT, b BIGINT")


def groups(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, text_key, row_key, n_shingles, node, root, component_id`` of every row of ``docs``.

    Documents are linked if 100 times the common shingles reach ``percent`` times all of them;
    ``component_id`` is the least id that links lead to, ``root`` the least node.
    """
    bounded_batches(docs)
    light = cut(signatures(docs, k))
    classes = light.where("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("doc"), F.first("signature").alias("signature")
    )
    classes = cut(classes)
    regions = _regions(classes, docs, k)
    pairs = cut(_candidates(regions, classes, percent))

    large = regions.where(F.col("n") > REGION).select("region", "node")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).union(large.select("node")).distinct()
    sets = cut(_sets(docs, classes.select("node", "doc").join(ends, "node"), k))
    links = _confirmed(pairs, sets, percent)
    if not large.isEmpty():
        links = links.union(_family_links(large, sets, percent))
    roots = components(cut(merged(links)))
    named = roots.join(classes.select("node", "doc"), "node")
    first = named.groupBy("root").agg(F.min("doc").alias("first"))
    named = named.join(first, "root").select("node", "root", "first")
    of_class = classes.select("node", "doc").join(named, "node", "left")
    of_class = of_class.select(
        "node", F.coalesce("root", "node").alias("root"), F.coalesce("first", "doc").alias("component")
    )
    out = light.drop("signature").join(of_class, "node", "left")
    alone = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", "text_key", "row_key", "n_shingles", "node", "root", alone.alias("component_id"))


@sheltered
def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, that stay: of each group one row with the least id.

    Where rows repeat that id, or a group has null ids only, one of them stays, chosen by a hash
    of the row; of rows that are equal in all columns any. Documents without shingles all stay.
    """
    found = groups(docs, k, percent)
    lone = found.where("node is null").select("doc_id", "row_key").distinct()
    least = found.where("node is not null and doc_id <=> component_id")
    least = least.groupBy("root", "doc_id", "row_key").agg(F.count(F.lit(1)).alias("n"))
    first = least.groupBy("root").agg(F.min("row_key").alias("row_key"))
    first = cut(least.join(first, ["root", "row_key"]).select("doc_id", "row_key", "n"))

    def taken(stay: DataFrame) -> DataFrame:
        stay = stay.select(F.col("doc_id").alias("_doc"), F.col("row_key").alias("_key"))
        same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (_row_key(docs) == F.col("_key"))
        return docs.join(stay, same, "left_semi")

    once = taken(lone.union(first.where("n = 1").select("doc_id", "row_key")))
    repeated = first.where("n > 1")
    return once if repeated.isEmpty() else once.union(taken(repeated).dropDuplicates())


def group_report(docs: DataFrame, k: int = 3, percent: int = 85) -> DataFrame:
    rows = groups(docs, k, percent)
    return rows.select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    )
