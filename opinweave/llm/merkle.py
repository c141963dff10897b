"""A Merkle manifest of a dataset: one root, and for every row a proof that it belongs to it.

Rows are the leaves of a tree per group (language); each two consecutive nodes become their hash, a
last one without a partner too, until one is left. The groups' roots are the leaves of one more
tree, whose root stands for the dataset. A proof is the sibling on every level.

Leaves are put in order by range partitioning, so a group of any share of the rows lies in many
partitions; a run is what a partition holds of a group. All runs build what is theirs at once:

* *cover*: a run hashes upward and gives away its topmost complete nodes, some two per level;
* *blocks*: nodes between runs are made from the covers in blocks of ``2^HEIGHT`` leaves, then from
  the blocks' roots in blocks of ``2^(2 HEIGHT)``, so no task sees more than ``2^HEIGHT`` of them;
* *octopus*: a run lists the coordinates that its proofs need beyond what it can derive itself, each
  once, whatever the number of its leaves (again some two per level), and fetches them in one join;
* *expansion*: with these it derives the shared interior nodes and reads every proof off locally.

So what is exchanged besides the leaves is in proportion to the number of partitions and levels.
Nothing is collected on the driver but the size of the largest group.

Cases: any value may be null; rows that repeat an id are ordered by their hashes, equal rows have
equal leaves at places of their own; a null id comes first and is never tampered with; a null group
comes first and differs from an empty one; a group of one row is its own root; an empty table gives
an empty result. Columns that are not named take no part.
"""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.skew import attach
from .common import cut

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels that one round of blocks makes.
HEIGHT = 12
TAMPERED = 7

Nodes = list[dict[int, bytes]]


def field(value: Column) -> Column:
    """A value as its length in bytes, a colon and itself, or ``-``: no two rows read the same."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(columns: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*(field(c) for c in columns)), 256)


# ---------------------------------------------------------------- trees in one task


def parent_hash(left: bytes, right: bytes = b"") -> bytes:
    return sha256(left + right).hexdigest().encode()


def widths(size: int) -> list[int]:
    """Nodes of every level of a tree of ``size`` leaves, the last is 1."""
    out = [size]
    while out[-1] > 1:
        out.append((out[-1] + 1) // 2)
    return out


def missing(size: int, leaves: np.ndarray) -> list[tuple[int, int]]:
    """The fewest ``(level, index)`` that, with ``leaves``, give all their proofs: an octopus."""
    out = []
    known = np.unique(leaves)
    for level, width in enumerate(widths(size)[:-1]):
        beside = known ^ 1
        away = np.setdiff1d(beside[beside < width], known, assume_unique=True)
        out += [(level, int(i)) for i in away]
        known = np.unique(known >> 1)
    return out


def derive(nodes: Nodes, size: int, top: int | None = None) -> None:
    """Adds, up to level ``top``, every node whose children are known. ``nodes`` has a dict per level."""
    wide = widths(size)
    last = len(wide) - 1 if top is None else min(top, len(wide) - 1)
    for level in range(last):
        here, above, alone = nodes[level], nodes[level + 1], wide[level] - 1
        for index, value in here.items():
            if index & 1 or index >> 1 in above:
                continue
            right = here.get(index + 1)
            if right is not None:
                above[index >> 1] = parent_hash(value, right)
            elif index == alone:
                above[index >> 1] = parent_hash(value)


def topmost(nodes: Nodes, size: int) -> list[tuple[int, int, bytes]]:
    """The known nodes whose parent is not known."""
    depth = len(widths(size)) - 1
    return [
        (level, index, value)
        for level, here in enumerate(nodes[: depth + 1])
        for index, value in here.items()
        if level == depth or index >> 1 not in nodes[level + 1]
    ]


def siblings(nodes: Nodes, size: int, leaf: int) -> list[bytes | None]:
    """The proof of a leaf: its sibling on every level, None where it has none."""
    return [nodes[level].get((leaf >> level) ^ 1) for level in range(len(widths(size)) - 1)]


def _empty(size: int) -> Nodes:
    return [{} for _ in range(len(widths(size)))]


# ---------------------------------------------------------------- trees on the cluster


def _placed(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Adds ``index`` in the tree, the tree's ``size`` and ``start``, the index of the run's first row."""
    tied = cut(rows.withColumn("_tie", F.monotonically_increasing_id()))
    by = [F.asc_nulls_first(c) for c in ("tree", *order, "leaf", "_tie")]
    spread = cut(tied.repartitionByRange(*by).sortWithinPartitions(*by).drop("_tie"))
    spread = spread.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})
    runs = spread.groupBy("_part", "tree").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    tree = Window.partitionBy("tree")
    before = F.sum("_n").over(tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select(
        "_part", "tree", "_first", F.sum("_n").over(tree).alias("size"), F.coalesce(before, F.lit(0)).alias("start")
    )
    numbered = attach(spread, runs, ["_part", "tree"], "inner")
    return numbered.withColumn("index", F.col("_at") - F.col("_first") + F.col("start")).drop("_part", "_at", "_first")


def _ends(run: pa.Table) -> pa.Table:
    """What a run gives away (``hash``) and what it needs (no ``hash``)."""
    tree, size, start = (run[c][0].as_py() for c in ("tree", "size", "start"))
    nodes = _empty(size)
    index = run["index"].to_numpy()
    nodes[0] = dict(zip(index.tolist(), (h.encode() for h in run["leaf"].to_pylist()), strict=True))
    derive(nodes, size)
    have = topmost(nodes, size)
    rows = have + [(level, at, None) for level, at in missing(size, index)]
    return _coordinates(tree, size, start, rows)


def _coordinates(tree, size, start, rows) -> pa.Table:
    n = len(rows)
    level, index, value = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table(
        {
            "tree": pa.array([tree] * n, pa.string()),
            "size": pa.array([size] * n, pa.int64()),
            "start": pa.array([start] * n, pa.int64()),
            "level": pa.array(level, pa.int32()),
            "index": pa.array(index, pa.int64()),
            "hash": pa.array([None if v is None else v.decode() for v in value], pa.string()),
        }
    )


_COORDINATES = 'tree STRING, size BIGINT, start BIGINT, level INT, `index` BIGINT, hash STRING'


def _block_maker(top: int):
    """Hashes the nodes of a block up to level ``top``; ``start`` is 1 for what the next round needs."""

    def make(block: pa.Table) -> pa.Table:
        tree, size = block["tree"][0].as_py(), block["size"][0].as_py()
        nodes = _empty(size)
        for level, index, value in zip(*(block[c].to_pylist() for c in ("level", "index", "hash")), strict=True):
            nodes[level][index] = value.encode()
        given = [set(here) for here in nodes]
        derive(nodes, size, top)
        upper = {(level, index) for level, index, _ in topmost(nodes, size)}
        rows = [(level, i, v) for level, here in enumerate(nodes) for i, v in here.items()]
        out = [_coordinates(tree, size, 0, [r for r in rows if r[1] not in given[r[0]]])]
        out.append(_coordinates(tree, size, 1, [r for r in rows if (r[0], r[1]) in upper]))
        return pa.concat_tables(out)

    return make


def _store(covers: DataFrame, depth: int) -> DataFrame:
    """The covers and every node between runs: ``tree, size, level, index, hash``."""
    names = ["tree", "size", "level", "index", "hash"]
    store = pending = covers.select(*names)
    for top in range(HEIGHT, depth + HEIGHT, HEIGHT):
        inside = pending.where(F.col("level") < top)
        block = F.call_function("shiftright", F.col("index"), F.lit(top) - F.col("level"))
        made = inside.withColumn("_block", block).groupBy("tree", "_block")
        # start tells new nodes (0) from those that the next round needs (1)
        made = cut(made.applyInArrow(_block_maker(top), _COORDINATES))
        store = store.unionByName(made.where("start = 0").select(*names))
        pending = pending.where(F.col("level") >= top).unionByName(made.where("start = 1").select(*names))
    return store


def prove(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """The rows with ``index``, ``size``, ``siblings`` (one per level, null where there is none) and ``root``.

    ``rows`` has a non-null ``tree``, the hex digest ``leaf``, the columns of ``order`` and others;
    trees are told apart by ``tree``, their leaves are in the order of ``order``.
    """
    placed = _placed(rows, order)
    runs = placed.select("tree", "size", "start", "index", "leaf").groupBy("tree", "start")
    ends = cut(runs.applyInArrow(_ends, _COORDINATES))
    largest = ends.agg(F.max("size")).first()[0] or 1
    store = _store(ends.where("hash is not null"), len(widths(largest)) - 1)
    wanted = ends.where("hash is null").select("tree", "start", "level", "index")
    fetched = wanted.join(store.select("tree", "level", "index", "hash"), ["tree", "level", "index"])

    def expand(run: pa.Table, beyond: pa.Table) -> pa.Table:
        size = run["size"][0].as_py()
        nodes = _empty(size)
        index = run["index"].to_pylist()
        nodes[0] = dict(zip(index, (h.encode() for h in run["leaf"].to_pylist()), strict=True))
        for level, at, value in zip(*(beyond[c].to_pylist() for c in ("level", "index", "hash")), strict=True):
            nodes[level][at] = value.encode()
        derive(nodes, size)
        proofs = [[v and v.decode() for v in siblings(nodes, size, i)] for i in index]
        root = nodes[-1][0].decode()
        run = run.append_column("siblings", pa.array(proofs, pa.list_(pa.string())))
        return run.append_column("root", pa.array([root] * len(index), pa.string()))

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema)
    runs = placed.groupBy("tree", "start").cogroup(fetched.groupBy("tree", "start"))
    return runs.applyInArrow(expand, f"{kept}, siblings ARRAY<STRING>, root STRING").drop("start")


def folded(leaf: Column, index: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings give."""
    sides = F.transform(
        proof, lambda s, i: F.struct(s.alias("s"), (F.call_function("shiftright", index, i) % 2 == 1).alias("right"))
    )
    return F.aggregate(
        sides,
        leaf,
        lambda h, x: F.sha2(
            F.when(x["right"], F.concat(x["s"], h)).otherwise(F.concat(h, F.coalesce(x["s"], F.lit("")))), 256
        ),
    )


def manifest(rows: DataFrame, order: Sequence[str], group: Column) -> DataFrame:
    """The rows with the proof of their leaf in the tree of their group (``siblings``, ``subroot``) and of

    that in the tree of all groups (``upper``, ``place``, ``root``). ``group`` may be null.
    """
    name = F.coalesce(F.concat(F.lit(":"), group.cast("string")), F.lit("-"))  # null is first
    lower = cut(prove(rows.withColumn("tree", name), order)).withColumnRenamed("root", "subroot")
    groups = lower.where("index = 0").select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("subroot").alias("leaf"))
    upper = prove(groups, ["name"]).select(
        F.col("name").alias("tree"), F.col("index").alias("place"), F.col("siblings").alias("upper"), "root"
    )
    return attach(lower, upper, ["tree"], "inner").drop("tree")


def manifest_report(docs: DataFrame) -> DataFrame:
    """Every document's leaf, proof and roots, and whether it stands the proof after tampering."""
    plain = [F.col(c) for c in COLUMNS]
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("decimal(20,0)")
    forged = [more if c == "n_chars" else F.col(c) for c in COLUMNS]
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "lang",
        leaf_hash(plain).alias("leaf"),
        F.when(hit, leaf_hash(forged)).alias("forged"),
    )
    proved = manifest(rows, ["doc_id"], F.col("lang"))
    shown = folded(F.coalesce("forged", "leaf"), F.col("index"), F.col("siblings"))
    again = folded(shown, F.col("place"), F.col("upper"))
    path = F.array_join(F.concat("siblings", "upper"), "")
    out = proved.select("doc_id", "leaf", "subroot", "root", F.sha2(path, 256).alias("proof_sha256"), again.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
