"""Alignment of two tokenizers' tokens by divide and conquer at shared cuts.

A text is encoded twice; the byte offsets where a token of either ends are its cuts. An interval
of both token rows is divided at a cut that both share near its middle, found by bisecting the
other row's ends: from the middle one leaps to the first end of the other row that is not before,
and back, until both agree, then to the left likewise. Both halves go on alone; an interval
without a shared cut inside is a leaf group. All intervals of a batch of texts go down one level
at a time in numpy. Every pair of tokens of a group is a link.

Corpus-wide counts (how many documents hold a pair of ids linked) need one exchange of what a lot
of documents holds distinct, not of links: a task gathers about ``LOT`` bytes of texts, writes each
document's distinct pairs as places in the lot's sorted list of pairs, and the list with its
counts. The lists are summed by pair, the best count of every A id (a table no longer than the
vocabulary) is joined, and each lot gets its counts back to sum them over its documents.

``folder`` holds the vocabularies: every machine of the cluster needs it at that path. A's ids are
those of its file; a rank encoder with the same vocabulary finds them faster, but gives up on
very long white space, where the file's own library takes over.

Cases: a text that is null, empty or not given back by both rows of tokens (for instance one with
the mark that stands for a space) has no tokens, and its digest column is empty; control strings
inside texts are plain text; very long texts are one task's work, like any text; rows that repeat
an id are documents of their own; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import itertools
import json
import os
import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import bounded_batches, small_batches, tokenizer_folder, written

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Texts taken at a time, and of a lot whose pairs are counted together, in bytes.
SLICE, LOT = 4 << 20, 16 << 20
#: White space in a row that the rank encoder's pattern may not survive.
LONG_SPACE = re.compile(r"\s{400}")
#: A pair of ids is the number ``a * B_IDS + b``.
B_IDS = 1 << 15
#: Groups of more links are counted by distinct ids first.
WIDE_GROUP = 1 << 16


# ---------------------------------------------------------------- tokenizers


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteLevel:
    """Tokenizer A: ids and the bytes of every id."""

    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, folder: str):
        import tiktoken

        self.path = os.path.join(folder, A_FILE)
        with open(self.path, encoding="utf-8") as f:
            said = json.load(f)
        special = {t["content"] for t in said["added_tokens"]}
        alphabet = byte_alphabet()
        vocabulary = said["model"]["vocab"]
        ranks = {bytes(alphabet[c] for c in t): i for t, i in vocabulary.items() if t not in special}
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in ranks.items():
            self.bytes[i] = token
        self.fast = tiktoken.Encoding("a", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.slow = None

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self._own(t) if LONG_SPACE.search(t) else self.fast.encode_ordinary(t) for t in texts]

    def _own(self, text: str) -> list[int]:
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
            self.slow.encode_special_tokens = True
        return self.slow.encode(text, add_special_tokens=False).ids


class Pieces:
    """Tokenizer B: it puts the first space there itself."""

    def __init__(self, folder: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=os.path.join(folder, B_FILE))
        self.bytes = [self._bytes(i) for i in range(self.model.get_piece_size())]

    def _bytes(self, i: int) -> bytes:
        piece = self.model.id_to_piece(i)
        return bytes([int(piece[1:-1], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


# ---------------------------------------------------------------- groups


def leaf_groups(ends_a, ends_b, first_a, first_b) -> tuple[np.ndarray, np.ndarray]:
    """The groups' ends as token numbers (one past the last) of both rows, in order.

    ``ends_*`` are increasing byte offsets over all texts, ``first_*`` each text's first token and,
    at the end, the number of tokens; both rows of a text end at one offset.
    """
    lo_a, hi_a, lo_b, hi_b = first_a[:-1], first_a[1:], first_b[:-1], first_b[1:]
    some = hi_a > lo_a
    lo_a, hi_a, lo_b, hi_b = lo_a[some], hi_a[some], lo_b[some], hi_b[some]
    done_a, done_b = [], []
    while len(lo_a):
        leaf = (hi_a - lo_a == 1) | (hi_b - lo_b == 1)
        at_a, at_b = np.zeros_like(lo_a), np.zeros_like(lo_b)
        open_ = np.flatnonzero(~leaf)
        middle = (lo_a[open_] + hi_a[open_] - 1) // 2
        at_a[open_], at_b[open_] = _cut_after(ends_a, ends_b, middle)
        # the end of the interval is no cut inside it
        left = open_[at_a[open_] == hi_a[open_] - 1]
        middle = (lo_a[left] + hi_a[left] - 1) // 2
        at_a[left], at_b[left] = _cut_before(ends_a, ends_b, middle - 1, lo_a[left], lo_b[left])
        leaf[left[at_a[left] < lo_a[left]]] = True
        done_a.append(hi_a[leaf])
        done_b.append(hi_b[leaf])
        split = ~leaf
        cut_a, cut_b = at_a[split] + 1, at_b[split] + 1
        lo_a, hi_a = _halves(lo_a[split], cut_a), _halves(cut_a, hi_a[split])
        lo_b, hi_b = _halves(lo_b[split], cut_b), _halves(cut_b, hi_b[split])
    if not done_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.sort(np.concatenate(done_a)), np.sort(np.concatenate(done_b))


def _halves(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.column_stack([x, y]).ravel()


def _cut_after(ends_a, ends_b, i):
    """The first shared end at or after token ``i`` of A; each interval's own end is one."""
    at_a, at_b = i.copy(), np.zeros_like(i)
    todo = np.arange(len(i))
    while len(todo):
        j = np.searchsorted(ends_b, ends_a[at_a[todo]])
        at_b[todo] = j
        todo = todo[ends_b[j] != ends_a[at_a[todo]]]
        at_a[todo] = np.searchsorted(ends_a, ends_b[at_b[todo]])
    return at_a, at_b


def _cut_before(ends_a, ends_b, i, lo_a, lo_b):
    """The last shared end at or before token ``i`` of A; a token before ``lo_a`` where there is none."""
    at_a, at_b = i.copy(), np.zeros_like(i)
    todo = np.flatnonzero(at_a >= lo_a)
    while len(todo):
        at_b[todo] = np.searchsorted(ends_b, ends_a[at_a[todo]], side="right") - 1
        none = todo[at_b[todo] < lo_b[todo]]
        at_a[none] = lo_a[none] - 1
        todo = todo[at_b[todo] >= lo_b[todo]]
        todo = todo[ends_b[at_b[todo]] != ends_a[at_a[todo]]]
        at_a[todo] = np.searchsorted(ends_a, ends_b[at_b[todo]], side="right") - 1
        todo = todo[at_a[todo] >= lo_a[todo]]
    return at_a, at_b


class Aligner:
    """Aligns batches of texts."""

    def __init__(self, folder: str):
        self.a, self.b = ByteLevel(folder), Pieces(folder)
        self.long_a = np.array([len(t) for t in self.a.bytes])
        self.long_b = np.array([len(t) for t in self.b.bytes])
        says = lambda n, ends: [[f"{i}{e}" for i in range(n)] for e in ends]
        named = says(len(self.long_a), ",|") + says(len(self.long_b), ",;")
        self.says = np.array(list(itertools.chain.from_iterable(named)), object)

    def tokens(self, texts: list[str | None]) -> tuple[list[list[int]], list[list[int]]]:
        """The ids of both tokenizers, none where either row does not give the text back."""
        some = [i for i, t in enumerate(texts) if t]
        out_a, out_b = ([[] for _ in texts] for _ in "ab")
        spaced = [f" {texts[i]}" for i in some]
        rows = zip(some, spaced, self.a.encode(spaced), self.b.encode([texts[i] for i in some]), strict=True)
        for i, text, a, b in rows:
            raw = text.encode()
            if all(b"".join(map(t.bytes.__getitem__, ids)) == raw for t, ids in ((self.a, a), (self.b, b))):
                out_a[i], out_b[i] = a, b
        return out_a, out_b

    def align(self, texts: list[str | None]) -> dict[str, np.ndarray | list]:
        """Per text the numbers of tokens, groups and links, the digest of its groups and its distinct pairs.

        ``pair`` and ``times`` hold the pairs and how often each is linked, ``upto`` where each text's end.
        """
        rows = self.tokens(texts)
        n_a, n_b = (np.array([len(r) for r in x], np.int64) for x in rows)
        ids_a, ids_b = (np.fromiter(itertools.chain.from_iterable(x), np.int64, n.sum()) for x, n in zip(rows, (n_a, n_b), strict=True))
        first_a, first_b = (np.concatenate([[0], np.cumsum(n)]) for n in (n_a, n_b))
        ends_a, ends_b = np.cumsum(self.long_a[ids_a]), np.cumsum(self.long_b[ids_b])
        group_a, group_b = leaf_groups(ends_a, ends_b, first_a, first_b)
        text = np.searchsorted(first_a, group_a) - 1  # of each group; texts without tokens have none
        start_a, start_b = np.append(0, group_a)[:-1], np.append(0, group_b)[:-1]
        wide_a, wide_b = group_a - start_a, group_b - start_b
        links = wide_a * wide_b
        n_texts = len(texts)
        key, times = self._pairs(ids_a, ids_b, start_a, start_b, wide_a, wide_b, text)
        return {
            "n_a": n_a, "n_b": n_b,
            "n_groups": np.bincount(text, minlength=n_texts),
            "n_links": _sums(links, text, n_texts),
            "digest": self._digests(ids_a, ids_b, group_a, group_b, start_a, start_b, first_a, first_b),
            "pair": (key & ((1 << 31) - 1)).astype(np.uint32), "times": times,
            "upto": np.searchsorted(key >> 31, np.arange(n_texts), side="right"),
        }

    def _pairs(self, ids_a, ids_b, start_a, start_b, wide_a, wide_b, text):
        """``text << 31 | pair`` in order, and how often it is linked."""
        links = wide_a * wide_b
        usual = links <= WIDE_GROUP
        n = links[usual]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        over, rest = np.divmod(within, np.repeat(wide_b[usual], n))
        a = ids_a[np.repeat(start_a[usual], n) + over]
        b = ids_b[np.repeat(start_b[usual], n) + rest]
        key, times = np.unique(np.repeat(text[usual], n) << 31 | a * B_IDS + b, return_counts=True)
        if usual.all():
            return key, times
        keys, counts = [key], [times]
        for g in np.flatnonzero(~usual):
            a, m = np.unique(ids_a[start_a[g] : start_a[g] + wide_a[g]], return_counts=True)
            b, n = np.unique(ids_b[start_b[g] : start_b[g] + wide_b[g]], return_counts=True)
            keys.append((text[g] << 31 | np.add.outer(a * B_IDS, b)).ravel())
            counts.append(np.multiply.outer(m, n).ravel())
        key, at = np.unique(np.concatenate(keys), return_inverse=True)
        return key, _sums(np.concatenate(counts), at, len(key))

    def _digests(self, ids_a, ids_b, group_a, group_b, start_a, start_b, first_a, first_b) -> list[str]:
        """The digest of ``a1,a2|b1;a3|b2`` of every text."""
        size_a, size_b = len(self.long_a), len(self.long_b)
        # both rows in one, the A tokens of a group before its B tokens; the last of each says so
        named = np.empty(len(ids_a) + len(ids_b), np.int64)
        last_a, last_b = np.zeros(len(ids_a), bool), np.zeros(len(ids_b), bool)
        last_a[group_a - 1] = last_b[group_b - 1] = True
        named[np.arange(len(ids_a)) + np.repeat(start_b, group_a - start_a)] = ids_a + size_a * last_a
        named[np.arange(len(ids_b)) + np.repeat(group_a, group_b - start_b)] = 2 * size_a + ids_b + size_b * last_b
        said = self.says[named].tolist()
        at = (first_a + first_b).tolist()
        spans = zip(at[:-1], at[1:], strict=True)
        return [sha256("".join(said[x:y])[:-1].encode()).hexdigest() if y > x else "" for x, y in spans]


def _sums(values: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    np.add.at(out, at, values)
    return out


# ---------------------------------------------------------------- on the cluster

_ROWS = pa.schema(
    [
        ("lot", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()),
        ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()),
        ("places", pa.binary()), ("times", pa.binary()), ("pairs", pa.list_(pa.int32())), ("docs", pa.list_(pa.int32())),
    ]
)
_DDL = (
    "lot BIGINT, doc_id BIGINT, n_a BIGINT, n_b BIGINT, n_groups BIGINT, n_links BIGINT, groups_sha256 STRING, "
    "places BINARY, times BINARY, pairs ARRAY<INT>, docs ARRAY<INT>"
)


def _lot_rows(lot: int, parts: list[tuple[pa.Array, dict]]) -> Iterator[pa.RecordBatch]:
    """A row for every document of a lot, then one with its pairs and their documents."""
    every = np.concatenate([p["pair"] for _, p in parts])
    pairs, place, docs = np.unique(every, return_inverse=True, return_counts=True)
    place = place.astype(_narrow(len(pairs)))
    done = 0
    for ids, part in parts:
        n, upto = len(ids), part["upto"].tolist()
        times = part["times"].astype(_narrow(part["times"].max(initial=0) + 1))
        mine = place[done : done + len(part["pair"])]
        done += len(mine)
        spans = list(zip([0, *upto[:-1]], upto, strict=True))
        columns = {
            "lot": pa.array([lot] * n, pa.int64()), "doc_id": ids,
            **{c: pa.array(part[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")},
            "groups_sha256": pa.array(part["digest"], pa.string()),
            "places": pa.array([_packed(mine[a:b]) for a, b in spans], pa.binary()),
            "times": pa.array([_packed(times[a:b]) for a, b in spans], pa.binary()),
            "pairs": pa.nulls(n, pa.list_(pa.int32())), "docs": pa.nulls(n, pa.list_(pa.int32())),
        }
        yield pa.RecordBatch.from_arrays([columns[f.name] for f in _ROWS], schema=_ROWS)
    listed = {
        "lot": pa.array([lot], pa.int64()),
        "pairs": pa.array([pairs.astype(np.int32)], pa.list_(pa.int32())),
        "docs": pa.array([docs.astype(np.int32)], pa.list_(pa.int32())),
    }
    yield pa.RecordBatch.from_arrays([listed.get(f.name, pa.nulls(1, f.type)) for f in _ROWS], schema=_ROWS)


def _narrow(n: int) -> type:
    return np.uint8 if n <= 1 << 8 else np.uint16 if n <= 1 << 16 else np.uint32


def _packed(x: np.ndarray) -> bytes:
    """Numbers as the bytes of one, the width of a number."""
    return bytes([x.dtype.itemsize]) + x.tobytes()


def unpacked(said: bytes) -> np.ndarray:
    return np.frombuffer(said, f"u{said[0]}", offset=1)


def aligned(docs: DataFrame, folder: str) -> DataFrame:
    """A row for every document and one for every lot, as ``_DDL`` says."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = None
        lot, size, parts = TaskContext.get().partitionId() << 32, 0, []
        for batch in small_batches(batches, "text", SLICE):
            aligner = aligner or Aligner(folder)
            texts = batch.column(1).to_pylist()
            parts.append((batch.column(0), aligner.align(texts)))
            size += batch.column(1).nbytes
            if size >= LOT:
                yield from _lot_rows(lot, parts)
                lot, size, parts = lot + 1, 0, []
        if parts:
            yield from _lot_rows(lot, parts)

    bounded_batches(docs)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(rows, _DDL)


def pair_counts(rows: DataFrame) -> DataFrame:
    """``in_lot, place, n, best``: corpus-wide documents of every pair of a lot, and whether no pair of its A id has more."""
    held = rows.where("pairs is not null").select("lot", F.posexplode(F.arrays_zip("pairs", "docs")).alias("place", "x"))
    held = held.select("lot", "place", F.col("x.pairs").alias("pair"), F.col("x.docs").alias("docs"))
    counts = held.groupBy("pair").agg(F.sum("docs").alias("n"))
    a = F.call_function("shiftright", F.col("pair"), F.lit(B_IDS.bit_length() - 1)).alias("a")
    tops = counts.groupBy(a).agg(F.max("n").alias("most"))  # as many rows as A has ids
    counts = counts.withColumn("a", a).join(F.broadcast(tops), "a")
    best = (F.col("n") == F.col("most")).alias("best")
    found = held.select("lot", "place", "pair").join(counts.select("pair", "n", best), "pair")
    return found.select(F.col("lot").alias("in_lot"), "place", "n", "best")


_RESULT = "doc_id BIGINT, n_a BIGINT, n_b BIGINT, n_groups BIGINT, n_links BIGINT, n_best BIGINT, count_sum BIGINT, groups_sha256 STRING"


def _sum_up(docs: pa.Table, counts: pa.Table) -> pa.Table:
    """The documents of a lot with sums over their links."""
    n, best = np.zeros(counts.num_rows, np.int64), np.zeros(counts.num_rows, np.int64)
    place = counts["place"].to_numpy()
    n[place], best[place] = counts["n"].to_numpy(), counts["best"].to_numpy(zero_copy_only=False)
    sums, bests = [], []
    for places, times in zip(docs["places"].to_pylist(), docs["times"].to_pylist(), strict=True):
        at, often = unpacked(places), unpacked(times).astype(np.int64)
        sums.append(int((n[at] * often).sum()))
        bests.append(int((best[at] * often).sum()))
    kept = docs.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
    kept = kept.append_column("n_best", pa.array(bests, pa.int64())).append_column("count_sum", pa.array(sums, pa.int64()))
    return kept.append_column("groups_sha256", docs["groups_sha256"])


def alignment_report(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Tokens, groups and links of every document, and how usual its links are in the corpus."""
    rows = written(aligned(docs, folder or tokenizer_folder(docs.sparkSession)))
    mine = rows.where("pairs is null").drop("pairs", "docs").groupBy("lot")
    return mine.cogroup(pair_counts(rows).groupBy("in_lot")).applyInArrow(_sum_up, _RESULT)
