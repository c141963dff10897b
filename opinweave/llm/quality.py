"""Quality rules: gradient-boosted trees over document statistics.

The statistics of whole texts are counted over the bytes of a batch. Trees are fitted by
histogram boosting on a bounded sample of labelled documents, with the logistic loss; chosen
statistics are monotonic, so that more symbols, repeats or doubled lines never raise a score. A
split on such a statistic must order its sides, and its subtrees stay on their side of the
middle. The trees are flattened into node arrays, so scoring a batch is a few gathers.

Fitting reads about ``train_docs`` labelled documents (a documented bound, chosen by a hash of
the id), as rows of statistics, never their texts.

Cases: a null text has no words and fails the base rules; labels without a quality are not
learned from; if the sample holds one class only, or none, the base rules alone decide; ids
that repeat in the labels count as several labels; input columns with the names of results are
replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bounded_batches, mix64, set_aside, small_batches, text_bytes

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\v\f\r"
SPAN = 8
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = [
    "log_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "distinct_share",
    "stutter_share", "upper_share", "digit_share", "mark_share",
]
#: 1: a higher value never lowers the score; -1: never raises it; 0: free.
MONOTONE = [0, 0, -1, -1, -1, 0, -1, -1, 0, 0]


def _flags(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


_IS_SPACE, _IS_SYMBOL = _flags(SPACES), _flags(SYMBOLS)
_IS_UPPER, _IS_DIGIT = _flags(bytes(range(65, 91))), _flags(bytes(range(48, 58)))
_IS_MARK = _flags(b"!?")
_IS_START = np.array([b & 0xC0 != 0x80 for b in range(256)])


def _sums(flag: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flag)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _dup_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


def statistics(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The base counts and the features of every text, one row each."""
    raw, offsets = text_bytes(texts)
    n = len(texts)
    space = _IS_SPACE[raw]
    starts = ~space
    starts[1:] &= space[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    starts[first] = ~space[first]
    n_words = _sums(starts, offsets)
    word_chars = _sums(_IS_START[raw] & ~space, offsets)
    n_symbols = _sums(_IS_SYMBOL[raw], offsets)
    pieces = [raw[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    n_dup = np.array([_dup_lines(t) for t in pieces], np.int64)
    n_lines = _sums(raw == 10, offsets) + 1

    words = [w for t in pieces for w in t.split()]
    owner = np.repeat(np.arange(n), n_words)
    code = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    n_repeat = np.zeros(n, np.int64)
    distinct = np.zeros(n, np.int64)
    stutter = np.zeros(n, np.int64)
    if len(words):
        salted = mix64(code ^ mix64(owner.astype(np.uint64)))
        _, at = np.unique(salted, return_index=True)
        distinct = np.bincount(owner[at], minlength=n)
        same = (salted[1:] == salted[:-1]) & (owner[1:] == owner[:-1])
        stutter = np.bincount(owner[1:][same], minlength=n)
    if len(words) >= SPAN:
        window, step = mix64(salted), 1
        while step < SPAN:  # hashes of 2, 4, 8 words from those of half the length
            window = mix64(window[:-step] * np.uint64(3) + window[step:])
            step *= 2
        inside = np.flatnonzero(owner[: len(window)] == owner[SPAN - 1 :])
        _, group, size = np.unique(window[inside], return_inverse=True, return_counts=True)
        twice = inside[size[group] > 1]
        covered = np.zeros(len(words) + 1, np.int64)
        np.add.at(covered, twice, 1)
        np.add.at(covered, np.minimum(twice + SPAN, len(words)), -1)
        n_repeat = np.bincount(owner[np.cumsum(covered[:-1]) > 0], minlength=n)

    base = np.stack([n_words, word_chars, n_symbols, n_dup, n_repeat], axis=1)
    w, c = np.maximum(n_words, 1), np.maximum(word_chars, 1)
    features = [
        np.log1p(n_words), word_chars / w, n_symbols / c, n_dup / np.maximum(n_lines, 1), n_repeat / w,
        distinct / w, stutter / w, _sums(_IS_UPPER[raw], offsets) / c, _sums(_IS_DIGIT[raw], offsets) / c,
        _sums(_IS_MARK[raw], offsets) / c,
    ]
    return base, np.stack(features, axis=1).astype(float)


# ------------------------------------------------------------------ boosting


class Trees:
    """Flattened trees: the nodes of all of them in one set of arrays."""

    def __init__(self, feature, threshold, left, right, value, roots, start: float, depth: int):
        self.feature, self.threshold = feature, threshold
        self.left, self.right, self.value = left, right, value
        self.roots, self.start, self.depth = roots, start, depth

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of the rows of ``x``."""
        at = np.tile(self.roots, (len(x), 1))
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):  # leaves point to themselves
            low = x[row, self.feature[at]] <= self.threshold[at]
            at = np.where(low, self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.start + self.value[at].sum(1))))


def boost(
    x: np.ndarray, y: np.ndarray, monotone: list[int] = MONOTONE, n_trees: int = 60, depth: int = 3,
    rate: float = 0.2, n_bins: int = 64, least: int = 10, penalty: float = 1.0,
) -> Trees:
    """Fits trees to labels 0 and 1 with the logistic loss."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, n_bins + 1)[1:-1])) for j in range(x.shape[1])]
    bins = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(mean / (1 - mean)))
    margin = np.full(len(x), start)
    nodes: list[list[float]] = []  # feature, threshold, left, right, value
    roots = []
    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, p * (1 - p)

        def leaf(rows, lo, hi, grad=grad, hess=hess):
            return float(np.clip(grad[rows].sum() / (hess[rows].sum() + penalty), lo, hi))

        def grow(rows, level, lo, hi, grad=grad, hess=hess, leaf=leaf) -> int:
            me = len(nodes)
            nodes.append([0, np.inf, me, me, rate * leaf(rows, lo, hi)])
            margin[rows] += 0 if level < depth and len(rows) >= 2 * least else nodes[me][4]
            if level == depth or len(rows) < 2 * least:
                return me
            g, h = grad[rows], hess[rows]
            best = (1e-6, -1, -1, 0.0)
            whole = g.sum() ** 2 / (h.sum() + penalty)
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                b, m = bins[rows, j], len(c) + 1
                gl = np.cumsum(np.bincount(b, g, m))[:-1]
                hl = np.cumsum(np.bincount(b, h, m))[:-1]
                nl = np.cumsum(np.bincount(b, minlength=m))[:-1]
                gr, hr = g.sum() - gl, h.sum() - hl
                vl = np.clip(gl / (hl + penalty), lo, hi)
                vr = np.clip(gr / (hr + penalty), lo, hi)
                gain = gl**2 / (hl + penalty) + gr**2 / (hr + penalty) - whole
                bad = (nl < least) | (len(rows) - nl < least) | (monotone[j] * (vr - vl) < 0)
                gain[bad] = -1
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), j, k, float((vl[k] + vr[k]) / 2))
            _, j, k, middle = best
            if j < 0:
                margin[rows] += nodes[me][4]
                return me
            side = bins[rows, j] <= k
            low, high = (lo, hi), (lo, hi)
            if monotone[j]:
                low, high = ((lo, middle), (middle, hi))[:: monotone[j]]
            nodes[me][:2] = [j, float(cuts[j][k])]
            nodes[me][2] = grow(rows[side], level + 1, *low)
            nodes[me][3] = grow(rows[~side], level + 1, *high)
            return me

        roots.append(grow(np.arange(len(x)), 0, -4.0, 4.0))
    f, t, left, right, v = (np.array(c) for c in zip(*nodes, strict=True))
    ints = [a.astype(np.int32) for a in (f, left, right)]
    return Trees(ints[0], t, ints[1], ints[2], v, np.array(roots, np.int32), start, depth)


# ------------------------------------------------------------------ on Spark


def with_statistics(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` with the base counts and ``features`` (an array of doubles)."""
    bounded_batches(docs)
    docs = docs.drop(*BASE, "features")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 2 << 20):
            base, x = statistics(batch.column(batch.schema.get_field_index("text")).fill_null(""))
            ends = pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32())
            columns = [*batch.columns, *(pa.array(c, pa.int64()) for c in base.T)]
            columns.append(pa.ListArray.from_arrays(ends, pa.array(x.ravel())))
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, *BASE, "features"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]
    fields += [f"{c} BIGINT" for c in BASE] + ["features ARRAY<DOUBLE>"]
    return docs.mapInArrow(run, ", ".join(fields))


def train(docs: DataFrame, labels: DataFrame, train_docs: int = 4000) -> Trees | None:
    """Trees fitted to ``labels`` (``doc_id, quality``), or ``None`` without two classes."""
    known = labels.where("doc_id is not null and quality is not null").select(
        "doc_id", (F.col("quality") > 0).cast("int").alias("_y")
    )
    n = known.count()
    if not n:
        return None
    share = min(1.0, train_docs / n)
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    sample = F.broadcast(known.where(draw < share))  # about train_docs rows
    rows = with_statistics(docs.select("doc_id", "text").join(sample, "doc_id")).select("_y", "features").collect()
    y = np.array([r[0] for r in rows], float)
    if len(set(y)) < 2:
        return None
    x = np.array([r[1] for r in rows])
    order = np.lexsort([*x.T, y])  # the fit doesn't depend on the order of rows
    return boost(x[order], y[order])


def score(docs: DataFrame, trees: Trees | None, least: float = 0.5) -> DataFrame:
    """All columns of ``docs`` with the base counts, ``base_failed``, ``quality_score``, ``kept``."""
    docs = docs.drop(*BASE, "base_failed", "quality_score", "kept")
    held = set_aside(docs, ("features",))
    back = dict(zip(held.columns, docs.columns, strict=True))
    rows = with_statistics(held)

    @F.pandas_udf("double")
    def scored(x: pd.Series) -> pd.Series:
        if trees is None or not len(x):
            return pd.Series(np.ones(len(x)))
        parts = [np.stack(x[i : i + 4096]) for i in range(0, len(x), 4096)]
        return pd.Series(np.concatenate([trees.score(p) for p in parts]))

    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed).withColumn("quality_score", scored("features"))
    kept = ~F.col("base_failed") & (F.col("quality_score") >= least)
    return rows.withColumn("kept", kept).drop("features").withColumnsRenamed(back)


def quality_report(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    trees = train(docs, labels, **settings)
    rows = score(docs.select("doc_id", "text"), trees)
    return rows.select("doc_id", *BASE, "base_failed", "kept", "quality_score")
