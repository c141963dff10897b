"""Language identification by segmentation-marginalised unigrams.

A public vocabulary of word pieces is fixed; per language each piece has a probability. A word
may be cut into pieces in many ways, and its probability is the sum over all of them, found by
the forward algorithm. The piece probabilities of a language are fitted with expectation
maximisation (forward and backward) on its words; a text's score is the sum of its words' log
probabilities, and the languages' scores become a posterior.

Texts are lower-cased and read whole, as runs of letters; a run starts with the vocabulary's
word mark. Runs longer than `PART` letters are scored in parts of that length. A batch's new
words are scored together, length by length, and kept for later batches.

Fitting reads about ``train_docs`` labelled documents of each language (a documented bound,
chosen by a hash of the id) or all where there are fewer; languages are few (some hundreds).

Cases: a null text, or one without a letter, gets ``und`` and score 0; so does every text if
there is no labelled document; ties go to the first language by code point; documents without a
language are never learned from; a null id counts as an empty one.
"""

from __future__ import annotations

import itertools
import os
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import bounded_batches, mix64, small_batches, tokenizer_folder

#: The file of the pieces in the folder of the public vocabularies.
VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
UNKNOWN = "und"
PART = 32
#: Least probability of a single character, so that every word has a segmentation.
CHAR_FLOOR = 1e-6
PIECE_COUNT = 0.05
ROUNDS = 3
KEPT_WORDS = 200_000
_RUN = re.compile(r"[^\W\d_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def words_of(text: str) -> list[str]:
    """Runs of letters, lower-cased; empty if the text has no letter."""
    runs = _RUN.findall(text.lower())
    if any(r.isalpha() for r in runs):
        return runs
    return runs if any(c.isalpha() for r in runs for c in r) else []


def vocabulary(path: str) -> list[str]:
    """The distinct lower-cased pieces of letters, with or without the word mark."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i).lower() for i in range(model.get_piece_size()))
    return sorted({p for p in pieces if len(p) <= PART and p.removeprefix(MARK).isalpha()})


class Pieces:
    """Finds the pieces that start at any place of many words at once."""

    def __init__(self, pieces: list[str]):
        self.longest = max(map(len, pieces), default=1)
        self.powers = np.array([pow(int(_BASE), i, 1 << 64) for i in range(PART + 2)], np.uint64)
        keys = np.array([self._prefixes(self._codes([p]))[0, len(p)] for p in pieces], np.uint64)
        self.n = len(pieces)
        # a few tables, each for the keys that found their slot taken in those before
        self.tables: list[tuple[np.ndarray, np.ndarray]] = []
        left = np.arange(self.n)
        while left.size:
            slot = self._slot(keys[left], len(self.tables))
            _, first = np.unique(slot, return_index=True)
            ids, held = np.full(1 << 19, -1, np.int32), np.zeros(1 << 19, np.uint64)
            ids[slot[first]], held[slot[first]] = left[first], keys[left[first]]
            self.tables.append((ids, held))
            left = np.delete(left, first)

    @staticmethod
    def _slot(keys: np.ndarray, level: int) -> np.ndarray:
        return (mix64(keys + np.uint64(level)) >> np.uint64(45)).astype(np.int64)

    @staticmethod
    def _codes(words: list[str]) -> np.ndarray:
        width = len(words[0])
        raw = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        return raw.reshape(len(words), width)

    def _prefixes(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros((len(codes), codes.shape[1] + 1), np.uint64)
        for i in range(codes.shape[1]):
            out[:, i + 1] = out[:, i] * _BASE + mix64(codes[:, i].astype(np.uint64) + np.uint64(1))
        return out

    def lattice(self, words: list[str]) -> dict[tuple[int, int], np.ndarray]:
        """For words of one length: per start and end the piece of every word, ``n`` for none."""
        prefix = self._prefixes(self._codes(words)).T.copy()
        width, out = len(prefix) - 1, {}
        for size in range(1, min(self.longest, width) + 1):  # all starts of one length at once
            key = prefix[size:] - prefix[:-size] * self.powers[size]
            found = np.full(key.shape, self.n, np.int32)
            for level, (ids, held) in enumerate(self.tables):
                slot = self._slot(key, level)
                at = ids[slot]
                hit = (held[slot] == key) & (at >= 0)
                found[hit] = at[hit]
            some = (found < self.n).any(axis=1)
            for start in range(len(found)):
                if size == 1 or some[start]:
                    out[start, start + size] = found[start]
        return out


def _forward(lattice, width: int, chances: np.ndarray) -> list[np.ndarray]:
    """Per place the summed probability of all segmentations up to it, by word and language."""
    size = len(next(iter(lattice.values())))
    alpha = [np.ones((size, chances.shape[1]))] + [np.zeros((size, chances.shape[1])) for _ in range(width)]
    for (start, end), ids in sorted(lattice.items(), key=lambda x: x[0][1]):
        p = chances[ids]
        if end - start == 1:
            p = np.maximum(p, CHAR_FLOOR)
        alpha[end] += alpha[start] * p
    return alpha


def by_length(parts: list[str], most: int = 4096) -> Iterator[list[str]]:
    """Groups of at most ``most`` words of one length."""
    for _, same in itertools.groupby(sorted(parts, key=len), key=len):
        group = list(same)
        for i in range(0, len(group), most):
            yield group[i : i + most]


def parts_of(word: str) -> list[str]:
    marked = MARK + word
    return [marked[i : i + PART] for i in range(0, len(marked), PART)]


def fit_pieces(counts: Counter[str], pieces: Pieces) -> np.ndarray:
    """Piece probabilities of one language from its words, by expectation maximisation."""
    groups = []
    expected = np.zeros(pieces.n + 1)
    for group in by_length(list(counts)):
        weight = np.array([counts[w] for w in group], float)
        lattice = pieces.lattice(group)
        groups.append((len(group[0]), weight, lattice))
        for ids in lattice.values():
            expected += np.bincount(ids, weight, pieces.n + 1)
    expected[-1] = 0
    for _ in range(ROUNDS):
        chance = _chances(expected)[:, None]
        expected = np.zeros(pieces.n + 1)
        for width, weight, lattice in groups:
            alpha = _forward(lattice, width, chance)
            beta = [np.zeros(len(weight)) for _ in range(width)] + [np.ones(len(weight))]
            for (start, end), ids in sorted(lattice.items(), key=lambda x: -x[0][1]):
                p = chance[ids, 0]
                if end - start == 1:
                    p = np.maximum(p, CHAR_FLOOR)
                expected += np.bincount(
                    ids, weight * alpha[start][:, 0] * p * beta[end] / alpha[width][:, 0], pieces.n + 1
                )
                beta[start] += p * beta[end]
        expected[-1] = 0
    return _chances(expected)


def _chances(expected: np.ndarray) -> np.ndarray:
    """Smoothed probabilities; the last entry (no piece) keeps 0."""
    n = len(expected) - 1
    out = (expected + PIECE_COUNT) / (expected.sum() + PIECE_COUNT * max(n, 1))
    out[-1] = 0
    return out


class Model:
    """Languages, their piece probabilities, and the words scored so far."""

    def __init__(self, languages: list[str], chances: np.ndarray, pieces: Pieces):
        self.languages, self.chances, self.pieces = languages, chances, pieces
        self.known: dict[str, int] = {}
        self.scores = np.zeros((0, len(languages)))

    def __reduce__(self):
        return Model, (self.languages, self.chances, self.pieces)

    def learn_words(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.known]
        if not new:
            return
        if len(self.known) + len(new) > KEPT_WORDS:
            self.known, self.scores = {}, np.zeros((0, len(self.languages)))
            new = list(words)
        cut = [parts_of(w) for w in new]
        part_score: dict[str, int] = {}
        rows = []
        for group in by_length(list({p for parts in cut for p in parts})):
            width = len(group[0])
            rows.append(np.log(_forward(self.pieces.lattice(group), width, self.chances)[width]))
            for p in group:
                part_score[p] = len(part_score)
        scores = np.concatenate(rows)
        at = np.array([part_score[p] for parts in cut for p in parts])
        starts = np.cumsum([0, *map(len, cut)])[:-1]
        first = len(self.known)
        self.known.update(zip(new, range(first, first + len(new)), strict=True))
        self.scores = np.concatenate([self.scores, np.add.reduceat(scores[at], starts, axis=0)])

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        found = [words_of(t) if t else [] for t in texts]
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        self.learn_words({w for words in found for w in words})
        names, scores = [], np.zeros(len(texts))
        for i, words in enumerate(found):
            if not words:
                names.append(UNKNOWN)
                continue
            total = self.scores[np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))].sum(0)
            best = int(total.argmax())
            scores[i] = 1 / np.exp(total - total[best]).sum()
            names.append(self.languages[best])
        return names, scores


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Documents that are kept from learning: crc32 of the id as text leaves 1 of 3."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def drawn(docs: DataFrame, train_docs: int) -> DataFrame:
    """``lang, text`` of about ``train_docs`` documents per language, at most but for the chance of the draw.

    The draw is by id and text, and rows that repeat both count once, so neither many null ids nor
    copies of a row make it larger.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    labelled = labelled.select("lang", "text", F.xxhash64("doc_id", "text").alias("_row"))
    counts = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("_n"))
    share = F.least(F.lit(1.0), F.lit(float(train_docs)) / F.col("_n"))
    shares = F.broadcast(counts.select("lang", share.alias("_share")))  # a row per language
    draw = F.pmod(F.xxhash64("_row"), F.lit(1 << 20)) / float(1 << 20)
    return labelled.join(shares, "lang").where(draw < F.col("_share")).dropDuplicates(["lang", "_row"]).select("lang", "text")


def train(docs: DataFrame, train_docs: int = 600, path: str | None = None) -> Model:
    """Fits one set of piece probabilities per language, each in a task of its own."""
    names = vocabulary(path or os.path.join(tokenizer_folder(docs.sparkSession), VOCABULARY))
    pieces = Pieces(names)

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        words = Counter(w for text in rows["text"] for w in words_of(text))
        parts: Counter[str] = Counter()
        for word, n in words.items():
            for part in parts_of(word):
                parts[part] += n
        chances = fit_pieces(parts, pieces)
        return pd.DataFrame({"lang": rows["lang"].iloc[:1], "chances": [chances]})

    fitted = drawn(docs, train_docs).groupBy("lang").applyInPandas(fit, "lang STRING, chances ARRAY<DOUBLE>")
    rows = sorted((r["lang"], r["chances"]) for r in fitted.collect())
    chances = np.array([r[1] for r in rows]).T if rows else np.zeros((len(names) + 1, 0))
    return Model([r[0] for r in rows], chances, pieces)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` with ``lang_pred`` and ``score``."""
    bounded_batches(docs)
    docs = docs.drop("lang_pred", "score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            names, scores = model.predict(texts)
            columns = [*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "lang_pred", "score"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]
    return docs.mapInArrow(run, ", ".join([*fields, "lang_pred STRING", "score DOUBLE"]))


def language_report(docs: DataFrame, **settings) -> DataFrame:
    model = train(docs, **settings)
    rows = predict(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
