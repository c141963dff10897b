"""Learners on MLlib and `trees`, with one shape: ``fit(train) -> Fitted``, ``Fitted.predict(df)``."""

from __future__ import annotations

import logging
import math
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.errors import IllegalArgumentException
from pyspark.ml.classification import (
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    NaiveBayes,
    OneVsRest,
)
from pyspark.ml.feature import HashingTF, Normalizer, Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from ..functions.text import space_tokens
from . import trees
from .evaluation import classification_metrics
from .features import build_vocabulary, minmax_scaler, standard_scaler, with_sequences

log = logging.getLogger(__name__)
ROWS_PER_TASK = 20_000
#: Fits of a grid that run side by side.
AT_ONCE = 4
#: Classes whose machines are fitted side by side; each keeps a copy of the mapped rows.
CLASSES_AT_ONCE = 2
#: Token sequences that a task reads side by side; some 10 kB each while it does.
SEQUENCES_AT_ONCE = 1024

# ------------------------------------------------------------ embeddings


def hashing_embedder(dim: int = 64) -> Callable[[DataFrame, str], DataFrame]:
    """Unit-length hashed word counts: stateless, so it also runs on streams."""
    hasher = HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=dim)
    unit = Normalizer(inputCol="_tf", outputCol="_unit", p=2.0)

    def embed(df: DataFrame, text: str) -> DataFrame:
        out = unit.transform(hasher.transform(df.withColumn("_tokens", space_tokens(text))))
        return out.withColumn("embedding", vector_to_array("_unit")).drop("_tokens", "_tf", "_unit")

    return embed


def word2vec_embedder(
    train: DataFrame, text: str, dim: int = 64, seed: int = 42, min_count: int = 2
) -> Callable[[DataFrame, str], DataFrame]:
    """Unit-length mean of word vectors that are fitted on the training texts."""
    tokens = lambda df, c: df.withColumn("_tokens", space_tokens(c))
    parts = min(max(train.sparkSession.sparkContext.defaultParallelism // 4, 1), 64)
    model = Word2Vec(
        vectorSize=dim, minCount=min_count, seed=seed, numPartitions=parts,
        inputCol="_tokens", outputCol="_mean",
    ).fit(tokens(train, text))
    unit = Normalizer(inputCol="_mean", outputCol="_unit", p=2.0)

    def embed(df: DataFrame, c: str) -> DataFrame:
        out = unit.transform(model.transform(tokens(df, c)))
        return out.withColumn("embedding", vector_to_array("_unit")).drop("_tokens", "_mean", "_unit")

    return embed


# ------------------------------------------------------------ learners


@dataclass
class Fitted:
    """A fitted learner; ``predict`` adds ``yhat`` from the array column ``features``."""

    transform: Callable[[DataFrame], DataFrame]
    classes: Sequence[int]
    features: str = "features"

    def predict(self, df: DataFrame, out: str = "yhat") -> DataFrame:
        rows = df.withColumn("_x", array_to_vector(F.col(self.features).cast("array<double>")))
        scored = self.transform(rows)
        code = F.get(F.lit([int(c) for c in self.classes]), F.col("prediction").cast("int"))
        return scored.select(*df.columns, code.alias(out))


def _training_rows(rows: DataFrame) -> DataFrame:
    """Rows kept for the passes of an iterative fit, in tasks of a useful size.

    A learner runs one or more jobs per iteration. The rows are made by all tasks that their
    source has; only then are small partitions merged, so that an iteration has few tasks.
    """
    made = rows.persist(StorageLevel.MEMORY_AND_DISK)
    few = made.coalesce(max(1, math.ceil(made.count() / ROWS_PER_TASK))).persist(StorageLevel.MEMORY_AND_DISK)
    few.count()
    made.unpersist()
    return few


def _fit_estimator(train: DataFrame, estimator, features: str, label: str) -> Fitted:
    classes = [r[0] for r in train.select(label).distinct().orderBy(label).collect()]
    codes = F.array_position(F.lit([int(c) for c in classes]), F.col(label).cast("int")) - 1
    rows = _training_rows(
        train.select(
            array_to_vector(F.col(features).cast("array<double>")).alias("_x"),
            codes.cast("double").alias("_y"),
        )
    )
    try:
        make = estimator(len(classes)) if callable(estimator) else estimator
        model = make.fit(rows)
    finally:
        rows.unpersist()
    return Fitted(model.transform, classes, features)


_COLUMNS = {"featuresCol": "_x", "labelCol": "_y"}


def _fit_trees(train: DataFrame, features: str, label: str, fit: Callable) -> Fitted:
    """``fit(rows, bins, classes)`` on binned rows gives a model that adds ``prediction`` to rows with ``_x``."""
    classes = [r[0] for r in train.select(label).distinct().orderBy(label).collect()]
    codes = F.array_position(F.lit([int(c) for c in classes]), F.col(label).cast("int")) - 1
    bins = trees.find_bins(train, features)
    rows = _training_rows(trees.packed(train, features, codes, bins))
    try:
        model = fit(rows, bins, len(classes))
    finally:
        rows.unpersist()

    return Fitted(model.predicted, classes, features)


def train_random_forest(
    train, features="features", label="y", n_trees=200, depth=20, min_split=5, min_leaf=2, seed=42
) -> Fitted:
    """Trees on bootstrap draws, each node trying the root of the number of features."""

    def fit(rows, bins, k):
        tried = max(1, math.isqrt(len(bins.cuts)))
        return trees.fit_forest(rows, bins, k, n_trees, trees.Rules(depth, min_split, min_leaf, tried, seed))

    return _fit_trees(train, features, label, fit)


def train_decision_tree(train, features="features", label="y", depth=20, min_split=5, min_leaf=2) -> Fitted:
    rules = trees.Rules(depth, min_split, min_leaf)
    return _fit_trees(train, features, label, lambda rows, bins, k: trees.fit_forest(rows, bins, k, 1, rules, False))


def train_logistic(
    train, features="features", label="y", c=1.0, max_iter=1000, tol=1e-4
) -> Fitted:
    """Multinomial regression with an L2 penalty of ``1 / (c n)``."""
    n = max(train.count(), 1)
    regression = LogisticRegression(
        maxIter=max_iter, regParam=1.0 / (c * n), elasticNetParam=0.0, standardization=False,
        family="multinomial", tol=tol, **_COLUMNS,
    )
    return _fit_estimator(train, regression, features, label)


def train_naive_bayes(train, features="features", label="y", alpha=1.0) -> Fitted:
    """Multinomial model; features must not be negative, so scaled rows are cut at 0."""

    def clipped(df: DataFrame) -> DataFrame:
        floor = F.transform(F.col(features), lambda x: F.greatest(x.cast("double"), F.lit(0.0)))
        return df.withColumn(features, floor)

    fitted = _fit_estimator(clipped(train), NaiveBayes(smoothing=alpha, **_COLUMNS), features, label)
    inner = fitted.transform

    def transform(rows: DataFrame) -> DataFrame:
        floor = F.transform(vector_to_array("_x"), lambda x: F.greatest(x, F.lit(0.0)))
        return inner(rows.withColumn("_x", array_to_vector(floor)))

    return Fitted(transform, fitted.classes, features)


def train_gradient_boosting(
    train, features="features", label="y", rounds=200, depth=10, rate=0.1, min_split=2, min_leaf=1
) -> Fitted:
    """Boosted trees on the gradients of all classes, one tree per class and round."""
    rules = trees.Rules(depth, min_split, min_leaf)
    return _fit_trees(
        train, features, label, lambda rows, bins, k: trees.fit_boosted(rows, bins, k, rounds, rate, rules)
    )


def _fourier_features(train: DataFrame, features: str, width: int, seed: int):
    """Random Fourier features of the RBF kernel with ``gamma = 1 / (d var(x))``."""
    row = train.select(
        Summarizer.metrics("mean", "variance")
        .summary(array_to_vector(F.col(features).cast("array<double>")))
        .alias("s")
    ).first()["s"]
    mean, var = np.asarray(row["mean"]), np.asarray(row["variance"])
    spread = float((var + mean**2).mean() - mean.mean() ** 2)
    dim = len(mean)
    gamma = 1.0 / (dim * spread) if spread > 0 else 1.0
    rng = np.random.default_rng(seed)
    weights = rng.normal(scale=math.sqrt(2 * gamma), size=(dim, width))
    phase = rng.uniform(0, 2 * math.pi, size=width)
    scale = math.sqrt(2.0 / width)

    @F.arrow_udf("array<double>")
    def project(x: pa.Array) -> pa.Array:
        matrix = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), dim)
        out = scale * np.cos(matrix @ weights + phase)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * width), pa.array(out.ravel()))

    return lambda column: project(column)


def train_svm(train, features="features", label="y", width=256, c=1.0, max_iter=100, seed=42) -> Fitted:
    """RBF-kernel machine as a linear one on random Fourier features, one against the rest.

    A machine takes hundreds of short passes, so those of two classes run side by side and fill each
    other's gaps.
    """
    project = _fourier_features(train, features, width, seed)
    n = max(train.count(), 1)
    linear = LinearSVC(maxIter=max_iter, regParam=1.0 / (c * n), standardization=False, **_COLUMNS)
    mapped = train.withColumn(features, project(F.col(features).cast("array<double>")))
    fitted = _fit_estimator(mapped, OneVsRest(classifier=linear, parallelism=CLASSES_AT_ONCE, **_COLUMNS), features, label)
    inner = fitted.transform

    def transform(rows: DataFrame) -> DataFrame:
        return inner(rows.withColumn("_x", array_to_vector(project(vector_to_array("_x")))))

    return Fitted(transform, fitted.classes, features)


def train_adaboost(train, features="features", label="y", rounds=200, rate=0.1) -> Fitted:
    """Boosted stumps (SAMME)."""
    return _fit_trees(train, features, label, lambda rows, bins, k: trees.fit_stumps(rows, bins, k, rounds, rate))


def train_perceptron(train, features="features", label="y", hidden=(64,), max_iter=100, seed=42) -> Fitted:
    """Small neural network."""
    width = len(train.select(features).first()[0])

    def estimator(k: int):
        return MultilayerPerceptronClassifier(
            layers=[width, *hidden, max(k, 2)], maxIter=max_iter, seed=seed, **_COLUMNS
        )

    return _fit_estimator(train, estimator, features, label)


@dataclass
class Learner:
    """How one row of the model grid is trained."""

    train: Callable[..., Fitted]
    scaling: str = "none"
    needs_two_classes: bool = False
    settings: dict = field(default_factory=dict)


LEARNERS = {
    "Random Forest": Learner(train_random_forest),
    "Decision Tree": Learner(train_decision_tree),
    "Logistic Regression": Learner(train_logistic, "standard", True),
    "SVM": Learner(train_svm, "standard", True),
    "Naive Bayes": Learner(train_naive_bayes, "minmax"),
    "Gradient Boosting": Learner(train_gradient_boosting, "none", True),
    "AdaBoost": Learner(train_adaboost),
}


def scaled_pair(train: DataFrame, test: DataFrame, scaling: str, features: str = "features"):
    """Training and test rows with ``features`` scaled by the training rows."""
    if scaling == "none":
        return train, test
    scaler = {"standard": standard_scaler, "minmax": minmax_scaler}[scaling](train, features)
    return scaler(train, features), scaler(test, features)


def fit_and_predict(
    train: DataFrame, test: DataFrame, learner: Learner, features: str = "features", label: str = "y", **settings
) -> DataFrame:
    """Test rows with ``yhat``."""
    a, b = scaled_pair(train, test, learner.scaling, features)
    fitted = learner.train(a, features=features, label=label, **{**learner.settings, **settings})
    return fitted.predict(b)


def model_grid(
    train: DataFrame,
    test: DataFrame,
    embeddings: dict[str, Callable[[DataFrame, str], DataFrame]],
    learners: dict[str, Learner] | None = None,
    text: str = "cleaned_text",
    label: str = "y",
    at_once: int = AT_ONCE,
) -> DataFrame:
    """``model, embedding, accuracy, precision, recall, f1, error`` for every pair.

    The inputs are computed once per embedding and kept; ``at_once`` learners are fitted side by
    side, so that the many small jobs of one fill the gaps of another. A learner that needs two
    classes where training has one is left out. One whose settings or data are rejected has NULL
    metrics and the reason in ``error``; failures of the cluster end the grid.
    """
    learners = LEARNERS if learners is None else learners
    classes = train.agg(F.count_distinct(label).alias("n")).first()["n"]
    chosen = {n: x for n, x in learners.items() if classes >= 2 or not x.needs_two_classes}
    inputs = {}
    for embedding, embed in embeddings.items():
        rows = [embed(df, text).select(label, F.col("embedding").alias("features")) for df in (train, test)]
        inputs[embedding] = [df.persist(StorageLevel.MEMORY_AND_DISK) for df in rows]
        for df in inputs[embedding]:
            df.count()

    def result(embedding: str, name: str) -> list[tuple]:
        try:
            scored = fit_and_predict(*inputs[embedding], chosen[name], label=label)
            keyed = scored.select(
                F.lit(name).alias("model"), F.lit(embedding).alias("embedding"), F.col(label).alias("y"), "yhat"
            )
            return [(*r, None) for r in classification_metrics(keyed, ("model", "embedding")).collect()]
        except (ValueError, IllegalArgumentException) as e:
            log.warning("%s on %s: %s", name, embedding, e)
            return [(name, embedding, None, None, None, None, str(e).splitlines()[0])]

    pairs = [(e, n) for n in chosen for e in embeddings]
    try:
        with ThreadPoolExecutor(at_once) as pool:
            started = [pool.submit(inheritable_thread_target(train.sparkSession)(result), *pair) for pair in pairs]
            results = [row for future in started for row in future.result()]
    finally:
        for df in (df for both in inputs.values() for df in both):
            df.unpersist()
    schema = "model STRING, embedding STRING, accuracy DOUBLE, precision DOUBLE, recall DOUBLE, f1 DOUBLE, error STRING"
    return train.sparkSession.createDataFrame(results, schema)


def recurrent_features(
    df: DataFrame, ids: str = "ids", units: int = 64, out: str = "features", seed: int = 42, memory: float = 0.95
) -> DataFrame:
    """Adds what a fixed random recurrent network remembers of a sequence: its last and its mean state.

    A state is ``tanh(state W + E[id])`` with an orthogonal ``W`` scaled by ``memory``, so texts of the
    same words, or of the same pairs of neighbours, in another order differ. Padding (0) leaves the state as
    it is. Every id's row of ``E`` comes from the seed and the id; ``SEQUENCES_AT_ONCE`` rows take one step at a time.
    """
    draw = np.random.default_rng(seed)
    turn = memory * np.linalg.qr(draw.normal(size=(units, units)))[0]
    rows_of = {}  # of the ids that a task has met

    @F.arrow_udf("array<double>")
    def states(sequences: pa.Array) -> pa.Array:
        both = np.zeros((len(sequences), 2 * units))
        for at in range(0, len(sequences), SEQUENCES_AT_ONCE):
            both[at : at + SEQUENCES_AT_ONCE] = read(sequences.slice(at, SEQUENCES_AT_ONCE))
        ends = np.arange(len(both) + 1, dtype=np.int32) * 2 * units
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(both.ravel()))

    def read(sequences: pa.Array) -> np.ndarray:
        counts = pc.fill_null(pc.list_value_length(sequences), 0).to_numpy(zero_copy_only=False)
        longest = int(counts.max(initial=0))
        grid = np.zeros((len(counts), longest), np.int64)
        grid[np.arange(longest) < counts[:, None]] = sequences.flatten().to_numpy(zero_copy_only=False)
        known, place = np.unique(grid, return_inverse=True)
        place = place.reshape(grid.shape)
        for i in known.tolist():
            if i not in rows_of:
                rows_of[i] = np.random.default_rng([seed, i]).normal(size=units)
        drawn = np.stack([rows_of[i] for i in known.tolist()]) if len(known) else None
        used = np.maximum((grid != 0).sum(axis=1), 1)
        # longest rows first, so that those with a word at a place are mostly the first ones
        last = np.where(grid != 0, np.arange(1, longest + 1), 0).max(axis=1, initial=0)
        order = np.argsort(-last, kind="stable")
        place, here = place[order], grid[order] != 0
        state, total = np.zeros((len(counts), units)), np.zeros((len(counts), units))
        for t in range(longest):
            some = slice(0, int(np.count_nonzero(last > t)))
            if not here[some, t].all():
                some = np.flatnonzero(here[:, t])
            state[some] = np.tanh(state[some] @ turn + drawn[place[some, t]])
            total[some] += state[some]
        back = np.argsort(order)
        state, total = state[back], total[back]
        return np.concatenate([state, total / used[:, None]], axis=1)

    return df.withColumn(out, states(F.col(ids).cast("array<int>")))


def train_sequence_classifier(
    df: DataFrame, pseudo: str = "pseudo_label", id_col: str = "id", text: str = "cleaned_text",
    units: int = 64, fallback: str | None = None,
) -> DataFrame:
    """Self-training: fit on pseudo-labels, then label every row again as ``ground_truth``.

    A random recurrent network reads the rows' token ids in a vocabulary of their own; what it
    remembers is read out by a small network that is trained.
    """
    coded = with_sequences(df, build_vocabulary(df, id_col, text), text)
    rows = recurrent_features(coded, units=units).drop("ids").persist(StorageLevel.MEMORY_AND_DISK)
    fitted = train_perceptron(rows, label=pseudo)
    scored = fitted.predict(rows, "ground_truth").drop("features")
    if fallback is not None:
        scored = scored.withColumn("ground_truth", F.coalesce("ground_truth", fallback))
    return scored
