"""Steps of training and scoring whose cost must not grow faster than their rows."""

from collections import Counter

import numpy as np
import pytest

from opinweave.functions import text as tx
from opinweave.operators import features as ft, learners as ln, pseudo_labels as ps


def test_nearest_is_that_of_all_differences():
    draw = np.random.default_rng(5)
    x = draw.integers(0, 3, (5000, 6)).astype(float)  # many rows as far from one centre as from another
    x[7, 2], x[9, 0] = np.nan, np.inf
    centres = np.concatenate([x[:3], x[:2], draw.normal(size=(2, 6))])
    with np.errstate(invalid="ignore"):
        far = ((x[:, None, :] - centres) ** 2).sum(axis=2)
    both = ps.nearest_of(x, np.array([centres, centres[::-1]]))
    assert both[:, 0].tolist() == far.argmin(axis=1).tolist() == ps.nearest(x, centres)[0].tolist()
    assert both[:, 1].tolist() == far[:, ::-1].argmin(axis=1).tolist()


def test_nearest_takes_no_room_for_all_differences():
    import tracemalloc

    x, centres = np.random.default_rng(1).normal(size=(4096, 256)), np.random.default_rng(2).normal(size=(12, 256))
    tracemalloc.start()
    ps.nearest(x, centres)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * x.nbytes


def test_kmeans_step_of_odd_numbers(spark):
    rows = [([1.0, 0.0],), ([3.0, 0.0],), ([0.0, 8.0],), ([float("nan"), 9.0],)]
    df = spark.createDataFrame(rows, "x ARRAY<DOUBLE>")
    moved, n, cost = ps.kmeans_step(df.where("not isnan(x[0])"), np.array([[[0.0, 0.0], [0.0, 9.0]]]))
    assert n.tolist() == [[2, 1]] and moved.tolist() == [[[2.0, 0.0], [0.0, 8.0]]] and cost.tolist() == [11.0]
    moved, n, _ = ps.kmeans_step(df, np.array([[[0.0, 9.0], [2.0, 0.0]]]))
    assert n.tolist() == [[2, 2]] and np.isnan(moved[0, 0, 0]) and moved[0, 1].tolist() == [2.0, 0.0]


@pytest.mark.parametrize("sign", [" ", "  ", "\t", "\n", "\x0b", "\x1c", "\x85", "\xa0", " ", "　 "])
def test_space_tokens_between_any_white_space(spark, sign):
    rows = [(f"A{sign}b{sign}", ["a", "b"]), (f"{sign}É", ["é"]), (sign, []), ("", []), (None, [])]
    df = spark.createDataFrame(rows, "t STRING, want ARRAY<STRING>")
    assert [r[0] for r in df.select(tx.space_tokens("t")).collect()] == [w for _, w in rows]


WORDS = ["aa", "bb", "cc", "dd", "ee", "the", "x", "Ünï"]


def _texts(n: int):
    draw = np.random.default_rng(3)
    said = [" ".join(draw.choice(WORDS, draw.integers(0, 12), p=[0.3, 0.2, 0.15, 0.1, 0.05, 0.1, 0.05, 0.05])) for _ in range(n)]
    return [*said, None, "", "only only only only only only only only only only"]


def _grams(text):
    w = [t for t in (text or "").lower().split() if len(t) >= 2 and t != "the"]
    return w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def _expected(texts, size, min_df, max_df):
    cf, df = Counter(), Counter()
    for t in texts:
        cf.update(_grams(t))
        df.update(set(_grams(t)))
    kept = [(t, c, df[t]) for t, c in cf.items() if min_df <= df[t] <= max_df * len(texts)]
    return sorted(kept, key=lambda r: (-r[1], r[0].encode()))[:size]


@pytest.mark.parametrize("size, max_df", [(1, 1.0), (1, 0.3), (5, 0.95), (5, 0.2), (100, 0.95)])
@pytest.mark.parametrize("paired", [20_000, 3])
def test_tfidf_vocabulary_is_that_of_all_counts(spark, monkeypatch, size, max_df, paired):
    monkeypatch.setattr(ft, "PAIRED_WORDS", paired)
    texts = _texts(150)
    df = spark.createDataFrame([(t,) for t in texts], "cleaned_text STRING").repartition(3)
    found = ft.tfidf_vocabulary(df, max_features=size, max_df=max_df, stop=["the"]).collect()
    assert [(r["term"], r["cf"], r["df"]) for r in found] == _expected(texts, size, 2, max_df)


def test_tfidf_vocabulary_shuffles_no_rare_pairs(spark, monkeypatch):
    """Words of one text and their pairs never leave the task that reads them as terms."""
    seen = []
    top = ft._top_terms
    monkeypatch.setattr(ft, "_top_terms", lambda totals, *a: (seen.append(totals.count()), top(totals, *a))[1])
    rows = [(f"aa bb aa bb w{i} v{i} u{i}",) for i in range(300)]
    df = spark.createDataFrame(rows, "cleaned_text STRING")
    found = ft.tfidf_vocabulary(df, max_features=2, max_df=1.0, stop=[]).collect()
    assert [r["term"] for r in found] == ["aa", "aa bb"] and seen[-1] < 20


def test_tfidf_counts(spark):
    texts = _texts(60)
    terms = ["bb", "aa bb", "aa aa", "the", "bb", "x", "aa bb cc", "ünï", "zz aa"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id INT, cleaned_text STRING").repartition(2)
    found = df.select("id", ft._term_counts(terms, ["the"])(ft._said("cleaned_text")).alias("n")).collect()
    want = {i: [Counter(_grams(t))[g] for g in terms] for i, t in enumerate(texts)}
    assert {r["id"]: r["n"] for r in found} == want


def test_svm_fits_classes_side_by_side(spark, monkeypatch):
    import threading

    draw = np.random.default_rng(4)
    rows = [(i, i % 3, [float(v) for v in draw.normal(size=4) + 3 * (i % 3)]) for i in range(150)]
    df = spark.createDataFrame(rows, "id INT, y INT, features ARRAY<DOUBLE>")
    met, fit = threading.Barrier(2), ln.LinearSVC.fit
    waits = iter([True, True])

    def fitted(self, *args):
        if next(waits, False):
            met.wait(60)  # ends with an error if no second class is fitted meanwhile
        return fit(self, *args)

    monkeypatch.setattr(ln.LinearSVC, "fit", fitted)
    found = ln.train_svm(df, width=32, max_iter=20).predict(df).collect()
    assert np.mean([r["y"] == r["yhat"] for r in found]) > 0.95


def test_fourier_features(spark):
    x = np.random.default_rng(6).normal(size=(50, 3))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id INT, features ARRAY<DOUBLE>").repartition(3)
    project = ln._fourier_features(df, "features", 4096, 42)
    z = np.array([r[0] for r in df.select("id", project("features").alias("z")).orderBy("id").select("z").collect()])
    spread = (x.var(axis=0, ddof=1) + x.mean(axis=0) ** 2).mean() - x.mean() ** 2
    kernel = np.exp(-((x[:, None] - x) ** 2).sum(axis=2) / (3 * spread))
    assert z.shape == (50, 4096) and np.abs(z @ z.T - kernel).max() < 0.1


def test_score_sentiment_makes_its_training_rows_once(spark, sf, monkeypatch):
    from pyspark.sql import functions as F

    from opinweave.catalog import queries as q

    seen, rows = spark.sparkContext.accumulator(0), q.x.labelled_reviews

    @F.udf("string")
    def noted(text):
        seen.add(1)
        return text

    monkeypatch.setattr(q.x, "labelled_reviews", lambda s, d: rows(s, d).withColumn("cleaned_text", noted("cleaned_text")))
    q.QUERIES["score_sentiment"](spark, sf)
    assert seen.value == rows(spark, sf).count() > 0
