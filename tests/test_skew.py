from collections import defaultdict
from hashlib import md5
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from opinweave.operators import evaluation as ev, features as ft, filters as fl, joins as jn, skew


@pytest.mark.parametrize("limit", [10, 100_000])
def test_attach_both_ways(spark, limit):
    df = spark.range(1000).select((F.col("id") % 50).alias("k"), "id")
    dim = spark.range(0, 60, 2).select(F.col("id").alias("k"), F.col("id").alias("v"))
    got = skew.attach(df, dim, ["k"], "left", limit)
    assert got.count() == 1000 and got.where("v is not null").count() == 500


@pytest.mark.parametrize("values", [
    [5.0], [1.0, 2.0], list(range(1000)), [3.0] * 500 + list(range(500)), [float(i % 7) for i in range(999)],
])
def test_exact_percentiles(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v DOUBLE").repartition(5)
    probs = [0.0, 0.3, 0.5, 0.7, 1.0]
    assert skew.exact_percentiles(df, "v", probs) == pytest.approx(np.percentile(values, [100 * p for p in probs]))


def test_exact_percentiles_with_a_coarse_sketch(spark):
    values = np.random.default_rng(0).exponential(size=5000)
    df = spark.createDataFrame([(float(v),) for v in values], "v DOUBLE").persist()
    got = [skew._percentile(df, 5000, p, 50) for p in (0.01, 0.31, 0.5, 0.99)]
    assert got == pytest.approx(np.percentile(values, [1, 31, 50, 99]))
    assert skew.exact_percentiles(df.where("v < 0"), "v", [0.5]) is None


def _order(i):
    return md5(f"{i}:42".encode()).hexdigest()


def test_split_is_exact_and_does_not_depend_on_partitions(spark):
    rows = [(i, 0 if i % 10 else 2 if i % 20 else 1) for i in range(1237)]
    groups = defaultdict(list)
    for i, y in rows:
        groups[y].append(i)
    total = math.ceil(0.2 * len(rows))
    exact = {y: total * len(g) / len(rows) for y, g in groups.items()}
    quota = {y: int(e) for y, e in exact.items()}
    for y in sorted(exact, key=lambda y: (quota[y] - exact[y], y))[: total - sum(quota.values())]:
        quota[y] += 1
    want = {i for y, g in groups.items() for i in sorted(g, key=lambda i: (_order(i), i))[: quota[y]]}
    for parts in (1, 7):
        df = spark.createDataFrame(rows, "id LONG, y INT").repartition(parts)
        got = ft.stratified_split(df)
        assert {r["id"] for r in got.where("split = 'test'").collect()} == want
        assert got.count() == len(rows)
    whole = ft.stratified_split(df, label=None)
    assert whole.where("split = 'test'").count() == total


def test_sample_with_replacement(spark):
    rows = [(i, i % 3 // 2) for i in range(3000)]
    groups = defaultdict(list)
    for i, y in rows:
        groups[y].append(i)
    df = spark.createDataFrame(rows, "id LONG, y INT").repartition(5)
    got = sorted((r["y"], r["draw"], r["id"]) for r in ft.stratified_sample(df, size=1024).collect())
    assert len(got) == 1024
    ordered = {y: sorted(g, key=lambda i: (_order(i), i)) for y, g in groups.items()}
    for y, draw, i in got:
        assert ordered[y][(draw * 2654435761 + 42) % len(ordered[y])] == i


def test_english_filter_both_ways(spark):
    vocab = spark.createDataFrame([(w,) for w in ("Good", "food", "fast", "and")], "word STRING")
    rows = [
        (1, "good food fast and x"), (2, "good food fast x y"), (3, None), (4, "ভালো good food"),
        (5, "12 34"), (6, "Good, food! Don't-know"), (7, "good good good good zzz"),
    ]
    df = spark.createDataFrame(rows, "id INT, content STRING")
    for inline in (100, 0):
        got = fl.filter_english(df, vocab, inline_words=inline)
        assert sorted(r["id"] for r in got.collect()) == [1, 6, 7]
        assert got.columns == df.columns


def test_english_filter_with_repeated_and_missing_ids(spark):
    vocab = spark.createDataFrame([(w,) for w in ("aa", "bb", "cc", "dd", "ee", None)], "word STRING")
    rows = [(1, "aa bb cc dd ee"), (1, "zz zz zz zz zz"), (None, "aa bb"), (2, "aa bb"), (None, None)]
    df = spark.createDataFrame(rows, "id INT, content STRING")
    for inline in (100, 0):
        got = fl.filter_english(df, vocab, inline_words=inline).collect()
        assert sorted((r["id"] or 0, r["content"]) for r in got) == [(0, "aa bb"), (1, "aa bb cc dd ee"), (2, "aa bb")]


def test_attach_labels_of_equal_rows(spark):
    reviews = spark.createDataFrame([("a",)] * 500 + [(None,)], "cleaned_text STRING")
    marked = spark.createDataFrame([("a", "Positive")], "cleaned_text STRING, sentiment_label STRING")
    got = jn.attach_labels(reviews, marked)
    assert got.count() == 501 and got.where("sentiment_label = 'Positive'").count() == 500


def test_percentiles_skip_nan(spark):
    df = spark.createDataFrame([(float(v),) for v in range(10)] + [(math.nan,)] * 5, "v DOUBLE")
    assert skew.exact_percentiles(df, "v", [0.3, 0.9]) == pytest.approx([2.7, 8.1])


def test_split_and_sample_skip_rows_without_a_label(spark):
    df = spark.createDataFrame([(i, i % 2 if i % 5 else None) for i in range(100)], "id LONG, y INT")
    assert ft.stratified_split(df).count() == 80
    assert ft.stratified_sample(df, size=20).where("y is null").count() == 0


def test_attach_labels_fans_out(spark):
    reviews = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id INT, cleaned_text STRING")
    marked = spark.createDataFrame(
        [("a", "Positive"), ("a", "Positive"), ("a", "Negative")], "cleaned_text STRING, sentiment_label STRING"
    )
    got = sorted((r["id"], r["sentiment_label"] or "") for r in jn.attach_labels(reviews, marked).collect())
    assert got == [(1, "Negative"), (1, "Positive"), (2, "Negative"), (2, "Positive"), (3, "")]


def test_metrics(spark):
    rows = [("a", 1, 0), ("a", 0, 0), ("a", 2, 0), ("a", 2, -1), ("b", 0, 0)]
    df = spark.createDataFrame(rows, "scorer STRING, y INT, yhat INT")
    m = {r["scorer"]: r for r in ev.classification_metrics(df).collect()}
    assert m["a"]["accuracy"] == pytest.approx(100 / 3) and m["b"]["f1"] == pytest.approx(100)
    assert m["a"]["precision"] == pytest.approx(100 / 9)
    lenient = {r["scorer"]: r["accuracy"] for r in ev.lenient_binary_accuracy(df).collect()}
    assert lenient["a"] == pytest.approx(200 / 3)
    soft = {r["scorer"]: r["accuracy"] for r in ev.classification_metrics(df, lenient=["a"]).collect()}
    assert soft["a"] == pytest.approx(200 / 3)
    cells = ev.confusion_matrix(df)
    assert cells.count() == 18 and cells.agg(F.sum("n")).first()[0] == 4
    assert cells.where("scorer = 'b' and actual = 1").agg(F.max("share")).first()[0] == 0.0


def test_sequences(spark):
    rows = [(1, "b a b"), (2, "c a " + "z " * 300), (3, ""), (4, "A new")]
    df = spark.createDataFrame(rows, "id INT, t STRING")
    vocab = ft.build_vocabulary(df.where("id < 4"), text="t", max_words=5)
    assert {r["word"]: r["idx"] for r in vocab.collect()} == {"b": 2, "a": 3, "c": 4}
    ids = {r["id"]: r["ids"] for r in ft.encode_sequences(df, vocab, text="t").collect()}
    assert all(len(v) == 256 for v in ids.values())
    assert ids[1][:4] == [2, 3, 2, 0] and ids[2][:3] == [4, 3, 1] and ids[2][255] == 1
    assert ids[3] == [0] * 256 and ids[4][:3] == [3, 1, 0]
    same = spark.createDataFrame([(1, "b"), (1, "a"), (None, None)], "id INT, t STRING")
    got = ft.encode_sequences(same, vocab, text="t", length=2)
    assert sorted((r["id"] or 0, r["ids"]) for r in got.collect()) == [(0, [0, 0]), (1, [2, 0]), (1, [3, 0])]
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_scalers_keep_constant_columns_at_zero(spark):
    df = spark.createDataFrame([([1.0, 5.0],), ([3.0, 5.0],)], "features ARRAY<DOUBLE>")
    assert [r[1] for r in ft.standard_scaler(df)(df).collect()] == [[-1.0, 0.0], [1.0, 0.0]]
    assert [r[1] for r in ft.minmax_scaler(df)(df).collect()] == [[0.0, 0.0], [1.0, 0.0]]


def test_labels_are_attached_without_shuffling_texts(spark):
    from opinweave.operators import joins as jn

    reviews = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "b", "a", None, "", "z"])], "id INT, cleaned_text STRING")
    marks = [("a", "x"), ("a", "y"), ("a", "x"), (None, "n"), ("", "e"), ("b", None)]
    labelled = spark.createDataFrame(marks, "cleaned_text STRING, sentiment_label STRING")
    want = reviews.join(labelled.distinct(), "cleaned_text", "left")
    for limit in (0, 100):
        got = jn.attach_labels(reviews, labelled, limit=limit)
        assert got.columns == want.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    some = jn.attach_labels(reviews, labelled, limit=0).select("id", "sentiment_label")
    plan = some._jdf.queryExecution().executedPlan().toString()
    sent = [line for line in plan.splitlines() if "HashAggregate" in line or "SortMergeJoin" in line]
    assert sent and not any("cleaned_text" in line for line in sent)


def test_vocabulary_of_the_first_texts(spark, monkeypatch):
    from opinweave.operators import features as ft

    monkeypatch.setattr(ft, "FIRST_TEXTS", 3)
    rows = [(i // 2, f"w{i % 7} w{i} w{i + 1}") for i in range(80)] + [(None, "none at all"), (1, None), (2, " ")]
    df = spark.createDataFrame(rows, "id INT, t STRING").repartition(4)
    for words in (2, 5, 12, 40, 1000):
        at = {}
        for i, t in rows:
            for pos, w in enumerate(dict.fromkeys((t or "").split())):
                at[w] = min(at.get(w, (9e9, 0)), (-1 if i is None else i, pos))
        order = sorted(at, key=lambda w: (at[w], w))[: words - 2]
        got = {r["word"]: r["idx"] for r in ft.build_vocabulary(df, "id", "t", words).collect()}
        assert got == {w: i for i, w in enumerate(order, 2)}
    assert "<= " in ft.build_vocabulary(df, "id", "t", 12)._jdf.queryExecution().toString()


def test_words_are_counted_before_they_are_shuffled_for_a_lookup(spark, sf, monkeypatch):
    from opinweave.catalog.queries import QUERIES
    from opinweave.operators import joins as jn

    few = QUERIES["vocab_lookup"](spark, sf).collect()  # the vocabulary is broadcast
    monkeypatch.setattr(jn, "attach", lambda df, dim, keys, how: df.join(dim, keys, how))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = QUERIES["vocab_lookup"](spark, sf)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("Join LeftSemi") < plan.index("Aggregate [word")
        assert sorted(found.collect()) == sorted(few)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
