"""Scorers that fail, sequences and marked files."""

import numpy as np
import pytest

from opinweave.functions import lexicons as lex
from opinweave.operators import features as ft, labellers as lab, learners as ln
from opinweave.sources import writers as wr


def texts(spark, rows, parts=1):
    return spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "id INT, cleaned_text STRING").coalesce(parts)


def test_a_failing_batch_costs_its_own_texts_only(spark):
    def loud():
        def predict(batch):
            if "bad" in batch:
                raise RuntimeError("no")
            return [len(t) for t in batch]

        return predict

    df = texts(spark, ["a", "bb", "bad", "dddd", "eeeee", None, "g"])
    lost = spark.sparkContext.accumulator(0)
    scored = lab.batch_scorer(loud, "n", -1, "int", 2, lost)(df, "cleaned_text")
    assert [r["n"] for r in scored.orderBy("id").collect()] == [1, 2, -1, -1, 5, 0, 1]
    assert lost.value >= 2


@pytest.mark.parametrize(
    ("answer", "wanted"),
    [
        (lambda b: [0.5] * (len(b) - 1), [0.5, 0.5, 0.0, 0.5, 0.0]),
        (lambda b: [0.5] * (len(b) + 3), [0.5] * 5),
        (lambda b: [None, *[0.25] * (len(b) - 1)], [0.0, 0.25, 0.25, 0.0, 0.25]),
        (lambda b: ["what"] * len(b), [0.0] * 5),
        (lambda b: [], [0.0] * 5),
    ],
)
def test_short_long_and_missing_answers(spark, answer, wanted):
    scorer = lab.batch_scorer(lambda: answer, "toxicity_score", 0.0, "double", 3)
    scored = lab.with_toxicity(texts(spark, list("abcde")), scorer)
    assert [r["toxicity_score"] for r in scored.orderBy("id").collect()] == wanted


def test_a_model_that_cannot_be_loaded(spark):
    def load():
        raise OSError("no weights")

    scorer = lab.batch_scorer(load, "class_idx", -1, "int")
    scored = lab.with_class_sentiment(texts(spark, ["a", "b"]), scorer, lex.TWO_CLASSES)
    assert {r["sentiment"] for r in scored.collect()} == {-1}


def test_sequence_classifier_tells_the_order_of_words(spark):
    """Both classes have the same words and the same pairs of neighbours."""
    rows = [(i, i % 2, ["a b a c a", "a c a b a"][i % 2] + " d" * (i % 5)) for i in range(120)]
    df = spark.createDataFrame(rows, "id INT, pseudo_label INT, cleaned_text STRING")
    scored = ln.train_sequence_classifier(df).collect()
    assert np.mean([r["pseudo_label"] == r["ground_truth"] for r in scored]) > 0.95


def test_recurrent_features_skip_padding(spark):
    df = spark.createDataFrame([([3, 4],), ([3, 4, 0, 0],), ([4, 3],), ([],), (None,)], "ids ARRAY<INT>")
    a, b, c, d, e = [np.array(r["features"]) for r in ln.recurrent_features(df, units=8).collect()]
    assert (a == b).all() and not np.allclose(a, c)
    assert not d.any() and not e.any() and len(d) == 16


def test_marked_files(spark, tmp_path):
    rows = [(1, "plain", 0.5), (2, 'quo"te, comma', None), (3, "two\nlines", 1.0), (4, "", 2.0), (5, None, 3.0), (6, " café ", -1.0)]
    df = spark.createDataFrame(rows, "id INT, `a.b` STRING, x DOUBLE").repartition(3)
    path = str(tmp_path / "out")
    wr.write_utf8_sig(df, path)
    files = [f.read_bytes() for f in (tmp_path / "out").glob("part-*")]
    assert files and all(f.startswith(b"\xef\xbb\xbfid,a.b,x\n") for f in files)
    back = spark.read.options(header="true", quote='"', escape='"', multiLine="true", nullValue="\0").schema("id INT, t STRING, x DOUBLE").csv(path)
    assert sorted(tuple(r) for r in back.collect()) == sorted(rows, key=lambda r: r[0])
    empty = str(tmp_path / "empty")
    wr.write_utf8_sig(df.limit(0), empty)
    assert [f.read_bytes() for f in (tmp_path / "empty").glob("part-*")] == [b"\xef\xbb\xbfid,a.b,x\n"]


def test_grid_keeps_failures_as_rows(spark):
    rows = [(i, i % 2, "good nice" if i % 2 else "bad awful") for i in range(40)]
    df = spark.createDataFrame(rows, "id INT, y INT, cleaned_text STRING")

    def broken(*_, **__):
        raise ValueError("cannot be fitted")

    learners = {"Naive Bayes": ln.LEARNERS["Naive Bayes"], "Broken": ln.Learner(broken)}
    grid = ln.model_grid(df.where("id < 30"), df.where("id >= 30"), {"h": ln.hashing_embedder(16)}, learners).collect()
    said = {r["model"]: r for r in grid}
    assert said["Naive Bayes"]["accuracy"] == 100.0 and said["Broken"]["error"] == "cannot be fitted"
    assert said["Broken"]["accuracy"] is None


def test_sequences_are_read_a_few_at_a_time(spark, monkeypatch):
    texts = [(i, " ".join(f"w{(i * j) % 7}" for j in range(i % 9))) for i in range(30)]
    df = spark.createDataFrame([*texts, (30, None)], "id INT, cleaned_text STRING").coalesce(1)
    wanted = None
    for some in (1024, 4):
        monkeypatch.setattr(ft, "TEXTS_AT_ONCE", some)
        monkeypatch.setattr(ln, "SEQUENCES_AT_ONCE", some)
        coded = ft.with_sequences(df, ft.build_vocabulary(df))
        got = [(r["id"], r["ids"], np.round(r["features"], 12).tolist()) for r in ln.recurrent_features(coded, units=8).orderBy("id").collect()]
        wanted = wanted or got
        assert got == wanted
