import pytest
from pyspark.sql import functions as F

from opinweave.operators import labellers as lab, learners as ln
from opinweave.plans import reports


@pytest.fixture(scope="module")
def reviews(spark):
    texts = ["worst app ever", "good food, fast delivery", "late delivery and cold food", "ok", "love app", "zzz"]
    rows = [(i, f"app{i % 3}", texts[i % 6]) for i in range(60)]
    return spark.createDataFrame(rows, "id LONG, app STRING, content STRING")


@pytest.fixture(scope="module")
def labelled(reviews):
    df = lab.with_theme(lab.with_cleaned(reviews))
    df = lab.with_sentiment_label(lab.with_lexicon_sentiment(df))
    return reports.kept(lab.with_toxicity(lab.with_emotion(df)))


def test_sentiment_report(labelled):
    out = reports.sentiment_report(labelled)
    assert out["distribution"].agg(F.sum("pct")).first()[0] == pytest.approx(100)
    assert [r["label"] for r in out["distribution_ordered"].collect()] == ["Negative", "Neutral", "Positive"]
    assert out["by_app"].agg(F.sum(F.col("Negative") + F.col("Neutral") + F.col("Positive"))).first()[0] == 60
    per_app = out["per_app"].groupBy("app").agg(F.sum("pct").alias("p")).collect()
    assert all(r["p"] == pytest.approx(100) for r in per_app) and len(per_app) == 3
    assert out["negative_rate"].first()["negative"] == 20


def test_theme_and_emotion_reports(labelled):
    themes = reports.theme_sentiment_report(labelled)
    for r in themes["heatmap"].collect():
        assert sum(r[c] for c in reports.THEME_SENTIMENT_ORDER) == pytest.approx(100)
    assert themes["counts"].count() == themes["distribution"].count()
    for by in ("app", "theme"):
        out = reports.emotion_report(labelled, by)
        assert out["confidence"].agg(F.sum("n")).first()[0] == 60
        assert out["distribution"].count() == out["mean_confidence"].count()


def test_toxicity_reports(reviews, labelled):
    out = reports.toxicity_report(labelled)
    assert out["bins"].agg(F.sum("n")).first()[0] == 60
    assert 0 <= out["summary"].first()["median"] < 1
    by_theme = reports.theme_toxicity_report(reviews)
    assert by_theme["coverage"].first()["total"] == 60
    assert by_theme["top_subthemes"].count() <= 15 and by_theme["row_pct"].count() > 0


def test_word_cloud_and_training(labelled):
    cloud = reports.word_cloud_report(labelled, "sentiment_label")
    assert cloud.where("rank = 1 and weight = 1.0").count() == cloud.select("sentiment_label").distinct().count()
    rows = labelled.select("id", F.col("sentiment").alias("y"), "cleaned_text")
    out = reports.training_report(rows, {"hashing": ln.hashing_embedder(32)}, {"Decision Tree": ln.LEARNERS["Decision Tree"]})
    best = out["leaderboard"].where("best").first()
    assert best["accuracy"] > 60 and out["metrics"].count() == 4
    one_class = rows.withColumn("y", F.lit(0))
    train, test = reports.split_rows(one_class)
    assert (train.count(), test.count()) == (48, 12)
    kept = ln.model_grid(train, test, {"h": ln.hashing_embedder(8)}, {k: ln.LEARNERS[k] for k in ("Logistic Regression", "Decision Tree")})
    assert [r["model"] for r in kept.collect()] == ["Decision Tree"]
