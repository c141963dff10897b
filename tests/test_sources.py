import pytest
from pyspark.sql import functions as F

from opinweave.operators import labellers as lab
from opinweave.sources import readers as rd, writers as wr
from opinweave.streaming import incremental as st


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a.csv.csv").write_text('content,is_english\n"good ""food"", fast",True\nNA,True\n"two\nlines",False\n')
    (tmp_path / "b.csv").write_text("rating,Review Text\n5,worst app\n4,\n")
    (tmp_path / "c.csv").write_text("rating,stars\n5,1\n")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / ".hidden.csv").write_text("content\nx\n")
    return tmp_path


def test_scan_review_files(spark, folder):
    df = rd.scan_review_files(spark, str(folder))
    got = sorted((r["app"], r["content"], r["is_english"]) for r in df.collect())
    assert got == [("a", 'good "food", fast', True), ("a", "two\nlines", False), ("b", "worst app", None)]


def test_file_shapes(spark, folder):
    files = rd.list_files(spark, str(folder))
    shapes = {k: sorted(f.rpartition("/")[2] for f in v) for k, v in rd.file_shapes(spark, files).items()}
    assert shapes == {
        (("content", "is_english"), True): ["a.csv.csv"],
        (("rating", "Review Text"), False): ["b.csv"],
        (("rating", "stars"), False): ["c.csv"],
    }


def test_themes(spark, tmp_path):
    (tmp_path / "themes.csv").write_text("theme,subtheme\nB,two\nA,one\nB,three\n")
    themes = rd.scan_themes(spark, str(tmp_path / "themes.csv"))
    assert rd.theme_pairs(themes) == [("B", "two"), ("A", "one"), ("B", "three")]
    grouped = [(r["theme"], r["subthemes"], r["n_subthemes"]) for r in rd.group_themes(themes).collect()]
    assert grouped == [("B", ["two", "three"], 2), ("A", ["one"], 1)]


def test_negative_reviews_are_written_per_app(spark, tmp_path):
    rows = [(i, f"app{i % 2}", t) for i, t in enumerate(["worst app", "good food", "bad, \"cold\" food", "ok"])]
    df = lab.with_cleaned(spark.createDataFrame(rows, "id INT, app STRING, content STRING"))
    labelled = lab.with_sentiment_label(lab.with_lexicon_sentiment(df))
    rate = wr.write_negative_by_app(labelled, str(tmp_path / "neg")).first()
    assert (rate["negative"], rate["total"], rate["pct"]) == (2, 4, 50.0)
    back = spark.read.options(**rd.CSV).csv(str(tmp_path / "neg"))
    assert sorted(back.columns) == ["app", "content", "id"]
    assert sorted(r["content"] for r in back.collect()) == ['bad, "cold" food', "worst app"]


def test_sentiment_results(spark, folder, tmp_path):
    raw = rd.scan_review_files(spark, str(folder))
    assert rd.sentiment_results(spark, str(tmp_path / "none"), ["/no/such.csv"], raw) is None
    out = tmp_path / "deep"
    (out / "x").mkdir(parents=True)
    (out / "x" / "my_sentiment.csv").write_text("content,predicted_sentiment\ngood,2\nbad,0\nodd,7\n")
    got = rd.sentiment_results(spark, str(out), [], None)
    assert sorted(r["sentiment_label"] for r in got.collect()) == ["Negative", "Positive"]


def test_landing(spark, tmp_path):
    with pytest.raises(ValueError):
        rd.ingest_landing(spark.range(1))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text('{"content": "good", "score": 5}\n{"content": "bad", "score": 1}\n')
    stream = st.landing_stream(spark, str(tmp_path / "in"), "json", "content STRING, score INT")
    for _ in range(2):  # the second run finds no new files
        st.ingest_stream(stream, str(tmp_path / "out"), str(tmp_path / "state"), "parquet").awaitTermination()
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.columns == ["content"] and sorted(r[0] for r in back.collect()) == ["bad", "good"]


def test_stream_equals_batch(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stream = st.landing_stream(spark, sf, "parquet", docs.schema.simpleString()[7:-1].replace(":", " "), "documents.parquet")
    scored = st.incremental_scoring(stream, "text")
    batch = st.score_reviews(docs, "text")
    assert scored.exceptAll(batch.select(scored.columns)).count() == 0
    assert scored.count() == docs.count()
    assert scored.where(F.col("theme").isNotNull()).count() > 0


def test_a_table_of_one_file_or_of_many_is_streamed(spark, sf, tmp_path):
    from opinweave.catalog.queries import QUERIES

    spark.read.parquet(f"{sf}/documents.parquet").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    one, many = (QUERIES["incremental_scoring"](spark, p).orderBy("id").collect() for p in (sf, str(tmp_path)))
    assert len(one) > 0 and one == many
