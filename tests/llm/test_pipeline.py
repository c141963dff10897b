"""Every stage of the pipeline against what it must do to its own input."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from opinweave.llm import langid, mixing
from test_training_data import brute_contamination, brute_groups, doc, frame, odd


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    sf = "/root/testdata/sf0.001"
    folder = tmp_path_factory.mktemp("pipeline")
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in cp.STAGES:
        stage(spark, docs, sf).write.parquet(f"{folder}/{name}")
        after = spark.read.parquet(f"{folder}/{name}")
        out.append((docs, after))
        docs = after
    return out


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_columns_and_names(stages):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    assert [after.columns for _, after in stages] == [columns] * 4 + [[*columns, "shard", "slot"]]
    assert len(cp.STAGES) == 5


def test_language_keeps_what_it_is_sure_of(stages):
    before, after = stages[0]
    sure = langid.predict(before, langid.train(before)).where("lang_pred <> 'und' and score >= 0.5")
    assert ids(after) == ids(sure) and len(ids(after)) > 0.95 * before.count()


def test_one_of_each_group_stays(stages):
    before, after = stages[1]
    rows = [(r["doc_id"], r["text"]) for r in before.collect()]
    assert ids(after) == sorted(d for d, _, _, kept in brute_groups(rows, 5, 80) if kept)


def test_contaminated_documents_go(spark, stages):
    before, after = stages[2]
    items = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    rows = [(r["doc_id"], r["text"]) for r in before.collect()]
    assert ids(after) == sorted(r[0] for r in brute_contamination(rows, items) if not r[-1])


def test_mix_and_shards(stages):
    before, after = stages[3]
    report = mixing.mix_report(before).agg(F.sum("taken")).first()[0]
    assert sum(len(r["text"].split()) for r in after.collect()) == report
    before, after = stages[4]
    assert sorted(map(str, after.drop("shard", "slot").collect())) == sorted(map(str, before.collect()))
    counts = [r["count"] for r in after.groupBy("shard").count().collect()]
    assert max(counts) - min(counts) <= 1


def test_stages_take_odd_and_empty_tables(spark):
    for rows in (odd(), [], [doc(1, None)]):
        docs = frame(spark, rows)
        for _, stage in cp.STAGES:
            docs = stage(spark, docs, "/root/testdata/sf0.001")
            docs.count()
