import re

import pytest
from pyspark.sql import functions as F

from opinweave.functions import labels as fn, lexicons as lex
from opinweave.operators import labellers as lab

TEXTS = [
    "xyz", "quick delivery", "good", "best", "late night", "good bad", "", None, "chocolate nights",
    "worst app ever, never again! 😡 👍", "goodness", "problem problem", "bad " * 15 + "good food fast",
    "OTP failures & payment & server errors", "slow/laggy", "the food or restaurant unavailable",
    "love app ❤️ highly recommended " + "word " * 30, "Unprofessional staff, rude and late delivery",
]


def py_theme(text):
    low, best = (text or "").lower(), (0, None, None)
    for theme, sub in lex.THEME_PAIRS:
        score = 2 * sum(k in low for k in theme.lower().split())
        score += 3 * sum(k in low for k in sub.lower().split()) + 5 * (sub.lower() in low)
        if score > best[0]:
            best = (score, theme, sub)
    return best[1:]


def py_points(text):
    low, sides = (text or "").lower(), []
    for table, emoji in ((lex.NEGATIVE_KEYWORDS, lex.NEGATIVE_EMOJI), (lex.POSITIVE_KEYWORDS, lex.POSITIVE_EMOJI)):
        n = 0.0
        for k, w in table.items():
            if " " in k:
                n += 2 * w * (k in low)
            else:
                n += w * bool(re.search(rf"\b{re.escape(k)}\b", low))
        sides.append(n + 4 * sum(e in (text or "") for e in emoji))
    neg, pos = sides
    length = len(low.split())
    if length > 20 and neg > pos:
        neg += length * 0.1
    elif length > 20 and pos > neg:
        pos += length * 0.1
    return neg, pos


def py_sentiment(neg, pos):
    if neg > 0 and pos > 0:
        return 0 if neg / pos > 2 else 2 if neg / pos < 0.5 else 1
    return 0 if neg >= 3 else 2 if pos >= 3 else 1


@pytest.fixture
def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id INT, t STRING").repartition(3)


def test_theme(texts):
    got = {r["id"]: (r["theme"], r["subtheme"]) for r in lab.with_theme(texts, "t").collect()}
    assert got == {i: py_theme(t) for i, t in enumerate(TEXTS)}
    scored = lab.theme_scores(texts, "t").where("id = 1 and subtheme = 'Quick Delivery'").first()
    assert scored["score"] == 13


def test_lexicon(texts):
    rows = lab.with_lexicon_scores(texts, "t").collect()
    want = {i: py_points(t) for i, t in enumerate(TEXTS)}
    assert {r["id"]: (r["negative_score"], r["positive_score"]) for r in rows} == want
    got = {r["id"]: r["sentiment"] for r in lab.with_lexicon_sentiment(texts, "t").collect()}
    assert got == {i: py_sentiment(*p) for i, p in want.items()}
    assert (got[2], got[3], got[4], got[5]) == (1, 2, 0, 1)


def test_labels_can_be_filtered_without_being_computed_twice(texts):
    df = lab.with_lexicon_sentiment(lab.with_theme(lab.with_cleaned(texts, "t")))
    df = df.where("theme is not null and sentiment = 0")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("worst customer") <= 2
    assert df.count() > 0


def test_bins(spark):
    scores = [0.0, 0.3, 0.30001, 0.7, 0.70001, 1.0, 1.1, None, -0.1]
    df = spark.createDataFrame(list(enumerate(scores)), "i INT, s DOUBLE")
    got = [r[0] for r in df.orderBy("i").select(fn.bin_score("s")).collect()]
    assert got == ["Low", "Low", "Medium", "Medium", "High", "High", None, None, None]


def test_softmax_and_argmax(spark):
    df = spark.range(1).select(fn.softmax(F.array(F.lit(1.0), F.lit(3.0), F.lit(2.0))).alias("p"))
    p = df.first()["p"]
    assert sum(p) == pytest.approx(1) and p[1] == max(p) and p[0] == pytest.approx(0.0900306)
    tie = F.create_map(F.lit("b"), F.lit(0.5), F.lit("a"), F.lit(0.5))
    top = spark.range(1).select(fn.argmax_map(tie, ["b", "a"]).alias("t")).first()["t"]
    assert (top["label"], top["score"]) == ("b", 0.5)
    unknown = spark.range(1).select(fn.argmax_map(tie, ["a"]).alias("t")).first()["t"]
    assert unknown["label"] == "a"


def test_crosstab_counts_labels_outside_the_list(spark):
    from opinweave.operators import aggregates as agg

    df = spark.createDataFrame([("x", "joy"), ("x", "trust")], "app STRING, emotion STRING")
    assert agg.crosstab_row_pct(df, "app", "emotion", ["joy"]).collect()[0].asDict() == {"app": "x", "joy": 50.0}
    every = agg.crosstab_row_pct(df, "app", "emotion").collect()[0].asDict()
    assert every == {"app": "x", "joy": 50.0, "trust": 50.0}
    assert agg.crosstab_counts(df, "app", "emotion", None).collect()[0].asDict() == {"app": "x", "joy": 1, "trust": 1}


def test_remap_and_coalesce(spark):
    df = spark.createDataFrame([(i,) for i in range(6)], "k INT")
    got = [r[0] for r in df.orderBy("k").select(fn.label_remap("k", lex.FIVE_STAR_CLASSES)).collect()]
    assert got == [0, 0, 1, 2, 2, -1]
    rows = spark.createDataFrame([(0, 2), (-1, 2), (None, 0)], "m INT, f INT")
    assert [r[2] for r in lab.coalesce_labels(rows, "m", "f").collect()] == [0, 2, 0]


def test_emotion(texts):
    rows = lab.with_emotion(texts, text="t").collect()
    assert all(abs(sum(r["emotion_scores"].values()) - 1) < 1e-9 for r in rows)
    by_id = {r["id"]: r["emotion"] for r in rows}
    assert by_id[2] == "joy" and by_id[0] == "joy"  # nothing found: equal shares, first label


def test_scorers(spark, texts):
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("int")
    def length_class(t):
        return t.fillna("").str.len().clip(upper=5).astype("int32")

    scored = lab.with_class_sentiment(
        texts, lab.udf_scorer(length_class, "class_idx"), lex.FIVE_STAR_CLASSES, "t"
    )
    assert {r["id"]: r["sentiment"] for r in scored.collect()}[6] == 0
    with pytest.raises(ValueError):
        lab.first_scorer(None, None)
    failed = lab.expression_scorer(lambda c: F.lit(None).cast("double"), "toxicity_score")
    assert lab.with_toxicity(texts, failed, "t").agg(F.max("toxicity_score")).first()[0] == 0.0
