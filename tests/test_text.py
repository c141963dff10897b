"""Text functions against an independent statement in Python's own regular expressions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from opinweave.functions import lexicons as lex, text as tx

SAMPLES = [
    None, "", "   ", "👍", "...", "http://x.y", "Don't  go!! café ২ a_b #1", "seewww.x.com now",
    "tabs\tand\nlines wide", "mail me@x.org, see https://a.b/c?d=e end", "naïve — “quoted”",
    "ভালো খাবার good", "I cannot and gonna wanna_x GOTTA go", "x" * 5000 + " !", "\x1c\x85 a\x1fb",
    "one two 22 three's re-do", "❤️ ok", "www", "http",
]


def rows(spark, expr):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(SAMPLES)], "i INT, t STRING").repartition(3)
    return {r["i"]: r["v"] for r in df.select("i", expr.alias("v")).collect()}


def py_clean(text):
    if text is None or not text.strip():
        return ""
    text = re.sub(r"http\S+|www\S+", "", text.strip())
    text = re.sub(r"[^\w\sঀ-৿@#!?]", " ", text)
    return re.sub(r"\s+", " ", text).strip() or " "


def test_clean_text(spark):
    got = rows(spark, tx.clean_text("t"))
    assert got == {i: py_clean(t) for i, t in enumerate(SAMPLES)}


def test_clean_text_twice_is_the_same(spark):
    got = rows(spark, tx.clean_text(tx.clean_text("t")))
    assert {i: v for i, v in got.items() if v.strip()} == {
        i: py_clean(t) for i, t in enumerate(SAMPLES) if py_clean(t).strip()
    }


def test_word_count_and_tokens(spark):
    assert rows(spark, tx.word_count("t")) == {i: len((t or "").split()) for i, t in enumerate(SAMPLES)}
    assert rows(spark, tx.space_tokens("t")) == {i: (t or "").lower().split() for i, t in enumerate(SAMPLES)}


def test_has_bengali(spark):
    got = rows(spark, tx.has_bengali("t"))
    assert sorted(i for i, v in got.items() if v) == [6, 11]


def test_report_tokens(spark):
    def py(text):
        out = []
        for token in re.split(r"[\s@#!?]+", py_clean(text).lower()):
            out += lex.SPLIT_WORDS.get(token, (token,))
        return [t for t in out if t.isalpha() and len(t) > 2 and t not in lex.stopwords()]

    got = rows(spark, tx.report_tokens(tx.clean_text("t"), lex.stopwords()))
    assert got == {i: py(t) for i, t in enumerate(SAMPLES)}


@pytest.mark.parametrize(
    "text, tokens",
    [
        ("It's good, don't go.", ["it", "good", "do", "go"]),
        ("Stop! 'quoted' re-do 24/7 end.", ["stop", "end"]),
        ("First one. Second one...", ["first", "one", "second", "one"]),
        ("(a) [b] {c} \"d\" e;f", ["a", "b", "c", "d", "e", "f"]),
        ("12 34", []),
    ],
)
def test_english_tokens(spark, text, tokens):
    df = spark.createDataFrame([(text,)], "t STRING")
    assert df.select(tx.english_tokens("t")).first()[0] == tokens


def test_word_ngrams(spark):
    df = spark.createDataFrame([("The good a food is FAST",), ("",), (None,), ("one",)], "t STRING")
    got = [r[0] for r in df.select(tx.word_ngrams("t", ["the", "is"])).collect()]
    assert got == [["good", "food", "fast", "good food", "food fast"], [], [], ["one"]]


def test_names(spark):
    df = spark.createDataFrame([("Trust & Ethics",)], "t STRING")
    assert df.select(tx.safe_name("t")).first()[0] == "Trust__Ethics"
    assert df.select(tx.model_file_name(F.lit("A B-c/D"))).first()[0] == "a_b_c_d"
    assert df.select(tx.model_key(F.lit("SVM"), F.lit("e"))).first()[0] == "SVM (e)"


def old_english_tokens(raw):
    """Every step of the tokeniser by itself: signs set apart, endings cut, words tested one by one."""
    t = F.lower(F.coalesce(F.col(raw), F.lit("")))
    for pattern, by in (
        (r"\.\.\.", " ... "),
        (r"[;@#$%&?!(){}<>\[\]\"«»“”‘’„`]|--", " $0 "),
        (r"([:,])([^\p{Nd}])", " $1 $2"),
        (r"[:,]$", " $0 "),
        (f"(\\.+)([{tx.SPACE}]|$)", " $1 "),
        (f"[{tx.SPACE}]+", " "),
    ):
        t = F.regexp_replace(t, pattern, by)
    t = F.concat(t, F.lit(" "))
    t = F.regexp_replace(t, "([^' ])('s|'m|'d|'ll|'re|'ve|n't|') ", "$1 $2 ")
    return F.filter(F.split(t, " "), lambda w: w.rlike(r"^\p{L}+$"))


def test_english_tokens_are_those_of_the_single_steps(spark, sf):
    draw = random.Random(5)
    signs = ["a", "n", "t", "s", "can", "'", "'s", "n't", "'ll", ",", ":", ".", "..", "-", "--", " ", "\n", "\u00a0", "\x85", "1", ")", "“", "é", "É", "\u0981", "_", "İ"]
    rows = [("".join(draw.choice(signs) for _ in range(draw.randint(0, 12))),) for _ in range(30_000)]
    df = spark.createDataFrame([*rows, (None,)], "text STRING").unionByName(spark.read.parquet(f"{sf}/documents.parquet").select("text"))
    both = df.select("text", old_english_tokens("text").alias("old"), tx.english_tokens("text").alias("new"))
    assert both.where(~F.col("old").eqNullSafe(F.col("new"))).take(3) == []


def test_english_tokens_test_no_word_by_itself(spark):
    plan = spark.range(1).select(tx.english_tokens(F.col("id").cast("string")).alias("t"))._jdf.queryExecution().toString()
    assert "lambda" not in plan and plan.split("== Physical Plan ==")[1].count("regexp_replace") == 3
