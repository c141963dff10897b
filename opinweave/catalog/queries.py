"""One query per operator, over the whole of the given tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import labels as fn, lexicons as lex, text as tx, vectors as vec
from ..operators import (
    aggregates as agg,
    evaluation as ev,
    features as ft,
    filters as fl,
    joins as jn,
    labellers as lab,
    learners as ln,
    pseudo_labels as ps,
    wordvectors as wv,
)
from ..operators.skew import exact_percentiles
from ..plans import reports
from ..plans.workspace import new_folder
from ..sources import readers as rd, writers as wr
from ..sources.balance import wanted_partitions
from ..streaming import incremental as st
from . import inputs as x

Query = Callable[[SparkSession, str], DataFrame]
DIGITS = 6
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _r(df: DataFrame, *columns: str) -> DataFrame:
    """Doubles rounded for comparison."""
    return df.withColumns({c: F.round(F.col(c), DIGITS) for c in columns})


def _long(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """A vector column as ``pos, value`` rows."""
    rows = df.select(*keys, F.posexplode(vector).alias("pos", "value"))
    return rows.withColumn("value", F.round("value", DIGITS) + F.lit(0.0))


# ------------------------------------------------------------ flagship


@query
def theme_sentiment(s, sf):
    pct = reports.theme_sentiment_pct(x.reviews(s, sf))
    return _r(pct, *reports.THEME_SENTIMENT_ORDER)


# ------------------------------------------------------------ sources


@query
def scan_review_files(s, sf):
    """Tables written as CSV files with differing headers, found and read again."""
    path = new_folder(s, "csv")
    texts = {
        "documents": F.col("text").alias("Review Text"),
        "conversations": F.col("text").alias("content"),
    }
    for name, text in texts.items():
        rows = x.table(s, sf, name).select(text, F.lit(name).alias("origin"))
        rows.write.options(**rd.CSV, ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false").mode(
            "append"
        ).csv(path)
    return rd.scan_review_files(s, path).groupBy("origin", "content").agg(F.count(F.lit(1)).alias("n"))


@query
def scan_reviews(s, sf):
    docs = x.table(s, sf, "documents").withColumn("app", F.col("source"))
    tables = {"documents": docs, "nation": x.table(s, sf, "nation")}
    tables |= {n: x.table(s, sf, n) for n in ("conversations", "benchmark")}
    return rd.scan_review_tables(tables).select("app", "content", "doc_id", "conv_id", "turn", "item_id")


@query
def resolve_text_column(s, sf):
    found = rd.resolve_text_column(x.table(s, sf, "conversations"))
    return found.select("conv_id", "turn", "content")


@query
def tag_source(s, sf):
    path = F.concat(F.lit("data/"), F.col("source"), F.lit(".csv.csv"))
    return x.table(s, sf, "documents").select("doc_id", rd.source_tag(path).alias("app"))


@query
def drop_missing_text(s, sf):
    text = F.when(F.col("lang") == "de", "NA").when(F.col("lang") == "es", " NA").otherwise(F.col("text"))
    docs = x.table(s, sf, "documents").select("doc_id", text.alias("content"))
    return fl.drop_missing_text(docs)


@query
def scan_themes(s, sf):
    regions = F.broadcast(x.table(s, sf, "region"))
    nations = x.table(s, sf, "nation")
    themes = nations.join(regions, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("ord"), F.col("r_name").alias("theme"), F.col("n_name").alias("subtheme")
    )
    return rd.group_themes(themes).withColumn("subthemes", F.array_join("subthemes", "|"))


@query
def first_available_source(s, sf):
    labelled = lambda: x.sentiment(s, sf).select("id", "sentiment_label")
    found = rd.first_available(
        [
            lambda: s.read.parquet(f"{sf}/no_such_results.parquet"),
            lambda: x.table(s, sf, "conversations"),
            labelled,
        ]
    )
    return fl.filter_in_set(found, "sentiment_label", ["Positive", "Neutral", "Negative"])


@query
def ingest_landing(s, sf):
    return rd.ingest_landing(x.reviews(s, sf))


# ------------------------------------------------------------ sinks


@query
def write_results(s, sf):
    path = new_folder(s, "results")
    wr.write_results(x.emotions(s, sf), path, fmt="parquet")
    return _r(s.read.parquet(path), "emotion_confidence")


@query
def write_negative_by_app(s, sf):
    path = new_folder(s, "negative")
    wr.write_negative_by_app(x.sentiment(s, sf), path, fmt="parquet")
    return s.read.schema("id BIGINT, content STRING, app STRING").parquet(path)


@query
def write_utf8_sig(s, sf):
    """Written with a byte-order mark on every file, and read back with whether all files have it."""
    folder = new_folder(s, "marked")
    wr.write_utf8_sig(x.cleaned(s, sf).select("id", "app", "cleaned_text"), folder)
    files = s.read.format("binaryFile").load(folder)
    marked = files.agg(F.min(F.hex(F.substring("content", 1, 3)) == "EFBBBF")).first()[0]
    rows = s.read.options(**rd.CSV, multiLine="true", nullValue="\0").schema("id BIGINT, app STRING, cleaned_text STRING").csv(folder)
    return rows.withColumn("marked", F.lit(marked))


@query
def write_filtered(s, sf):
    path = new_folder(s, "english")
    kept = fl.filter_english(x.reviews(s, sf), x.vocabulary(s, sf))
    wr.write_filtered(fl.mark_english(kept), path, fmt="parquet")
    schema = "id BIGINT, content STRING, is_english BOOLEAN, app STRING"
    return s.read.schema(schema).parquet(path)


# ------------------------------------------------------------ scalar functions


@query
def clean_text(s, sf):
    return x.cleaned(s, sf).select("id", "cleaned_text")


@query
def clean_text_pages(s, sf):
    return x.table(s, sf, "pages").select("page_id", tx.clean_text("html").alias("cleaned_text"))


@query
def has_bengali(s, sf):
    return x.reviews(s, sf).select("id", tx.has_bengali("content").alias("bengali"))


@query
def tokenize_words(s, sf):
    tokens = tx.report_tokens("cleaned_text", lex.stopwords())
    return x.cleaned(s, sf).select("id", F.array_join(tokens, " ").alias("tokens"))


@query
def word_count(s, sf):
    return x.reviews(s, sf).select(
        "id",
        tx.word_count(tx.clean_text("content")).alias("n_cleaned"),
        tx.word_count("content").alias("n_raw"),
    )


@query
def label_decode(s, sf):
    return x.embeddings(s, sf).select("vec_id", fn.label_decode("label", "Unknown").alias("name"))


@query
def label_remap(s, sf):
    label = F.col("label")
    return x.embeddings(s, sf).select(
        "vec_id",
        fn.label_remap(label, lex.FIVE_STAR_CLASSES).alias("five"),
        fn.label_remap(label, lex.THREE_CLASSES).alias("three"),
        fn.label_remap(label, lex.TWO_CLASSES).alias("two"),
    )


@query
def argmax_map(s, sf):
    scores = fn.emotion_scores("cleaned_text", x.PROBE_EMOTIONS)
    top = x.cleaned(s, sf).select("id", fn.argmax_map(scores, lex.EMOTIONS).alias("top"))
    return _r(top.select("id", "top.label", "top.score"), "score")


@query
def softmax(s, sf):
    p = fn.softmax(F.transform("embedding", lambda v: v.cast("double") * 10.0))
    return _r(
        x.embeddings(s, sf)
        .withColumn("_p", p)
        .select("vec_id", F.get("_p", F.lit(1)).alias("p1"), F.array_max("_p").alias("top")),
        "p1",
        "top",
    )


@query
def cosine_similarity(s, sf):
    rows = x.embeddings(s, sf)
    centre = ps.mean_vector(rows, "embedding")
    cos = vec.cosine_similarity("embedding", vec.literal_vector(centre))
    return _r(rows.select("vec_id", cos.alias("similarity")), "similarity")


@query
def l2_normalize(s, sf):
    unit = vec.l2_normalize(F.transform("embedding", lambda v: v * 3))
    return _long(x.embeddings(s, sf).select("vec_id", unit.alias("u")), ["vec_id"], "u")


@query
def safe_name(s, sf):
    return x.table(s, sf, "pages").select(
        "page_id", tx.safe_name("url").alias("name"), tx.model_file_name("url").alias("file_name")
    )


@query
def bin_score(s, sf):
    return x.event_scores(s, sf).select("event_id", fn.bin_score("score").alias("category"))


@query
def format_pct(s, sf):
    counts = x.reviews(s, sf).groupBy("app").count()
    total = x.reviews(s, sf).count()
    return counts.select("app", fn.format_pct("count", F.lit(total)).alias("pct"))


@query
def key_concat(s, sf):
    return x.table(s, sf, "part").select("p_partkey", tx.model_key("p_brand", "p_type").alias("key"))


# ------------------------------------------------------------ filters


@query
def filter_english(s, sf):
    return fl.filter_english(x.reviews(s, sf), x.vocabulary(s, sf)).select("id")


@query
def filter_english_joined(s, sf):
    """The same filter for a vocabulary that is too large for the plan."""
    return fl.filter_english(x.reviews(s, sf), x.vocabulary(s, sf), inline_words=0, shipped_words=0).select("id")


@query
def filter_english_shipped(s, sf):
    """The same rows, the vocabulary in a vectorised function."""
    return fl.filter_english(x.reviews(s, sf), x.vocabulary(s, sf), inline_words=0).select("id")


@query
def filter_label(s, sf):
    return fl.filter_label(x.sentiment(s, sf), "sentiment", 0).select("id", "app")


@query
def filter_notnull(s, sf):
    both = fl.filter_notnull(x.theme_and_sentiment(s, sf), "theme", "sentiment")
    return both.select("id", "theme", "sentiment")


@query
def filter_in_set(s, sf):
    return fl.filter_in_set(x.table(s, sf, "events"), "event_type", ["click", "error"]).select("event_id", "event_type")


@query
def filter_valid_prediction(s, sf):
    return fl.filter_valid_prediction(x.predictions(s, sf), "words").select("id", "y", "words")


@query
def filter_nonblank(s, sf):
    return fl.filter_nonblank(x.cleaned(s, sf), "cleaned_text").select("id")


@query
def filter_threshold(s, sf):
    return fl.filter_threshold(_metrics(s, sf), "accuracy", 20.0)


# ------------------------------------------------------------ labellers


@query
def theme_scores(s, sf):
    return lab.theme_scores(x.cleaned(s, sf)).select("id", "ord", "theme", "subtheme", "score")


@query
def theme_classify(s, sf):
    return x.themed(s, sf).select("id", "theme", "subtheme")


@query
def theme_classify_raw(s, sf):
    return lab.with_theme(x.reviews(s, sf), "content").select("id", "theme", "subtheme")


@query
def lexicon_scores(s, sf):
    scored = lab.with_lexicon_scores(x.cleaned(s, sf))
    return _r(scored.select("id", "negative_score", "positive_score"), "negative_score", "positive_score")


@query
def lexicon_sentiment(s, sf):
    return lab.with_lexicon_sentiment(x.cleaned(s, sf)).select("id", "sentiment")


@query
def lexicon_sentiment_raw(s, sf):
    return lab.with_lexicon_sentiment(x.reviews(s, sf), "content").select("id", "sentiment")


@query
def coalesce_labels(s, sf):
    marks = x.table(s, sf, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") * 2).alias("model"))
    rows = lab.with_lexicon_sentiment(x.cleaned(s, sf)).select("id", "sentiment").join(marks, "id", "left")
    rows = rows.withColumn("model", F.coalesce("model", F.lit(-1)))
    return lab.coalesce_labels(rows, "model", "sentiment").select("id", "ground_truth")


def _quality_features(df: DataFrame, text: str) -> DataFrame:
    embedded = ln.hashing_embedder(64)(df, text)
    return embedded.withColumnRenamed("embedding", "features")


@query
def score_sentiment(s, sf):
    """A model fitted on the quality labels as a two-class scorer of every review."""
    # the learner counts the rows, looks for their classes and then keeps them
    train = reports.kept(_quality_features(x.labelled_reviews(s, sf), "cleaned_text").select("quality", "features"))
    fitted = ln.train_logistic(train, label="quality")
    train.unpersist()
    scorer = lambda df, text: fitted.predict(_quality_features(df, text), "class_idx").drop("features")
    scored = lab.with_class_sentiment(x.cleaned(s, sf), scorer, lex.TWO_CLASSES)
    return scored.select("id", "sentiment")


@query
def score_emotion(s, sf):
    rows = x.emotions(s, sf).select("id", "emotion", "emotion_confidence", F.explode("emotion_scores").alias("label", "p"))
    return _r(rows, "emotion_confidence", "p")


@query
def score_toxicity(s, sf):
    """A model fitted on the toxicity labels, applied to every review."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    def features(df: DataFrame, text: str) -> DataFrame:
        return _quality_features(df, text).withColumn("features", array_to_vector("features"))

    train = features(x.labelled_reviews(s, sf), "cleaned_text")
    model = LogisticRegression(labelCol="toxic", regParam=0.01).fit(train)
    p = vector_to_array(F.col("probability"))[1]
    scorer = lab.model_scorer(model, features, "toxicity_score", p)
    scored = lab.with_toxicity(x.cleaned(s, sf), scorer)
    return _r(scored.select("id", "toxicity_score", "toxicity_category"), "toxicity_score")


def _moody(every: int, bad: int, silent: int, answer):
    """A model by the number of words: it raises where ``bad`` are over a multiple, and leaves out ``silent``."""

    def load():
        def predict(texts):
            words = [len(t.split()) for t in texts]
            if any(n % every == bad for n in words):
                raise ValueError("a text that the model cannot take")
            return [answer(n) for n in words if n % every != silent]

        return predict

    return load


@query
def score_failing_batches(s, sf):
    """Models that fail on some batches: only their texts get the value that stands for a failure."""
    classes = lab.batch_scorer(_moody(7, 3, 5, lambda n: n % 2), "class_idx", -1, "int", batch_size=1)
    toxic = lab.batch_scorer(_moody(5, 2, -1, lambda n: 1 / (1 + n)), "toxicity_score", 0.0, batch_size=1)
    scored = classes(x.cleaned(s, sf), "cleaned_text")
    scored = scored.withColumn("sentiment", F.coalesce(fn.label_remap("class_idx", lex.TWO_CLASSES), F.lit(-1)))
    scored = lab.with_toxicity(scored, toxic)
    return _r(scored.select("id", "class_idx", "sentiment", "toxicity_score"), "toxicity_score")


@query
def score_toxicity_keywords(s, sf):
    return _r(x.toxicity(s, sf).select("id", "toxicity_score", "toxicity_category"), "toxicity_score")


@query
def embed_text(s, sf):
    embedded = ln.hashing_embedder(64)(x.cleaned(s, sf), "cleaned_text")
    return embedded.select("id", F.transform("embedding", lambda v: F.round(v, DIGITS)).alias("embedding"))


@query
def word_company(s, sf):
    """Positive PMI of the words that keep company in reviews."""
    return _r(wv.word_company(x.cleaned(s, sf), "cleaned_text"), "ppmi")


@query
def embed_company(s, sf):
    """Unit-length means of word vectors that are fitted on all reviews."""
    rows = x.cleaned(s, sf)
    vectors = wv.word_vectors(wv.word_company(rows, "cleaned_text"))
    embedded = wv.text_vectors(rows, "id", "cleaned_text", vectors)
    return embedded.select("id", F.transform("embedding", lambda v: F.round(v, 4)).alias("embedding"))


# ------------------------------------------------------------ joins


@query
def attach_labels(s, sf):
    marked = x.labelled_reviews(s, sf).withColumn("sentiment_label", fn.label_decode("y"))
    return jn.attach_labels(x.cleaned(s, sf), marked).select("id", "sentiment_label")


@query
def theme_cross(s, sf):
    pairs = lab.theme_scores(x.cleaned(s, sf))
    return pairs.groupBy("ord", "theme", "subtheme").agg(
        F.count(F.lit(1)).alias("n"), F.sum("score").alias("points")
    )


@query
def vocab_lookup(s, sf):
    """Words are counted where they are read, so the lookup meets each distinct word once."""
    counted = x.tokens(s, sf).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return jn.vocab_lookup(counted, x.vocabulary(s, sf))


@query
def stopword_removal(s, sf):
    stop = s.createDataFrame([(w,) for w in sorted(lex.stopwords())], "word STRING")
    left = jn.stopword_removal(x.tokens(s, sf), stop)
    return left.groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@query
def lookup_map(s, sf):
    rows = x.emotions(s, sf).select("id", "emotion")
    colours = {k: v for k, v in lex.EMOTION_COLOURS.items() if k != "neutral"}
    return jn.lookup_map(rows, "emotion", colours, lex.OTHER_COLOUR, "colour")


# ------------------------------------------------------------ aggregates


@query
def label_distribution(s, sf):
    return _r(agg.label_distribution(x.themed(s, sf), "theme"), "pct")


@query
def label_distribution_ordered(s, sf):
    return _r(agg.label_distribution_ordered(x.sentiment(s, sf)), "pct")


@query
def crosstab_counts(s, sf):
    return agg.crosstab_counts(x.sentiment(s, sf), "app", "sentiment_label")


@query
def crosstab_row_pct(s, sf):
    return _r(agg.crosstab_row_pct(x.emotions(s, sf), "app", "emotion", lex.EMOTIONS), *lex.EMOTIONS)


@query
def crosstab_toxicity_pct(s, sf):
    return _r(agg.crosstab_toxicity_pct(x.theme_and_toxicity(s, sf), "theme"), *agg.BIN_NAMES)


@query
def crosstab_theme_counts(s, sf):
    rows = fl.filter_notnull(x.theme_and_emotion(s, sf), "theme")
    return agg.crosstab_counts(rows, "theme", "emotion", lex.EMOTIONS)


@query
def per_group_distribution(s, sf):
    return _r(agg.per_group_distribution(x.emotions(s, sf), "app", "emotion"), "pct")


@query
def summary_stats(s, sf):
    return _r(agg.summary_stats(x.table(s, sf, "events"), "value"), "mean", "median", "max", "min")


@query
def group_mean_desc(s, sf):
    return _r(agg.group_mean_desc(x.toxicity(s, sf), "app", "toxicity_score"), "mean")


@query
def group_mean_count(s, sf):
    return _r(agg.group_mean_count(x.theme_and_toxicity(s, sf), "subtheme", "toxicity_score"), "mean")


@query
def avg_confidence_by_label(s, sf):
    return _r(agg.avg_confidence_by_label(x.emotions(s, sf), "emotion", "emotion_confidence"), "mean")


@query
def bin_counts(s, sf):
    return _r(agg.bin_counts(x.event_scores(s, sf), "score"), "pct")


@query
def histogram_by_label(s, sf):
    return _r(agg.histogram_by_label(x.table(s, sf, "events"), "event_type", "value"), "lo", "hi")


@query
def term_frequency(s, sf):
    return agg.term_frequency(x.themed(s, sf), "theme", "cleaned_text", lex.stopwords("theme"))


@query
def distinct_values(s, sf):
    return agg.distinct_values(x.themed(s, sf), "subtheme")


@query
def count_distinct(s, sf):
    return agg.count_distinct(x.theme_and_emotion(s, sf), "app", "theme", "emotion")


@query
def coverage(s, sf):
    return _r(agg.coverage(x.themed(s, sf), "theme"), "share")


@query
def negative_rate(s, sf):
    return _r(agg.negative_rate(x.sentiment(s, sf)), "pct")


def _long_predictions(s, sf):
    return ev.scorer_long_form(x.predictions(s, sf), "y", x.SCORERS)


def _metrics(s, sf):
    return _r(ev.classification_metrics(_long_predictions(s, sf)), *ev.METRICS)


@query
def confusion_matrix(s, sf):
    return _r(ev.confusion_matrix(_long_predictions(s, sf)), "share")


@query
def classification_metrics(s, sf):
    return _metrics(s, sf)


@query
def lenient_binary_accuracy(s, sf):
    return _r(ev.lenient_binary_accuracy(_long_predictions(s, sf)), "accuracy")


@query
def vector_mean(s, sf):
    means = x.embeddings(s, sf).groupBy("label").agg(vec.vector_mean("embedding").alias("m"))
    return _long(means, ["label"], "m")


@query
def percentile_thresholds(s, sf):
    rows = x.table(s, sf, "lineitem")
    low, high = exact_percentiles(rows, "l_extendedprice", [0.3, 0.7])
    return rows.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.round(F.lit(low), DIGITS).alias("p30"), F.round(F.lit(high), DIGITS).alias("p70")
    )


# ------------------------------------------------------------ sorts and top-k


@query
def sort_desc(s, sf):
    totals = x.reviews(s, sf).groupBy("app").agg(F.sum(F.length("content")).alias("total"))
    return agg.sort_desc(totals, "total", "app")


@query
def top_k(s, sf):
    means = agg.group_mean_count(x.theme_and_toxicity(s, sf), "subtheme", "toxicity_score")
    return _r(agg.top_k(means, "mean", 10, "subtheme"), "mean")


@query
def top_terms_per_group(s, sf):
    return _r(reports.word_cloud_report(x.sentiment(s, sf), "sentiment_label"), "weight")


@query
def top_terms_per_theme(s, sf):
    return _r(reports.word_cloud_report(x.themed(s, sf), "theme", "theme"), "weight")


@query
def argmax_row(s, sf):
    return agg.argmax_row(_metrics(s, sf), "accuracy", "scorer")


@query
def sort_by_key(s, sf):
    return agg.sort_by_key(x.themed(s, sf).where("theme is not null").groupBy("theme").count(), "theme")


# ------------------------------------------------------------ set operations


@query
def union_all(s, sf):
    docs = x.table(s, sf, "documents").select("doc_id", "text", "lang")
    return jn.union_all([docs, x.table(s, sf, "conversations"), x.table(s, sf, "benchmark")])


@query
def distinct_rows(s, sf):
    return jn.distinct_rows(x.sentiment(s, sf), "cleaned_text", "sentiment_label")


@query
def set_union(s, sf):
    words = lambda name: x.table(s, sf, name).select(F.explode(tx.space_tokens("text")).alias("word"))
    return jn.set_union(words("benchmark"), words("conversations"))


# ------------------------------------------------------------ features


@query
def stratified_split(s, sf):
    return ft.stratified_split(x.marks(s, sf).select("id", "y"))


@query
def tfidf_vocabulary(s, sf):
    vocabulary = ft.tfidf_vocabulary(x.cleaned(s, sf))
    return _r(vocabulary, "idf")


@query
def tfidf_features(s, sf):
    train, test = reports.split_rows(x.labelled_reviews(s, sf).select("id", "y", "cleaned_text"))
    _, test = reports.tfidf_rows(train, test)
    return _long(test, ["id"], "features").where("value > 0")


def _split_vectors(s, sf):
    marked = ft.stratified_split(x.embeddings(s, sf), "label", "vec_id")
    return marked, marked.where("split = 'train'")


@query
def standard_scale(s, sf):
    rows, train = _split_vectors(s, sf)
    return _long(ft.standard_scaler(train, "embedding")(rows), ["vec_id"], "scaled")


@query
def minmax_scale(s, sf):
    rows, train = _split_vectors(s, sf)
    return _long(ft.minmax_scaler(train, "embedding")(rows), ["vec_id"], "scaled")


@query
def build_vocabulary(s, sf):
    return ft.build_vocabulary(x.cleaned(s, sf))


@query
def encode_sequences(s, sf):
    rows = x.cleaned(s, sf)
    encoded = ft.encode_sequences(rows, ft.build_vocabulary(rows))
    return encoded.select("id", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


@query
def stratified_sample(s, sf):
    rows = x.table(s, sf, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("y"))
    return ft.stratified_sample(rows)


@query
def single_class_guard(s, sf):
    return ev.single_class_guard(ft.stratified_split(x.marks(s, sf).select("id", "y")))


# ------------------------------------------------------------ training


def _learn(s, sf, learner: str, **settings) -> DataFrame:
    """Test rows of the labelled reviews with the learner's prediction."""
    rows = _quality_features(x.labelled_reviews(s, sf), "cleaned_text").select("id", "y", "features")
    train, test = reports.split_rows(rows)
    return ln.fit_and_predict(train, test, ln.LEARNERS[learner], **settings).select("id", "y", "yhat")


@query
def train_random_forest(s, sf):
    return _learn(s, sf, "Random Forest")


@query
def train_decision_tree(s, sf):
    return _learn(s, sf, "Decision Tree")


@query
def shallow_tree(s, sf):
    """A tree of two levels on three whole-number features, applied to the rows that it learned from."""
    docs = x.table(s, sf, "documents").select(F.col("doc_id").alias("id"), "lang", "n_chars")
    lang = F.array_position(F.lit(["de", "en", "es", "fr"]), F.col("lang"))
    size = F.floor(F.log2(F.col("n_chars") + 1))
    parts = [F.coalesce(c, F.lit(0)).cast("double") for c in (lang, size, F.col("id") % 7)]
    rows = docs.join(x.marks(s, sf), "id").select("id", "y", F.array(*parts).alias("features"))
    return ln.train_decision_tree(rows, depth=2).predict(rows).select("id", "y", "yhat")


@query
def train_logistic(s, sf):
    return _learn(s, sf, "Logistic Regression")


@query
def train_naive_bayes(s, sf):
    return _learn(s, sf, "Naive Bayes")


@query
def naive_bayes_letters(s, sf):
    """The same learner on counts of letters, which SQL can count as well."""
    rows = x.labelled_reviews(s, sf).select("id", "y", "cleaned_text")
    counts = F.array(*(F.length("cleaned_text") - F.length(F.replace("cleaned_text", F.lit(a), F.lit(""))) for a in "abcdefghijklmnop"))
    train, test = reports.split_rows(rows.select("id", "y", counts.cast("array<double>").alias("features")))
    return ln.train_naive_bayes(train).predict(test).select("id", "y", "yhat")


@query
def train_svm(s, sf):
    return _learn(s, sf, "SVM")


@query
def train_gradient_boosting(s, sf):
    return _learn(s, sf, "Gradient Boosting")


@query
def train_adaboost(s, sf):
    return _learn(s, sf, "AdaBoost")


@query
def kmeans_pseudo_labels(s, sf):
    rows = x.embeddings(s, sf)
    negative = ps.mean_vector(rows.where("label = 0"), "embedding")
    positive = ps.mean_vector(rows.where("label = 2"), "embedding")
    return ps.kmeans_pseudo_labels(rows, negative, positive).select("vec_id", "cluster", "pseudo_label")


@query
def kmeans_step(s, sf):
    """One step of k-means from the vectors of the ids 0, 1 and 2."""
    rows = x.embeddings(s, sf)
    start = [r["embedding"] for r in rows.where("vec_id < 3").orderBy("vec_id").collect()]
    vectors = rows.select(F.col("embedding").cast("array<double>").alias("x"))
    moved, n, _ = ps.kmeans_step(vectors, np.array([start], float))
    centres = [(i, int(n[0, i]), [float(v) for v in c]) for i, c in enumerate(moved[0])]
    return _long(s.createDataFrame(centres, "cluster INT, n BIGINT, centre ARRAY<DOUBLE>"), ["cluster", "n"], "centre")


@query
def cluster_label_rule(s, sf):
    rows = x.embeddings(s, sf)
    negative = ps.mean_vector(rows.where("label in (0, 1)"), "embedding")
    positive = ps.mean_vector(rows.where("label in (2, 3)"), "embedding")
    centres = rows.groupBy("label").agg(vec.vector_mean("embedding").alias("centroid"))
    named = ps.label_centroids(centres, negative, positive)
    return _r(named.select("label", "neg_sim", "pos_sim", "pseudo_label"), "neg_sim", "pos_sim")


@query
def similarity_pseudo_labels(s, sf):
    rows = x.embeddings(s, sf)
    centre = ps.mean_vector(rows.where("label = 2"), "embedding")
    labelled = ps.similarity_pseudo_labels(rows, centre)
    return _r(labelled.select("vec_id", "similarity", "pseudo_label"), "similarity")


@query
def train_sequence_classifier(s, sf):
    rows = lab.with_lexicon_sentiment(x.cleaned(s, sf), out="pseudo_label")
    return ln.train_sequence_classifier(rows).select("id", "pseudo_label", "ground_truth")


@query
def pseudo_label_flow(s, sf):
    return reports.pseudo_label_report(lab.with_lexicon_sentiment(x.cleaned(s, sf)))


@query
def train_on_tfidf(s, sf):
    rows = x.labelled_reviews(s, sf).select("id", "y", "cleaned_text")
    return _r(reports.train_on_tfidf(rows), *ev.METRICS)


@query
def model_grid(s, sf):
    train, test = reports.split_rows(x.labelled_reviews(s, sf).select("id", "y", "cleaned_text"))
    embedders = {
        "hashing": ln.hashing_embedder(64),
        "word vectors": ln.word2vec_embedder(train, "cleaned_text"),
    }
    return _r(ln.model_grid(train, test, embedders), *ev.METRICS)


@query
def scorer_comparison(s, sf):
    result = ev.scorer_comparison(x.predictions(s, sf), "y", x.SCORERS, lenient=["length"])
    return _r(result, *ev.METRICS)


@query
def leaderboard(s, sf):
    return ev.leaderboard(_metrics(s, sf), "scorer", 30.0)


@query
def metric_long_form(s, sf):
    return ev.metric_long_form(_metrics(s, sf), "scorer")


# ------------------------------------------------------------ streaming


@query
def incremental_scoring(s, sf):
    schema = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"
    stream = st.table_stream(s, f"{sf}/documents.parquet", schema)
    partitions = wanted_partitions(x.table(s, sf, "documents"))
    scored = st.incremental_scoring(stream, "text", partitions=partitions)
    return _r(
        scored.select(F.col("doc_id").alias("id"), "theme", "subtheme", "sentiment", "toxicity_score"),
        "toxicity_score",
    )
