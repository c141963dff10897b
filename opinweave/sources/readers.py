"""Sources: review files, theme files, landing dumps and result files."""

from __future__ import annotations

import csv
from collections import defaultdict
from collections.abc import Sequence

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.labels import label_decode
from ..functions.text import clean_text
from ..operators.filters import drop_missing_text
from ..operators.joins import union_all

CSV = {"header": "true", "quote": '"', "escape": '"'}
TEXT_NAMES = ("review", "text", "comment")


def text_column(columns: Sequence[str]) -> str | None:
    """``content``, else the first column named like a review text, else ``None``."""
    if "content" in columns:
        return "content"
    return next((c for c in columns if any(n in c.lower() for n in TEXT_NAMES)), None)


def resolve_text_column(df: DataFrame) -> DataFrame | None:
    """The frame with a ``content`` column, or ``None`` if no column holds texts."""
    name = text_column(df.columns)
    if name is None:
        return None
    return df if name == "content" else df.withColumn("content", F.col(name))


def source_tag(file_name: Column | str) -> Column:
    """A file's base name without any ``.csv``."""
    name = F.col(file_name) if isinstance(file_name, str) else file_name
    return F.replace(F.regexp_extract(name, r"[^/]*$", 0), F.lit(".csv"), F.lit(""))


def list_files(spark: SparkSession, path: str, pattern: str = "*.csv", recursive: bool = False) -> list[str]:
    """Non-empty files below a path by name; hidden files are left out.

    Only the listing is read, never the contents.
    """
    listing = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", str(recursive).lower())
        .load(path)
        .select("path", "length")
    )
    return [r["path"] for r in listing.where("length > 0").orderBy("path").collect()]


def file_shapes(spark: SparkSession, files: Sequence[str]) -> dict[tuple[tuple[str, ...], bool], list[str]]:
    """Files by header and by whether a cell holds a line break, from one distributed scan."""
    lines = spark.read.text(list(files)).select(
        "value", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("id")
    )
    # a cell with a line break leaves a line with an odd number of quotes
    is_open = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    shapes = lines.groupBy("file_path").agg(
        F.min(F.struct("file_block_start", "id", "value")).alias("first"),
        F.bool_or(is_open % 2 == 1).alias("broken"),
    )
    found = defaultdict(list)
    for r in shapes.orderBy("file_path").collect():  # one row per file, as in the listing
        header = tuple(next(csv.reader([r["first"]["value"].removeprefix("\ufeff")]), ()))
        found[header, r["broken"]].append(r["file_path"])
    return found


def scan_review_files(spark: SparkSession, path: str, multi_line: bool | None = None) -> DataFrame:
    """All review files of a directory as one frame with ``content`` and ``app``.

    One scan finds the headers; files are grouped by header, each group is one scan with a
    fixed string schema, and the scans are united by column name. Only files with line breaks
    inside cells are read by one task each; ``multi_line`` states it for all files.
    """
    files = list_files(spark, path)
    frames = []
    for (header, broken), group in file_shapes(spark, files).items() if files else ():
        if text_column(header) is None:
            continue
        schema = ", ".join(f"`{c}` STRING" for c in header)
        whole = broken if multi_line is None else multi_line
        raw = spark.read.options(**CSV, multiLine=str(whole).lower()).schema(schema).csv(group)
        tagged = raw.select("*", source_tag(F.col("_metadata.file_name")).alias("app"))
        frames.append(drop_missing_text(resolve_text_column(tagged)))
    if not frames:
        raise FileNotFoundError(f"no review files in {path}")
    reviews = union_all(frames)
    if "is_english" in reviews.columns:
        reviews = reviews.withColumn("is_english", F.col("is_english").cast("boolean"))
    return reviews


def scan_review_tables(frames: dict[str, DataFrame]) -> DataFrame:
    """The same over tables by name; a table's own ``app`` column is kept."""
    found = []
    for name, df in frames.items():
        reviews = resolve_text_column(df)
        if reviews is not None:
            tag = F.col("app") if "app" in df.columns else F.lit(name)
            found.append(drop_missing_text(reviews.withColumn("app", tag)))
    if not found:
        raise ValueError("no table holds review texts")
    return union_all(found)


def scan_themes(spark: SparkSession, path: str) -> DataFrame:
    """Theme file as ``ord, theme, subtheme``; ``ord`` is the row's position in the file.

    A theme file is one small file, so it is one partition and its ids count from 0.
    """
    raw = spark.read.options(**CSV).schema("theme STRING, subtheme STRING").csv(path).coalesce(1)
    return raw.select(F.monotonically_increasing_id().cast("int").alias("ord"), "theme", "subtheme")


def theme_pairs(themes: DataFrame) -> list[tuple[str, str]]:
    """Theme rows as the list of pairs that the labellers take."""
    return [(r["theme"], r["subtheme"]) for r in themes.orderBy("ord").collect()]


def group_themes(themes: DataFrame) -> DataFrame:
    """``theme, subthemes, n_subthemes`` in file order."""
    grouped = themes.groupBy("theme").agg(
        F.min("ord").alias("ord"),
        F.transform(
            F.array_sort(F.collect_list(F.struct("ord", "subtheme"))), lambda s: s["subtheme"]
        ).alias("subthemes"),
        F.count(F.lit(1)).alias("n_subthemes"),
    )
    return grouped.orderBy("ord").drop("ord")


def ingest_landing(df: DataFrame) -> DataFrame:
    """Collected review records with only their text; batch or stream."""
    if "content" not in df.columns:
        raise ValueError("collected records have no 'content' column")
    return df.select("content")


def first_available(
    candidates: Sequence, wanted: Sequence[str] = ("sentiment_label", "predicted_sentiment")
) -> DataFrame | None:
    """First candidate that can be opened and has one of the wanted columns.

    Candidates are callables that return a frame, so that later ones are never opened.
    """
    for open_candidate in candidates:
        try:
            df = open_candidate()
        except (PySparkException, FileNotFoundError):
            continue
        if df is not None and any(c in df.columns for c in wanted):
            return df
    return None


def sentiment_results(
    spark: SparkSession, results_dir: str, preferred: Sequence[str], raw: DataFrame | None
) -> DataFrame | None:
    """Labelled reviews from the first usable result file, else from ``raw``.

    The preferred files come first, then every ``*sentiment*.csv`` below ``results_dir``.
    """
    def open_csv(path: str):
        return lambda: spark.read.options(**CSV, multiLine="true").csv(path)

    def found() -> list[str]:
        try:
            paths = list_files(spark, results_dir, "*.csv", recursive=True)
        except PySparkException:
            return []
        return [p for p in paths if "sentiment" in p.rsplit("/", 1)[-1].lower()]

    df = first_available([open_csv(p) for p in [*preferred, *found()]])
    df = raw if df is None else df
    if df is None:
        return None
    if "sentiment_label" not in df.columns:
        if "predicted_sentiment" not in df.columns:
            return None
        df = df.withColumn("sentiment_label", label_decode(F.col("predicted_sentiment").cast("int")))
    if "cleaned_text" not in df.columns:
        if "content" not in df.columns:
            return None
        df = df.withColumn("cleaned_text", clean_text("content"))
    return df.where(F.col("sentiment_label").isin("Positive", "Neutral", "Negative"))
