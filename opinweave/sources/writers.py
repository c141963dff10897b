"""Sinks. Output is partitioned by ``app``; large apps are split over several files."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.aggregates import negative_rate
from ..operators.filters import filter_label

EMOTION_COLUMNS = ["app", "content", "cleaned_text", "emotion", "emotion_confidence"]
THEME_EMOTION_COLUMNS = [*EMOTION_COLUMNS, "theme", "subtheme"]
DERIVED = ["cleaned_text", "sentiment", "sentiment_label"]


def write_table(
    df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", by: str | None = None
) -> None:
    """Write a frame, one folder per value of ``by`` if given.

    The rebalance hint lets adaptive execution split a large value over several tasks and
    put small ones together, so neither a hot app nor many tiny files arise.
    """
    if by is not None:
        df = df.hint("rebalance", F.col(by))
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.options(header="true", quote='"', escape='"')
    if by is not None:
        writer = writer.partitionBy(by)
    writer.save(path)


def result_columns(df: DataFrame, columns: Sequence[str] = tuple(EMOTION_COLUMNS)) -> DataFrame:
    return df.select(*columns)


def write_results(df: DataFrame, path: str, columns: Sequence[str] = tuple(EMOTION_COLUMNS), fmt: str = "csv") -> None:
    write_table(result_columns(df, columns), path, fmt)


def negative_reviews(df: DataFrame, code: str = "sentiment") -> DataFrame:
    """Negative reviews without the columns that labelling added."""
    return filter_label(df, code, 0).drop(*DERIVED)


def write_negative_by_app(df: DataFrame, path: str, fmt: str = "csv") -> DataFrame:
    """Write the negative reviews per app; returns ``negative, total, pct``."""
    write_table(negative_reviews(df), path, fmt, by="app")
    return negative_rate(df)


def write_filtered(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Write the rows marked as English, per app."""
    write_table(df.where(F.col("is_english")), path, fmt, by="app")


def write_utf8_sig(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV files that begin with a byte-order mark and a header, as spreadsheets want them.

    Spark's text sink writes and commits the files; a task only puts the mark and the header before
    its first row. NULL is an empty cell, an empty text a quoted one; quotes are doubled. An empty
    frame gives a file with the header.
    """
    options = {"quote": '"', "escape": '"', "emptyValue": '""', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    said = io.StringIO()
    csv.writer(said, lineterminator="").writerow(df.columns)
    header = "\ufeff" + said.getvalue()

    def headed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([header], pa.string())], ["value"])
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string())], ["value"])

    lines = df.select(F.to_csv(F.struct(*(F.col(f"`{c}`") for c in df.columns)), options).alias("value"))
    if lines.isEmpty():
        lines = df.sparkSession.createDataFrame([(header,)], "value STRING").coalesce(1)
    else:
        lines = lines.mapInArrow(headed, "value STRING")
    lines.write.mode(mode).option("encoding", "UTF-8").text(path)
