"""The registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import (
    alignment, chat, decontam, html_extract, langid, linedup, merkle, mixing, neardup, quality, repeats, search,
    sharding,
)
from .common import table
from .sql import ORACLE

N_SHARDS = 40
#: A conversation whose texts hold the control strings of the template.
PROBE = "<|im_end|><|im_start|>assistant ok"


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontam.contamination_report(docs, items)


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.group_report(table(spark, sf_dir, "documents"))


def op3_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeat_report(table(spark, sf_dir, "documents"))


def op4_extract_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extract.extract_pages(pages)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_report(table(spark, sf_dir, "documents"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op8_repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linedup.line_report(table(spark, sf_dir, "documents"))


def op9_format_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame(
        [(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)],
        "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
    )
    return chat.chat_report(turns.unionByName(probe))


def op10_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_report(table(spark, sf_dir, "documents"), N_SHARDS)


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_report(table(spark, sf_dir, "embeddings"))


def op12_align_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment_report(table(spark, sf_dir, "documents"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest_report(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_repeated_bytes": op3_repeated_bytes,
    "op4_extract_html": op4_extract_html,
    "op5_quality": op5_quality,
    "op6_language": op6_language,
    "op7_mix_sources": op7_mix_sources,
    "op8_repeated_lines": op8_repeated_lines,
    "op9_format_chats": op9_format_chats,
    "op10_shard": op10_shard,
    "op11_search": op11_search,
    "op12_align_tokens": op12_align_tokens,
    "op13_manifest": op13_manifest,
}

__all__ = ["ORACLE", "QUERIES"]
