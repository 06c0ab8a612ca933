"""Registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from evenstep.llm import quality_classifier, toxicity
from evenstep.llm.alignment import aligned
from evenstep.llm.byte_bpe import decode, digests, encode
from evenstep.llm.language_id import held_out_identification
from evenstep.llm.lexical import RANKED_SQL, search
from evenstep.llm.near_dedup import near_duplicates
from evenstep.llm.nearest import nearest
from evenstep.llm.packing import packed_documents
from evenstep.llm.quality_rules import judge, judged_sql
from evenstep.llm.substring_dedup import repeated_passages
from evenstep.llm.url_filters import JUDGED_PAGES_SQL, judged_pages
from evenstep.llm.warc import ARCHIVED_PAGES_SQL, archived_pages


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_documents(spark, sf_dir))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return digests(decode(encode(_documents(spark, sf_dir), path, public_tokenizers.PATTERN), path))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.held_out_scores(_documents(spark, sf_dir), _labels(spark, sf_dir))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(_documents(spark, sf_dir))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(_documents(spark, sf_dir)).drop("uid")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return held_out_identification(_documents(spark, sf_dir))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.held_out_scores(_documents(spark, sf_dir), _labels(spark, sf_dir))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return aligned(_documents(spark, sf_dir), *paths)


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": op1_near_dedup,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_toxicity": op3_toxicity,
    "op4_quality_rules": op4_quality_rules,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_language_id": op6_language_id,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_url_filters": op9_url_filters,
    "op10_nearest_neighbours": op10_nearest_neighbours,
    "op11_token_alignment": op11_token_alignment,
    "op12_warc": op12_warc,
    "op13_lexical_search": op13_lexical_search,
}

LLM_ORACLES: dict[str, str] = {
    "op4_quality_rules": judged_sql(),
    "op9_url_filters": JUDGED_PAGES_SQL,
    "op12_warc": ARCHIVED_PAGES_SQL,
    "op13_lexical_search": RANKED_SQL,
}
