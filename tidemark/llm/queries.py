"""The registered queries of this subpackage: one thin query per operator."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, chat_format, decontaminate, language, license_scan, minhash_join, quality, suffix_dedup, token_align, token_file, toxicity, treap_search, url_filter
from tidemark.llm.common import materialize, scratch, table

VOCABULARY = "word_bpe_49k.json"


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-files")
    token_file.write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path(VOCABULARY))
    return token_file.describe_token_files(spark, path)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), url_filter.rules_frame(spark))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_join.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), size=2)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge_quality(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return judged.drop("text", "lang")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score_documents(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.judge_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.remove_repeats(docs).drop("kept_text")


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    written = materialize(chat_format.format_conversations(turns.unionByName(chat_format.example(spark))), "chats")
    return chat_format.describe(written)


def op12_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_align.align_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_treap_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return treap_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_files": op1_token_files,
        "op2_url_filter": op2_url_filter,
        "op3_minhash": op3_minhash,
        "op4_license_scan": op4_license_scan,
        "op5_bpe": op5_bpe,
        "op6_quality": op6_quality,
        "op7_toxicity": op7_toxicity,
        "op8_decontaminate": op8_decontaminate,
        "op9_language": op9_language,
        "op10_suffix_dedup": op10_suffix_dedup,
        "op11_chat_format": op11_chat_format,
        "op12_token_align": op12_token_align,
        "op13_treap_search": op13_treap_search,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_url_filter": url_filter.ORACLE_SQL,
        "op3_minhash": minhash_join.ORACLE_SQL,
        "op4_license_scan": license_scan.ORACLE_SQL,
        "op8_decontaminate": decontaminate.ORACLE_SQL,
        "op10_suffix_dedup": suffix_dedup.ORACLE_SQL,
        "op11_chat_format": chat_format.ORACLE_SQL,
        "op13_treap_search": treap_search.ORACLE_SQL,
    }
