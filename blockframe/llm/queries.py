"""Registered queries of the corpus operators and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from blockframe.llm import byte_bpe, decontaminate, fingerprints, hmm, lexical, packing, pii, quality, sharding, simhash, spelling, substring, url_filters
from blockframe.llm.common import table

#: The tokenizer file; a package that every machine has.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: Ranks of a vocabulary for many languages.
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), shards=8)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge_urls(table(spark, sf_dir, "pages"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.benchmark_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score_documents(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), TOKENIZER)


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))


def op10_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_and_decode(table(spark, sf_dir, "documents"), RANKS)


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_quality": op2_quality,
    "op3_pii": op3_pii,
    "op4_url_filters": op4_url_filters,
    "op5_decontamination": op5_decontamination,
    "op6_hmm": op6_hmm,
    "op7_simhash": op7_simhash,
    "op8_packing": op8_packing,
    "op9_fingerprints": op9_fingerprints,
    "op10_substring": op10_substring,
    "op11_spelling": op11_spelling,
    "op12_lexical": op12_lexical,
    "op13_byte_bpe": op13_byte_bpe,
}
ORACLES = {"op4_url_filters": url_filters.JUDGE_SQL, "op11_spelling": spelling.VARIANTS_SQL, "op12_lexical": lexical.RANK_SQL}
