"""The thin queries of the operators, ``opN_<name>``, and their DuckDB twins.

Each query applies its operator to the whole of its table and keeps the contract's
columns; operators return more (texts, places, spans) where they have it.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prospecta.llm import bpe, codes, decontaminate, licenses, lm, mixing, near, neighbours, quality, repeats, tokens, toxicity, trie
from prospecta.llm.common import table

VOCABULARY, RANKS, WORD_VOCABULARY = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "word_bpe_49k.json"


def op1_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.report(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("places")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.report(table(spark, sf_dir, "embeddings"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie(table(spark, sf_dir, "conversations"))


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_VOCABULARY))
    return encoded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_scores": op1_lm_scores,
    "op2_toxicity": op2_toxicity,
    "op3_mixing": op3_mixing,
    "op4_repeats": op4_repeats,
    "op5_decontamination": op5_decontamination,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_license_scan": op7_license_scan,
    "op8_quality": op8_quality,
    "op9_token_counts": op9_token_counts,
    "op10_nearest_neighbours": op10_nearest_neighbours,
    "op11_vector_codes": op11_vector_codes,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_bpe": op13_bpe,
}

ORACLE_SQL: dict[str, str] = {
    "op5_decontamination": decontaminate.oracle_sql(),
    "op6_near_duplicates": near.ORACLE,
    "op7_license_scan": licenses.oracle_sql(),
    "op10_nearest_neighbours": neighbours.ORACLE,
    "op11_vector_codes": codes.oracle_sql(),
    "op12_conversation_trie": trie.ORACLE,
}
