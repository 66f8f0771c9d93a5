"""The queries of the training-data operators, one for each, and their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import fingerprint, fixity, langid, line_dedup, packing, pieces, quality, simhash, token_counts, toxicity

#: Where the vocabulary files of public tokenizers are.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def vocabulary(name: str) -> str:
    return os.path.join(TOKENIZERS, name)


def op1_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return fixity.audit(fixity.replica(pages), fixity.damaged(pages))


def op2_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op3_site_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(read(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op4_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited(read(spark, sf_dir, "documents"))


def op5_token_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"))


def op6_bin_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op7_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(read(spark, sf_dir, "documents"))


def op8_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept".split()
    return quality.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).select(columns)


def op9_trie_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(read(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op10_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.scores(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_merkle_fixity": op1_merkle_fixity,
        "op2_simhash_golay": op2_simhash_golay,
        "op3_site_spread": op3_site_spread,
        "op4_bottom_k": op4_bottom_k,
        "op5_token_histogram": op5_token_histogram,
        "op6_bin_slack_packing": op6_bin_slack_packing,
        "op7_language_spans": op7_language_spans,
        "op8_decision_list": op8_decision_list,
        "op9_trie_pieces": op9_trie_pieces,
        "op10_weak_supervision": op10_weak_supervision,
    }


#: Operators that SQL can express over whole tables.
ORACLE: dict[str, str] = {"op1_merkle_fixity": fixity.SQL, "op3_site_spread": line_dedup.SQL}
