"""The registered queries of this subpackage; each takes (spark, folder of the tables)."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from evenkeel.llm import bpe, chosen_path, decontaminate, dialogue, html_blocks, lexicon, phrases, pii, quality, shard, suffix, token_files, warc
from evenkeel.llm.shared import table

RANKS, TOKENIZER = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json"


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(spark, sf_dir)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(table(spark, sf_dir, "documents"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_round_trip(spark, table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.near_duplicates(table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_documents(docs, public_tokenizers.path(RANKS))


def op8_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard.shard_documents(table(spark, sf_dir, "documents"))


def op9_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract_pages(table(spark, sf_dir, "pages"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of each language of all documents."""
    return phrases.top_phrases(table(spark, sf_dir, "documents"))


def op12_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents through a lexicon of their frequent words, and what they decode to."""
    return lexicon.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of all conversations, after the damage of the test."""
    return dialogue.repair_damaged(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_pii": op2_pii,
    "op3_token_files": op3_token_files,
    "op4_quality": op4_quality,
    "op5_decontaminate": op5_decontaminate,
    "op6_chosen_path": op6_chosen_path,
    "op7_bpe": op7_bpe,
    "op8_shard": op8_shard,
    "op9_suffix": op9_suffix,
    "op10_html": op10_html,
    "op11_phrases": op11_phrases,
    "op12_transducer": op12_transducer,
    "op13_repair": op13_repair,
}
SQL: dict[str, str] = {"op1_warc": warc.SQL, "op4_quality": quality.SQL}
