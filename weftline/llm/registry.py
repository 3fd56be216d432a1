"""Queries of the corpus operators, one opN_<name> each, over their whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from .align import align_tokens
from .bpe import bpe_digests
from .chat import chat_digests, format_turns
from .decontaminate import find_benchmark
from .hmm import score_lm
from .oracle import SQL
from .ordinal import fit_ordinal, grade_of, score_quality
from .parity import near_duplicates
from .rules import judge
from .secrets import secret_digests
from .shared import at_exit, shared_dir, table
from .spelling import group_spellings
from .sstable import read_shards, write_shards
from .tokenizer_files import tokenizer_path
from .vectors import near_vectors
from .warc import read_warc, write_warc

Query = Callable[[SparkSession, str], DataFrame]


def op1_warc_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), folder)
    at_exit(spark, folder)
    return read_warc(spark, folder).drop("payload", "url")


def op2_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op3_chat_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat_digests(format_turns(table(spark, sf_dir, "conversations").select(*more.columns).unionByName(more)))


def op4_simhash_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 0).alias("poor"))
    out = judge(table(spark, sf_dir, "documents"), labels)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_lm(table(spark, sf_dir, "documents"))


def op8_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", grade_of(F.col("quality"), F.col("toxic")).alias("grade"))
    return score_quality(docs, fit_ordinal(docs, labels)).withColumn("kept", F.col("tail_probability") >= 0.5)


def op9_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "shards")
    write_shards(table(spark, sf_dir, "documents"), folder, tokenizer_path("word_bpe_49k.json"), end_id=2)
    at_exit(spark, folder)
    return read_shards(spark, folder)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digests(table(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op12_pca_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_spellings(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {"pipeline": corpus_pipeline.run} | {f.__name__: f for f in (op1_warc_shards, op2_bpe_trie, op3_chat_parts, op4_simhash_windows, op5_parity_join, op6_decision_list, op7_hidden_markov, op8_ordinal_quality, op9_token_shards, op10_secret_scan, op11_token_alignment, op12_pca_tiles, op13_spelling_variants)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
