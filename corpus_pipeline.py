"""A training-data pipeline over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``docs`` (whatever they are), so stages can be
written as Parquet between them. Rows with null texts count as empty texts;
empty tables pass through. ``run`` applies the stages on end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.bpe import bpe_encode
from weftline.llm.decontaminate import drop_contaminated
from weftline.llm.ordinal import fit_ordinal, grade_of, select_quality
from weftline.llm.parity import keep_one_of_each
from weftline.llm.secrets import redact_secrets
from weftline.llm.shared import materialize, small_batches, table
from weftline.llm.tokenizer_files import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose chance of the top grade is at least one half, by a model of all labelled grades."""
    labels = table(spark, sf_dir, "labels").select("doc_id", grade_of(F.col("quality"), F.col("toxic")).alias("grade"))
    return select_quality(docs, fit_ordinal(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near-duplicates the document of the least id."""
    small_batches(spark)
    return keep_one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents in which a benchmark item is found."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts; n_chars, where it is a column, follows the new text."""
    small_batches(spark)
    out = redact_secrets(docs)
    return out.withColumn("n_chars", F.length("text").cast(out.schema["n_chars"].dataType)) if "n_chars" in out.columns else out


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of each text that is left."""
    small_batches(spark)
    return bpe_encode(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("secrets", secrets), ("encode", encode)]

#: SQL can't express the model, the tokenizer and the lexer; ``test_pipeline_equals_brute_force`` compares each stage, on what the
#: one before kept, with a plain version: scores from the model's weights, all pairs, all windows, the library's tokens. The lexer's
#: own spans are tested on fixtures.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
