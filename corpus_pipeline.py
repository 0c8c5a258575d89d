"""A corpus pipeline of five operators: language, near duplicates, benchmark passages, personal data, encoding.

Every stage works on all that its predecessor kept, and its decisions take effect: texts in no learned language go,
one document of each group of near duplicates stays (the one of smallest id), documents with a benchmark window
go, personal data are masked in the text, and what is left is encoded (and decoded, as a proof) with byte-level
BPE. All stages but the last return the columns of ``documents``; the last one returns doc_id, n_tokens, ids, ids_sha256
and decoded_sha256.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import bpe, decontaminate, langid, neardup, pii
from corvane.llm.common import held_out, stored


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what language identification rejects; the models learn from this stage's own labelled rows."""
    return langid.keep_identified(docs, langid.fit(docs.where(~held_out("doc_id", 4, 2))))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_representatives(docs).select(docs.columns)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks spans in the text; n_chars follows the text."""
    masked = pii.redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else masked


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True, block_bytes=3 << 20)
    return found.select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("benchmark", drop_benchmark_passages),
    ("personal_data", mask_personal_data),
    ("encoding", encode),
]

#: Character models can't be expressed in SQL; tests/llm/test_pipeline.py holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written as Parquet and read by the next one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
