"""Corpus pipeline: stages of the training-data operators over ``documents``.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet
and read again as the next stage's ``docs``; all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.llm import bpe, line_dedup, mixing, near_dup, quality
from kestrel.llm.common import WORD, written
from kestrel.session import ship_package, table

#: Columns of documents, passed from stage to stage.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break no quality rule."""
    ship_package(spark)
    return quality.judge(docs).where("kept").select(*COLUMNS)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later repeated runs of lines; documents left without a word go."""
    ship_package(spark)
    cleaned = line_dedup.dedup_lines(docs).where((F.col("n_removed") == 0) | F.col("text").rlike(WORD))
    return cleaned.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long"))
                              .otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One text of each near-duplicate group (five-word shingles, 80 % in common)."""
    ship_package(spark)
    return near_dup.drop_near_texts(docs, percent=80).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated (0 to 2 times) so that sources meet their target words."""
    ship_package(spark)
    return mixing.mix_documents(docs).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests of ids and decoded text, and the ids of every document."""
    ship_package(spark)
    return bpe.round_trip_report(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True, limit=60_000)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup_stage), ("near_dedup", near_dedup),
          ("mix_sources", mix_sources), ("bpe_encode", encode)]

#: Near-duplicate components, the mix and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
