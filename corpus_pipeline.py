"""A training corpus from raw documents: five stages, each on all that the one before kept.

Stages judge rows by what they hold (``row_key``), so null and repeated ids are judged row by row.

quality         documents that the quality classifier accepts
language        documents whose language is identified and not rejected
near_duplicates one row of each group of near duplicates (Jaccard similarity of 0.8 or more), that of the smallest id, and all others
decontaminate   documents that hold no benchmark item
encode          ids and digests of every document left
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodesieve.llm import bpe, contamination, langid, minhash, quality
from lodesieve.llm.queries import table, tokenizer
from lodesieve.llm.rows import row_key, without_rows
from lodesieve.sources.scratch import Scratch


def _kept(spark: SparkSession, docs: DataFrame, verdicts: DataFrame, label: str) -> DataFrame:
    """The documents less those whose key was rejected."""
    return without_rows(docs, Scratch(spark, label).save(verdicts.where(~F.col("accepted")).select("doc_id").distinct(), "rejected"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _kept(spark, docs, quality.judged(spark, docs, table(spark, sf_dir, "labels"), row_key(docs)), "quality-stage")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _kept(spark, docs, langid.identified(spark, docs.withColumn("doc_id", row_key(docs)), F.lit(True)), "language-stage")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one(spark, docs, percent=80, bands=34).select(docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return contamination.without_leaks(spark, docs, table(spark, sf_dir, "benchmark")).select(docs.columns)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encoded(docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontaminate", decontamination_stage),
    ("encode", encoding_stage),
]

#: SQL can express neither the models nor the encoder; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])
    return docs
