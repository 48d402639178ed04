"""The corpus pipeline: quality, near duplicates, decontamination, personal data, packing.

Each stage takes what its predecessor kept, written as Parquet and read again,
so a lost executor costs no more than a part of one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import near_copies, op3_decontaminate, op4_packing, op5_pii, op10_quality, stage
from lectern.llm.tokens import default_tokenizer


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal quality model selects.

    Null and empty texts are graded like others, null ids and repeated rows by
    their own text; without ratings of two grades everything stays.
    """
    return op10_quality.drop_bad(docs, stage.table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies (five words, similarity 0.8): the one with the least id.

    Null, empty and blank texts are one class; a row without an id stays only
    if no other of its class has one; of equal rows one stays.
    """
    return near_copies.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that align with no benchmark item; null and empty texts stay, each row is judged by its own text."""
    return op3_decontaminate.drop_contaminated(docs, stage.table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; null and empty texts stay as they are."""
    return op5_pii.redacted(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of tokens; null and empty texts hold the end id alone."""
    return op4_packing.pack(docs, default_tokenizer())


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: No stage's rows can be had from SQL; tests hold them to plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Columns beside those of ``documents`` pass through to the last stage; empty tables give none.

    A stage's table is deleted once the next one is written.
    """
    docs = stage.table(spark, sf_dir, "documents")
    for name, apply in STAGES:
        before, docs = docs, stage.written(apply(spark, docs, sf_dir), f"pipeline-{name}")
        stage.drop_table(spark, before)
    return docs
