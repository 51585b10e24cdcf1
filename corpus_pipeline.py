"""Corpus pipeline: language ID, near-duplicates, repeated passages, personal data, packing.

``run`` applies the stages to the ``documents`` table; each stage's result is written as Parquet in the shared
folder and reread as the next one's documents. What a stage stores besides is deleted when its result is written, and
that result when the next one's is; the last one's stays. All stages but the last return the columns of
``documents``; the last returns one row a piece of a document in a packed sequence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import langid, packing, pii, simhash, substring
from cohortlens.llm.encoder import vocabulary
from cohortlens.session import delete, new_path, run_folder


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars, where the table has it, follows the text."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter go, and those of which no language holds two fifths of the letters."""
    return langid.accept(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group stays, as one row; rows without a doc_id stay only
    where their whole group has none."""
    return simhash.keep_first(docs, shingle=4, max_bits=4)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows that start in an earlier document go; documents of which nothing is left go."""
    return _counted(substring.deduplicate(docs))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Emails, IP addresses, card and phone numbers are masked by their kind."""
    return _counted(pii.redact(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 tokens."""
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language),
    ("simhash_near_dedup", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("pii", personal_data),
    ("best_fit_packing", packed),
]

# SQL can express neither the learned language model nor the tokenizer; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        path = new_path(spark, name)
        with run_folder(spark):
            kept = stage(spark, docs, sf_dir)
            kept.write.option("compression", "zstd").parquet(path)
        docs = spark.read.schema(kept.schema).parquet(path)
        if before:
            delete(spark, before)
        before = path
    return docs
