"""The corpus pipeline: quality classifier, near-duplicates, benchmark decontamination,
personal data, packing. Each stage reads the whole result of the one before."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacanta.llm import cotrain, decontaminate, pack, pii, simhash
from vacanta.llm.common import stored, table
from vacanta.llm.queries import pii_key, tokenizer


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go."""
    return cotrain.keep_good(docs, table(spark, sf_dir, "labels", ["doc_id", "quality"]))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays."""
    return simhash.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark", ["item_id", "text"]))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to surrogates; n_chars follows the text."""
    replaced = pii.pseudonymise(docs, pii_key(spark))
    n_chars = F.when(F.col(replaced.columns[-1]) > 0, F.length("text")).otherwise(F.col("n_chars"))
    return replaced.withColumn("n_chars", n_chars.cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: every piece with its ids and place."""
    return pack.pack(docs, tokenizer("byte_bpe_50k.json")).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("quality_classifier", quality),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("pii", personal_data),
    ("best_fit_packing", packing),
]

#: Training, hashing and tokenizing have no SQL form; tests/llm/test_pipeline.py checks the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
