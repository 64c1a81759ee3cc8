"""From documents to packed sequences: toxicity, near copies, benchmark leaks, secrets, packing.

Each stage reads what its predecessor kept, written as Parquet; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import decontaminate, near_copies, packing, secrets_scan, toxicity
from tallyloom.llm.common import cut, table
from tallyloom.llm.tokens import vocabulary

#: Near copies share five-word shingles: their sets' exact Jaccard similarity is so much or more.
SHINGLE_WORDS, SIMILARITY = 5, 0.8


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model finds toxic go."""
    rated = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return rated.where("predicted = 0").select(*docs.columns)


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near copies, found by SimHash anchors and min-hashes and confirmed by their shingles, the row of
    least doc_id stays."""
    return near_copies.survivors(docs, SHINGLE_WORDS, SIMILARITY)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item within its edit budget go."""
    found = cut(decontaminate.find(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct(), "leaks")
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; all documents stay."""
    return secrets_scan.redacted(docs, secrets_scan.dictionary(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequence and place."""
    return packing.pack(docs, vocabulary())


STAGES = [
    ("toxicity", toxicity_stage),
    ("simhash_near_dedup", near_copies_stage),
    ("benchmark_decontamination", benchmark_stage),
    ("secret_scans", secrets_stage),
    ("packing", packing_stage),
]

#: Trained models, fingerprints and tokenizers cannot be written in SQL: the stages are tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
