"""A training corpus from documents: toxic rows go, one row of each near-duplicate class stays, secrets are redacted, sources are mixed to target weights, and what is left is encoded.

run(spark, sf_dir) applies the stages one after another, each on all rows that the one before it kept, written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.llm.bpe import encode_documents, public_vocabulary, shared_chunks
from lectern.llm.dartminhash import drop_near_duplicates
from lectern.llm.mixing import sample_documents
from lectern.llm.secrets import redact_documents
from lectern.llm._shared import materialize
from lectern.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact_documents(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sample_documents(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = public_vocabulary()
    return encode_documents(docs, path, keep=("doc_id", "lang", "source", "n_chars"), shared=shared_chunks(docs, path))


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("mixing", mixing), ("bpe", bpe)]

#: The toxicity model, near-duplicate classes and BPE have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
