"""The corpus pipeline: documents through five stages, each written and read again.

Toxic documents go; of near duplicates one stays; documents that hold benchmark
passages go; secrets are masked; what is left is encoded and decoded. Every
stage works on all that its predecessor kept, and each but the last returns the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from warden.llm import decontaminate, ngram_join, secret_scan, toxicity
from warden.llm.common import delete, scratch, stored, table
from warden.llm.queries import bpe_digests


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar, fitted on labelled ones of ``docs``, scores below its threshold."""
    return toxicity.reject(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the least id) of each component of the n-gram Jaccard join."""
    return ngram_join.one_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked and n_chars as it is then."""
    kind = docs.schema["n_chars"].dataType
    return secret_scan.redact(docs).withColumn("n_chars", F.length("text").cast(kind))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Numbers of tokens, and digests of ids and decoded texts."""
    return bpe_digests(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_join", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("secret_scan", mask_secrets),
    ("bpe", encode),
]
#: SQL cannot express the learned stages; the tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what a stage stored for itself, and its input, go when its output is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch(spark) as keep:
            out = keep(stored(stage(spark, docs, sf_dir), name))
        if hasattr(docs, "stored_at"):
            delete(spark, docs.stored_at)
        docs = out
    return docs
