"""From raw documents to packed sequences: quality, lines, SimHash near copies, personal data, packing.

Each stage takes what the one before kept and is written and read again.
``run`` applies all of them to the documents table. There is no SQL for the
whole: fingerprints and boosted trees can't be written in it; the stages are
tested against brute force.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import line_dedup, packing, pii, quality, simhash
from shelfmark.llm.common import bounded_batches
from shelfmark.session import scratch_path

ORACLE_SQL = None


def _recounted(docs: DataFrame) -> DataFrame:
    """``n_chars`` after a change of texts."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the adaptive quality rules keep."""
    bounded_batches(spark)
    return quality.filter_documents(docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that an earlier line equals or nearly equals."""
    bounded_batches(spark)
    return _recounted(line_dedup.dedup_lines(docs))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose fingerprints link: four-word shingles, 4 bits at most."""
    bounded_batches(spark)
    return simhash.near_dedup(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    return _recounted(pii.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    import public_tokenizers

    bounded_batches(spark)
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", keep_good),
    ("line dedup", drop_lines),
    ("SimHash near-dedup", drop_copies),
    ("personal data", redact),
    ("best-fit packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    for name, stage in STAGES:
        path = scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
