"""The corpus pipeline: quality rules, near-duplicate removal, secret redaction, mixing, packing.

Each stage is (name, function of (spark, docs, sf_dir)) and works on all that the stage before kept. A stage's result is
written as Parquet in the shared checkpoint folder and read again for the next one, so that a lost executor costs a stage
at most.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lodeweave.llm import mixing, packing, quality_rules, secrets, simhash
from lodeweave.llm.common import checkpoint_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_rules.quality_filter(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group linked by SimHash fingerprints (as op9_simhash) or by similarity
    (five words, 0.8)."""
    return simhash.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced."""
    return secrets.redact(docs, secrets.train())


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many tokens as there are, by the target weights of domains, languages and sources, in two epochs at most."""
    return mixing.mix_documents(docs, (1, 1))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their ids and places in sequences of at most 2048 tokens."""
    packed = packing.pack_documents(docs, packing.fast_vocabulary(), with_ids=True)
    return packed.withColumnRenamed("rid", "doc_id")


STAGES = [("quality_rules", quality), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("mixing", mix), ("packing", pack)]

#: Near-duplicate groups and byte-pair tokens are beyond SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
