"""From raw documents to shards of a training mix, in five stages.

Each stage takes what its predecessor kept, as written to and read back from
Parquet. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from boughs.llm import decontam, minhash, mixing, quality_model, sharding
from boughs.llm.common import Stash

SHARDS = 16


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the byte-level network, trained on labelled ones among them, takes for bad."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~quality_model.held_out())
    scored = quality_model.score(docs, quality_model.fit(docs, labels))
    return scored.where("predicted = 1").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group at similarity 0.8 of five-word shingles."""
    return minhash.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut benchmark passages out; drop documents that are mostly such."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that each source's words come to its target."""
    return mixing.mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Give each row its shard and its slot there."""
    return sharding.shard_rows(docs, (1.0,) * SHARDS)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mix_sources", mix_sources),
    ("shard", shard),
]

#: The classifier's verdicts can't be expressed in SQL; tests/llm/test_pipeline.py has a brute-force version of each stage and of run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stash, before = Stash(spark, "pipeline"), []
    for name, stage in STAGES[:-1]:
        docs = stash.keep(stage(spark, docs, sf_dir), name)
        stash.drop(*before)
        before = [name]
    return STAGES[-1][1](spark, docs, sf_dir)
