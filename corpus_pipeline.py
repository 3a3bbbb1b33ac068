"""A training corpus from ``documents``: five stages, each written as Parquet and read by the next.

1. language: documents whose language the network cannot tell (no letter, or a low probability) go;
2. near_dedup: of every group of documents whose SimHash fingerprints (three-word shingles) are linked
   by at most 2 differing bits, the document with the smallest id stays;
3. decontaminate: documents that hold a passage of ``benchmark`` go;
4. mix: every document is repeated as often as the mix of sources takes it;
5. shard: documents are put into 24 shards of near equal bytes.

Every stage takes all that the one before kept. All but the last return the columns of their input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillgauge.llm import decontaminate, langid, mixing, sharding, simhash
from quillgauge.session import stored


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_known(docs, langid.fit(docs.filter(~langid.held_out())))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard(docs)


STAGES = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminated),
    ("mix", mix),
    ("shard", shard),
]

# A network and packing by search have no SQL; tests compare the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
