"""The corpus pipeline: language identification, near-duplicates, decontamination, mixing and sharding of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from framelake.llm import langid_crf, mixing, shards, simhash, winnowing
from framelake.llm.shared import settled


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or without evidence of a learned language, go."""
    return langid_crf.identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash group stays, the smallest by id."""
    return simhash.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    return winnowing.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out until the sources have their target weights."""
    return mixing.mixed(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row gets its virtual slot and shard, with the map's version."""
    return shards.sharded(docs)


STAGES = [("language", languages), ("near duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing_sources), ("sharding", sharding)]

#: SQL can express neither the language model nor XXH64; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = settled(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
