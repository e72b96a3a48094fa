"""A corpus pipeline of five stages over ``documents``.

Each stage takes what its predecessor kept; all but the last return the columns of
``documents``. ``run`` writes every stage as Parquet in the shared folder and reads it
again as the next stage's input, so a lost executor costs one stage's tasks at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plait.llm import decontam, mixing, quality, sharding, similar
from plait.llm.common import materialise, read_table
from plait.shipping import ship


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and their group's thresholds accept."""
    return quality.quality_filter(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts whose five-word similarity is 0.8 or more."""
    return similar.keep_similar(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of any benchmark item: one leaked item is enough to go, if it is more than a few common words."""
    return decontam.clean(docs, read_table(spark, sf_dir, "benchmark"), min_items=1, evidence=True)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens meet the target weights."""
    return mixing.mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sample's documents with their size, digest, shard and slot."""
    return sharding.shard_report(docs).select("doc_id", F.col("size"), "text_crc32", "law", "shard", "slot", "home_shard")


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", near_dedup),
    ("decontamination", decontaminate),
    ("source mixing", mix_sources),
    ("sharding", shard),
]

#: Near duplicates need graph components over hashes that SQL lacks; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = materialise(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
