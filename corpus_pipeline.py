"""A training-data pipeline over ``documents``: each stage works on what the one before kept.

1. quality: documents that the quality classifier rejects go.
2. near_duplicates: of each component of the n-gram Jaccard join the smallest doc_id stays.
3. substring_dedup: repeated passages of 35 words or more are cut out of the texts; a document of which
   nothing is left goes.
4. decontamination: documents that contain a benchmark item go.
5. packing: what is left is cut into token pieces and packed into sequences of at most 2048 tokens.

Stages 1 to 4 return the columns of their input; ids of ``documents`` are distinct.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import contamination, ngram_join, packing, quality, substring_dedup
from plumbline.llm.ship import ship
from plumbline.llm.store import stored
from plumbline.llm.tables import table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring_dedup.without_repeats(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return contamination.without_items(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs)


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", keep_one_of_each),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

# Tokenisation and the classifier are beyond SQL; tests hold the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents`` after all stages; each stage's result is stored and read again."""
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
