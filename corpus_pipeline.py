"""From raw documents to shards: quality rules, near-duplicates, decontamination, mixing, sharding.

The near-duplicate stage keeps one document of each group by fingerprint and then, of those, one of
each group by five-word shingles with a similarity of 0.8 or more, which fingerprints hardly find.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and read again
as the documents of the next.  All but the last return the columns of documents.  An empty table of
documents passes through all stages; what nulls, empty and very long texts, repeated rows and
clashing columns mean is said by the operator of each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tesserspark.llm import decontamination, mixing, near_copies, quality, sharding, simhash
from tesserspark.llm.common import materialize, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.one_of_each(simhash.one_of_each(docs))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.sharded_documents(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("simhash near-duplicates", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing to target weights", mixing_stage),
    ("sharding", sharding_stage),
]

#: SQL has no XXH64 and no heap, so the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
