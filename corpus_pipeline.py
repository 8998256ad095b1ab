"""A training corpus from documents: rejects, near copies and repeated passages go, sources are mixed, the rest is packed.

Each stage reads what its predecessor wrote. All but the last return the columns of documents.

Defined results, stage by stage: documents with null or empty text have too few words and go with the rejects; null languages
and sources are groups of their own; a null doc_id is kept and linked with nothing; rows that repeat a doc_id stand or
fall together among near copies and are documents of their own everywhere else; texts of any length are used whole; whole numbers
stay exact beside nulls; other columns are returned as they are, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliowire.llm import minhash, mixing, packing, quality, substrings
from foliowire.llm.common import materialise
from foliowire.llm.queries import TOKENIZER


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies one document stays."""
    return minhash.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that recur among the documents are cut out of the texts."""
    return substrings.without_repeats(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated, shortened or left out until sources meet their target weights."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in sequences of several lengths."""
    return packing.pack_tiers(docs, TOKENIZER)


STAGES = [("quality rules", quality_rules), ("near duplicates", near_duplicates), ("repeated passages", repeated_passages),
          ("source mix", source_mix), ("packing", packed)]

#: SQL cannot express the later stages; they are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each over the written rows of the one before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, name.replace(" ", "-"))
    return docs
