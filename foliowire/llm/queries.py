"""The registered queries of the dealt operators, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliowire.llm import bagclassifier, capfilters, chat, minhash, mixing, oracles, packing, quality, recurrent, spelling, substrings, tokens, warc, whitening
from foliowire.llm.common import table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one made of control strings, formatted into windows and read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return chat.digests(chat.format_conversations(turns.unionByName(control)))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    return quality.verdicts(table(spark, sf_dir, "documents"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate component of every document."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links and the component of every vector."""
    return capfilters.linked_vectors(table(spark, sf_dir, "embeddings"))


def op5_token_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as packed id rows."""
    return tokens.pack_rows(table(spark, sf_dir, "documents"), TOKENIZER)


def op6_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes from every document."""
    return mixing.taken(table(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document."""
    docs = table(spark, sf_dir, "documents")
    return bagclassifier.scored(docs, bagclassifier.learned(docs, table(spark, sf_dir, "labels")))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of several lengths; a checksum instead of the ids of each piece."""
    pieces = packing.pack_tiers(table(spark, sf_dir, "documents"), TOKENIZER)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without recurring passages."""
    return substrings.removals(table(spark, sf_dir, "documents"))


def op10_recurrent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log-likelihood of every document."""
    return recurrent.scores(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent word with its more frequent form, one edit away."""
    return spelling.spelling_forms(table(spark, sf_dir, "documents"), modulus=199)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors on the leading components of their scatter."""
    return whitening.whitened(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").try_cast("long"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as web archives and read back."""
    return warc.page_records(spark, warc.archived(table(spark, sf_dir, "pages")))


QUERIES = {f.__name__: f for f in (
    op1_chat_formatting, op2_quality_rules, op3_minhash, op4_cap_filters, op5_token_rows, op6_mixing_sources, op7_quality_classifier, op8_packing,
    op9_substring_dedup, op10_recurrent_scores, op11_spelling_variants, op12_embedding_whitening, op13_warc)}
SQL = {
    "op1_chat_formatting": oracles.CHAT, "op2_quality_rules": oracles.QUALITY, "op3_minhash": oracles.NEAR_DUPLICATES,
    "op4_cap_filters": oracles.CAP_FILTERS, "op9_substring_dedup": oracles.SUBSTRINGS, "op11_spelling_variants": oracles.SPELLING,
    "op13_warc": oracles.WARC,
}
