"""Predictions of the pipeline's four variants for labelled pairs of news and portfolio.

``rules`` judges relevance by rules alone, ``hybrid`` blends in embeddings, ``hybrid_nli`` adds event and impact, and ``full`` also
asks supplied verdicts on borderline pairs and folds in supplied analyses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliowire.functions.vectors import cosine
from foliowire.operators import gates, impact, matching
from foliowire.operators.relevance import blend
from foliowire.session import cut_lineage

VARIANTS = ("rules", "hybrid", "hybrid_nli", "full")  # fixed values
PAIR = ["news_id", "portfolio_id"]


def layer_scores(labelled: DataFrame, news: DataFrame, assets: DataFrame, vectors: DataFrame, asset_vectors: DataFrame) -> DataFrame:
    """Direct score, matched assets and semantic score of every labelled pair; only its own portfolio's assets are compared."""
    rules = matching.rule_relevance(news.select("news_id", "text"), news.select("news_id", "orgs"), assets)
    held = asset_vectors.select("portfolio_id", F.col("vector").alias("asset_vector"))
    close = labelled.select(*PAIR).join(vectors.select("news_id", "vector"), "news_id").join(held, "portfolio_id").groupBy(*PAIR).agg(
        F.greatest(F.max(cosine(F.col("vector"), F.col("asset_vector"))), F.lit(0.0)).alias("semantic_score"))
    return labelled.select(*PAIR).distinct().join(rules.select(*PAIR, "direct_score", "matched_assets"), PAIR, "left").join(close, PAIR, "left").select(
        *PAIR, F.coalesce("direct_score", F.lit(0.0)).alias("direct_score"), F.coalesce("semantic_score", F.lit(0.0)).alias("semantic_score"),
        F.coalesce("matched_assets", F.array().cast("array<string>")).alias("matched_assets"))


def variant_predictions(labelled: DataFrame, news: DataFrame, assets: DataFrame, vectors: DataFrame, asset_vectors: DataFrame,
                        sentiments: DataFrame, verdicts: DataFrame, analyses: DataFrame) -> DataFrame:
    """One row per labelled pair and variant: relevance, assets, and as far as the variant goes event, direction and severity.

    The tables are those of the alert pipeline. ``discarded_at`` tells where a pair left it.
    """
    news = news.join(labelled.select("news_id").distinct(), "news_id", "left_semi")  # texts without a labelled pair have no row
    layers = cut_lineage(layer_scores(labelled, news, assets, vectors, asset_vectors))  # read for the scores and for the labels
    full = F.col("variant") == "full"
    scored = layers.withColumn("variant", F.explode(F.array(*[F.lit(v) for v in VARIANTS]))).withColumn(
        "relevance", F.when(F.col("variant") == "rules", F.col("direct_score")).otherwise(blend(F.col("direct_score"), F.col("semantic_score"))))
    asked = verdicts.select(*PAIR, F.col("is_relevant").alias("_ok"), F.col("relevance_score").alias("_score"), F.col("affected_assets").alias("_assets"))
    judged = scored.join(asked, PAIR, "left").withColumn("_gate", gates.relevance_gate(F.col("relevance")))
    rescued = full & (F.col("_gate") == "borderline") & F.coalesce("_ok", F.lit(False))
    raised = judged.withColumn("_rescued", rescued).withColumn(
        "relevance", F.when(F.col("_rescued"), F.greatest("relevance", F.coalesce("_score", "relevance"))).otherwise(F.col("relevance"))).withColumn(
        "matched_assets", F.when(F.col("_rescued"), F.array_union("matched_assets", F.coalesce("_assets", F.array().cast("array<string>")))).otherwise(
            F.col("matched_assets"))).withColumn(
        "discarded_at", gates.discard_stage(F.lit(False), F.col("_gate"), F.col("_ok"), F.col("relevance"), full)).drop(
        "_ok", "_score", "_assets", "_gate", "_rescued")
    kept = F.col("discarded_at").isNull()
    events = impact.classify_by_keywords(news.select("news_id", "text"), "text").select("news_id", "event_type", "event_confidence")
    moods = sentiments.select("news_id", "sentiment", "sentiment_confidence")
    later = raised.where(kept & F.col("variant").isin("hybrid_nli", "full")).join(events, "news_id").join(moods, "news_id", "left").withColumn(
        "sentiment", F.coalesce("sentiment", F.lit("neutral"))).withColumn("sentiment_confidence", F.coalesce("sentiment_confidence", F.lit(0.5)))
    keys = [*PAIR, "variant"]
    refined = impact.merge_analyses(impact.estimate_impact(later), analyses.withColumn("variant", F.lit("full")), keys)
    named = analyses.select(*PAIR, F.lit("full").alias("variant"), F.col("event_type").alias("_event"))
    labels = refined.join(named, keys, "left").select(
        *keys, F.coalesce("_event", "event_type").alias("event_type"), "direction", "severity", "severity_label", "confidence")
    return raised.join(labels, keys, "left").select(
        *keys, kept.alias("is_relevant"), F.round("relevance", 4).alias("relevance_score"), "matched_assets", F.round("direct_score", 4).alias("direct_score"),
        F.round("semantic_score", 4).alias("semantic_score"), "event_type", "direction", "severity", "severity_label", "confidence", "discarded_at")
