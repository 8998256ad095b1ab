"""Integrity checks of a labelled corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def corpus_checks(corpus: DataFrame, portfolios: DataFrame) -> DataFrame:
    """(rule, value) rows: violations of label consistency and reference, and coverage counts."""
    known = portfolios.select("portfolio_id").distinct()
    counts = corpus.agg(
        F.count_if(~F.col("is_relevant") & (F.size("matched_assets") > 0)).alias("irrelevant_with_assets"),
        F.count_if(~F.col("is_relevant")).alias("negatives"),
        F.countDistinct("event_type").alias("event_types"))
    unknown = (
        corpus.groupBy("portfolio_id").agg(F.count(F.lit(1)).alias("n")).join(known, "portfolio_id", "left_anti")
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("unknown_portfolio")))
    wide = counts.unpivot([], ["irrelevant_with_assets", "negatives", "event_types"], "rule", "value")
    return wide.unionByName(unknown.unpivot([], ["unknown_portfolio"], "rule", "value"))
