"""Relevance and severity gates, stage tags and funnel counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliowire import domain


def relevance_gate(score: Column, passing: float = domain.RELEVANCE_PASS, borderline: float = domain.RELEVANCE_BORDERLINE) -> Column:
    return F.when(score >= passing, "pass").when(score >= borderline, "borderline").otherwise("drop")


def rescue_borderline(scored: DataFrame, verdicts: DataFrame, keys: list[str], final: float = domain.RELEVANCE_BORDERLINE) -> DataFrame:
    """Borderline rows survive on a positive verdict, which may raise the score and add assets.

    ``scored`` has keys, relevance and matched_assets; ``verdicts`` has keys, is_relevant,
    relevance_score and affected_assets. ``final`` is the score required after rescue.
    """
    v = verdicts.select(*keys, F.col("is_relevant").alias("_ok"), F.col("relevance_score").alias("_score"),
                        F.col("affected_assets").alias("_assets"))
    gate = relevance_gate(F.col("relevance"))
    rescued = (gate == "borderline") & F.coalesce(F.col("_ok"), F.lit(False))
    extra = F.coalesce(F.col("_assets"), F.array().cast("array<string>"))
    out = scored.join(v, keys, "left").withColumn("rescued", rescued).where((gate == "pass") | rescued)
    raised = F.when(F.col("rescued"), F.greatest("relevance", F.coalesce("_score", F.lit(0.0)))).otherwise(F.col("relevance"))
    assets = F.when(F.col("rescued"), F.array_union("matched_assets", extra)).otherwise(F.col("matched_assets"))
    return out.withColumn("matched_assets", assets).withColumn("relevance", raised).drop("_ok", "_score", "_assets").where(
        F.col("relevance") >= final)


def severity_gates(df: DataFrame, estimated: str, final: str, minimum: float = domain.SEVERITY_MIN) -> DataFrame:
    """Keep rows whose estimate reaches half the minimum and whose merged severity reaches it."""
    return df.where((F.col(estimated) >= minimum * 0.5) & (F.col(final) >= minimum))


def discard_stage(failed: Column, gate: Column, verdict: Column, score: Column, full: Column,
                  passing: float = domain.RELEVANCE_PASS) -> Column:
    """Where a pair left the evaluation pipeline: error, relevance_llm, relevance, or null if it stayed.

    In the full variant a borderline pair needs a positive verdict; afterwards every score must pass.
    """
    asked = full & (gate == "borderline")
    return (
        F.when(failed, "error")
        .when(asked & ~F.coalesce(verdict, F.lit(False)), "relevance_llm")
        .when(score < passing, "relevance")
    )


def outcome_counts(df: DataFrame) -> DataFrame:
    """Processed, generated, duplicate and discarded rows of a batch (columns is_alert, is_duplicate)."""
    alert, dup = F.col("is_alert"), F.col("is_duplicate")
    return df.agg(
        F.count(F.lit(1)).alias("processed"), F.count_if(alert & ~dup).alias("alerts_generated"),
        F.count_if(alert & dup).alias("duplicates"), F.count_if(~alert).alias("discarded"))


def funnel(df: DataFrame, stages: dict[str, Column]) -> DataFrame:
    """Rows surviving each gate and all gates before it, in one pass."""
    alive, counts = F.lit(True), [F.count(F.lit(1)).alias("input")]
    for name, condition in stages.items():
        alive = alive & condition
        counts.append(F.count_if(alive).alias(name))
    return df.agg(*counts)
