"""Agreement between models and per-model summaries over a long table of model outputs.

Rows: news_id, model, event_type, direction, severity, confidence, latency_s, error (null when fine).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliowire import domain


def model_pairs(outputs: DataFrame) -> DataFrame:
    """Pairs of different models that both answered the same news item.

    Outputs are one per (news, model), so an item yields at most the square of the model count.
    """
    answer = F.struct("event_type", "direction", "severity")  # of several answers the least counts
    fine = outputs.where(F.col("error").isNull()).groupBy("news_id", "model").agg(F.min(answer).alias("answer")).select("news_id", "model", "answer.*")
    a, b = (fine.select("news_id", *[F.col(c).alias(f"{c}_{s}") for c in ("model", "event_type", "direction", "severity")]) for s in ("a", "b"))
    return a.join(b, "news_id").where(F.col("model_a") < F.col("model_b"))


def model_agreement(outputs: DataFrame) -> DataFrame:
    """Per pair of models: common items, event and direction agreement, mean absolute severity difference."""
    def same(column):
        return F.round(F.avg((F.col(f"{column}_a") == F.col(f"{column}_b")).cast("double")), 3)

    return model_pairs(outputs).groupBy("model_a", "model_b").agg(
        F.count(F.lit(1)).alias("n"), same("event_type").alias("event_agreement"), same("direction").alias("direction_agreement"),
        F.round(F.avg(F.abs(F.col("severity_a") - F.col("severity_b"))), 4).alias("severity_mae"))


def model_summary(outputs: DataFrame) -> DataFrame:
    """Calls, errors, means over answered calls and the counts of each direction, per model."""
    ok = F.col("error").isNull()
    return outputs.groupBy("model").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~ok).alias("errors"),
        F.coalesce(F.avg(F.when(ok, F.col("severity"))), F.lit(0.0)).alias("avg_severity"),
        F.coalesce(F.avg(F.when(ok, F.col("confidence"))), F.lit(0.0)).alias("avg_confidence"),
        F.avg(F.when(ok, F.col("latency_s"))).alias("avg_latency"),
        *[F.count_if(ok & (F.col("direction") == d)).alias(d) for d in domain.DIRECTIONS])


def event_counts(outputs: DataFrame) -> DataFrame:
    return outputs.where(F.col("error").isNull()).groupBy("model", "event_type").agg(F.count(F.lit(1)).alias("n"))


def top_events(outputs: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` most frequent event types of each model, by name on equal counts."""
    order = W.partitionBy("model").orderBy(F.desc("n"), "event_type")
    return event_counts(outputs).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
