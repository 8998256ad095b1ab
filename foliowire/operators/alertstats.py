"""Alert list views, distributions, histograms and feedback statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliowire import domain
from foliowire.functions.scoring import safe_divide


def history_view(alerts: DataFrame) -> DataFrame:
    """The eight columns of the history table, numbers with two decimals, assets joined."""
    return alerts.select(
        F.col("news_title").alias("Titular"), F.col("event_type").alias("Evento"), F.col("direction").alias("Dirección"),
        F.col("severity_label").alias("Severidad"), F.format_string("%.2f", "severity").alias("Score"),
        F.format_string("%.2f", "confidence").alias("Confianza"), F.array_join("matched_assets", ", ").alias("Activos"),
        F.col("news_source").alias("Fuente"))


def alert_stats(alerts: DataFrame) -> DataFrame:
    """Count and mean severity and confidence; zeros for no alerts."""
    return alerts.agg(
        F.count(F.lit(1)).alias("total"), F.coalesce(F.avg("severity"), F.lit(0.0)).alias("avg_severity"),
        F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("avg_confidence"))


def feedback_stats(feedback: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Votes, useful and not useful ones, and the useful rate to 4 places."""
    grouped = feedback.groupBy(*by) if by else feedback.groupBy()
    counts = grouped.agg(F.count_if("useful").alias("useful"), F.count_if(~F.col("useful")).alias("not_useful"))
    total = F.col("useful") + F.col("not_useful")
    return counts.withColumn("total", total).withColumn("useful_rate", F.round(safe_divide(F.col("useful"), total), 4))


def distribution(alerts: DataFrame, column: str, domain_values: tuple[str, ...] | None = None) -> DataFrame:
    """Count and share per value; values outside a given domain are ignored."""
    rows = alerts.where(F.col(column).isin(*domain_values)) if domain_values else alerts
    counts = rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.select(column, "n", (F.col("n") / total).alias("share"))


def severity_histogram(alerts: DataFrame, bins: int = 20) -> DataFrame:
    """Counts in equal bins of 0-1, the last one closed, empty bins included."""
    index = F.least(F.floor(F.col("severity") * bins), F.lit(bins - 1)).cast("int")
    counts = alerts.groupBy(index.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    spine = alerts.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return spine.join(counts, "bin", "left").select(
        "bin", F.format_string("%.2f", F.col("bin") / bins).alias("range"), F.coalesce("n", F.lit(0)).cast("bigint").alias("count"))


def annotate_feedback(alerts: DataFrame, feedback: DataFrame) -> DataFrame:
    """Alerts with the latest vote on them, over all users."""
    latest = feedback.groupBy("alert_id").agg(F.max_by("useful", F.struct("updated_at", "user_id")).alias("feedback_useful"))
    return alerts.join(latest, "alert_id", "left")


def direction_points(alerts: DataFrame) -> DataFrame:
    """Severity and confidence of the alerts of each known direction."""
    return alerts.where(F.col("direction").isin(*domain.DIRECTIONS)).select("alert_id", "direction", "severity", "confidence")


def positive_weights(assets: DataFrame) -> DataFrame:
    return assets.where(F.col("weight") > 0)


def weight_by_sector(assets: DataFrame) -> DataFrame:
    known = assets.where(F.col("sector").isNotNull() & F.col("weight").isNotNull())
    return known.groupBy("sector").agg(F.sum("weight").alias("weight"))


def enrich_fundamentals(alerts: DataFrame, fundamentals: DataFrame) -> DataFrame:
    """One row per alert and affected asset with that asset's fundamentals; alerts without assets stay."""
    exploded = alerts.withColumn("ticker", F.explode_outer("matched_assets")).drop("matched_assets")
    rest = [c for c in fundamentals.columns if c != "ticker"]
    one_each = fundamentals.groupBy("ticker").agg(F.min(F.struct(*rest)).alias("least")).select("ticker", "least.*")  # of several rows the least
    return exploded.join(one_each, "ticker", "left")


def counters_by_interval(alerts: DataFrame, ts: str = "created_at", interval: str = "1 hour") -> DataFrame:
    """Alerts per type and tumbling interval; the same expression serves batch and stream."""
    return alerts.groupBy(F.window(ts, interval).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("interval_start"), "event_type", "n")


def usage_cost(calls: DataFrame, prompt_price: float, completion_price: float) -> DataFrame:
    """Calls, tokens and cost (price per 1000 tokens) per provider and model."""
    cost = F.col("prompt_tokens") / 1000 * prompt_price + F.col("completion_tokens") / 1000 * completion_price
    return calls.groupBy("provider", "model").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"), F.sum(cost).alias("cost"))
