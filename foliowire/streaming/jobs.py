"""Streaming jobs: continuous ingest, continuous alerting, live counters.

Each takes a streaming DataFrame and a folder for output and checkpoints and returns the started query.
The trigger decides the cadence: ``availableNow`` for scheduled runs, a processing-time interval otherwise.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from foliowire import domain
from foliowire.functions import text
from foliowire.operators import gates, impact, limiter, matching, relevance, similarity, storage
from foliowire.session import cut_lineage
from foliowire.sources import feeds
from foliowire.streaming.daystore import DayStore

LATENESS = "2 days"
PAIR = ["news_id", "portfolio_id"]


def append_to(stream: DataFrame, path: str, mode: str = "append", every: str | None = None) -> StreamingQuery:
    """Write a stream to parquet with its checkpoint beside it."""
    writer = stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", f"{path}/_stream").option("path", f"{path}/rows")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def with_closing(stream: DataFrame, path: str) -> DataFrame:
    """The stream and the rows of a closing folder; see ``close``."""
    spark = stream.sparkSession
    spark.createDataFrame([], stream.schema).write.mode("append").parquet(path)
    return stream.unionByName(spark.readStream.schema(stream.schema).parquet(path))


def close(spark: SparkSession, path: str, schema, time_col: str) -> None:
    """End a stream in event time: one row without a key, later than all others, lets the watermark pass everything.

    Run the query once more from its checkpoint afterwards; what still waited is settled then.
    """
    values = [F.lit("2200-01-01 00:00:00").cast(f.dataType) if f.name == time_col else F.lit(None).cast(f.dataType) for f in schema.fields]
    spark.range(1).select(*[v.alias(f.name) for v, f in zip(values, schema.fields)]).write.mode("append").parquet(path)


def ingest(news: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """News without repeated urls; a url is remembered for as long as late rows may arrive."""
    timed = news.withColumn("published_at", F.col("published_at").cast("timestamp"))
    return timed.withWatermark("published_at", lateness).dropDuplicatesWithinWatermark(["url"])


def _days(lateness: str) -> float:
    """An interval such as '2 days' in days."""
    return pd.Timedelta(lateness) / pd.Timedelta(days=1)


def ingest_batch(path: str, lateness: str = LATENESS) -> Callable[[DataFrame, int], None]:
    """Micro-batch function for continuous ingest that loses nothing, safe to repeat.

    The first row of every url not stored yet goes to ``rows``. Rows more than ``lateness`` behind the newest stored one can
    no longer be compared with everything and go to the side table ``late`` instead. Only stored folders of the days within the
    lateness are opened, and of those only the ones whose filter may hold a url of the batch.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        news = cut_lineage(batch.withColumn("published_at", F.col("published_at").cast("timestamp")))
        store = news_store(batch.sparkSession, path, news.schema, lateness)
        newest, days = store.mark(batch_id)
        mark = None if newest is None else newest - pd.Timedelta(lateness).to_pytimedelta()
        behind = F.lit(False) if mark is None else F.coalesce(F.col("published_at") < F.lit(mark), F.lit(False))
        current = news.where(~behind)
        recent = store.rows(store.folders(days, batch_id, current)).where(~behind)
        order = [c for c in ("published_at", *news.columns) if c != "url"]
        store.write(storage.insert_if_absent(current, recent, "url", list(dict.fromkeys(order))), batch_id)
        news.where(behind).write.mode("overwrite").parquet(f"{path}/late/batch={batch_id}")

    return run


def news_store(spark: SparkSession, path: str, schema: StructType, lateness: str = LATENESS) -> DayStore:
    """The stored news of an ingest stream at ``path``; ``news_store(...).purge_before(day)`` is its retention."""
    return DayStore(spark, path, schema, "published_at", "url", _days(lateness))


def start_ingest(news: DataFrame, path: str, lateness: str = LATENESS, every: str | None = None) -> StreamingQuery:
    return _each_batch(news, ingest_batch(path, lateness), path, every)


def _each_batch(stream: DataFrame, run: Callable[[DataFrame, int], None], path: str, every: str | None) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", f"{path}/_stream")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def landing_batch(path: str, normalise: Callable[[DataFrame], DataFrame], most_chars: int = feeds.MOST_ITEM_CHARS) -> Callable[[DataFrame, int], None]:
    """Micro-batch function that lands feed items, safe to repeat: news to ``news``, what cannot be used to ``faults``.

    ``normalise`` makes news rows of good items, as ``feeds.rss_to_news`` does. A fault row has its kind, its file and the item.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        judged = feeds.faults(batch, most_chars).persist()
        normalise(judged.where("fault is null")).write.mode("overwrite").parquet(f"{path}/news/batch={batch_id}")
        judged.where("fault is not null").write.mode("overwrite").parquet(f"{path}/faults/batch={batch_id}")
        judged.unpersist()

    return run


def start_landing(items: DataFrame, path: str, normalise: Callable[[DataFrame], DataFrame], every: str | None = None,
                  most_chars: int = feeds.MOST_ITEM_CHARS) -> StreamingQuery:
    return _each_batch(items, landing_batch(path, normalise, most_chars), path, every)


def _counted(path: str) -> Callable[[DataFrame, int], None]:
    """Writes the counters that a batch changed; a replay overwrites its own."""
    def run(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("day", F.to_date("interval_start")).withColumn("batch", F.lit(batch_id)).write.partitionBy("day", "batch").mode(
            "overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{path}/rows")

    return run


def start_open_counters(alerts: DataFrame, path: str, lateness: str = LATENESS, interval: str = "1 hour", every: str | None = None) -> StreamingQuery:
    """Live counters that show open intervals after every batch and correct them when late rows arrive; see ``current_counters``."""
    writer = live_counters(alerts, lateness, interval).writeStream.outputMode("update").foreachBatch(_counted(path)).option("checkpointLocation", f"{path}/_stream")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def current_counters(spark: SparkSession, path: str, since: dt.date | None = None) -> DataFrame:
    """(interval_start, event_type, n): the latest count of every interval, of days from ``since`` on."""
    rows = spark.read.schema("interval_start timestamp, event_type string, n bigint, day date, batch bigint").parquet(f"{path}/rows")
    recent = rows if since is None else rows.where(F.col("day") >= F.lit(since))
    return recent.groupBy("interval_start", "event_type").agg(F.max_by("n", "batch").alias("n"))


def live_counters(alerts: DataFrame, lateness: str = LATENESS, interval: str = "1 hour") -> DataFrame:
    """Alerts per type and tumbling interval, emitted once an interval can no longer change."""
    from foliowire.operators.alertstats import counters_by_interval

    timed = alerts.withColumn("created_at", F.col("created_at").cast("timestamp"))
    return counters_by_interval(timed.withWatermark("created_at", lateness), interval=interval)


def alerts_of(news: DataFrame, assets: DataFrame | matching.WatchTerms, sentiments: DataFrame | None = None, verdicts: DataFrame | None = None,
              analyses: DataFrame | None = None, vectors: DataFrame | None = None, asset_vectors: DataFrame | None = None) -> DataFrame:
    """Alert rows of news for every portfolio they concern: relevance, event type, impact, analyses, gates, explanation.

    ``news`` has news_id, title, text, source, orgs and published_at. The other tables are supplied scores, each
    optional: ``sentiments`` (news_id, sentiment, sentiment_confidence; neutral where missing), ``verdicts`` on borderline pairs
    (news_id, portfolio_id, is_relevant, relevance_score, affected_assets), ``analyses`` (news_id, portfolio_id, severity,
    direction, confidence, event_type, explanation), and ``vectors`` (news_id, vector) with ``asset_vectors``
    (portfolio_id, ticker, pos, vector) for hybrid relevance. Without vectors the rules alone decide.
    """
    spark = news.sparkSession
    rules = matching.rule_relevance(news.select("news_id", "text"), news.select("news_id", "orgs"), assets)
    if vectors is None:
        scored = rules.select(*PAIR, F.col("direct_score").alias("relevance"), "matched_assets")
    else:
        hybrid = relevance.gated_hybrid_relevance(vectors.join(news.select("news_id"), "news_id", "left_semi"), rules, asset_vectors)
        scored = hybrid.select(*PAIR, F.col("relevance_score").alias("relevance"), "matched_assets")
    if verdicts is None:
        verdicts = spark.createDataFrame([], "news_id bigint, portfolio_id string, is_relevant boolean, relevance_score double, affected_assets array<string>")
    relevant = gates.rescue_borderline(scored, verdicts, PAIR).drop("rescued")
    events = impact.classify_by_keywords(news.select("news_id", "title", "source", "published_at", "text"), "text").drop("text", "keyword_hits")
    known = relevant.join(events, "news_id")
    if sentiments is None:
        known = known.withColumn("sentiment", F.lit("neutral")).withColumn("sentiment_confidence", F.lit(0.5))
    else:
        known = known.join(sentiments.select("news_id", "sentiment", "sentiment_confidence"), "news_id", "left").withColumn(
            "sentiment", F.coalesce("sentiment", F.lit("neutral"))).withColumn("sentiment_confidence", F.coalesce("sentiment_confidence", F.lit(0.5)))
    estimated = impact.estimate_impact(known)
    if analyses is None:
        analyses = spark.createDataFrame([], "news_id bigint, portfolio_id string, severity double, direction string, confidence double, event_type string, explanation string")
    refined = analyses.select(*PAIR, F.col("event_type").alias("_event"), F.col("explanation").alias("_explanation"))
    merged = impact.merge_analyses(estimated.withColumn("estimate", F.col("severity")), analyses, PAIR).join(refined, PAIR, "left")
    kept = gates.severity_gates(merged, "estimate", "severity").withColumn("event_type", F.coalesce("_event", "event_type"))
    c = F.col
    told = text.alert_explanation(c("title"), c("matched_assets"), c("event_type"), c("direction"), c("severity_label"), c("confidence"),
                                  c("relevance"), c("source"), c("sentiment"), c("_explanation"))
    return kept.select(*PAIR, c("published_at").cast("timestamp").alias("created_at"), "event_type", "direction", "severity",
                       "severity_label", "confidence", "relevance", "sentiment", "matched_assets", told.alias("explanation"))


def admitted(alerts: DataFrame, vectors: DataFrame | None = None, cap: int = domain.ALERTS_PER_HOUR,
             threshold: float = domain.DEDUP_SIMILARITY, stored: DataFrame | None = None) -> DataFrame:
    """Alerts with their duplicate flag that pass the limiter of their portfolio's anchored hours.

    An alert is a duplicate when its news is close to a kept one among the newest of its portfolio. ``stored`` alerts
    count in both steps. Alerts whose news has no vector are no duplicates.
    """
    if vectors is None:
        flagged = alerts.withColumn("max_similarity", F.lit(0.0)).withColumn("is_duplicate", F.lit(False))
    else:
        timed = alerts.select(*PAIR, "created_at")
        if stored is not None:
            timed = timed.unionByName(stored.where(~F.col("is_duplicate")).select(*PAIR, "created_at"))
        items = timed.join(vectors, "news_id").withColumn("pair", F.struct(*PAIR))
        flags = similarity.greedy_duplicates(items, ["portfolio_id"], ["created_at", "news_id"], "pair", threshold)
        flagged = alerts.join(flags.select("pair.*", "max_similarity", "is_duplicate"), PAIR, "left").withColumn(
            "max_similarity", F.coalesce("max_similarity", F.lit(0.0))).withColumn("is_duplicate", F.coalesce("is_duplicate", F.lit(False)))
    return limiter.first_per_anchored_hour(flagged, "portfolio_id", ("created_at", "news_id"), cap, stored)


def alert_batch(news: DataFrame, assets: DataFrame, sentiments: DataFrame | None = None, verdicts: DataFrame | None = None,
                analyses: DataFrame | None = None, vectors: DataFrame | None = None, asset_vectors: DataFrame | None = None,
                cap: int = domain.ALERTS_PER_HOUR, threshold: float = domain.DEDUP_SIMILARITY, stored: DataFrame | None = None) -> DataFrame:
    """The whole alert pipeline over a table of news."""
    return admitted(alerts_of(news, assets, sentiments, verdicts, analyses, vectors, asset_vectors), vectors, cap, threshold, stored)


ALERT_ROW = ("news_id bigint, portfolio_id string, created_at timestamp, event_type string, direction string, severity double, severity_label string, "
             "confidence double, relevance double, sentiment string, matched_assets array<string>, explanation string, max_similarity double, "
             "is_duplicate boolean, hour_start double")


def alerting_batch(path: str, assets: DataFrame, cap: int = domain.ALERTS_PER_HOUR, threshold: float = domain.DEDUP_SIMILARITY,
                   **scores: DataFrame) -> Callable[[DataFrame, int], None]:
    """Micro-batch function for continuous alerting, safe to repeat; ``scores`` are the tables of ``alerts_of``.

    A batch owns its folders of the store and overwrites them, so a replay after a lost task or driver leaves
    the same rows. Pairs stored by other batches are skipped; their alerts count towards hours and as kept news. The terms of the
    watch list are made once for all batches.
    """
    watch = matching.WatchTerms(assets)

    def run(batch: DataFrame, batch_id: int) -> None:
        news = batch.persist()  # every branch of the matching reads it
        first = news.agg(F.min(F.col("published_at").cast("timestamp"))).first()[0]
        store = alert_store(batch.sparkSession, path)
        # only the days in which earlier alerts can still matter
        since = None if first is None else (first - dt.timedelta(days=domain.RETENTION_DAYS)).date()
        days = [d for d in store.mark(batch_id)[1] if since is None or d >= since]
        recent = store.rows(store.folders(days, batch_id))
        fresh = alerts_of(news, watch, **scores).join(recent.select(*PAIR), PAIR, "left_anti")
        store.write(admitted(fresh, scores.get("vectors"), cap, threshold, recent), batch_id)
        news.unpersist()

    return run


def alert_store(spark: SparkSession, path: str) -> DayStore:
    """The stored alerts of an alerting stream at ``path``; ``alert_store(...).purge_before(day)`` is its retention."""
    return DayStore(spark, path, StructType.fromDDL(ALERT_ROW), "created_at", "news_id", domain.RETENTION_DAYS)


def start_alerting(news: DataFrame, path: str, assets: DataFrame, cap: int = domain.ALERTS_PER_HOUR, every: str | None = None,
                   threshold: float = domain.DEDUP_SIMILARITY, **scores: DataFrame) -> StreamingQuery:
    return _each_batch(news, alerting_batch(path, assets, cap, threshold, **scores), path, every)
