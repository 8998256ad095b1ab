"""Queries over the streaming jobs, the limiters and the scorer extension points.

Streams read the given files as a streaming source, run until the input is used up and return the table
they wrote.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from foliowire import domain, session
from foliowire.functions import text
from foliowire.operators import limiter, scoring_tables
from foliowire.plans.bindings import ALERTS, NEWS, Tables
from foliowire.plans.matching_and_similarity import _BLEND, _RULES, _SEMANTIC, greedy_sql
from foliowire.plans.registry import query
from foliowire.plans.text_and_scores import _EVENT_TEXT_SQL, _KEYWORD_SQL, _LABEL
from foliowire.sources import feeds
from foliowire.streaming import jobs, state


_PRIORS = ", ".join(f"('{e}', {p[0]}::DOUBLE, {p[1]}::DOUBLE)" for e, p in domain.IMPACT_PRIORS.items())


class Streamed(Tables):
    """The same tables and bindings over streaming sources."""

    def __getitem__(self, name):
        schema = super().__getitem__(name).schema
        # a table is one file or a folder of files; the pattern matches the table's path in either form, a stream takes no plain path of a file
        return self.spark.readStream.schema(schema).parquet(f"{self.sf_dir}/{name}.parque[t]")


def _finish(t: Tables, name, stream, mode="append"):
    path = session.scratch_path(t.spark, name)
    jobs.append_to(stream, path, mode).awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(f"{path}/rows")


def _closed(t: Tables, name, stream, build, time_col):
    """Run ``build(stream)`` to the end of the input, then close the stream so that what waits is settled too."""
    path, conf = session.scratch_path(t.spark, name), t.spark.conf
    before = conf.get(state.STATE_STORE[0], None)
    conf.set(*state.STATE_STORE)  # a query owns its session for as long as it runs
    try:
        result = build(jobs.with_closing(stream, f"{path}/closing"))
        jobs.append_to(result, path).awaitTermination()
        jobs.close(t.spark, f"{path}/closing", stream.schema, time_col)
        jobs.append_to(result, path).awaitTermination()
    finally:
        conf.set(state.STATE_STORE[0], before) if before else conf.unset(state.STATE_STORE[0])
    return t.spark.read.schema(result.schema).parquet(f"{path}/rows")


def _stream(t: Tables) -> Streamed:
    return Streamed(t.spark, t.sf_dir)


_ANCHORED_HOURS = f"""WITH RECURSIVE {ALERTS},
starts(user_id, start) AS (
  SELECT user_id, min(created_at) FROM alerts GROUP BY 1
  UNION ALL SELECT s.user_id, min(a.created_at) FROM starts s JOIN alerts a ON a.user_id = s.user_id AND a.created_at > s.start + INTERVAL 3600 SECONDS GROUP BY s.user_id, s.start),
placed AS (SELECT a.alert_id, a.user_id, a.is_duplicate, (SELECT max(start) FROM starts s WHERE s.user_id = a.user_id AND s.start <= a.created_at) AS start, a.created_at FROM alerts a),
counted AS (SELECT *, count(*) FILTER (NOT is_duplicate) OVER (PARTITION BY user_id, start ORDER BY created_at, alert_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM placed)
SELECT alert_id, is_duplicate FROM counted WHERE coalesce(before, 0) < 1"""


def _limited_alerts(s: Tables):
    return s.alerts.select("alert_id", "user_id", F.col("created_at").cast("timestamp").alias("created_at"), "is_duplicate")


@query("H4_anchored_limiter", _ANCHORED_HOURS)
def anchored_limiter(t: Tables):
    return limiter.first_per_anchored_hour(_limited_alerts(t), "user_id", cap=1).select("alert_id", "is_duplicate")


@query("H4_limiter_stream", _ANCHORED_HOURS)
def limiter_stream(t: Tables):
    limited = _closed(t, "limited", _limited_alerts(_stream(t)), lambda alerts: state.limit_stream(alerts, "user_id", cap=1), "created_at")
    return limited.select("alert_id", "is_duplicate")


@query("H5_hourly_limiter", f"""WITH {ALERTS},
ranked AS (SELECT alert_id, portfolio_id, row_number() OVER (PARTITION BY portfolio_id, date_trunc('hour', created_at) ORDER BY created_at, alert_id) AS rn FROM alerts WHERE NOT is_duplicate)
SELECT alert_id, portfolio_id FROM ranked WHERE rn <= 1""")
def hourly_limiter(t: Tables):
    fresh = t.alerts.where(~F.col("is_duplicate")).select("alert_id", "portfolio_id", "created_at")
    return limiter.first_per_hour(fresh, "portfolio_id", "created_at", "alert_id", 1).select("alert_id", "portfolio_id")


@query("H6_continuous_ingest", f"""WITH {NEWS} SELECT DISTINCT url FROM news""")
def continuous_ingest(t: Tables):
    news = _stream(t).news.select("url", "source", F.col("published_at").cast("timestamp").alias("published_at"))
    path = session.scratch_path(t.spark, "ingest")
    jobs.start_ingest(news, path).awaitTermination()
    stored = [t.spark.read.schema(news.schema).parquet(f"{path}/{part}").select("url") for part in ("rows", "late")]
    return stored[0].union(stored[1].join(stored[0], "url", "left_anti").distinct())


def _half_up(x, places=4):
    """Rounding on the decimal digits of a number, as the engine rounds."""
    return f"round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(24, 18)), {places})::DOUBLE"


_PIPELINE_INPUTS = f"""{_RULES}, {_SEMANTIC}, {ALERTS},
words AS ({_KEYWORD_SQL}),
hits AS (SELECT doc_id AS news_id, event_type, prio, count(*) AS n FROM documents JOIN words ON contains(lower(text), word) GROUP BY 1, 2, 3),
best AS (SELECT news_id, arg_min(event_type, (-n, prio)) AS event_type, max(n) AS n FROM hits GROUP BY 1),
priors AS (SELECT * FROM (VALUES {_PRIORS}) AS v(e, base, bias)),
-- a news item with its event, its supplied sentiment, and the verdict and analysis on one portfolio
news_items AS (
  SELECT d.doc_id AS news_id, d.source, coalesce(best.event_type, 'otro') AS e, CASE WHEN best.n > 0 THEN least(0.3::DOUBLE + best.n * 0.15::DOUBLE, 0.85::DOUBLE) ELSE 0.1::DOUBLE END AS ec,
         coalesce(a.sentiment, 'neutral') AS sentiment, coalesce(a.confidence, 0.5) AS sc
  FROM documents d LEFT JOIN best ON best.news_id = d.doc_id LEFT JOIN alerts a ON a.alert_id = d.doc_id),
given AS (
  SELECT doc_id AS news_id, 'W' || doc_id % 4 AS portfolio_id, quality = 1 AS ok, (doc_id * 7 % 100) / 100.0::DOUBLE AS v_score, (doc_id * 13 % 100) / 100.0::DOUBLE AS g_sev,
         CASE doc_id % 3 WHEN 0 THEN 'alcista' WHEN 1 THEN 'bajista' ELSE 'neutral' END AS g_dir, (doc_id * 17 % 100) / 100.0::DOUBLE AS g_conf,
         CASE WHEN doc_id % 5 = 0 THEN 'macroeconomia' END AS g_event, CASE WHEN doc_id % 7 = 0 THEN 'Nota ' || doc_id END AS g_text FROM labels)"""
_ALERT_PIPELINE = f"""WITH RECURSIVE {_PIPELINE_INPUTS},
hybrid AS (
  SELECT news_id, portfolio_id, round({_BLEND.format('coalesce(semantic_score, 0)')}, 4) AS score, coalesce(assets, '') AS assets
  FROM (SELECT * FROM semantic WHERE news_id IN (SELECT doc_id FROM documents)) FULL JOIN rules USING (news_id, portfolio_id)),
relevant AS (
  SELECT h.news_id, h.portfolio_id, CASE WHEN assets = '' THEN []::VARCHAR[] ELSE string_split(assets, ',') END AS assets,
         CASE WHEN score < 0.5 THEN greatest(score, v_score) ELSE score END AS relevance
  FROM hybrid h LEFT JOIN given g USING (news_id, portfolio_id) WHERE score >= 0.5 OR score >= 0.3 AND coalesce(ok, false)),
raw AS (
  SELECT r.*, n.* EXCLUDE (news_id), least(1.0, 0.3 * sc + 0.4 * ec + 0.3 * relevance) AS conf,
         CASE sentiment WHEN 'positive' THEN 0.5 + 0.3 * sc + 0.2 * bias WHEN 'negative' THEN -0.5 - 0.3 * sc + 0.2 * bias ELSE 0.5 * bias END AS ds,
         least(1.0, base * (0.7 + 0.3 * relevance) * CASE WHEN sc > 0.8 THEN 1.1 ELSE 1 END * CASE WHEN len(assets) > 1 THEN 1 + 0.05 * least(len(assets), 5) ELSE 1 END) AS full_sev
  FROM relevant r JOIN news_items n USING (news_id) JOIN priors USING (e)),
estimated AS (
  SELECT *, {_half_up('full_sev')} AS sev, {_half_up('conf')} AS c4, CASE WHEN ds > 0.15 THEN 'alcista' WHEN ds < -0.15 THEN 'bajista' ELSE 'neutral' END AS dir FROM raw),
folded AS (
  SELECT e.*, g_event, g_text, g_sev IS NOT NULL AS has, g_dir, g_conf,
         CASE WHEN g_sev IS NULL THEN sev ELSE least(greatest(g_sev, greatest(0.0, sev - 0.2)), least(1.0, sev + 0.2)) END AS moved
  FROM estimated e LEFT JOIN given USING (news_id, portfolio_id)),
merged AS (
  SELECT news_id, portfolio_id, source, sentiment, assets, relevance, coalesce(g_event, e) AS event_type, g_text, sev,
         CASE WHEN has AND (g_dir = dir OR g_conf >= 0.6) THEN g_dir ELSE dir END AS direction, {_half_up('moved')} AS severity,
         CASE WHEN has THEN {_LABEL.format('moved')} ELSE {_LABEL.format('full_sev')} END AS severity_label,
         CASE WHEN has THEN {_half_up('least(c4 * 0.5 + g_conf * 0.5, 1.0)')} ELSE c4 END AS confidence FROM folded),
passing AS MATERIALIZED (SELECT * FROM merged WHERE sev >= 0.15 AND severity >= 0.3),
flags AS ({greedy_sql("items AS (SELECT news_id AS vec_id, portfolio_id AS scope, embedding FROM passing JOIN embeddings ON vec_id = news_id)", also="scope AS portfolio_id, ")}),
flagged AS MATERIALIZED (SELECT p.*, coalesce(is_duplicate, false) AS is_duplicate FROM passing p LEFT JOIN flags f ON f.vec_id = p.news_id AND f.portfolio_id = p.portfolio_id),
starts(portfolio_id, start) AS (
  SELECT portfolio_id, min(news_id) FROM flagged GROUP BY 1
  UNION ALL SELECT s.portfolio_id, min(a.news_id) FROM starts s JOIN flagged a ON a.portfolio_id = s.portfolio_id AND a.news_id > s.start + 60 GROUP BY s.portfolio_id, s.start),
windowed AS (SELECT f.*, (SELECT max(start) FROM starts s WHERE s.portfolio_id = f.portfolio_id AND s.start <= f.news_id) AS start FROM flagged f),
counted AS (SELECT *, count(*) FILTER (NOT is_duplicate) OVER (PARTITION BY portfolio_id, start ORDER BY news_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM windowed)
SELECT news_id, portfolio_id, event_type, direction, severity, severity_label, confidence, is_duplicate,
  CASE WHEN g_text IS NOT NULL THEN g_text || '. Confianza: ' || printf('%.2f', {_half_up('confidence', 2)}) || '. Fuente: ' || source || '.' ELSE
  'Posible alerta ' || direction || ' de severidad ' || severity_label || ' para ' || CASE WHEN len(assets) = 0 THEN 'cartera general' ELSE array_to_string(assets, ', ') END
  || '. Evento detectado: ' || {_EVENT_TEXT_SQL} || '. Relevancia: ' || CASE WHEN relevance >= 0.8 THEN 'mención directa de activo en cartera'
  WHEN relevance >= 0.5 THEN 'alta similitud semántica con la cartera' ELSE 'relevancia indirecta por sector o geografía' END
  || CASE WHEN sentiment <> 'neutral' THEN '; sentimiento ' || sentiment || ' detectado por FinBERT' ELSE '' END
  || '. Confianza: ' || printf('%.2f', {_half_up('confidence', 2)}) || '. Fuente: ' || source || '.' END AS explanation
FROM counted WHERE before < 20"""
_ALERT_COLUMNS = ("news_id", "portfolio_id", "event_type", "direction", "severity", "severity_label", "confidence", "is_duplicate", "explanation")


def _alert_news(s: Tables):
    return s.news.select("news_id", "title", F.col("content").alias("text"), "source",
                         text.mined_organisations("content", None, squeezed=True).alias("orgs"), "published_at")


def _supplied(t: Tables):
    """Score tables for the alert pipeline: sentiments, verdicts, analyses and vectors."""
    doc, c = F.col("doc_id"), F.col
    pair = [doc.alias("news_id"), F.concat(F.lit("W"), doc % 4).alias("portfolio_id")]
    labels = t["labels"]
    verdicts = labels.select(*pair, (c("quality") == 1).alias("is_relevant"), (doc * 7 % 100 / F.lit(100.0)).alias("relevance_score"),
                             F.array().cast("array<string>").alias("affected_assets"))
    analyses = labels.select(
        *pair, (doc * 13 % 100 / F.lit(100.0)).alias("severity"), F.when(doc % 3 == 0, "alcista").when(doc % 3 == 1, "bajista").otherwise("neutral").alias("direction"),
        (doc * 17 % 100 / F.lit(100.0)).alias("confidence"), F.when(doc % 5 == 0, "macroeconomia").alias("event_type"),
        F.when(doc % 7 == 0, F.concat(F.lit("Nota "), doc)).alias("explanation"))
    sentiments = t.alerts.select(c("alert_id").alias("news_id"), "sentiment", c("confidence").alias("sentiment_confidence"))
    vectors = t["embeddings"].select(c("vec_id").alias("news_id"), c("embedding").alias("vector"))
    return {"sentiments": sentiments, "verdicts": verdicts, "analyses": analyses, "vectors": vectors, "asset_vectors": t.embedded_assets}


@query("H7_continuous_alerting", _ALERT_PIPELINE)
def continuous_alerting(t: Tables):
    path = session.scratch_path(t.spark, "alerting")
    jobs.start_alerting(_alert_news(_stream(t)), path, t.watch, threshold=0.3, **_supplied(t)).awaitTermination()
    return t.spark.read.schema(jobs.ALERT_ROW).parquet(f"{path}/rows").select(*_ALERT_COLUMNS)


@query("H7_alert_batch", _ALERT_PIPELINE)
def alert_batch(t: Tables):
    return jobs.alert_batch(_alert_news(t), t.watch, threshold=0.3, **_supplied(t)).select(*_ALERT_COLUMNS)


def _vectors(s: Tables):
    at = F.expr("TIMESTAMP '2024-01-01 00:00:00' + vec_id * INTERVAL '1' HOUR")
    return s["embeddings"].select("vec_id", F.col("label").alias("scope"), at.alias("seen_at"), F.col("embedding").cast("array<double>").alias("vector"))


_SCOPED = "items AS (SELECT vec_id, label AS scope, embedding FROM embeddings)"


def _flagged(t: Tables, name, **options):
    return _closed(t, name, _vectors(_stream(t)), lambda items: state.flag_duplicates_stream(
        items, "scope", "vec_id", ("seen_at", "vec_id"), 0.3, **options), "seen_at")


@query("H9_state_expiry", greedy_sql(_SCOPED, 48))
def state_expiry(t: Tables):
    return _flagged(t, "expiring", ttl_days=2)


@query("U4_stateful_duplicates", greedy_sql(_SCOPED, 24 * domain.RETENTION_DAYS))
def stateful_duplicates(t: Tables):
    return _flagged(t, "flags")


@query("H10_live_counters", f"""WITH {ALERTS}
SELECT strftime(date_trunc('hour', created_at), '%Y-%m-%d %H:%M:%S') AS interval_start, event_type, CAST(count(*) AS BIGINT) AS n FROM alerts GROUP BY 1, 2""")
def live_counters(t: Tables):
    alerts = _stream(t).alerts.select(F.col("created_at").cast("timestamp").alias("created_at"), "event_type")
    counted = _closed(t, "counters", alerts, lambda a: jobs.live_counters(a, lateness="1 hour"), "created_at")
    return counted.withColumn("interval_start", F.date_format("interval_start", "yyyy-MM-dd HH:mm:ss"))


@query("H10_open_counters", f"""WITH {ALERTS}
SELECT strftime(date_trunc('hour', created_at), '%Y-%m-%d %H:%M:%S') AS interval_start, event_type, CAST(count(*) AS BIGINT) AS n FROM alerts GROUP BY 1, 2""")
def open_counters(t: Tables):
    alerts = _stream(t).alerts.select(F.col("created_at").cast("timestamp").alias("created_at"), "event_type")
    path = session.scratch_path(t.spark, "open-counters")
    jobs.start_open_counters(alerts, path).awaitTermination()
    return jobs.current_counters(t.spark, path).withColumn("interval_start", F.date_format("interval_start", "yyyy-MM-dd HH:mm:ss"))


_LANDED = f"""news_items AS (
  SELECT news_id, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS title, trim(regexp_replace(content, '\\s+', ' ', 'g')) AS content, url, published_at, lang, source
  FROM (SELECT * FROM news))"""


@query("A1_landed_files", f"""WITH {NEWS}, {_LANDED}
SELECT url, strftime(published_at, '%Y-%m-%d %H:%M:%S') AS published, sha256(title || ' ' || lang || ' ' || content) AS content_hash, NULL::VARCHAR AS fault FROM news_items WHERE news_id % 13 <> 0
UNION ALL SELECT NULL, NULL, NULL, 'unlinked' FROM news_items WHERE news_id % 13 = 0""")
def landed_files(t: Tables):
    n, folder = t.news, session.scratch_path(t.spark, "feed-files")
    squeezed = {c: F.trim(F.regexp_replace(c, "[ \\t\\n\\f\\r]+", " ")) for c in ("title", "content")}
    item = F.struct(squeezed["title"].alias("title"), F.when(F.col("news_id") % 13 != 0, F.col("url")).alias("link"), F.concat(
        F.date_format("published_at", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT")).alias("pubDate"), F.col("lang").alias("description"), squeezed["content"].alias("content"))
    n.select(F.to_xml(item, {"rowTag": "item"})).write.text(folder)
    path = session.scratch_path(t.spark, "landed")
    jobs.start_landing(feeds.stream_rss(t.spark, folder), path, lambda items: feeds.rss_to_news(items, F.lit("desk"), F.current_timestamp())).awaitTermination()
    landed = t.spark.read.parquet(f"{path}/news").select(
        "url", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published"), "content_hash", F.lit(None).cast("string").alias("fault"))
    return landed.unionByName(t.spark.read.parquet(f"{path}/faults").select("fault"), allowMissingColumns=True)


@query("U1_score_tables", f"""WITH {ALERTS}
SELECT doc_id AS news_id, a.sentiment AS mood_sentiment, a.confidence AS mood_confidence, l.quality = 1 AS verdict_is_relevant
FROM documents LEFT JOIN alerts a ON alert_id = doc_id LEFT JOIN labels l USING (doc_id)""")
def score_tables(t: Tables):
    mood = t.alerts.select(F.col("alert_id").alias("news_id"), "sentiment", "confidence")
    verdict = t["labels"].select(F.col("doc_id").alias("news_id"), (F.col("quality") == 1).alias("is_relevant"))
    return scoring_tables.attach_scores(t.news.select("news_id"), {"mood": (mood, ["news_id"]), "verdict": (verdict, ["news_id"])})


def _vowel_scorer():
    """A stand-in for a model: mood by the share of the letter e."""
    def score(batch: pd.DataFrame) -> pd.DataFrame:
        share = batch["text"].str.count("e") / batch["text"].str.len().clip(lower=1)
        mood = share.map(lambda s: "positive" if s > 0.13 else "negative" if s < 0.09 else "neutral")
        return pd.DataFrame({"news_id": batch["news_id"], "sentiment": mood, "confidence": share})

    return score


@query("U2_batch_scorer", """
SELECT doc_id AS news_id, CASE WHEN s > 0.13 THEN 'positive' WHEN s < 0.09 THEN 'negative' ELSE 'neutral' END AS sentiment, round(s, 6) AS confidence
FROM (SELECT doc_id, (length(text) - length(replace(text, 'e', ''))) / greatest(length(text), 1) AS s FROM documents)""")
def batch_scorer(t: Tables):
    docs = t["documents"].select(F.col("doc_id").alias("news_id"), "text")
    scored = scoring_tables.batch_score(docs, _vowel_scorer, "news_id bigint, sentiment string, confidence double")
    return scored.withColumn("confidence", F.round("confidence", 6))
