"""Queries over landed payloads, keyed tables and bounded reads (sources, sinks, retention)."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from foliowire import domain, session
from foliowire.operators import storage
from foliowire.operators.prices import ohlcv
from foliowire.plans.bindings import ALERTS, NEWS, PORTFOLIO_ASSETS, Tables
from foliowire.plans.registry import query
from foliowire.sources import corpora, feeds
from foliowire.streaming import daystore

AS_TEXT = "yyyy-MM-dd HH:mm:ss"


def _ingested():
    return F.to_timestamp(F.lit("2024-06-01 00:00:00"))


def _day(ts):
    return F.date_format(ts, AS_TEXT)


# Payloads are built from the news table, one record per row, and parsed back by the feed code.

@query("A1_rss_feed", f"""WITH {NEWS}
SELECT title, md5(content) AS content_md5, url, source, 'rss' AS source_type, 'en' AS language,
       CASE WHEN news_id % 11 = 0 THEN '2024-06-01 00:00:00' ELSE strftime(published_at, '%Y-%m-%d %H:%M:%S') END AS published,
       sha256(title || ' ' || lang || ' ' || content) AS content_hash
FROM (SELECT * REPLACE (trim(regexp_replace(content, '\\s+', ' ', 'g')) AS content, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS title) FROM news)
WHERE news_id % 13 <> 0""")
def rss_feed(t: Tables):
    n = t.news
    squeezed = {c: F.trim(F.regexp_replace(c, "[ \\t\\n\\f\\r]+", " ")) for c in ("title", "content")}
    item = F.struct(
        squeezed["title"].alias("title"),
        F.when(F.col("news_id") % 13 != 0, F.col("url")).alias("link"),
        F.when(F.col("news_id") % 11 != 0, F.concat(F.date_format("published_at", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))).alias("pubDate"),
        F.col("lang").alias("description"), squeezed["content"].alias("content"))
    payload = n.select("source", F.to_xml(item, {"rowTag": "item"}).alias("payload"))
    parsed = payload.select(F.col("source").alias("feed"), F.from_xml("payload", feeds.RSS_ITEM, {"rowTag": "item"}).alias("i"))
    news = feeds.rss_to_news(parsed.select("feed", "i.*"), F.col("feed"), _ingested())
    return news.select("title", F.md5("content").alias("content_md5"), "url", "source", "source_type", "language",
                       _day("published_at").alias("published"), "content_hash")


@query("A2_regulator_feed", f"""WITH {NEWS}
SELECT url, 'cnmv_hechos' AS source, 'cnmv' AS source_type, 'es' AS language,
       strftime(published_at, '%Y-%m-%d %H:%M:%S') AS published, sha256(source || ' ' || lang) AS content_hash, 'hechos' AS feed
FROM news""")
def regulator_feed(t: Tables):
    item = F.struct(F.col("source").alias("title"), F.col("url").alias("link"),
                    F.concat(F.date_format("published_at", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000")).alias("pubDate"),
                    F.col("lang").alias("description"))
    payload = t.news.select(F.to_xml(item, {"rowTag": "item"}).alias("payload"))
    parsed = payload.select(F.from_xml("payload", feeds.RSS_ITEM, {"rowTag": "item"}).alias("i")).select("i.*")
    news = feeds.regulator_to_news(parsed, "hechos", _ingested())
    return news.select("url", "source", "source_type", "language", _day("published_at").alias("published"), "content_hash",
                       F.col("metadata")["cnmv_feed"].alias("feed"))


@query("A3_article_json", f"""WITH {NEWS}
SELECT title, url, CASE WHEN news_id % 5 = 0 THEN 'newsapi_newsapi' ELSE 'newsapi_' || source END AS source, lang AS author,
       CASE WHEN news_id % 11 = 0 THEN '2024-06-01 00:00:00' ELSE strftime(published_at, '%Y-%m-%d %H:%M:%S') END AS published,
       sha256(title || ' ' || CASE WHEN news_id % 3 = 0 THEN '' ELSE lang END || ' ' || content) AS content_hash
FROM news WHERE title <> '' AND news_id % 13 <> 0""")
def article_json(t: Tables):
    key = F.col("news_id")
    article = F.struct(
        "title", F.when(key % 3 != 0, F.col("lang")).alias("description"), "content",
        F.when(key % 13 != 0, F.col("url")).otherwise("").alias("url"),
        F.when(key % 11 != 0, F.concat(F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))).otherwise("soon").alias("publishedAt"),
        F.col("lang").alias("author"),
        F.struct(F.when(key % 5 != 0, F.col("source")).alias("name")).alias("source"))
    payload = t.news.select(F.to_json(F.struct(F.lit("ok").alias("status"), F.array(article).alias("articles"))).alias("payload"))
    parsed = payload.select(F.from_json("payload", feeds.ARTICLES).alias("p")).select("p.*")
    news = feeds.articles_to_news(parsed, _ingested())
    return news.select("title", "url", "source", "author", _day("published_at").alias("published"), "content_hash")


@query("A4_sentiment_json", f"""WITH {NEWS}
SELECT url, 'alphavantage_' || source AS source, lang || ', desk' AS author,
       strftime(published_at, '%Y-%m-%d %H:%M:%S') AS published, sha256(title || ' ' || lang) AS content_hash,
       'T' || news_id % 7 || ',T' || news_id % 5 AS entities, CASE WHEN news_id % 2 = 0 THEN 'Bullish' ELSE 'Neutral' END AS sentiment
FROM news WHERE title <> ''""")
def sentiment_json(t: Tables):
    key = F.col("news_id")

    def ticker(k):
        return F.struct(F.concat(F.lit("T"), key % k).alias("ticker"), F.lit("0.1").alias("ticker_sentiment_score"))

    item = F.struct(
        "title", F.col("lang").alias("summary"), "url",
        F.date_format("published_at", "yyyyMMdd'T'HHmmss").alias("time_published"), "source",
        F.array("lang", F.lit("desk")).alias("authors"),
        F.when(key % 2 == 0, "Bullish").alias("overall_sentiment_label"), F.array(ticker(7), ticker(5)).alias("ticker_sentiment"))
    payload = t.news.select(F.to_json(F.struct(F.array(item).alias("feed"))).alias("payload"))
    parsed = payload.select(F.from_json("payload", feeds.SENTIMENT_FEED).alias("p")).select("p.*")
    news = feeds.sentiment_feed_to_news(parsed, _ingested())
    return news.select("url", "source", "author", _day("published_at").alias("published"), "content_hash",
                       F.array_join("entities_raw", ",").alias("entities"), F.col("metadata")["av_sentiment"].alias("sentiment"))


@query("A5_filing_hits", """
SELECT '[' || CASE WHEN o_orderkey % 3 = 0 THEN 'Filing' ELSE '8-K' END || '] Customer ' || o_custkey AS title,
       'https://www.sec.gov/Archives/edgar/data/' || o_custkey || '/' || o_orderkey AS url,
       sha256('https://www.sec.gov/Archives/edgar/data/' || o_custkey || '/' || o_orderkey) AS content_hash,
       strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS published
FROM orders""")
def filing_hits(t: Tables):
    hit = F.struct(F.struct(
        F.when(F.col("o_orderkey") % 3 != 0, "8-K").alias("form_type"),
        F.array(F.concat(F.lit("Customer "), "o_custkey")).alias("display_names"),
        F.col("o_custkey").cast("string").alias("entity_id"), F.col("o_orderkey").cast("string").alias("file_num"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("file_date")).alias("_source"))
    payload = t["orders"].select(F.to_json(F.struct(F.struct(F.array(hit).alias("hits")).alias("hits"))).alias("payload"))
    parsed = payload.select(F.from_json("payload", feeds.FILING_HITS).alias("p")).select("p.*")
    news = feeds.filing_hits_to_news(parsed, _ingested())
    return news.select("title", "url", "content_hash", _day("published_at").alias("published"))


@query("A6_company_filings", """
SELECT '[' || CASE i WHEN 0 THEN '10-K' WHEN 1 THEN '10-Q' ELSE '8-K' END || '] ' || c_name AS title,
       CASE i WHEN 0 THEN c_mktsegment ELSE '' END AS summary,
       'https://www.sec.gov/Archives/edgar/data/' || lpad(CAST(c_custkey AS VARCHAR), 10, '0') || '/'
         || CASE i WHEN 2 THEN '' ELSE '00' || c_custkey || i END AS url,
       '2024-01-0' || (i + 1) AS filed
FROM customer, unnest(range(0, 3)) AS r(i)""")
def company_filings(t: Tables):
    key = F.col("c_custkey").cast("string")
    recent = F.struct(
        F.array(F.lit("10-K"), F.lit("10-Q"), F.lit("8-K")).alias("form"),
        F.array(F.lit("2024-01-01"), F.lit("2024-01-02"), F.lit("2024-01-03")).alias("filingDate"),
        F.array(F.concat(F.lit("00-"), key, F.lit("-0")), F.concat(F.lit("00-"), key, F.lit("-1"))).alias("accessionNumber"),
        F.array("c_mktsegment").alias("primaryDocDescription"))
    payload = t["customer"].select(F.to_json(F.struct(
        key.alias("cik"), F.col("c_name").alias("name"), F.struct(recent.alias("recent")).alias("filings"))).alias("payload"))
    parsed = payload.select(F.from_json("payload", feeds.SUBMISSIONS).alias("p")).select("p.*")
    news = feeds.company_filings_to_news(parsed, _ingested())
    return news.select("title", "summary", "url", F.date_format("published_at", "yyyy-MM-dd").alias("filed"))


@query("A7_labelled_corpus", f"""WITH {NEWS}
SELECT CAST(doc_id AS VARCHAR) AS id, quality = 1 AS is_relevant, 'T' || doc_id % 9 AS assets, length(content) AS n_chars
FROM labels JOIN news ON news_id = doc_id""")
def labelled_corpus(t: Tables):
    key = F.col("doc_id")
    record = F.to_json(F.struct(
        key.cast("string").alias("id"), F.col("content"),
        F.struct((F.col("quality") == 1).alias("is_relevant"), F.array(F.concat(F.lit("T"), key % 9)).alias("matched_assets")).alias("labels")))
    labelled = t["labels"].join(t.news, F.col("news_id") == key)
    lines = labelled.select(F.explode(F.array(record, F.lit("  "))).alias("value"))
    return corpora.parse_corpus(lines).select("id", "labels.is_relevant", F.array_join("labels.matched_assets", ",").alias("assets"),
                                              F.length("content").cast("bigint").alias("n_chars"))


@query("A8_portfolio_files", f"""WITH {PORTFOLIO_ASSETS}
SELECT portfolio_id, CAST(pos - 1 AS INTEGER) AS pos, ticker, sector, weight, alias FROM portfolio_assets""")
def portfolio_files(t: Tables):
    lines = t.portfolios.select(F.to_json(F.array(F.struct("portfolio_id", "assets"))).alias("value"))
    parsed = lines.select(F.inline(F.from_json("value", f"array<struct<portfolio_id:string,name:string,assets:array<{corpora.ASSET}>>>")))
    flat = corpora.flatten_portfolios(parsed.select("portfolio_id", "assets"))
    return flat.select("portfolio_id", "pos", "ticker", "sector", "weight", F.array_join("aliases", ",").alias("alias"))


@query("A9_annotations", """
SELECT CAST(doc_id AS VARCHAR) AS item_id, 'first' AS annotator, unnest(['is_relevant', 'event_type', 'direction', 'severity_label']) AS dimension,
       unnest([CASE WHEN quality = 1 THEN 'true' ELSE 'false' END, 'otro', CASE WHEN toxic = 1 THEN 'bajista' ELSE 'neutral' END, NULL]) AS label
FROM labels""")
def annotations(t: Tables):
    label = F.struct((F.col("quality") == 1).alias("is_relevant"), F.lit("otro").alias("event_type"),
                     F.when(F.col("toxic") == 1, "bajista").otherwise("neutral").alias("direction"))
    lines = t["labels"].select(F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), label.alias("labels"))).alias("value"))
    return corpora.annotations_long(corpora.parse_annotations(lines), "first")


@query("A10_bar_history", """
SELECT ticker, strftime(dt, '%Y-%m-%d') AS date, round(arg_min(price, pos), 2) AS open, round(max(price), 2) AS high, round(min(price), 2) AS low,
       round(arg_max(price, pos), 2) AS close, CAST(sum(l_quantity) AS BIGINT) AS volume
FROM (SELECT p_type AS ticker, CAST(l_shipdate AS DATE) AS dt, l_extendedprice / l_quantity + 0.0001 AS price, l_quantity,
             (l_orderkey, l_linenumber, l_partkey) AS pos FROM lineitem JOIN part ON p_partkey = l_partkey)
GROUP BY 1, 2""")
def bar_history(t: Tables):
    # 0.0001 keeps prices off the rounding ties of two decimals.
    line = (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("decimal(20,0)")
    pos = (line * F.lit(10**12).cast("decimal(13,0)") + F.col("l_partkey")).cast("decimal(38,0)")
    ticks = t["lineitem"].select(
        "l_partkey", F.to_date("l_shipdate").alias("dt"), (F.col("l_extendedprice") / F.col("l_quantity") + 0.0001).alias("price"),
        F.col("l_quantity").alias("quantity"), pos.alias("pos"))
    names = t["part"].select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("ticker"))
    return ohlcv(ticks, names, "l_partkey")


@query("A11_ingest_statistics", """
WITH batch AS (
  SELECT 'rss' AS source_type, 0 AS prio, doc_id AS id, sha256(text) AS url FROM documents
  UNION ALL SELECT 'newsapi', 1, page_id, url FROM pages
  UNION ALL SELECT 'alphavantage', 2, conv_id * 1000 + turn, sha256(text) FROM conversations),
store AS (SELECT DISTINCT sha256(text) AS url FROM documents JOIN labels USING (doc_id) WHERE toxic = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY prio, id) AS rn FROM batch)
SELECT source_type, CAST(count(*) FILTER (rn = 1 AND url NOT IN (SELECT url FROM store)) AS BIGINT) AS saved,
       CAST(count(*) FILTER (rn > 1 OR url IN (SELECT url FROM store)) AS BIGINT) AS duplicates
FROM ranked GROUP BY 1""")
def ingest_statistics(t: Tables):
    def source(df, name, prio, key, url):
        return df.select(F.lit(name).alias("source_type"), F.lit(prio).alias("prio"), key.alias("id"), url.alias("url"))

    batch = (
        source(t["documents"], "rss", 0, F.col("doc_id"), F.sha2("text", 256))
        .unionByName(source(t["pages"], "newsapi", 1, F.col("page_id"), F.col("url")))
        .unionByName(source(t["conversations"], "alphavantage", 2, F.col("conv_id") * 1000 + F.col("turn"), F.sha2("text", 256))))
    toxic = t["labels"].where("toxic = 1").select("doc_id")
    store = t["documents"].join(toxic, "doc_id", "left_semi").select(F.sha2("text", 256).alias("url"))
    return storage.ingest_statistics(batch, store, "url", ["prio", "id"], "source_type")


@query("A12_insert_if_absent", f"""WITH {NEWS}
SELECT url, news_id, source FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY news_id) AS rn FROM news)
WHERE rn = 1 AND url NOT IN (SELECT url FROM news JOIN labels ON doc_id = news_id WHERE quality = 0)""")
def insert_if_absent(t: Tables):
    rejected = t["labels"].where("quality = 0").select(F.col("doc_id").alias("news_id"))
    news, path = t.news.select("url", "news_id", "source"), session.scratch_path(t.spark, "news")
    news.join(rejected, "news_id", "left_semi").withColumn("load", F.lit(0)).write.parquet(path)
    storage.append_absent(news, path, "url", ["news_id"], load=F.lit(1))
    return t.spark.read.parquet(path).where("load = 1").drop("load")


@query("A13_feedback_upsert", f"""WITH {ALERTS}
SELECT k AS alert_id, user_id, arg_max(direction = 'alcista', (created_at, alert_id)) AS useful,
       arg_max(raw_type, (created_at, alert_id)) AS comment, strftime(min(created_at), '%Y-%m-%d %H:%M:%S') AS created,
       strftime(max(created_at), '%Y-%m-%d %H:%M:%S') AS updated FROM alerts GROUP BY 1, 2""")
def feedback_upsert(t: Tables):
    votes, path = storage.feedback_rows(_votes(t)), session.scratch_path(t.spark, "feedback")
    for half in (1, 0):
        storage.merge_version(votes.where(F.col("vote_id") % 2 == half), path, ["alert_id", "user_id"],
                              lambda rows: storage.merge_feedback(rows).select(*votes.columns))
    latest = storage.current_rows(t.spark, path, votes.schema)
    return latest.select("alert_id", "user_id", "useful", "comment", _day("created_at").alias("created"), _day("updated_at").alias("updated"))


def _votes(t: Tables):
    return t.alerts.select(F.col("k").alias("alert_id"), "user_id", (F.col("direction") == "alcista").alias("useful"),
                           F.col("raw_type").alias("comment"), F.col("created_at").alias("voted_at"), F.col("alert_id").alias("vote_id"))


@query("A14_backtest_upsert", """
SELECT o_custkey AS alert_id, strftime(max(o_orderdate), '%Y-%m-%d') AS run_on, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS mean_car,
       arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS run_id FROM orders GROUP BY 1""")
def backtest_upsert(t: Tables):
    runs = t["orders"].select(F.col("o_custkey").alias("alert_id"), F.col("o_orderdate").alias("run_at"),
                              F.col("o_orderkey").alias("run_id"), F.col("o_totalprice").alias("mean_car"))
    path = session.scratch_path(t.spark, "backtests")
    for half in (0, 1):
        storage.merge_version(runs.where(F.col("run_id") % 2 == half), path, ["alert_id"],
                              lambda rows: storage.latest_per_key(rows, ["alert_id"], ["run_at", "run_id"]).select(*runs.columns))
    return storage.current_rows(t.spark, path, runs.schema).select("alert_id", F.date_format("run_at", "yyyy-MM-dd").alias("run_on"), "mean_car", "run_id")


@query("A15_retention", """
SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '2024-02-14 00:00:00' - INTERVAL 30 DAYS""")
def retention(t: Tables):
    name = f"events_{uuid.uuid4().hex}"
    t["events"].withColumn("day", F.to_date("ts")).hint("rebalance", "day").write.partitionBy("day").saveAsTable(name)
    storage.purge_before(t.spark, name, "day", dt.date(2024, 2, 14) - dt.timedelta(days=domain.RETENTION_DAYS))
    return t.spark.table(name).select("event_id", "user_id")


#: Days of events that the store of a stream keeps; the given events span a month.
_EVENT_DAYS = 10


@query("A15_stream_retention", f"""
SELECT event_id, user_id FROM events WHERE CAST(ts AS DATE) >= CAST((SELECT max(ts) FROM events) - INTERVAL {_EVENT_DAYS} DAYS AS DATE)""")
def stream_retention(t: Tables):
    events = t["events"].select("event_id", "user_id", "ts")
    store = daystore.DayStore(t.spark, session.scratch_path(t.spark, "kept"), events.schema, "ts", "event_id", _EVENT_DAYS)
    for batch_id, part in enumerate((F.col("ts") >= "2024-01-20", F.col("ts") < "2024-01-20")):  # the older half comes late
        store.write(events.where(part), batch_id)
    newest, _ = store.mark(2)
    if newest is None:
        return events.select("event_id", "user_id")
    first = (newest - dt.timedelta(days=_EVENT_DAYS)).date()
    store.purge_before(first)
    return store.rows(store.folders(store.days(), 2)).select("event_id", "user_id")


@query("A16_append_alerts", f"""WITH {ALERTS}
SELECT strftime(created_at, '%Y-%m-%d') AS created_on, CAST(count(*) AS BIGINT) AS n, round(sum(severity), 4) AS severity
FROM alerts WHERE NOT is_duplicate GROUP BY 1""")
def append_alerts(t: Tables):
    path = session.scratch_path(t.spark, "alerts")
    rows = t.alerts.select("alert_id", "portfolio_id", "severity", "is_duplicate", "created_at")
    storage.append_alerts(rows, path)
    stored = t.spark.read.schema(
        "alert_id bigint, portfolio_id string, severity double, is_duplicate boolean, created_at timestamp_ntz, created_date date").parquet(path)
    return stored.groupBy(F.date_format("created_date", "yyyy-MM-dd").alias("created_on")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("severity"), 4).alias("severity"))


@query("A17_prediction_files", f"""WITH {ALERTS}
SELECT raw_type AS variant, CAST(count(*) AS BIGINT) AS n, round(avg(relevance), 6) AS relevance FROM alerts GROUP BY 1""")
def prediction_files(t: Tables):
    path = session.scratch_path(t.spark, "predictions")
    corpora.write_predictions(t.alerts.select(F.col("alert_id").alias("id"), "relevance", F.col("raw_type").alias("variant")), path)
    stored = corpora.read_predictions(t.spark, path, "id bigint, relevance double, variant string")
    return stored.groupBy("variant").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("relevance"), 6).alias("relevance"))


@query("A18_list_portfolios", f"""WITH {PORTFOLIO_ASSETS}
SELECT portfolio_id, user_id, CAST(count(*) AS INTEGER) AS n_assets FROM portfolio_assets WHERE user_id = 'U7'
GROUP BY ALL ORDER BY portfolio_id LIMIT 50""")
def list_portfolios(t: Tables):
    mine = storage.by_id(t.portfolios, "user_id", "U7")
    return mine.select("portfolio_id", "user_id", F.size("assets").alias("n_assets")).orderBy("portfolio_id").limit(50)


@query("A18_fetch_portfolio", f"""WITH {PORTFOLIO_ASSETS}
SELECT portfolio_id, user_id, round(sum(weight), 6) AS weight FROM portfolio_assets WHERE portfolio_id = 'P42' GROUP BY ALL""")
def fetch_portfolio(t: Tables):
    total = F.aggregate("assets", F.lit(0.0), lambda acc, a: acc + a["weight"])
    return storage.by_id(t.portfolios, "portfolio_id", "P42").select("portfolio_id", "user_id", F.round(total, 6).alias("weight"))


@query("B1_flatten_holdings", f"""WITH {PORTFOLIO_ASSETS}
SELECT portfolio_id, pos, ticker, lower(name) || '|' || lower(ticker) || '|' || lower(alias) AS names FROM portfolio_assets""")
def flatten_holdings(t: Tables):
    flat = t.portfolios.select("portfolio_id", F.inline("assets"))
    names = F.array_join(F.transform(F.concat(F.array("name", "ticker"), "aliases"), F.lower), "|")
    return flat.select("portfolio_id", "pos", "ticker", names.alias("names"))


@query("B1_sectors_countries", f"""WITH {PORTFOLIO_ASSETS}
SELECT portfolio_id, coalesce(string_agg(DISTINCT sector, ',' ORDER BY sector), '') AS sectors,
       coalesce(string_agg(DISTINCT nullif(country, ''), ',' ORDER BY nullif(country, '')), '') AS countries FROM portfolio_assets GROUP BY 1""")
def sectors_countries(t: Tables):
    def distinct(field):
        values = F.array_distinct(F.filter(F.transform("assets", lambda a: a[field]), lambda x: x.isNotNull() & (x != "")))
        return F.array_join(F.array_sort(values), ",")

    return t.portfolios.select("portfolio_id", distinct("sector").alias("sectors"), distinct("country").alias("countries"))


@query("B2_edit_assets", f"""WITH {PORTFOLIO_ASSETS},
adds AS (SELECT 'P' || c_custkey AS portfolio_id, 'NEW' || c_nationkey AS ticker, 99 AS pos FROM customer WHERE c_mktsegment = 'BUILDING'),
edited AS (
  SELECT a.portfolio_id, a.pos, a.ticker FROM portfolio_assets a
  WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE 'P' || c.c_custkey = a.portfolio_id AND c.c_acctbal < 0 AND a.ticker = 'T' || ((c.c_custkey * 7 + 13) % 97))
  UNION ALL SELECT portfolio_id, pos, ticker FROM adds)
SELECT 'P' || c_custkey AS portfolio_id, coalesce(string_agg(ticker, ',' ORDER BY pos), '') AS tickers,
       c_mktsegment = 'BUILDING' OR c_acctbal < 0 AS touched
FROM customer LEFT JOIN edited ON portfolio_id = 'P' || c_custkey GROUP BY 1, 3""")
def edit_assets(t: Tables):
    customers = t["customer"]
    key = F.concat(F.lit("P"), "c_custkey").alias("portfolio_id")
    asset = F.struct(
        F.lit(99).alias("pos"), F.concat(F.lit("NEW"), "c_nationkey").alias("ticker"), F.col("c_name").alias("name"),
        F.lit(None).cast("string").alias("sector"), F.lit("").alias("country"), F.lit(0.0).alias("weight"),
        F.array(F.lit("new")).alias("aliases"))
    adds = customers.where("c_mktsegment = 'BUILDING'").select(key, asset.alias("asset"))
    drops = customers.where("c_acctbal < 0").select(key, F.concat(F.lit("T"), (F.col("c_custkey") * 7 + 13) % 97).alias("ticker"))
    edited = storage.edit_assets(t.portfolios, adds, drops, _ingested())
    return edited.select("portfolio_id", F.array_join(F.transform("assets", lambda a: a["ticker"]), ",").alias("tickers"),
                         F.col("updated_at").isNotNull().alias("touched"))


@query("B3_newest_alerts", f"""WITH {ALERTS}
SELECT alert_id, portfolio_id, severity_label FROM alerts WHERE portfolio_id = 'u8' ORDER BY created_at DESC, alert_id DESC LIMIT 50""")
def newest_alerts(t: Tables):
    rows = storage.newest(t.alerts, "created_at", "alert_id", 50, F.col("portfolio_id") == "u8")
    return rows.select("alert_id", "portfolio_id", "severity_label")


@query("B10_corpus_checks", """
WITH corpus AS (SELECT doc_id, quality = 1 AS relevant, 'src' || doc_id % 25 AS portfolio, CASE WHEN toxic = 1 THEN 'litigio' ELSE 'otro' END AS event_type,
                       CASE WHEN quality = 1 OR doc_id % 50 = 0 THEN 1 ELSE 0 END AS n_assets FROM labels)
SELECT 'irrelevant_with_assets' AS rule, CAST(count(*) FILTER (NOT relevant AND n_assets > 0) AS BIGINT) AS value FROM corpus
UNION ALL SELECT 'unknown_portfolio', CAST(count(*) AS BIGINT) FROM corpus WHERE portfolio NOT IN (SELECT source FROM documents)
UNION ALL SELECT 'negatives', CAST(count(*) FILTER (NOT relevant) AS BIGINT) FROM corpus
UNION ALL SELECT 'event_types', CAST(count(DISTINCT event_type) AS BIGINT) FROM corpus""")
def corpus_checks(t: Tables):
    from foliowire.operators.quality import corpus_checks as checks

    corpus = t["labels"].select(
        "doc_id", (F.col("quality") == 1).alias("is_relevant"), F.concat(F.lit("src"), F.col("doc_id") % 25).alias("portfolio_id"),
        F.when(F.col("toxic") == 1, "litigio").otherwise("otro").alias("event_type"),
        F.when((F.col("quality") == 1) | (F.col("doc_id") % 50 == 0), F.array(F.lit("T1"))).otherwise(F.array().cast("array<string>")).alias("matched_assets"))
    return checks(corpus, t["documents"].select(F.col("source").alias("portfolio_id")))


@query("G1_newest_news", f"""WITH {NEWS}
SELECT news_id, title, strftime(published_at, '%Y-%m-%d %H:%M:%S') AS published FROM news ORDER BY published_at DESC, news_id DESC LIMIT 50""")
def newest_news(t: Tables):
    return storage.newest(t.news, "published_at", "news_id", 50).select("news_id", "title", _day("published_at").alias("published"))


@query("G2_newest_comparisons", """
SELECT o_orderkey AS comparison_id, strftime(o_orderdate, '%Y-%m-%d') AS run_on, o_orderdate = (SELECT max(o_orderdate) FROM orders) AS is_latest_day
FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20""")
def newest_comparisons(t: Tables):
    runs = t["orders"].select("o_orderkey", "o_orderdate")  # the detail columns are never read
    last = runs.agg(F.max("o_orderdate").alias("last"))
    top = storage.newest(runs, "o_orderdate", "o_orderkey", 20)
    return top.join(last, F.col("o_orderdate") == F.col("last"), "left").select(
        F.col("o_orderkey").alias("comparison_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("run_on"),
        F.col("last").isNotNull().alias("is_latest_day"))


@query("G6_bounded_history", f"""WITH {ALERTS}
SELECT alert_id, portfolio_id, rn <= 200 AS in_memory FROM (
  SELECT alert_id, portfolio_id, row_number() OVER (ORDER BY created_at DESC, alert_id DESC) AS rn FROM alerts WHERE NOT is_duplicate)
WHERE rn <= 500""")
def bounded_history(t: Tables):
    kept = t.alerts.where(~F.col("is_duplicate"))
    stored = storage.newest(kept, "created_at", "alert_id", domain.HISTORY_STORE)
    recent = storage.newest(kept, "created_at", "alert_id", domain.HISTORY_MEMORY).select(F.col("alert_id").alias("recent_id"))
    return stored.join(recent, F.col("alert_id") == F.col("recent_id"), "left").select(
        "alert_id", "portfolio_id", F.col("recent_id").isNotNull().alias("in_memory"))
