"""Landed feed payloads to the one news schema.

Readers name an explicit schema and hand the parsed records to a normaliser; the normalisers also
accept records parsed from a payload column (``from_xml`` / ``from_json``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliowire.functions import text

RSS_ITEM = "title string, link string, pubDate string, description string, content string, author string"
ARTICLES = ("status string, articles array<struct<title:string,description:string,content:string,url:string,"
            "publishedAt:string,author:string,urlToImage:string,source:struct<name:string>>>")
SENTIMENT_FEED = ("feed array<struct<title:string,summary:string,url:string,time_published:string,source:string,"
                  "authors:array<string>,overall_sentiment_label:string,overall_sentiment_score:double,"
                  "ticker_sentiment:array<struct<ticker:string,ticker_sentiment_score:string>>,"
                  "topics:array<struct<topic:string>>>>")
FILING_HITS = ("hits struct<hits:array<struct<_source:struct<form_type:string,display_names:array<string>,"
               "entity_id:string,file_num:string,file_date:string,file_description:string>>>>")
SUBMISSIONS = ("cik string, name string, filings struct<recent:struct<form:array<string>,filingDate:array<string>,"
               "accessionNumber:array<string>,primaryDocDescription:array<string>>>")

FILING_URL = "https://www.sec.gov/Archives/edgar/data/"


def _blank(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def feed_time(value: Column) -> Column:
    """Timestamp of an RFC-822 or ISO-8601 date string, null when it cannot be read."""
    rfc = F.regexp_replace(value, "^[A-Za-z]{3}, *", "")
    return F.coalesce(
        F.try_to_timestamp(rfc, F.lit("d MMM yyyy HH:mm:ss z")),
        F.try_to_timestamp(rfc, F.lit("d MMM yyyy HH:mm:ss Z")),
        F.try_to_timestamp(value),
    )


def read_rss(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", "item").schema(RSS_ITEM).load(path)


#: Characters of an item beyond which it is kept apart.
MOST_ITEM_CHARS = 5_000_000


def stream_rss(spark: SparkSession, path: str, per_batch: int | None = None) -> DataFrame:
    """Items of the feed files that arrive below ``path``, with their file, and the record itself where it cannot be parsed.

    Files are cut at the ends of items and each item is parsed on its own, so a broken one costs no other.
    """
    reader = spark.readStream.option("lineSep", "</item>")
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    cut = reader.text(path).select(F.split("value", "<item(?=[\\s/>])", -1).alias("parts"), F.col("_metadata.file_path").alias("file"))
    # behind what comes before the first item: items that never end, and one that ends where the file was cut
    opened = cut.select("file", F.size("parts").alias("n"), F.posexplode("parts").alias("k", "part")).where("k > 0")
    item = F.concat(F.lit("<item"), "part", F.when(F.col("k") == F.col("n") - 1, "</item>").otherwise(""))
    options = {"rowTag": "item", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "record"}
    return opened.select("file", F.from_xml(item, f"{RSS_ITEM}, record string", options).alias("i")).select("i.*", "file")


def faults(items: DataFrame, most_chars: int = MOST_ITEM_CHARS) -> DataFrame:
    """Items with ``fault``: broken, empty (neither title, summary nor content), unlinked, huge, or null for good ones."""
    texts = [_blank(F.col(c)) for c in ("title", "description", "content")]
    size = sum((F.length(t) for t in texts), F.lit(0))
    return items.withColumn("fault", F.when(F.col("record").isNotNull(), "broken").when(size == 0, "empty").when(
        _blank(F.col("link")) == "", "unlinked").when(size > most_chars, "huge"))


def read_json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def rss_to_news(items: DataFrame, source: Column, ingested_at: Column) -> DataFrame:
    """News rows of RSS items; items without a link are dropped, a missing date becomes the ingest time."""
    title, summary, content = _blank(F.col("title")), _blank(F.col("description")), _blank(F.col("content"))
    return items.where(_blank(F.col("link")) != "").select(
        title.alias("title"), summary.alias("summary"), content.alias("content"), F.col("link").alias("url"),
        source.alias("source"), F.lit("rss").alias("source_type"),
        F.coalesce(feed_time(F.col("pubDate")), ingested_at).alias("published_at"),
        F.lit("en").alias("language"), F.col("author"),
        text.content_hash(title, summary, content).alias("content_hash"),
    )


def regulator_to_news(items: DataFrame, feed: str, ingested_at: Column) -> DataFrame:
    """News rows of a regulator's RSS feed, hashed on title and summary only."""
    title, summary = _blank(F.col("title")), _blank(F.col("description"))
    return items.where(_blank(F.col("link")) != "").select(
        title.alias("title"), summary.alias("summary"), F.lit("").alias("content"), F.col("link").alias("url"),
        F.lit(f"cnmv_{feed}").alias("source"), F.lit("cnmv").alias("source_type"),
        F.coalesce(feed_time(F.col("pubDate")), ingested_at).alias("published_at"),
        F.lit("es").alias("language"),
        text.content_hash(title, summary).alias("content_hash"),
        F.create_map(F.lit("cnmv_feed"), F.lit(feed)).alias("metadata"),
    )


def articles_to_news(payloads: DataFrame, ingested_at: Column, language: str = "en") -> DataFrame:
    """News rows of article payloads with status ok; articles without url or title are dropped."""
    rows = payloads.where(F.col("status") == "ok").select(F.inline("articles"))
    title, summary, content = _blank(F.col("title")), _blank(F.col("description")), _blank(F.col("content"))
    origin = F.coalesce(F.col("source.name"), F.lit("newsapi"))
    return rows.where((_blank(F.col("url")) != "") & (title != "")).select(
        title.alias("title"), summary.alias("summary"), content.alias("content"), "url",
        F.concat(F.lit("newsapi_"), origin).alias("source"), F.lit("newsapi").alias("source_type"),
        F.coalesce(F.try_to_timestamp("publishedAt"), ingested_at).alias("published_at"),
        F.lit(language).alias("language"), "author",
        text.content_hash(title, summary, content).alias("content_hash"),
        F.create_map(F.lit("newsapi_source"), origin, F.lit("image_url"), F.col("urlToImage")).alias("metadata"),
    )


def sentiment_feed_to_news(payloads: DataFrame, ingested_at: Column) -> DataFrame:
    """News rows of a sentiment-annotated feed, with the mentioned tickers and the overall sentiment."""
    rows = payloads.select(F.inline("feed"))
    title, summary = _blank(F.col("title")), _blank(F.col("summary"))
    return rows.where((_blank(F.col("url")) != "") & (title != "")).select(
        title.alias("title"), summary.alias("summary"), F.lit("").alias("content"), "url",
        F.concat(F.lit("alphavantage_"), F.coalesce("source", F.lit("alphavantage"))).alias("source"),
        F.lit("alphavantage").alias("source_type"),
        F.coalesce(F.try_to_timestamp("time_published", F.lit("yyyyMMdd'T'HHmmss")), ingested_at).alias("published_at"),
        F.lit("en").alias("language"),
        F.array_join(F.coalesce("authors", F.array().cast("array<string>")), ", ").alias("author"),
        text.content_hash(title, summary).alias("content_hash"),
        F.transform(F.coalesce("ticker_sentiment", F.array().cast("array<struct<ticker:string,ticker_sentiment_score:string>>")),
                    lambda t: _blank(t["ticker"])).alias("entities_raw"),
        F.create_map(
            F.lit("av_sentiment"), F.coalesce("overall_sentiment_label", F.lit("Neutral")),
            F.lit("av_sentiment_score"), F.coalesce("overall_sentiment_score", F.lit(0.0)).cast("string"),
        ).alias("metadata"),
    )


def filing_hits_to_news(payloads: DataFrame, ingested_at: Column, limit: int = 20) -> DataFrame:
    """News rows of the first ``limit`` hits of each filing search."""
    hits = payloads.select(F.explode(F.slice("hits.hits", 1, limit)).alias("hit")).select("hit._source.*")
    url = F.concat(F.lit(FILING_URL), _blank(F.col("entity_id")), F.lit("/"), _blank(F.col("file_num")))
    company = _blank(F.try_element_at("display_names", F.lit(1)))
    title = F.concat(F.lit("["), F.coalesce("form_type", F.lit("Filing")), F.lit("] "), company)
    return hits.select(
        title.alias("title"), _blank(F.col("file_description")).alias("summary"), url.alias("url"),
        F.lit("sec_edgar").alias("source"), F.lit("sec_edgar").alias("source_type"),
        F.coalesce(F.try_to_timestamp("file_date", F.lit("yyyy-MM-dd")), ingested_at).alias("published_at"),
        F.lit("en").alias("language"), F.sha2(url, 256).alias("content_hash"),
        F.create_map(F.lit("form_type"), F.col("form_type"), F.lit("cik"), F.col("entity_id")).alias("metadata"),
    )


def company_filings_to_news(payloads: DataFrame, ingested_at: Column, limit: int = 10) -> DataFrame:
    """News rows of a company's recent filings, whose attributes arrive as parallel arrays."""
    recent = F.col("filings.recent")
    zipped = F.arrays_zip(
        recent["form"].alias("form"), recent["filingDate"].alias("filed"),
        recent["accessionNumber"].alias("accession"), recent["primaryDocDescription"].alias("about"),
    )
    cik = F.lpad("cik", 10, "0")
    rows = payloads.select(
        "cik", cik.alias("padded"), F.coalesce("name", F.lit("Unknown")).alias("company"),
        F.inline(F.slice(zipped, F.lit(1), F.least(F.lit(limit), F.size(recent["form"])))),
    )
    url = F.concat(F.lit(FILING_URL), "padded", F.lit("/"), F.replace(_blank(F.col("accession")), F.lit("-"), F.lit("")))
    return rows.select(
        F.concat(F.lit("["), "form", F.lit("] "), "company").alias("title"), _blank(F.col("about")).alias("summary"),
        url.alias("url"), F.lit("sec_edgar").alias("source"), F.lit("sec_edgar").alias("source_type"),
        F.coalesce(F.try_to_timestamp("filed", F.lit("yyyy-MM-dd")), ingested_at).alias("published_at"),
        F.lit("en").alias("language"), F.sha2(url, 256).alias("content_hash"),
        F.create_map(F.lit("form_type"), F.col("form"), F.lit("cik"), F.col("cik"), F.lit("company"), F.col("company")).alias("metadata"),
    )
