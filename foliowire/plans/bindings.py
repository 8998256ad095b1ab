"""How the domain tables (news, alerts, holdings, prices, ...) are derived from the given tables.

Each binding exists twice: as a DataFrame below, and as a SQL common table expression that the
oracle statements prepend. Both read whole tables.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# --- SQL side ---------------------------------------------------------------------------------

ALERTS = """alerts AS (
  SELECT event_id AS alert_id, 'u' || user_id AS portfolio_id, user_id, ts AS created_at, raw_type, event_type,
         direction, severity, confidence, relevance, is_duplicate, sentiment, news_title, k,
         CASE WHEN severity >= 0.8 THEN 'muy_alta' WHEN severity >= 0.6 THEN 'alta' WHEN severity >= 0.4 THEN 'media'
              WHEN severity >= 0.2 THEN 'baja' ELSE 'muy_baja' END AS severity_label
  FROM (SELECT event_id, user_id, ts, event_type AS raw_type,
               CASE event_type WHEN 'click' THEN 'macroeconomia' WHEN 'purchase' THEN 'fusion_adquisicion'
                    WHEN 'signup' THEN 'cambio_directivo' WHEN 'error' THEN 'incidencia_operativa' ELSE 'otro' END AS event_type,
               CASE WHEN event_type IN ('purchase', 'signup') THEN 'alcista' WHEN event_type = 'error' THEN 'bajista'
                    ELSE 'neutral' END AS direction,
               CASE WHEN event_type IN ('purchase', 'signup') THEN 'positive' WHEN event_type = 'error' THEN 'negative'
                    ELSE 'neutral' END AS sentiment,
               least(value / 200, 1) AS severity, k, k / 100.0::DOUBLE AS confidence, (k * 7 % 100) / 100.0::DOUBLE AS relevance,
               k < 10 AS is_duplicate, 'Noticia ' || event_id AS news_title
        FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events)))"""

PORTFOLIO_ASSETS = """portfolio_assets AS (
  SELECT 'P' || c_custkey AS portfolio_id, 'U' || c_nationkey AS user_id, c_custkey, CAST(i AS INTEGER) AS pos,
         'T' || ((c_custkey * 7 + i * 13) % 97) AS ticker, 'Compañía ' || ((c_custkey * 7 + i * 13) % 97) || ' S.A.' AS name,
         CASE i WHEN 1 THEN 'tech' WHEN 2 THEN 'Financials' WHEN 3 THEN 'health care' WHEN 4 THEN 'Energy' END AS sector,
         CASE (c_custkey + i) % 5 WHEN 0 THEN 'usa' WHEN 1 THEN 'Spain' WHEN 2 THEN 'Japan' WHEN 3 THEN 'china' ELSE '' END AS country,
         ((c_custkey * i) % 10) / 10.0::DOUBLE AS weight, 'Alias ' || i AS alias
  FROM customer, unnest(range(1, 2 + c_custkey % 5)) AS r(i))"""

NEWS = """news AS (
  SELECT doc_id AS news_id, 'https://feed.example/' || sha256(text) AS url, source, lang,
         trim(split_part(text, '.', 1)) AS title, text AS content,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(doc_id AS INTEGER)) AS published_at
  FROM documents)"""

HOLDINGS = """holdings AS (
  SELECT o_custkey AS portfolio_id, l_partkey AS asset_id, min(l_suppkey) AS suppkey, round(sum(l_extendedprice), 2) AS amount
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2),
assets AS (
  SELECT portfolio_id, asset_id, p_name AS name, amount,
         CASE p_type WHEN 'STANDARD' THEN 'tech' WHEN 'ECONOMY' THEN 'Financials' WHEN 'LARGE' THEN 'health care'
              WHEN 'PROMO' THEN 'Energy' WHEN 'SMALL' THEN 'consumer staples' ELSE 'Luxury' END AS raw_sector,
         CASE r_name WHEN 'AFRICA' THEN 'South Africa' WHEN 'AMERICA' THEN 'USA' WHEN 'ASIA' THEN ' japan '
              WHEN 'EUROPE' THEN 'Spain' END AS raw_country
  FROM holdings JOIN part ON p_partkey = asset_id JOIN supplier ON s_suppkey = suppkey
       JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey)"""

DAILY = """daily AS (
  SELECT p_type AS ticker, CAST(l_shipdate AS DATE) AS dt, sum(l_extendedprice) / sum(l_quantity) AS close
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
market AS (
  SELECT CAST(l_shipdate AS DATE) AS dt, sum(l_extendedprice) / sum(l_quantity) AS close FROM lineitem GROUP BY 1)"""

RETURNS = DAILY + """,
asset_returns AS (
  SELECT ticker, dt, ret FROM (
    SELECT ticker, dt, close / lag(close) OVER (PARTITION BY ticker ORDER BY dt) - 1 AS ret FROM daily) WHERE ret IS NOT NULL),
market_returns AS (
  SELECT dt, ret FROM (SELECT dt, close / lag(close) OVER (ORDER BY dt) - 1 AS ret FROM market) WHERE ret IS NOT NULL)"""

ALERT_EVENTS = """alert_events AS (
  SELECT DISTINCT o_orderkey AS alert_id, p_type AS ticker, CAST(o_orderdate AS DATE) AS event_date,
         CASE o_orderstatus WHEN 'O' THEN 'alcista' WHEN 'F' THEN 'bajista' ELSE 'neutral' END AS direction,
         o_totalprice / 500000 AS severity
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""

MONTHLY = """monthly AS (
  SELECT p_type AS ticker, CAST(date_trunc('month', l_shipdate) AS DATE) AS dt, sum(l_extendedprice) / sum(l_quantity) AS close
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
monthly_market AS (
  SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS dt, sum(l_extendedprice) / sum(l_quantity) AS close
  FROM lineitem GROUP BY 1),
monthly_returns AS (
  SELECT ticker, dt, ret FROM (
    SELECT ticker, dt, close / lag(close) OVER (PARTITION BY ticker ORDER BY dt) - 1 AS ret FROM monthly) WHERE ret IS NOT NULL),
monthly_benchmark AS (
  SELECT dt, ret FROM (SELECT dt, close / lag(close) OVER (ORDER BY dt) - 1 AS ret FROM monthly_market) WHERE ret IS NOT NULL),
raw_weights AS (
  SELECT c_nationkey AS portfolio_id, p_type AS ticker, round(sum(l_extendedprice), 2) AS weight
  FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey
       JOIN part ON p_partkey = l_partkey GROUP BY 1, 2)"""

ANSWERS = """answers AS (
  SELECT c_custkey AS user_id, q.question_id,
         split_part(q.question_id, '_', 1) || '_' || substr('abcdefgh', CAST(1 + (c_custkey * q.step + q.num) % 6 AS INTEGER), 1) AS option_id
  FROM customer, (VALUES ('q1_horizon', 1, 1), ('q2_goal', 2, 3), ('q3_loss_reaction', 3, 5), ('q4_knowledge', 4, 7),
                         ('q5_experience', 5, 11), ('q6_income_stability', 6, 13), ('q7_liquidity', 7, 17),
                         ('q8_max_loss', 8, 19), ('q9_esg', 9, 23)) AS q(question_id, num, step)
  WHERE (c_custkey + q.num) % 7 <> 0
  UNION ALL
  SELECT c_custkey, 'q10_sectors', 'q10_' || substr('abcdefgh', CAST(1 + c_custkey % 8 AS INTEGER), 1) || ', q10_'
         || substr('abcdefgh', CAST(1 + c_custkey * 3 % 8 AS INTEGER), 1)
  FROM customer WHERE c_custkey % 4 <> 1)"""

WATCH = """watch AS (
  SELECT 'W' || (item_id % 4) AS portfolio_id, item_id AS pos, w[n] AS ticker, w[h + 1] || ' ' || w[h + 2] || ' Inc.' AS name,
         w[n - 2] || ' ' || w[n - 1] AS alias, w[n // 3 + 1] AS sector, w[h + 2] AS country
  FROM (SELECT *, len(w) AS n, len(w) // 2 AS h FROM (SELECT item_id, list_filter(string_split_regex(text, '[^\\p{L}]+'), lambda x: x <> '') AS w FROM benchmark)))"""

EMBEDDED_ASSETS = """embedded_assets AS (
  SELECT 'W' || (label % 4) AS portfolio_id, 'L' || label AS ticker, label AS pos, list(m ORDER BY i) AS vector
  FROM (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM embeddings, unnest(range(1, 65)) AS r(i) GROUP BY 1, 2)
  GROUP BY label)"""

# --- DataFrame side ----------------------------------------------------------------------------

_LETTERS = "abcdefgh"


class Tables:
    """The given tables of one scale-factor folder and the domain tables derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getitem__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def alerts(self) -> DataFrame:
        raw = F.col("raw_type")
        k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
        return (
            self["events"]
            .withColumnRenamed("event_type", "raw_type")
            .select(
                F.col("event_id").alias("alert_id"),
                F.concat(F.lit("u"), "user_id").alias("portfolio_id"),
                "user_id",
                F.col("ts").alias("created_at"),
                "raw_type",
                F.when(raw == "click", "macroeconomia").when(raw == "purchase", "fusion_adquisicion")
                .when(raw == "signup", "cambio_directivo").when(raw == "error", "incidencia_operativa")
                .otherwise("otro").alias("event_type"),
                F.when(raw.isin("purchase", "signup"), "alcista").when(raw == "error", "bajista")
                .otherwise("neutral").alias("direction"),
                F.when(raw.isin("purchase", "signup"), "positive").when(raw == "error", "negative")
                .otherwise("neutral").alias("sentiment"),
                F.least(F.col("value") / 200, F.lit(1.0)).alias("severity"),
                k.alias("k"),
                (k / F.lit(100.0)).alias("confidence"),
                ((k * 7 % 100) / F.lit(100.0)).alias("relevance"),
                (k < 10).alias("is_duplicate"),
                F.concat(F.lit("Noticia "), "event_id").alias("news_title"),
            )
            .withColumn("severity_label", _severity_label("severity"))
        )

    @cached_property
    def portfolios(self) -> DataFrame:
        """Portfolios with their assets nested, one per customer row."""
        key = F.col("c_custkey")

        def asset(i):
            number = (key * 7 + i * 13) % 97
            place = (key + i) % 5
            return F.struct(
                i.cast("int").alias("pos"),
                F.concat(F.lit("T"), number).alias("ticker"),
                F.concat(F.lit("Compañía "), number, F.lit(" S.A.")).alias("name"),
                F.when(i == 1, "tech").when(i == 2, "Financials").when(i == 3, "health care")
                .when(i == 4, "Energy").alias("sector"),
                F.when(place == 0, "usa").when(place == 1, "Spain").when(place == 2, "Japan")
                .when(place == 3, "china").otherwise("").alias("country"),
                ((key * i) % 10 / F.lit(10.0)).alias("weight"),
                F.array(F.concat(F.lit("Alias "), i)).alias("aliases"),
            )

        return self["customer"].select(
            F.concat(F.lit("P"), key).alias("portfolio_id"),
            F.concat(F.lit("U"), "c_nationkey").alias("user_id"),
            F.transform(F.sequence(F.lit(1).cast("bigint"), 1 + key % 5), asset).alias("assets"),
        )

    @cached_property
    def news(self) -> DataFrame:
        return self["documents"].select(
            F.col("doc_id").alias("news_id"),
            F.concat(F.lit("https://feed.example/"), F.sha2("text", 256)).alias("url"),
            "source",
            "lang",
            F.trim(F.split_part("text", F.lit("."), F.lit(1))).alias("title"),
            F.col("text").alias("content"),
            F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + doc_id * INTERVAL '1' MINUTE").alias("published_at"),
        )

    @cached_property
    def holdings(self) -> DataFrame:
        """Flat holdings with raw sector and country spellings."""
        held = (
            self["orders"].select("o_orderkey", "o_custkey")
            .join(self["lineitem"].select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice"),
                  F.col("l_orderkey") == F.col("o_orderkey"))
            .groupBy(F.col("o_custkey").alias("portfolio_id"), F.col("l_partkey").alias("asset_id"))
            .agg(F.min("l_suppkey").alias("suppkey"), F.round(F.sum("l_extendedprice"), 2).alias("amount"))
        )
        kind, region = F.col("p_type"), F.col("r_name")
        places = (
            self["supplier"].select("s_suppkey", "s_nationkey")
            .join(self["nation"].select("n_nationkey", "n_regionkey"), F.col("s_nationkey") == F.col("n_nationkey"))
            .join(self["region"], F.col("n_regionkey") == F.col("r_regionkey"))
            .select("s_suppkey", "r_name")
        )
        return (
            held.join(self["part"].select("p_partkey", "p_type", "p_name"), F.col("asset_id") == F.col("p_partkey"))
            .join(places, F.col("suppkey") == F.col("s_suppkey"))
            .select(
                "portfolio_id", "asset_id", F.col("p_name").alias("name"), "amount",
                F.when(kind == "STANDARD", "tech").when(kind == "ECONOMY", "Financials").when(kind == "LARGE", "health care")
                .when(kind == "PROMO", "Energy").when(kind == "SMALL", "consumer staples").otherwise("Luxury").alias("raw_sector"),
                F.when(region == "AFRICA", "South Africa").when(region == "AMERICA", "USA").when(region == "ASIA", " japan ")
                .when(region == "EUROPE", "Spain").alias("raw_country"),
            )
        )

    def _periods(self, unit: str) -> DataFrame:
        """Turnover and quantity per ticker and period: the part names join first, then one aggregation combines on the map side."""
        day = F.trunc(F.to_date("l_shipdate"), "month") if unit == "month" else F.to_date("l_shipdate")
        return (
            self["lineitem"].select("l_partkey", day.alias("dt"), "l_extendedprice", "l_quantity")
            .join(self["part"].select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
            .groupBy(F.col("p_type").alias("ticker"), "dt")
            .agg(F.sum("l_extendedprice").alias("turnover"), F.sum("l_quantity").alias("quantity"))
        )

    def _closes(self, unit: str) -> DataFrame:
        return self._periods(unit).select("ticker", "dt", (F.col("turnover") / F.col("quantity")).alias("close"))

    def _market(self, unit: str) -> DataFrame:
        """All tickers together, from the same aggregation."""
        return (
            self._periods(unit).groupBy("dt")
            .agg((F.sum("turnover") / F.sum("quantity")).alias("close"))
            .withColumn("ticker", F.lit("MARKET"))
        )

    @cached_property
    def daily(self) -> DataFrame:
        return self._closes("day")

    @cached_property
    def market(self) -> DataFrame:
        return self._market("day")

    @cached_property
    def monthly(self) -> DataFrame:
        return self._closes("month")

    @cached_property
    def monthly_market(self) -> DataFrame:
        return self._market("month")

    @cached_property
    def alert_events(self) -> DataFrame:
        """One row per alert and affected ticker: an order and the distinct part types on it."""
        tickers = (
            self["lineitem"].select("l_orderkey", "l_partkey")
            .join(self["part"].select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
            .select("l_orderkey", F.col("p_type").alias("ticker"))
            .distinct()
        )
        status = F.col("o_orderstatus")
        return self["orders"].join(tickers, F.col("l_orderkey") == F.col("o_orderkey")).select(
            F.col("o_orderkey").alias("alert_id"),
            "ticker",
            F.to_date("o_orderdate").alias("event_date"),
            F.when(status == "O", "alcista").when(status == "F", "bajista").otherwise("neutral").alias("direction"),
            (F.col("o_totalprice") / 500000).alias("severity"),
        )

    @cached_property
    def weights(self) -> DataFrame:
        """Portfolio weights by ticker: a customer nation's turnover per part type."""
        by_customer = (
            self["orders"].select("o_orderkey", "o_custkey")
            .join(self["lineitem"].select("l_orderkey", "l_partkey", "l_extendedprice"),
                  F.col("l_orderkey") == F.col("o_orderkey"))
            .join(self["part"].select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
            .groupBy("o_custkey", "p_type").agg(F.sum("l_extendedprice").alias("turnover"))
        )
        return (
            by_customer.join(self["customer"].select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
            .groupBy(F.col("c_nationkey").alias("portfolio_id"), F.col("p_type").alias("ticker"))
            .agg(F.round(F.sum("turnover"), 2).alias("weight"))
        )

    @cached_property
    def answers(self) -> DataFrame:
        key = F.col("c_custkey")
        asked = (("q1_horizon", 1, 1), ("q2_goal", 2, 3), ("q3_loss_reaction", 3, 5), ("q4_knowledge", 4, 7),
                 ("q5_experience", 5, 11), ("q6_income_stability", 6, 13), ("q7_liquidity", 7, 17),
                 ("q8_max_loss", 8, 19), ("q9_esg", 9, 23))

        def option(prefix, position):
            return F.concat(F.lit(f"{prefix}_"), F.substring(F.lit(_LETTERS), (1 + position).cast("int"), F.lit(1)))

        rows = [
            F.when((key + num) % 7 != 0, F.struct(F.lit(question).alias("question_id"),
                                                  option(question.split("_")[0], (key * step + num) % 6).alias("option_id")))
            for question, num, step in asked
        ]
        rows.append(F.when(key % 4 != 1, F.struct(
            F.lit("q10_sectors").alias("question_id"),
            F.concat(option("q10", key % 8), F.lit(", "), option("q10", key * 3 % 8)).alias("option_id"))))
        return (
            self["customer"]
            .select(key.alias("user_id"), F.explode(F.array_compact(F.array(*rows))).alias("answer"))
            .select("user_id", "answer.question_id", "answer.option_id")
        )

    @cached_property
    def watch(self) -> DataFrame:
        """Watched assets named after words from the start, the middle and the end of the benchmark passages."""
        words = F.filter(F.split("text", "[^\\p{L}]+"), lambda w: w != "")

        size = F.size("w")
        half = F.floor(size / 2).cast("int")

        def word(i):
            return F.get("w", i - 1)

        return self["benchmark"].select("item_id", words.alias("w")).select(
            F.concat(F.lit("W"), F.col("item_id") % 4).alias("portfolio_id"),
            F.col("item_id").alias("pos"),
            word(size).alias("ticker"),
            F.concat(word(half + 1), F.lit(" "), word(half + 2), F.lit(" Inc.")).alias("name"),
            F.array(F.concat(word(size - 2), F.lit(" "), word(size - 1))).alias("aliases"),
            word(F.floor(size / 3).cast("int") + 1).alias("sector"),
            word(half + 2).alias("country"),
        )

    @cached_property
    def embedded_assets(self) -> DataFrame:
        """One asset per embedding label: the mean vector of the label."""
        vectors = self["embeddings"]
        width = vectors.select(F.max(F.size("embedding"))).first()[0] or 0
        means = [F.avg(F.col("embedding")[i].cast("double")) for i in range(width)]
        return (
            vectors.groupBy("label").agg(F.array(*means).alias("vector"))
            .select(F.concat(F.lit("W"), F.col("label") % 4).alias("portfolio_id"),
                    F.concat(F.lit("L"), "label").alias("ticker"), F.col("label").alias("pos"), "vector")
        )


def _severity_label(column: str):
    from foliowire.functions.scoring import severity_label

    return severity_label(F.col(column))
