"""Queries over text functions, scalar scores, gates, impact and alert statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliowire import domain
from foliowire.functions import scoring, text, vectors
from foliowire.operators import alertstats, gates, impact, prices, storage
from foliowire.plans.bindings import ALERTS, DAILY, NEWS, PORTFOLIO_ASSETS, Tables
from foliowire.plans.registry import query

# White-space class of the SQL side, spelled as RE2 wants it.
_WS = "\\s\\x0B\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"


def _sql_clean(x):
    return (f"trim(regexp_replace(regexp_replace(regexp_replace({x}, '<[^>]+>', ' ', 'g'), "
            f"'https?://[^{_WS}]+', '', 'g'), '[{_WS}]+', ' ', 'g'))")


def _sql_match(x):
    return (f"(' ' || trim(regexp_replace(regexp_replace(strip_accents(lower({x})), '[^\\p{{L}}\\p{{N}}_{_WS}]', ' ', 'g'), "
            f"'[{_WS}]+', ' ', 'g')) || ' ')")


def _sql_case(column, table, default="NULL"):
    whens = " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in table.items())
    return f"CASE {column} {whens} ELSE {default} END"


_LABEL = "CASE WHEN {0} >= 0.8 THEN 'muy_alta' WHEN {0} >= 0.6 THEN 'alta' WHEN {0} >= 0.4 THEN 'media' WHEN {0} >= 0.2 THEN 'baja' ELSE 'muy_baja' END"
_CAR_LABEL = ("CASE WHEN {0} >= 0 AND {0} < 0.005 THEN 'muy_baja' WHEN {0} >= 0.005 AND {0} < 0.015 THEN 'baja' "
              "WHEN {0} >= 0.015 AND {0} < 0.03 THEN 'media' WHEN {0} >= 0.03 AND {0} < 0.06 THEN 'alta' ELSE 'muy_alta' END")


@query("C1_full_text", f"""WITH {NEWS}
SELECT news_id, md5(trim(title || '. ' || coalesce(lang, '') || '. ' || content, '. ')) AS full_md5 FROM news""")
def full_text(t: Tables):
    return t.news.select("news_id", F.md5(text.full_text(F.col("title"), F.col("lang"), F.col("content"))).alias("full_md5"))


@query("C2_clean_pages", f"""SELECT page_id, md5({_sql_clean('html')}) AS clean_md5 FROM pages""")
def clean_pages(t: Tables):
    return t["pages"].select("page_id", F.md5(text.clean(F.col("html"))).alias("clean_md5"))


@query("C2_clean_documents", f"""SELECT doc_id, md5({_sql_clean('text')}) AS clean_md5 FROM documents""")
def clean_documents(t: Tables):
    return t["documents"].select("doc_id", F.md5(text.clean(F.col("text"))).alias("clean_md5"))


@query("C3_char_counts", f"""
SELECT doc_id, CAST(length(c) AS BIGINT) AS n_chars, md5(substr(c, 1, 500)) AS p500, md5(substr(c, 1, 512)) AS p512, md5(substr(c, 1, 1200)) AS p1200,
       md5(substr(c, 1, 1500)) AS p1500, md5(substr(c, 1, 5000)) AS p5000
FROM (SELECT doc_id, {_sql_clean('text')} AS c FROM documents)""")
def char_counts(t: Tables):
    cleaned = t["documents"].select("doc_id", text.clean(F.col("text")).alias("c"))
    return cleaned.select("doc_id", F.length("c").cast("bigint").alias("n_chars"),
                          *[F.md5(F.substring("c", 1, n)).alias(f"p{n}") for n in (500, 512, 1200, 1500, 5000)])


_ES = ", ".join(f"'{w}'" for w in domain.SPANISH_STOP_WORDS)


@query("C4_language_vote", f"""
SELECT doc_id, CASE WHEN len(list_filter(list_filter(string_split_regex(lower(text), '[{_WS}]+'), lambda x: x <> '')[1:50], lambda x: x IN ({_ES}))) > 5
       THEN 'es' ELSE 'en' END AS language FROM documents""")
def language_vote(t: Tables):
    return t["documents"].select("doc_id", text.vote_language(F.col("text")).alias("language"))


_ORG_STOP = ", ".join(f"'{w}'" for w in domain.ORG_STOP_FIRST_WORDS)
# RE2 knows ASCII word boundaries only: other letters become '_', other symbols '-'.
_ASCII = (f"regexp_replace(regexp_replace(regexp_replace(text, '[{_WS}]+', ' ', 'g'), '[^\\x00-\\x7F\\p{{L}}\\p{{N}}]', '-', 'g'), "
          "'[^\\x00-\\x7F]', '_', 'g')")


@query("C5_mined_organisations", f"""
SELECT doc_id, array_to_string(list_filter(list_distinct_ordered, lambda x: split_part(x, ' ', 1) NOT IN ({_ORG_STOP}))[1:10], '|') AS orgs
FROM (SELECT doc_id, list_filter(runs, lambda x, i: list_position(runs, x) = i) AS list_distinct_ordered
      FROM (SELECT doc_id, regexp_extract_all({_ASCII}, '\\b([A-Z][a-z]+(?:[ ]+[A-Z][a-z]+)+)\\b', 1) AS runs FROM documents))""")
def mined_organisations(t: Tables):
    squeezed = F.regexp_replace("text", f"[{text.SPACE}]+", " ")
    return t["documents"].select("doc_id", F.array_join(text.mined_organisations(squeezed), "|").alias("orgs"))


@query("C6_entity_dedup", f"""
SELECT doc_id, entity, label, CAST(min(pos) AS INTEGER) AS start, CAST(count(*) AS BIGINT) AS mentions FROM (
  SELECT doc_id, lower(runs[i]) AS entity, CAST(i - 1 AS INTEGER) AS pos,
         ['ORG', 'PERSON', 'GPE', 'MISC', 'DATE'][1 + length(runs[i]) % 5] AS label
  FROM (SELECT doc_id, regexp_extract_all({_ASCII}, '\\b([A-Z][a-z]+(?:[ ]+[A-Z][a-z]+)+)\\b', 1) AS runs FROM documents),
       unnest(range(1, len(runs) + 1)) AS r(i))
WHERE label <> 'MISC' GROUP BY 1, 2, 3""")
def entity_dedup(t: Tables):
    squeezed = F.regexp_replace("text", f"[{text.SPACE}]+", " ")
    mentions = t["documents"].select("doc_id", F.posexplode(text.capitalised_runs(squeezed)).alias("start", "text"))
    labels = F.array(*[F.lit(x) for x in ("ORG", "PERSON", "GPE", "MISC", "DATE")])
    entities = mentions.withColumn("label", F.element_at(labels, (1 + F.length("text") % 5).cast("int")))
    known = entities.where(F.col("label").isin(*domain.ENTITY_LABELS)).withColumn("entity", F.lower("text"))
    return known.groupBy("doc_id", "entity", "label").agg(F.min("start").alias("start"), F.count(F.lit(1)).alias("mentions"))


@query("C7_strip_accents", "SELECT doc_id, md5(strip_accents(text)) AS bare_md5 FROM documents")
def strip_accents(t: Tables):
    return t["documents"].select("doc_id", F.md5(text.strip_accents(F.col("text"))).alias("bare_md5"))


_COMPANY = ("text || CASE doc_id % 5 WHEN 0 THEN ' S.A.' WHEN 1 THEN ', Inc.' WHEN 2 THEN ' Holdings plc' WHEN 3 THEN ' & Co. GmbH' ELSE '' END")
_SUFFIXES = ", ".join(f"'{w}'" for w in domain.CORPORATE_SUFFIXES)
_SQL_CANONICAL = (f"array_to_string(list_filter(string_split(trim(regexp_replace(regexp_replace(replace(strip_accents(lower(name)), '.', ''), "
                  f"'[^\\p{{L}}\\p{{N}}_{_WS}]', ' ', 'g'), '[{_WS}]+', ' ', 'g')), ' '), lambda x: x <> '' AND x NOT IN ({_SUFFIXES})), ' ')")


def _companies(t: Tables):
    k = F.col("doc_id") % 5
    suffix = F.when(k == 0, " S.A.").when(k == 1, ", Inc.").when(k == 2, " Holdings plc").when(k == 3, " & Co. GmbH").otherwise("")
    return t["documents"].select("doc_id", F.concat("text", suffix).alias("name"))


@query("C8_canonical_name", f"""SELECT doc_id, {_SQL_CANONICAL} AS canonical FROM (SELECT doc_id, {_COMPANY} AS name FROM documents)""")
def canonical_name(t: Tables):
    return _companies(t).select("doc_id", text.canonical_name(F.col("name")).alias("canonical"))


@query("C9_company_root", f"""SELECT doc_id, split_part({_SQL_CANONICAL}, ' ', 1) AS root FROM (SELECT doc_id, {_COMPANY} AS name FROM documents)""")
def company_root(t: Tables):
    return _companies(t).select("doc_id", text.name_root(text.canonical_name(F.col("name"))).alias("root"))


@query("C10_match_text", f"""SELECT doc_id, md5({_sql_match('text')}) AS match_md5 FROM documents""")
def match_text(t: Tables):
    return t["documents"].select("doc_id", F.md5(text.match_text(F.col("text"))).alias("match_md5"))


@query("C11_content_hash", f"""WITH {NEWS}
SELECT news_id, sha256(title || ' ' || lang || ' ' || content) AS full_hash, sha256(title || ' ' || lang) AS short_hash, sha256(url) AS url_hash FROM news""")
def content_hash(t: Tables):
    return t.news.select("news_id", text.content_hash(F.col("title"), F.col("lang"), F.col("content")).alias("full_hash"),
                         text.content_hash(F.col("title"), F.col("lang")).alias("short_hash"), F.sha2("url", 256).alias("url_hash"))


@query("C12_json_extraction", f"""WITH {ALERTS}
SELECT alert_id, CASE WHEN alert_id % 6 = 4 THEN NULL ELSE event_type END AS event_type,
       CASE WHEN alert_id % 6 = 4 THEN NULL ELSE CAST(k AS VARCHAR) END AS severity,
       CASE WHEN alert_id % 6 = 5 THEN '{{"a": 1}}' WHEN alert_id % 6 = 4 THEN 'no answer' ELSE 'object' END AS flat
FROM alerts""")
def json_extraction(t: Tables):
    kind = F.col("alert_id") % 6
    body = F.to_json(F.struct("event_type", F.col("k").alias("severity")))
    raw = (
        F.when(kind == 0, body)
        .when(kind == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(kind == 2, F.concat(F.lit("Sure, here it is: "), body, F.lit(" Hope it helps.")))
        .when(kind == 3, F.concat(F.lit("<think>a {b} c</think>\n"), body))
        .when(kind == 4, F.lit("no answer"))
        .otherwise(F.concat(F.lit('<think>x</think>'), F.regexp_replace(body, "}$", ',"nested":{"a": 1}}')))
    )
    answers = t.alerts.select("alert_id", raw.alias("raw"))
    parsed = answers.select("alert_id", "raw", F.from_json(impact.extract_json(F.col("raw")), "event_type string, severity string").alias("p"))
    flat = impact.first_flat_object(F.col("raw"))
    return parsed.select("alert_id", "p.event_type", "p.severity",
                         F.when(F.col("alert_id") % 6 == 5, flat).when(F.col("alert_id") % 6 == 4, flat).otherwise("object").alias("flat"))


@query("C13_validated_analysis", f"""WITH {ALERTS}
SELECT alert_id, CASE WHEN alert_id % 4 = 0 THEN 'otro' ELSE event_type END AS event_type,
       CASE WHEN alert_id % 5 = 0 THEN 'neutral' ELSE direction END AS direction,
       CASE WHEN alert_id % 3 = 0 THEN 0.5 ELSE least(1.0, greatest(0.0, round(k / 50.0::DOUBLE - 0.3, 4))) END AS severity,
       round(confidence, 4) AS confidence FROM alerts""")
def validated_analysis(t: Tables):
    key = F.col("alert_id")
    raw = t.alerts.select(
        "alert_id", F.when(key % 4 == 0, F.col("raw_type")).otherwise(F.col("event_type")).alias("event_type"),
        F.when(key % 5 == 0, "sideways").otherwise(F.col("direction")).alias("direction"),
        F.when(key % 6 == 0, "high").when(key % 3 != 0, (F.col("k") / F.lit(50.0) - 0.3).cast("string")).alias("severity"),
        F.col("confidence").cast("string").alias("confidence"))
    return impact.validate_analysis(raw)


@query("C14_event_date", """
SELECT event_id, CASE WHEN event_id % 4 IN (0, 1) THEN CAST(ts AS DATE) END AS event_date FROM events""")
def event_date(t: Tables):
    key = F.col("event_id") % 4
    raw = (
        F.when(key == 0, F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
        .when(key == 1, F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")).when(key == 2, F.lit("yesterday")))
    return t["events"].select("event_id", text.event_date(raw).alias("event_date"))


@query("C15_safe_float", """
SELECT event_id, CASE WHEN event_id % 6 < 2 THEN round(value + 0.00001, 4) ELSE 0.0 END AS number,
       CASE WHEN event_id % 6 < 2 THEN round(value + 0.00001, 4) END AS nullable FROM events""")
def safe_float(t: Tables):
    key = F.col("event_id") % 6
    raw = (
        F.when(key < 2, (F.col("value") + 0.00001).cast("string")).when(key == 2, "NaN").when(key == 3, "Infinity")
        .when(key == 4, "n/a"))
    return t["events"].select("event_id", scoring.safe_float(raw).alias("number"), scoring.safe_float(raw, None).alias("nullable"))


@query("C16_severity_band", f"""SELECT event_id, {_LABEL.format('least(value / 200, 1)')} AS label FROM events""")
def severity_band(t: Tables):
    return t["events"].select("event_id", scoring.severity_label(F.least(F.col("value") / 200, F.lit(1.0))).alias("label"))


@query("C17_car_band", f"""SELECT event_id, {_CAR_LABEL.format('(value / 2000)')} AS label FROM events""")
def car_band(t: Tables):
    return t["events"].select("event_id", scoring.abs_car_label(F.col("value") / 2000).alias("label"))


@query("C18_expected_car", f"""WITH {ALERTS}
SELECT alert_id, CASE severity_label WHEN 'muy_baja' THEN 0.0025 WHEN 'baja' THEN 0.01 WHEN 'media' THEN 0.0225
       WHEN 'alta' THEN 0.045 ELSE 0.09 END::DOUBLE AS expected FROM alerts""")
def expected_car(t: Tables):
    return t.alerts.select("alert_id", F.round(scoring.expected_abs_car(F.col("severity_label")), 6).alias("expected"))


@query("C19_sector_region", """
SELECT p_partkey, CASE p_type WHEN 'STANDARD' THEN 'Technology' WHEN 'ECONOMY' THEN 'Financial Services' WHEN 'LARGE' THEN 'Healthcare'
       WHEN 'PROMO' THEN 'Consumer Defensive' WHEN 'SMALL' THEN 'Crypto' ELSE 'Other' END AS sector,
       CASE p_size % 6 WHEN 0 THEN 'United States' WHEN 1 THEN 'Europe' WHEN 2 THEN 'Asia' WHEN 3 THEN 'Emerging Markets' ELSE 'Other' END AS region FROM part""")
def sector_region(t: Tables):
    kind, place = F.col("p_type"), F.col("p_size") % 6
    raw_sector = (
        F.when(kind == "STANDARD", " Information Technology").when(kind == "ECONOMY", "financials").when(kind == "LARGE", "Health Care ")
        .when(kind == "PROMO", "Consumer Staples").when(kind == "SMALL", " Crypto ").when(kind == "MEDIUM", ""))
    raw_country = (
        F.when(place == 0, "USA").when(place == 1, "spain ").when(place == 2, "Hong Kong").when(place == 3, "BRAZIL").when(place == 4, "Kenya"))
    return t["part"].select("p_partkey", scoring.canonical_sector(raw_sector).alias("sector"), scoring.canonical_region(raw_country).alias("region"))


@query("C20_change_pct", f"""WITH {DAILY}
SELECT ticker, dt, CASE WHEN prev > 0 THEN round((close - prev) / prev * 100, 2) ELSE 0 END AS change_pct
FROM (SELECT ticker, dt, close, lag(close) OVER (PARTITION BY ticker ORDER BY dt) AS prev FROM daily)""")
def change_pct(t: Tables):
    return prices.daily_change(t.daily).select("ticker", "dt", "change_pct")


@query("C21_high_distance", f"""WITH {DAILY}
SELECT ticker, dt, round((close - hi) / hi * 100, 6) AS from_high_pct, round((1500 - close) / close * 100, 6) AS upside_pct
FROM (SELECT ticker, dt, close, max(close) OVER (PARTITION BY ticker ORDER BY dt RANGE BETWEEN INTERVAL 364 DAYS PRECEDING AND CURRENT ROW) AS hi FROM daily)""")
def high_distance(t: Tables):
    return prices.high_distance(t.daily, F.lit(1500.0)).select(
        "ticker", "dt", F.round("from_high_pct", 6).alias("from_high_pct"), F.round("upside_pct", 6).alias("upside_pct"))


_EVENT_TEXT_SQL = _sql_case("event_type", domain.EVENT_TEXT)


def _with_assets(t: Tables):
    """Alerts with 0 to 2 assets, a source and, now and then, a supplied explanation."""
    k = F.col("k")
    assets = F.when(k % 3 == 0, F.array().cast("array<string>")).when(k % 3 == 1, F.array(F.concat(F.lit("T"), k))).otherwise(
        F.array(F.concat(F.lit("T"), k), F.lit("SPY")))
    return t.alerts.withColumn("matched_assets", assets).withColumn("news_source", F.concat(F.lit("feed"), F.col("user_id") % 4)).withColumn(
        "supplied", F.when(F.col("alert_id") % 7 == 0, "Subida esperada..").when(F.col("alert_id") % 7 == 1, ""))


_WITH_ASSETS = ALERTS + """,
full_alerts AS (SELECT *, CASE k % 3 WHEN 0 THEN '' WHEN 1 THEN 'T' || k ELSE 'T' || k || ', SPY' END AS assets, 'feed' || user_id % 4 AS news_source FROM alerts)"""


@query("C22_explanation", f"""WITH {_WITH_ASSETS}
SELECT alert_id, CASE WHEN alert_id % 7 = 0 THEN 'Subida esperada. Confianza: ' || printf('%.2f', confidence) || '. Fuente: ' || news_source || '.' ELSE
  'Posible alerta ' || direction || ' de severidad ' || severity_label || ' para ' || CASE assets WHEN '' THEN 'cartera general' ELSE assets END
  || '. Evento detectado: ' || {_EVENT_TEXT_SQL} || '. Relevancia: ' || CASE WHEN relevance >= 0.8 THEN 'mención directa de activo en cartera'
  WHEN relevance >= 0.5 THEN 'alta similitud semántica con la cartera' ELSE 'relevancia indirecta por sector o geografía' END
  || CASE WHEN sentiment <> 'neutral' THEN '; sentimiento ' || sentiment || ' detectado por FinBERT' ELSE '' END
  || '. Confianza: ' || printf('%.2f', confidence) || '. Fuente: ' || news_source || '.' END AS explanation
FROM full_alerts""")
def explanation(t: Tables):
    c = F.col
    return _with_assets(t).select("alert_id", text.alert_explanation(
        c("news_title"), c("matched_assets"), c("event_type"), c("direction"), c("severity_label"), c("confidence"), c("relevance"),
        c("news_source"), c("sentiment"), c("supplied")).alias("explanation"))


@query("C23_asset_description", f"""WITH {PORTFOLIO_ASSETS}
SELECT portfolio_id, string_agg(concat_ws(', ', name, ticker, sector, nullif(country, '')), ' / ' ORDER BY pos) AS assets,
  string_agg(ticker || ' — ' || name || coalesce(' | Sector: ' || sector, '') || coalesce(' | País: ' || nullif(country, ''), '')
  || CASE WHEN weight > 0 THEN ' | Peso: ' || printf('%.1f', weight * 100) || '%' ELSE '' END, chr(10) ORDER BY pos) AS lines
FROM portfolio_assets GROUP BY 1""")
def asset_description(t: Tables):
    from foliowire.functions.portfolio_text import portfolio_lines

    described = F.transform("assets", lambda a: text.asset_description(a["name"], a["ticker"], a["sector"], a["country"]))
    return t.portfolios.select("portfolio_id", F.array_join(described, " / ").alias("assets"), portfolio_lines(F.col("assets")).alias("lines"))


_ICON_SQL = _sql_case("severity_label", domain.SEVERITY_ICON)


@query("C24_notification", f"""WITH {_WITH_ASSETS}
SELECT alert_id, {_ICON_SQL} || ' Alerta ' || direction || ' (' || severity_label || ') — ' || CASE assets WHEN '' THEN 'cartera' ELSE assets END AS subject,
  md5('ALERTA: ' || news_title || chr(10) || chr(10) || 'Dirección: ' || direction || chr(10) || 'Severidad: ' || severity_label || ' (' || printf('%.2f', severity)
  || ')' || chr(10) || 'Confianza: ' || printf('%.2f', confidence) || chr(10) || 'Activos: ' || assets || chr(10) || 'Evento: ' || event_type || chr(10)
  || 'Sentimiento: ' || sentiment || chr(10) || chr(10) || 'Explicación: ' || raw_type || chr(10) || chr(10) || 'Fuente: ' || news_source || chr(10) || 'URL: ') AS body_md5,
  '{{"alert_id":' || alert_id || ',"direction":"' || direction || '","event_type":"' || event_type || '"}}' AS payload
FROM (SELECT * REPLACE (floor(severity * 1000) / 1000 + 0.0001 AS severity) FROM full_alerts)""")
def notification(t: Tables):
    c = F.col
    # Severity is nudged off the two-decimal ties, where the engines' printf differ.
    alerts = _with_assets(t).withColumn("severity", F.floor(c("severity") * 1000) / 1000 + 0.0001)
    fields = {"title": c("news_title"), "direction": c("direction"), "severity_label": c("severity_label"), "severity": c("severity"),
              "confidence": c("confidence"), "assets": c("matched_assets"), "event_type": c("event_type"), "sentiment": c("sentiment"),
              "explanation": c("raw_type"), "source": c("news_source"), "url": F.lit("")}
    return alerts.select("alert_id", text.alert_subject(c("severity_label"), c("direction"), c("matched_assets")).alias("subject"),
                         F.md5(text.alert_body(fields)).alias("body_md5"),
                         F.to_json(F.struct("alert_id", "direction", "event_type")).alias("payload"))


@query("C25_pretty_label", f"""WITH {ALERTS}
SELECT alert_id, array_to_string(list_transform(string_split(replace(event_type, '_', ' '), ' '), lambda x: upper(x[1]) || x[2:]), ' ') AS label FROM alerts""")
def pretty_label(t: Tables):
    return t.alerts.select("alert_id", text.pretty_label(F.col("event_type")).alias("label"))


@query("C26_relative_age", """
SELECT event_id, CASE WHEN m < 1 THEN 'Ahora' WHEN m < 60 THEN 'Hace ' || m || 'm' WHEN m // 60 < 24 THEN 'Hace ' || m // 60 || 'h'
       WHEN m // 1440 < 7 THEN 'Hace ' || m // 1440 || 'd' ELSE strftime(ts, '%Y-%m-%d %H:%M') END AS age
FROM (SELECT event_id, ts, CAST(floor((epoch(TIMESTAMP '2024-01-31 00:00:00') - floor(epoch(ts))) / 60) AS BIGINT) AS m FROM events)""")
def relative_age(t: Tables):
    return t["events"].select("event_id", text.age_label(F.col("ts"), F.to_timestamp(F.lit("2024-01-31 00:00:00"))).alias("age"))


@query("C27_cosine", """
SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) + 0.0::DOUBLE AS cosine
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def cosine(t: Tables):
    e = t["embeddings"]
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return e.join(after, "vec_id").select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("next")), 6).alias("cosine"))


# --- Gates, impact ------------------------------------------------------------------------------

@query("B4_history_view", f"""WITH {_WITH_ASSETS}
SELECT news_title AS Titular, event_type AS Evento, direction AS Dirección, severity_label AS Severidad, printf('%.2f', severity) AS Score,
       printf('%.2f', confidence) AS Confianza, assets AS Activos, news_source AS Fuente FROM (SELECT * REPLACE (floor(severity * 1000) / 1000 + 0.0001 AS severity) FROM full_alerts)""")
def history_view(t: Tables):
    return alertstats.history_view(_with_assets(t).withColumn("severity", F.floor(F.col("severity") * 1000) / 1000 + 0.0001))


@query("B5_relevance_gate", f"""WITH {ALERTS}
SELECT alert_id, CASE WHEN relevance >= 0.5 THEN 'pass' WHEN relevance >= 0.3 THEN 'borderline' ELSE 'drop' END AS gate FROM alerts""")
def relevance_gate(t: Tables):
    return t.alerts.select("alert_id", gates.relevance_gate(F.col("relevance")).alias("gate"))


@query("B6_severity_gates", f"""WITH {ALERTS}
SELECT alert_id FROM alerts WHERE confidence >= 0.15 AND severity >= 0.3""")
def severity_gates(t: Tables):
    return gates.severity_gates(t.alerts, "confidence", "severity").select("alert_id")


@query("B7_discard_stage", f"""WITH {ALERTS}
SELECT alert_id, CASE WHEN k = 13 THEN 'error' WHEN relevance >= 0.3 AND relevance < 0.5 AND alert_id % 2 = 0 AND raw_type <> 'click' THEN 'relevance_llm'
       WHEN CASE WHEN relevance >= 0.3 AND relevance < 0.5 AND alert_id % 2 = 0 THEN 0.6 ELSE relevance END < 0.5 THEN 'relevance' END AS discarded_at FROM alerts""")
def discard_stage(t: Tables):
    full = F.col("alert_id") % 2 == 0
    gate = gates.relevance_gate(F.col("relevance"))
    score = F.when(full & (gate == "borderline"), 0.6).otherwise(F.col("relevance"))
    return t.alerts.select("alert_id", gates.discard_stage(F.col("k") == 13, gate, F.col("raw_type") == "click", score, full).alias("discarded_at"))


@query("B8_direction_points", f"""WITH {ALERTS}
SELECT alert_id, direction, severity, confidence FROM alerts WHERE direction IN ('alcista', 'bajista', 'neutral')""")
def direction_points(t: Tables):
    return alertstats.direction_points(t.alerts)


@query("B9_positive_weights", f"""WITH {PORTFOLIO_ASSETS} SELECT portfolio_id, ticker, weight FROM portfolio_assets WHERE weight > 0""")
def positive_weights(t: Tables):
    return alertstats.positive_weights(t.portfolios.select("portfolio_id", F.inline("assets"))).select("portfolio_id", "ticker", "weight")


@query("D11_borderline_rescue", f"""WITH {ALERTS}
SELECT alert_id, CASE WHEN relevance < 0.5 THEN greatest(relevance, confidence) ELSE relevance END AS relevance,
       CASE WHEN relevance < 0.5 AND k % 4 <> 0 THEN 'T1,T2' ELSE 'T1' END AS assets
FROM alerts WHERE relevance >= 0.5 OR (relevance >= 0.3 AND alert_id % 3 <> 0 AND raw_type <> 'view')""")
def borderline_rescue(t: Tables):
    scored = t.alerts.select("alert_id", "relevance", F.array(F.lit("T1")).alias("matched_assets"))
    verdicts = t.alerts.where("alert_id % 3 <> 0").select(
        "alert_id", (F.col("raw_type") != "view").alias("is_relevant"), F.col("confidence").alias("relevance_score"),
        F.when(F.col("k") % 4 == 0, F.array(F.lit("T1"))).otherwise(F.array(F.lit("T2"), F.lit("T1"))).alias("affected_assets"))
    kept = gates.rescue_borderline(scored, verdicts, ["alert_id"])
    return kept.select("alert_id", "relevance", F.array_join("matched_assets", ",").alias("assets"))


_BASE = "CASE e WHEN 'macroeconomia' THEN 0.5 WHEN 'fusion_adquisicion' THEN 0.7 WHEN 'cambio_directivo' THEN 0.5 WHEN 'incidencia_operativa' THEN 0.6 ELSE 0.3 END::DOUBLE"
_BIAS = "CASE e WHEN 'fusion_adquisicion' THEN 0.1 WHEN 'incidencia_operativa' THEN -0.3 ELSE 0 END::DOUBLE"
_IMPACT = f"""{ALERTS},
inputs AS (SELECT *, CASE WHEN k = 50 THEN 'unknown' ELSE event_type END AS e, (k * 3 % 100) / 100.0::DOUBLE + 0.001 AS sc, k % 8 AS na,
                  (k * 11 % 100) / 100.0::DOUBLE AS ec FROM alerts),
scores AS (SELECT *, {_BASE} AS base, {_BIAS} AS bias FROM inputs),
raw_impact AS (
  SELECT alert_id, k, direction AS given_direction, e, base, bias, least(1.0, 0.3 * sc + 0.4 * ec + 0.3 * relevance) AS conf,
         CASE sentiment WHEN 'positive' THEN 0.5 + 0.3 * sc + 0.2 * bias WHEN 'negative' THEN -0.5 - 0.3 * sc + 0.2 * bias ELSE 0.5 * bias END AS ds,
         least(1.0, base * (0.7 + 0.3 * relevance) * CASE WHEN sc > 0.8 THEN 1.1 ELSE 1 END * CASE WHEN na > 1 THEN 1 + 0.05 * least(na, 5) ELSE 1 END) AS sev
  FROM scores),
impacts AS (
  SELECT *, CASE WHEN ds > 0.15 THEN 'alcista' WHEN ds < -0.15 THEN 'bajista' ELSE 'neutral' END AS dir FROM raw_impact)"""


def _impact_inputs(t: Tables):
    k = F.col("k")
    return t.alerts.select(
        "alert_id", "k", "sentiment", "relevance", F.col("direction").alias("given_direction"),
        F.when(k == 50, "unknown").otherwise(F.col("event_type")).alias("event_type"),
        ((k * 3 % 100) / F.lit(100.0) + 0.001).alias("sentiment_confidence"), ((k * 11 % 100) / F.lit(100.0)).alias("event_confidence"),
        F.slice(F.array(*[F.lit(f"T{i}") for i in range(8)]), F.lit(1), k % 8).alias("matched_assets"))


@query("D12_impact_priors", f"""WITH {_IMPACT} SELECT alert_id, base AS base_severity, bias AS direction_bias FROM impacts""")
def impact_priors(t: Tables):
    base, bias = impact.event_priors(F.col("event_type"))
    return _impact_inputs(t).select("alert_id", base.alias("base_severity"), bias.alias("direction_bias"))


@query("E2_impact_direction", f"""WITH {_IMPACT} SELECT alert_id, dir AS direction, round(ds, 6) AS score FROM impacts""")
def impact_direction(t: Tables):
    _, bias = impact.event_priors(F.col("event_type"))
    score = impact.direction_score(F.col("sentiment"), F.col("sentiment_confidence"), bias)
    return _impact_inputs(t).select("alert_id", scoring.direction_from_score(score).alias("direction"), F.round(score, 6).alias("score"))


@query("E3_impact_severity", f"""WITH {_IMPACT} SELECT alert_id, round(sev, 9) AS severity, {_LABEL.format('sev')} AS label FROM impacts""")
def impact_severity(t: Tables):
    base, _ = impact.event_priors(F.col("event_type"))
    severity = impact.impact_severity(base, F.col("relevance"), F.col("sentiment_confidence"), F.size("matched_assets"))
    return _impact_inputs(t).select("alert_id", F.round(severity, 9).alias("severity"), scoring.severity_label(severity).alias("label"))


@query("E4_impact_confidence", f"""WITH {_IMPACT} SELECT alert_id, round(conf, 6) AS confidence FROM impacts""")
def impact_confidence(t: Tables):
    return _impact_inputs(t).select("alert_id", F.round(impact.impact_confidence(
        F.col("sentiment_confidence"), F.col("event_confidence"), F.col("relevance")), 6).alias("confidence"))


@query("D25_merged_analysis", f"""WITH {_IMPACT},
given AS (SELECT *, alert_id % 3 <> 0 AS has, CASE WHEN alert_id % 5 <> 0 THEN (k * 13 % 100) / 100.0::DOUBLE ELSE sev END AS raw_sev,
                 (k * 17 % 100) / 100.0::DOUBLE AS raw_conf FROM impacts),
merged AS (SELECT *, CASE WHEN has THEN least(greatest(raw_sev, greatest(0.0, sev - 0.2)), least(1.0, sev + 0.2)) ELSE sev END AS out_sev FROM given)
SELECT alert_id, has AS enhanced, round(out_sev, 9) AS severity, {_LABEL.format('out_sev')} AS severity_label,
       CASE WHEN has AND (given_direction = dir OR raw_conf >= 0.6) THEN given_direction ELSE dir END AS direction,
       round(CASE WHEN has THEN least(1.0, 0.5 * conf + 0.5 * raw_conf) ELSE conf END, 9) AS confidence,
       CASE WHEN has THEN round(raw_sev, 9) END AS severity_raw, CASE WHEN has THEN given_direction END AS direction_raw FROM merged""")
def merged_analysis(t: Tables):
    from foliowire.operators.impact import merge_analyses

    inputs = _impact_inputs(t)
    analyses = inputs.where("alert_id % 3 <> 0").select(
        "alert_id", F.when(F.col("alert_id") % 5 != 0, (F.col("k") * 13 % 100) / F.lit(100.0)).alias("severity"),
        F.col("given_direction").alias("direction"), ((F.col("k") * 17 % 100) / F.lit(100.0)).alias("confidence"))
    base, bias = impact.event_priors(F.col("event_type"))
    severity = impact.impact_severity(base, F.col("relevance"), F.col("sentiment_confidence"), F.size("matched_assets"))
    score = impact.direction_score(F.col("sentiment"), F.col("sentiment_confidence"), bias)
    estimated = inputs.select(
        "alert_id", severity.alias("severity"), scoring.severity_label(severity).alias("severity_label"),
        scoring.direction_from_score(score).alias("direction"),
        impact.impact_confidence(F.col("sentiment_confidence"), F.col("event_confidence"), F.col("relevance")).alias("confidence"))
    merged = merge_analyses(estimated, analyses, ["alert_id"], places=9)
    return merged.select("alert_id", "enhanced", "severity_label", "direction", "direction_raw",
                         *[F.round(c, 9).alias(c) for c in ("severity", "confidence", "severity_raw")])


_KEYWORD_SQL = " UNION ALL ".join(
    f"SELECT '{e}' AS event_type, {i} AS prio, '{w}' AS word" for i, (e, ws) in enumerate(domain.EVENT_KEYWORDS.items()) for w in ws)


@query("E1_keyword_events", f"""WITH words AS ({_KEYWORD_SQL}),
texts AS (SELECT doc_id AS id, text FROM documents UNION ALL SELECT -1 - doc_id, text || ' The CEO faces a data leak, a breach and a lawsuit in court.' FROM documents),
hits AS (SELECT id, event_type, prio, count(*) AS n FROM texts JOIN words ON contains(lower(text), word) GROUP BY 1, 2, 3),
best AS (SELECT id, arg_min(event_type, (-n, prio)) AS event_type, max(n) AS n FROM hits GROUP BY 1)
SELECT t.id, coalesce(event_type, 'otro') AS event_type, CAST(coalesce(n, 0) AS INTEGER) AS hits,
       round(CASE WHEN n > 0 THEN least(0.3 + 0.15 * n, 0.85) ELSE 0.1 END::DOUBLE, 6) AS confidence FROM texts t LEFT JOIN best USING (id)""")
def keyword_events(t: Tables):
    docs = t["documents"]
    texts = docs.select(F.col("doc_id").alias("id"), "text").unionByName(docs.select(
        (-1 - F.col("doc_id")).alias("id"), F.concat("text", F.lit(" The CEO faces a data leak, a breach and a lawsuit in court.")).alias("text")))
    scored = impact.classify_by_keywords(texts, "text")
    return scored.select("id", "event_type", F.col("keyword_hits").alias("hits"), F.round("event_confidence", 6).alias("confidence"))


# --- Alert statistics ----------------------------------------------------------------------------

@query("E6_alert_stats", f"""WITH {ALERTS}
SELECT 'all' AS scope, CAST(count(*) AS BIGINT) AS total, round(avg(severity), 6) AS avg_severity, round(avg(confidence), 6) AS avg_confidence FROM alerts
UNION ALL SELECT 'nobody', 0, 0.0, 0.0""")
def alert_stats(t: Tables):
    def rounded(df, scope):
        return alertstats.alert_stats(df).select(F.lit(scope).alias("scope"), "total", F.round("avg_severity", 6).alias("avg_severity"),
                                                 F.round("avg_confidence", 6).alias("avg_confidence"))

    return rounded(t.alerts, "all").unionByName(rounded(t.alerts.where(F.col("portfolio_id") == "nobody"), "nobody"))


_VOTES = ALERTS + """,
votes AS (SELECT k AS alert_id, user_id, arg_max(direction = 'alcista', (created_at, alert_id)) AS useful, max(created_at) AS updated_at FROM alerts GROUP BY 1, 2)"""


def _feedback(t: Tables):
    from foliowire.plans.sources_and_storage import _votes

    return storage.upsert_feedback(_votes(t))


@query("E7_feedback_stats", f"""WITH {_VOTES}
SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (useful) AS BIGINT) AS useful, CAST(count(*) FILTER (NOT useful) AS BIGINT) AS not_useful,
       round(count(*) FILTER (useful) / count(*), 4) AS useful_rate FROM votes""")
def feedback_stats(t: Tables):
    return alertstats.feedback_stats(_feedback(t))


@query("E7_feedback_by_portfolio", f"""WITH {_VOTES}
SELECT portfolio_id, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (useful) AS BIGINT) AS useful, CAST(count(*) FILTER (NOT useful) AS BIGINT) AS not_useful,
       round(count(*) FILTER (useful) / count(*), 4) AS useful_rate FROM votes JOIN (SELECT alert_id, portfolio_id FROM alerts) USING (alert_id) GROUP BY 1""")
def feedback_by_portfolio(t: Tables):
    owned = _feedback(t).join(t.alerts.select("alert_id", "portfolio_id"), "alert_id")
    return alertstats.feedback_stats(owned, ["portfolio_id"])


@query("D22_feedback_annotation", f"""WITH {_VOTES}
SELECT a.alert_id, v.useful AS feedback_useful FROM alerts a LEFT JOIN
  (SELECT alert_id, arg_max(useful, (updated_at, user_id)) AS useful FROM votes GROUP BY 1) v USING (alert_id)""")
def feedback_annotation(t: Tables):
    return alertstats.annotate_feedback(t.alerts.select("alert_id"), _feedback(t))


@query("E8_event_distribution", f"""WITH {ALERTS} SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM alerts GROUP BY 1 ORDER BY n DESC""")
def event_distribution(t: Tables):
    return alertstats.distribution(t.alerts, "event_type").select("event_type", "n").orderBy(F.desc("n"))


@query("E9_direction_shares", f"""WITH {ALERTS}
SELECT direction, CAST(count(*) AS BIGINT) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM alerts GROUP BY 1""")
def direction_shares(t: Tables):
    return alertstats.distribution(t.alerts, "direction", domain.DIRECTIONS).withColumn("share", F.round("share", 6))


@query("E10_severity_histogram", f"""WITH {ALERTS},
bins AS (SELECT least(CAST(floor(severity * 20) AS INTEGER), 19) AS bin, count(*) AS n FROM alerts GROUP BY 1)
SELECT CAST(i AS INTEGER) AS bin, printf('%.2f', i / 20.0::DOUBLE) AS range, CAST(coalesce(n, 0) AS BIGINT) AS count FROM unnest(range(0, 20)) AS r(i) LEFT JOIN bins ON bin = i""")
def severity_histogram(t: Tables):
    return alertstats.severity_histogram(t.alerts)


@query("E11_weight_by_sector", f"""WITH {PORTFOLIO_ASSETS} SELECT sector, round(sum(weight), 6) AS weight FROM portfolio_assets WHERE sector IS NOT NULL GROUP BY 1""")
def weight_by_sector(t: Tables):
    return alertstats.weight_by_sector(t.portfolios.select(F.inline("assets"))).withColumn("weight", F.round("weight", 6))


@query("E12_outcome_counts", f"""WITH {ALERTS}
SELECT CAST(count(*) AS BIGINT) AS processed, CAST(count(*) FILTER (severity >= 0.3 AND NOT is_duplicate) AS BIGINT) AS alerts_generated,
       CAST(count(*) FILTER (severity >= 0.3 AND is_duplicate) AS BIGINT) AS duplicates, CAST(count(*) FILTER (severity < 0.3) AS BIGINT) AS discarded FROM alerts""")
def outcome_counts(t: Tables):
    return gates.outcome_counts(t.alerts.withColumn("is_alert", F.col("severity") >= domain.SEVERITY_MIN))


@query("E13_discard_funnel", f"""WITH {ALERTS}
SELECT CAST(count(*) AS BIGINT) AS input, CAST(count(*) FILTER (relevance >= 0.3) AS BIGINT) AS relevance, CAST(count(*) FILTER (relevance >= 0.3 AND confidence >= 0.15) AS BIGINT) AS estimate,
       CAST(count(*) FILTER (relevance >= 0.3 AND confidence >= 0.15 AND severity >= 0.3) AS BIGINT) AS severity,
       CAST(count(*) FILTER (relevance >= 0.3 AND confidence >= 0.15 AND severity >= 0.3 AND NOT is_duplicate) AS BIGINT) AS novelty FROM alerts""")
def discard_funnel(t: Tables):
    return gates.funnel(t.alerts, {
        "relevance": F.col("relevance") >= 0.3, "estimate": F.col("confidence") >= 0.15,
        "severity": F.col("severity") >= 0.3, "novelty": ~F.col("is_duplicate")})


@query("D23_fundamentals", f"""WITH {_WITH_ASSETS},
fundamentals AS (SELECT 'T' || p_size AS ticker, round(avg(p_retailprice), 4) AS price, CAST(count(*) AS BIGINT) AS n FROM part GROUP BY 1),
exploded AS (SELECT alert_id, unnest(CASE k % 3 WHEN 0 THEN [NULL] WHEN 1 THEN ['T' || k] ELSE ['T' || k, 'SPY'] END) AS ticker FROM full_alerts)
SELECT alert_id, ticker, price, n FROM exploded LEFT JOIN fundamentals USING (ticker)""")
def fundamentals(t: Tables):
    table = t["part"].groupBy(F.concat(F.lit("T"), "p_size").alias("ticker")).agg(
        F.round(F.avg("p_retailprice"), 4).alias("price"), F.count(F.lit(1)).alias("n"))
    return alertstats.enrich_fundamentals(_with_assets(t).select("alert_id", "matched_assets"), table)


@query("H10_interval_counters", f"""WITH {ALERTS}
SELECT strftime(date_trunc('hour', created_at), '%Y-%m-%d %H:%M:%S') AS interval_start, event_type, CAST(count(*) AS BIGINT) AS n FROM alerts GROUP BY 1, 2""")
def interval_counters(t: Tables):
    counted = alertstats.counters_by_interval(t.alerts)
    return counted.withColumn("interval_start", F.date_format("interval_start", "yyyy-MM-dd HH:mm:ss"))


@query("E49_usage_cost", """
SELECT role AS provider, 'm' || turn % 3 AS model, CAST(count(*) AS BIGINT) AS calls, CAST(sum(length(text)) AS BIGINT) AS prompt_tokens,
       CAST(sum(length(text) // 4) AS BIGINT) AS completion_tokens, round(sum(length(text) / 1000 * 0.5 + (length(text) // 4) / 1000 * 1.5), 6) AS cost
FROM conversations GROUP BY 1, 2""")
def usage_cost(t: Tables):
    size = F.length("text").cast("bigint")
    calls = t["conversations"].select(
        F.col("role").alias("provider"), F.concat(F.lit("m"), F.col("turn") % 3).alias("model"), size.alias("prompt_tokens"),
        F.floor(size / 4).alias("completion_tokens"))
    return alertstats.usage_cost(calls, 0.5, 1.5).withColumn("cost", F.round("cost", 6))


@query("S1_asset_sets", f"""WITH {_WITH_ASSETS}
SELECT alert_id, array_to_string(list_sort(list_distinct(list_concat(a, b))), ',') AS either, array_to_string(list_sort(list_intersect(a, b)), ',') AS both_sets,
       array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), ',') AS only_first
FROM (SELECT alert_id, CASE k % 3 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN ['T' || k] ELSE ['T' || k, 'SPY'] END AS a, ['T' || alert_id % 50, 'SPY'] AS b FROM full_alerts)""")
def asset_sets(t: Tables):
    pairs = _with_assets(t).select("alert_id", F.col("matched_assets").alias("a"),
                                   F.array(F.concat(F.lit("T"), F.col("alert_id") % 50), F.lit("SPY")).alias("b"))

    def joined(x):
        return F.array_join(F.array_sort(x), ",")

    return pairs.select("alert_id", joined(F.array_union("a", "b")).alias("either"), joined(F.array_intersect("a", "b")).alias("both_sets"),
                        joined(F.array_except("a", "b")).alias("only_first"))
