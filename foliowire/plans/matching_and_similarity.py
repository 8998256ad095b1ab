"""Queries over entity matching, relevance layers and similarity of embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliowire import domain
from foliowire.functions import text
from foliowire.operators import gates, matching, relevance, similarity
from foliowire.plans.bindings import ALERTS, EMBEDDED_ASSETS, WATCH, Tables
from foliowire.plans.registry import query
from foliowire.plans.text_and_scores import _ASCII, _ORG_STOP, _SUFFIXES, _WS, _sql_match


def _canonical(x):
    return (f"array_to_string(list_filter(string_split(trim(regexp_replace(regexp_replace(replace(strip_accents(lower({x})), '.', ''), "
            f"'[^\\p{{L}}\\p{{N}}_{_WS}]', ' ', 'g'), '[{_WS}]+', ' ', 'g')), ' '), lambda w: w <> '' AND w NOT IN ({_SUFFIXES})), ' ')")


def _key(x):
    return f"CASE WHEN contains({x}, ' ') OR length({x}) > 5 THEN {_canonical(x)} ELSE trim(strip_accents(lower({x}))) END"


_KEYS = WATCH + f""",
canon AS (SELECT *, {_canonical('name')} AS cn, {_canonical('alias')} AS ca FROM watch),
roots AS (SELECT portfolio_id, split_part(c, ' ', 1) AS root FROM (SELECT portfolio_id, ticker, cn AS c FROM canon UNION ALL SELECT portfolio_id, ticker, ca FROM canon)
          GROUP BY 1, 2 HAVING count(DISTINCT ticker) = 1 AND root <> ''),
raw_keys AS (
  SELECT portfolio_id, {_key('ticker')} AS key, ticker, 0.95 AS weight, pos, 0 AS kind FROM watch
  UNION ALL SELECT portfolio_id, {_key('name')}, ticker, 0.95, pos, 1 FROM watch
  UNION ALL SELECT portfolio_id, {_key("split_part(cn, ' ', 1)")}, ticker, 0.85, pos, 2 FROM canon
    WHERE split_part(cn, ' ', 1) <> cn AND EXISTS (SELECT 1 FROM roots r WHERE r.portfolio_id = canon.portfolio_id AND r.root = split_part(cn, ' ', 1))
  UNION ALL SELECT portfolio_id, {_key('alias')}, ticker, 0.9, pos, 3 FROM watch),
keys AS (SELECT portfolio_id, key, ticker, CAST(max(weight) AS DOUBLE) AS weight, arg_min(pos, (pos, kind)) AS pos, arg_min(kind, (pos, kind)) AS kind
         FROM raw_keys WHERE key <> '' GROUP BY 1, 2, 3)"""

_FOUND = _KEYS + f""",
texts AS (SELECT doc_id AS news_id, text, {_sql_match('text')} AS body FROM documents),
found AS (SELECT news_id, k.* FROM texts JOIN keys k ON contains(body, ' ' || key || ' ')),
resolved AS (SELECT news_id, portfolio_id, ticker, max(weight) AS score, arg_min(key, (-weight, pos, kind, key)) AS matched_key, arg_min(pos, (-weight, pos, kind, key)) AS pos
             FROM found GROUP BY 1, 2, 3)"""

_ORGS = f"""org_texts AS (
  SELECT news_id, {_sql_match("orgs")} AS body FROM (
    SELECT doc_id AS news_id, array_to_string(list_filter(list_distinct(runs), lambda x: split_part(x, ' ', 1) NOT IN ({_ORG_STOP})), ' . ') AS orgs
    FROM (SELECT doc_id, regexp_extract_all({_ASCII}, '\\b([A-Z][a-z]+(?:[ ]+[A-Z][a-z]+)+)\\b', 1) AS runs FROM documents) WHERE len(runs) > 0)),
org_found AS (
  SELECT news_id, portfolio_id, ticker, least(max(weight), 0.85) AS score, arg_min(key, (-weight, pos, kind, key)) AS matched_key, arg_min(pos, (-weight, pos, kind, key)) AS pos
  FROM org_texts JOIN keys ON contains(body, ' ' || key || ' ') GROUP BY 1, 2, 3)"""

_SECTORS = """sector_hits AS (SELECT DISTINCT doc_id AS news_id, portfolio_id FROM documents JOIN (SELECT DISTINCT portfolio_id, lower(sector) AS term FROM watch WHERE sector <> '')
                 ON contains(lower(text), term))"""
# RE2 has ASCII word boundaries only; the country words are compared with any letter, digit or underscore around them.
_COUNTRIES = f"""country_hits AS (
  SELECT DISTINCT doc_id AS news_id, portfolio_id FROM documents JOIN (SELECT DISTINCT portfolio_id, lower(country) AS term FROM watch WHERE country <> '')
  ON contains(lower(text), term) AND (length(term) > 3 OR regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}_])' || term || '($|[^\\p{{L}}\\p{{N}}_])')))"""

_RULES = f"""{_FOUND}, {_ORGS}, {_SECTORS}, {_COUNTRIES},
signals AS (
  SELECT news_id, portfolio_id, score, ticker, 0 AS phase, pos, false AS sector, false AS country FROM resolved
  UNION ALL SELECT news_id, portfolio_id, score, ticker, 1, pos, false, false FROM org_found
  UNION ALL SELECT news_id, portfolio_id, 0.5, NULL, 2, NULL, true, false FROM sector_hits
  UNION ALL SELECT news_id, portfolio_id, 0.3, NULL, 3, NULL, false, true FROM country_hits),
ordered AS (SELECT news_id, portfolio_id, ticker, min((phase, -score, pos)) AS place FROM signals WHERE ticker IS NOT NULL GROUP BY 1, 2, 3),
matched AS (SELECT news_id, portfolio_id, string_agg(ticker, ',' ORDER BY place, ticker) AS assets FROM ordered GROUP BY 1, 2),
rules AS (SELECT news_id, portfolio_id, CAST(max(score) AS DOUBLE) AS direct_score, bool_or(sector) AS sector_match, bool_or(country) AS country_match,
                 coalesce(any_value(assets), '') AS assets FROM signals LEFT JOIN matched USING (news_id, portfolio_id) GROUP BY 1, 2)"""


def _docs(t: Tables):
    return t["documents"].select(F.col("doc_id").alias("news_id"), "text")


def _orgs(t: Tables):
    return _docs(t).select("news_id", text.mined_organisations("text", None, squeezed=True).alias("orgs"))


def _rules(t: Tables):
    return matching.rule_relevance(_docs(t), _orgs(t), t.watch)


@query("D1_entity_keys", f"WITH {_KEYS} SELECT portfolio_id, key, ticker, weight, pos FROM keys")
def entity_keys(t: Tables):
    return matching.entity_keys(t.watch).select("portfolio_id", "key", "ticker", "weight", "pos")


@query("D2_mention_resolution", f"WITH {_FOUND} SELECT news_id, portfolio_id, ticker, score, matched_key FROM resolved")
def mention_resolution(t: Tables):
    found = matching.mentions(_docs(t), matching.entity_keys(t.watch))
    return matching.resolve(found).select("news_id", "portfolio_id", "ticker", "score", "matched_key")


@query("D3_organisation_mentions", f"WITH {_KEYS}, {_ORGS} SELECT news_id, portfolio_id, ticker, CAST(score AS DOUBLE) AS score FROM org_found")
def organisation_mentions(t: Tables):
    return matching.org_mentions(_orgs(t), matching.entity_keys(t.watch)).select("news_id", "portfolio_id", "ticker", "score")


@query("D4_sector_mentions", f"WITH {WATCH}, {_SECTORS} SELECT * FROM sector_hits")
def sector_mentions(t: Tables):
    return matching.sector_mentions(_docs(t), t.watch)


@query("D5_country_mentions", f"WITH {WATCH}, {_COUNTRIES} SELECT * FROM country_hits")
def country_mentions(t: Tables):
    return matching.country_mentions(_docs(t), t.watch)


@query("D6_rule_relevance", f"""WITH {_RULES}
SELECT news_id, portfolio_id, direct_score, assets, sector_match, country_match,
       CASE WHEN direct_score >= 0.5 THEN 'pass' WHEN direct_score >= 0.3 THEN 'borderline' ELSE 'drop' END AS gate FROM rules""")
def rule_relevance(t: Tables):
    return _rules(t).select("news_id", "portfolio_id", "direct_score", F.array_join("matched_assets", ",").alias("assets"),
                            "sector_match", "country_match", gates.relevance_gate(F.col("direct_score")).alias("gate"))


@query("G5_ranked_matches", f"""WITH {_FOUND} SELECT news_id, portfolio_id, string_agg(ticker, ',' ORDER BY score DESC, pos, ticker) AS tickers FROM resolved GROUP BY 1, 2""")
def ranked_matches(t: Tables):
    resolved = matching.resolve(matching.mentions(_docs(t), matching.entity_keys(t.watch)))
    return matching.ranked(resolved).withColumn("tickers", F.array_join("tickers", ","))


@query("D10_candidate_pairs", f"WITH {_RULES} SELECT news_id, portfolio_id FROM rules")
def candidate_pairs(t: Tables):
    return _rules(t).select("news_id", "portfolio_id")


_COS = "list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), a.vector)"
_SEMANTIC = EMBEDDED_ASSETS + f""",
sims AS (SELECT vec_id AS news_id, portfolio_id, ticker, pos, {_COS} AS s FROM embeddings e CROSS JOIN embedded_assets a),
semantic AS (SELECT news_id, portfolio_id, greatest(max(s), 0) AS semantic_score, greatest(avg(s), 0) AS semantic_mean_score, arg_max(ticker, (s, -pos)) AS best_asset
             FROM sims GROUP BY 1, 2)"""


def _news_vectors(t: Tables):
    return t["embeddings"].select(F.col("vec_id").alias("news_id"), F.col("embedding").alias("vector"))


@query("D7_semantic_relevance", f"""WITH {_SEMANTIC}
SELECT news_id, portfolio_id, round(semantic_score, 6) AS semantic_score, round(semantic_mean_score, 6) AS semantic_mean_score, best_asset FROM semantic WHERE semantic_score >= 0.3""")
def semantic_relevance(t: Tables):
    scored = relevance.semantic_relevance(_news_vectors(t), t.embedded_assets)
    return scored.select("news_id", "portfolio_id", F.round("semantic_score", 6).alias("semantic_score"),
                         F.round("semantic_mean_score", 6).alias("semantic_mean_score"), "best_asset")


_BLEND = ("least(1.0, CASE WHEN coalesce(direct_score, 0) >= 0.8 THEN 0.7 * direct_score + 0.3 * {0} WHEN coalesce(direct_score, 0) >= 0.5 "
          "THEN 0.5 * direct_score + 0.5 * {0} ELSE 0.3 * coalesce(direct_score, 0) + 0.7 * {0} END)")


@query("D8_hybrid_relevance", f"""WITH {_RULES}, {_SEMANTIC}
SELECT news_id, portfolio_id, round({_BLEND.format('coalesce(semantic_score, 0)')}, 4) AS relevance_score, coalesce(assets, '') AS assets,
       round(coalesce(direct_score, 0), 4) AS direct_score, best_asset, coalesce(sector_match, false) AS sector_match
FROM (SELECT * FROM semantic WHERE semantic_score >= 0.3) FULL JOIN rules USING (news_id, portfolio_id)""")
def hybrid_relevance(t: Tables):
    semantic = relevance.semantic_relevance(_news_vectors(t), t.embedded_assets)
    return relevance.hybrid_relevance(_rules(t), semantic).select(
        "news_id", "portfolio_id", "relevance_score", F.array_join("matched_assets", ",").alias("assets"), "direct_score", "best_asset", "sector_match")


@query("D8_gated_hybrid", f"""WITH {_RULES}, {_SEMANTIC},
hybrid AS (SELECT news_id, portfolio_id, round({_BLEND.format('coalesce(semantic_score, 0)')}, 4) AS relevance_score, coalesce(assets, '') AS assets, best_asset
           FROM semantic FULL JOIN rules USING (news_id, portfolio_id))
SELECT * FROM hybrid WHERE relevance_score >= 0.3""")
def gated_hybrid(t: Tables):
    kept = relevance.gated_hybrid_relevance(_news_vectors(t), _rules(t), t.embedded_assets)
    return kept.select("news_id", "portfolio_id", "relevance_score", F.array_join("matched_assets", ",").alias("assets"), "best_asset")


@query("D7_close_assets", f"""WITH {EMBEDDED_ASSETS}
SELECT vec_id AS news_id, ticker, round({_COS}, 6) AS cosine FROM embeddings e CROSS JOIN embedded_assets a WHERE {_COS} >= 0.3""")
def close_assets(t: Tables):
    found = similarity.cross_similar(_news_vectors(t), t.embedded_assets, "news_id", "ticker", 0.3)
    return found.withColumn("cosine", F.round("cosine", 6))


_SCORES = """scores AS (SELECT doc_id AS news_id, 'W' || doc_id % 4 AS portfolio_id, (doc_id * 7 % 100) / 100.0::DOUBLE AS score FROM documents),
extras AS (SELECT news_id, s.portfolio_id, ticker FROM scores s JOIN (SELECT DISTINCT portfolio_id, ticker FROM watch) w ON w.portfolio_id = s.portfolio_id
           WHERE contains(lower(w.ticker), 'e'))"""


@query("D9_external_relevance", f"""WITH {_RULES}, {_SCORES},
both_sides AS (SELECT news_id, portfolio_id, direct_score, score, coalesce(assets, '') AS assets FROM rules FULL JOIN scores USING (news_id, portfolio_id)),
listed AS (
  SELECT news_id, portfolio_id, ticker FROM ordered
  UNION SELECT x.news_id, x.portfolio_id, x.ticker FROM extras x JOIN both_sides b USING (news_id, portfolio_id) WHERE coalesce(b.direct_score, 0) < 0.8),
joined AS (SELECT news_id, portfolio_id, string_agg(ticker, ',' ORDER BY ticker) AS tickers FROM listed GROUP BY 1, 2)
SELECT b.news_id, b.portfolio_id, round(CASE WHEN direct_score >= 0.8 THEN direct_score ELSE {_BLEND.format('coalesce(score, 0)')} END, 6) AS relevance_score,
       coalesce(tickers, '') AS assets
FROM both_sides b LEFT JOIN joined USING (news_id, portfolio_id)""")
def external_relevance(t: Tables):
    held = t.watch.where(F.contains(F.lower("ticker"), F.lit("e"))).groupBy("portfolio_id").agg(F.collect_set("ticker").alias("assets"))
    scores = t["documents"].select(
        F.col("doc_id").alias("news_id"), F.concat(F.lit("W"), F.col("doc_id") % 4).alias("portfolio_id"),
        (F.col("doc_id") * 7 % 100 / F.lit(100.0)).alias("score")).join(held, "portfolio_id", "left").withColumn(
        "assets", F.concat(F.coalesce("assets", F.array().cast("array<string>")), F.array(F.lit("not held"))))
    scored = relevance.externally_scored_relevance(_rules(t), scores, t.watch)
    return scored.select("news_id", "portfolio_id", F.round("relevance_score", 6).alias("relevance_score"),
                         F.array_join(F.array_sort("matched_assets"), ",").alias("assets"))


# --- Similarity and duplicates ---------------------------------------------------------------------

_PAIR = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"


@query("H1_earlier_similarity", f"""WITH items AS (SELECT *, row_number() OVER (PARTITION BY label % 2 ORDER BY vec_id) AS pos FROM embeddings)
SELECT a.vec_id, round(coalesce(max(greatest({_PAIR}, 0)), 0), 4) AS max_similarity, coalesce(max({_PAIR}), 0) >= 0.3 AS is_duplicate
FROM items a LEFT JOIN items b ON a.label % 2 = b.label % 2 AND b.pos < a.pos AND b.pos >= a.pos - 200 GROUP BY 1""")
def earlier_similarity(t: Tables):
    items = t["embeddings"].select("vec_id", (F.col("label") % 2).alias("scope"), F.col("embedding").alias("vector"))
    flagged = similarity.earlier_similarity(items, ["scope"], ["vec_id"], "vec_id", 0.3, domain.HISTORY_MEMORY)
    return flagged.select("vec_id", F.round("max_similarity", 4).alias("max_similarity"), "is_duplicate")


def greedy_sql(source: str, ttl: int | None = None, also: str = "") -> str:
    """Statement over ``items`` (vec_id, scope, embedding): a list of kept ids per scope, carried item by item.

    The cosines to all earlier items of the scope are computed beforehand. ``ttl`` in hours, one per id.
    """
    alive = "" if ttl is None else f" AND x.id >= nxt.vec_id - {ttl}"
    best = "coalesce(list_max(list_transform(list_filter(near, lambda x: list_contains(kept[-{0}:], x.id)" + alive + "), lambda x: x.c)), 0)"
    return f"""WITH RECURSIVE {source},
placed AS (SELECT vec_id, scope, embedding, row_number() OVER (PARTITION BY scope ORDER BY vec_id) AS pos FROM items),
nxt AS MATERIALIZED (
  SELECT a.vec_id, a.scope, a.pos, coalesce(list({{'id': b.vec_id, 'c': greatest({_PAIR}, 0)}}) FILTER (b.vec_id IS NOT NULL), []) AS near
  FROM placed a LEFT JOIN placed b ON a.scope = b.scope AND b.pos < a.pos GROUP BY 1, 2, 3),
walked(scope, pos, vec_id, similarity, kept) AS (
  SELECT DISTINCT scope, 0::BIGINT, NULL::BIGINT, 0::DOUBLE, []::BIGINT[] FROM items
  UNION ALL
  SELECT scope, pos, vec_id, similarity, CASE WHEN similarity >= 0.3 THEN kept ELSE list_append(kept, vec_id) END
  FROM (SELECT nxt.scope, nxt.pos, nxt.vec_id, kept,
               CASE WHEN {best.format(200)} >= 0.3 THEN {best.format(200)} ELSE {best.format(500)} END AS similarity
        FROM walked JOIN nxt ON nxt.scope = walked.scope AND nxt.pos = walked.pos + 1))
SELECT {also}vec_id, round(similarity, 4) AS max_similarity, similarity >= 0.3 AS is_duplicate FROM walked WHERE vec_id IS NOT NULL"""


_COPIED = """items AS (SELECT vec_id, embedding, label AS scope FROM embeddings UNION ALL SELECT vec_id + 1000000, embedding, label FROM embeddings WHERE label < 3)"""


def _copied(t: Tables):
    e = t["embeddings"].select("vec_id", F.col("embedding").alias("vector"), F.col("label").alias("scope"))
    return e.unionByName(e.where("scope < 3").withColumn("vec_id", F.col("vec_id") + 1000000))


@query("H2_greedy_duplicates", greedy_sql(_COPIED))
def greedy_duplicates(t: Tables):
    flagged = similarity.greedy_duplicates(_copied(t), ["scope"], ["vec_id"], "vec_id", 0.3)
    return flagged.withColumn("max_similarity", F.round("max_similarity", 4))


@query("H3_similar_pairs", f"""WITH {_COPIED},
firsts AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY vec_id) AS pos FROM (SELECT scope, embedding, min(vec_id) AS vec_id FROM items GROUP BY 1, 2))
SELECT b.vec_id AS earlier_id, a.vec_id AS later_id, round({_PAIR}, 6) AS cosine FROM firsts a JOIN firsts b ON a.scope = b.scope AND b.pos < a.pos AND b.pos >= a.pos - 500 WHERE {_PAIR} >= 0.3
UNION ALL SELECT f.vec_id, i.vec_id, 1 FROM items i JOIN firsts f ON f.scope = i.scope AND f.embedding = i.embedding WHERE f.vec_id <> i.vec_id""")
def similar_pairs(t: Tables):
    pairs = similarity.similar_pairs(_copied(t), ["scope"], ["vec_id"], "vec_id", 0.3)
    return pairs.withColumn("cosine", F.round("cosine", 6))


@query("H3_near_copies", f"""WITH {_COPIED},
firsts AS (SELECT embedding, min(vec_id) AS vec_id FROM items GROUP BY 1)
SELECT b.vec_id AS earlier_id, a.vec_id AS later_id, round({_PAIR}, 6) AS cosine FROM firsts a JOIN firsts b ON b.vec_id < a.vec_id WHERE {_PAIR} >= 0.5
UNION ALL SELECT f.vec_id, i.vec_id, 1 FROM items i JOIN firsts f ON f.embedding = i.embedding WHERE f.vec_id <> i.vec_id""")
def near_copies(t: Tables):
    return similarity.near_copies(_copied(t), "vec_id", 0.5).withColumn("cosine", F.round("cosine", 6))


@query("H8_idempotent_reprocessing", f"""WITH {ALERTS}
SELECT n.doc_id AS news_id, p.portfolio_id FROM documents n JOIN (SELECT DISTINCT doc_id, 'u' || quality AS portfolio_id FROM labels) p USING (doc_id)
WHERE NOT EXISTS (SELECT 1 FROM alerts a WHERE a.alert_id = n.doc_id AND ('u' || a.user_id % 2) = p.portfolio_id)""")
def idempotent_reprocessing(t: Tables):
    pairs = t["documents"].select("doc_id").join(t["labels"], "doc_id").select(
        F.col("doc_id").alias("news_id"), F.concat(F.lit("u"), "quality").alias("portfolio_id")).distinct()
    done = t.alerts.select(F.col("alert_id").alias("news_id"), F.concat(F.lit("u"), F.col("user_id") % 2).alias("portfolio_id"))
    return pairs.join(done, ["news_id", "portfolio_id"], "left_anti")
