"""Queries over questionnaires, portfolio composition and recommendations."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from foliowire import domain
from foliowire.operators import advisor
from foliowire.plans.bindings import ANSWERS, HOLDINGS, Tables
from foliowire.plans.registry import query
from foliowire.session import cut_lineage

_WEIGHTS = ", ".join(f"('{q}', {w})" for q, (w, _) in domain.RISK_QUESTIONS.items())
_SCORES = ", ".join(f"('{q}', '{o}', {s})" for q, (_, options) in domain.RISK_QUESTIONS.items() for o, s in options.items())


def _case(column, table, default):
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in table.items()) + f" ELSE {default} END"


_PROFILES = f"""{ANSWERS},
scored AS (SELECT user_id, a.question_id, score, weight FROM answers a JOIN (VALUES {_SCORES}) AS s(question_id, option_id, score) USING (question_id, option_id)
           JOIN (VALUES {_WEIGHTS}) AS w(question_id, weight) USING (question_id)),
risks AS (SELECT u.user_id, CAST(coalesce(round_even(sum(score * weight)::DOUBLE / sum(weight)::DOUBLE, 0), 50) AS INTEGER) AS risk_score
          FROM (SELECT DISTINCT user_id FROM answers) u LEFT JOIN scored USING (user_id) GROUP BY 1),
profiles AS (SELECT user_id AS portfolio_id, risk_score, CASE WHEN risk_score <= 20 THEN 'muy_conservador' WHEN risk_score <= 40 THEN 'conservador' WHEN risk_score <= 60 THEN 'moderado'
             WHEN risk_score <= 80 THEN 'agresivo' ELSE 'muy_agresivo' END AS risk_profile FROM risks)"""

_IDEAL = {name: ", ".join(f"('{p}', '{c}', {v})" for p, cs in table.items() for c, v in cs.items())
          for name, table in (("sectors", domain.IDEAL_SECTORS), ("regions", domain.IDEAL_REGIONS))}
_SECTOR = "CASE raw_sector WHEN 'tech' THEN 'Technology' WHEN 'Financials' THEN 'Financial Services' WHEN 'health care' THEN 'Healthcare' WHEN 'consumer staples' THEN 'Consumer Defensive' ELSE raw_sector END"
_REGION = "CASE raw_country WHEN 'South Africa' THEN 'Emerging Markets' WHEN 'USA' THEN 'United States' WHEN ' japan ' THEN 'Asia' WHEN 'Spain' THEN 'Europe' ELSE 'Other' END"
_PORTFOLIOS = f"""{_PROFILES}, {HOLDINGS},
totals AS (SELECT portfolio_id, sum(amount) AS total, count(*) AS n_assets, sum(amount * amount) / (sum(amount) * sum(amount)) AS hhi,
                  arg_max(asset_id, (amount, -asset_id)) AS top_asset, max(amount) / sum(amount) AS top_share FROM assets GROUP BY 1),
named AS (SELECT portfolio_id, coalesce(risk_profile, 'moderado') AS risk_profile FROM totals LEFT JOIN profiles USING (portfolio_id)),
sector_now AS (SELECT portfolio_id, {_SECTOR} AS category, sum(amount) / any_value(total) * 100 AS pct FROM assets JOIN totals USING (portfolio_id) GROUP BY 1, 2),
region_now AS (SELECT portfolio_id, {_REGION} AS category, sum(amount) / any_value(total) * 100 AS pct FROM assets JOIN totals USING (portfolio_id) GROUP BY 1, 2),
sector_ideal AS (SELECT portfolio_id, category, ideal FROM named JOIN (VALUES {_IDEAL['sectors']}) AS i(risk_profile, category, ideal) USING (risk_profile)),
region_ideal AS (SELECT portfolio_id, category, ideal FROM named JOIN (VALUES {_IDEAL['regions']}) AS i(risk_profile, category, ideal) USING (risk_profile)),
sector_raw AS (SELECT portfolio_id, category, round(coalesce(pct, 0), 1) AS current_pct, round(coalesce(ideal, 0), 1)::DOUBLE AS ideal_pct FROM sector_now FULL JOIN sector_ideal USING (portfolio_id, category)),
region_raw AS (SELECT portfolio_id, category, round(coalesce(pct, 0), 1) AS current_pct, round(coalesce(ideal, 0), 1)::DOUBLE AS ideal_pct FROM region_now FULL JOIN region_ideal USING (portfolio_id, category)),
sectors AS (SELECT *, round(current_pct - ideal_pct, 1) AS diff_pct FROM sector_raw),
regions AS (SELECT *, round(current_pct - ideal_pct, 1) AS diff_pct FROM region_raw),
spread AS (SELECT portfolio_id, (SELECT count(*) FROM sector_now s WHERE s.portfolio_id = t.portfolio_id AND pct > 0) AS n_sectors,
                  (SELECT count(*) FROM region_now r WHERE r.portfolio_id = t.portfolio_id AND pct > 0) AS n_regions FROM totals t)"""
_STATUS = "CASE WHEN abs(diff_pct) <= 5 THEN 'equilibrado' WHEN diff_pct > 0 THEN 'sobreexpuesto' ELSE 'infraexpuesto' END"


def _holdings(t: Tables):
    return t.holdings.select("portfolio_id", "asset_id", "name", F.col("amount").alias("weight"), F.col("raw_sector").alias("sector"), F.col("raw_country").alias("country"))


def _base(t: Tables):
    return advisor.composition(_holdings(t))


def _profiles(t: Tables):
    return advisor.risk_scores(t.answers).select(
        F.col("user_id").alias("portfolio_id"), advisor.risk_profile(F.col("risk_score")).alias("risk_profile"))


@query("D19_scored_answers", f"WITH {_PROFILES} SELECT user_id, question_id, CAST(score AS INTEGER) AS score, CAST(weight AS DOUBLE) AS weight FROM scored")
def scored_answers(t: Tables):
    return advisor.scored_answers(t.answers).select("user_id", "question_id", "score", "weight")


@query("E41_risk_score", f"WITH {_PROFILES} SELECT user_id, risk_score FROM risks")
def risk_score(t: Tables):
    return advisor.risk_scores(t.answers)


_Q10 = " UNION ALL ".join(f"SELECT {i} AS ord, 'q10_{c}' AS opt, '{s}' AS sector" for i, (c, s) in enumerate(
    zip("abcdefg", domain.SECTOR_BY_OPTION.values())))


@query("E42_investor_profile", f"""WITH {_PROFILES},
chosen AS (SELECT user_id, max(option_id) FILTER (question_id = 'q1_horizon') AS q1, max(option_id) FILTER (question_id = 'q2_goal') AS q2,
  max(option_id) FILTER (question_id = 'q4_knowledge') AS q4, max(option_id) FILTER (question_id = 'q8_max_loss') AS q8,
  max(option_id) FILTER (question_id = 'q9_esg') AS q9, max(option_id) FILTER (question_id = 'q10_sectors') AS q10 FROM answers GROUP BY 1),
picked AS (SELECT user_id, string_agg(sector, ',' ORDER BY i) AS sectors FROM (SELECT user_id, i, trim(string_split(q10, ',')[i]) AS opt FROM chosen, unnest(range(1, 3)) AS r(i))
           JOIN ({_Q10}) USING (opt) GROUP BY 1)
SELECT c.user_id, risk_score, risk_profile, CASE WHEN q1 IS NULL THEN 'medio_plazo' ELSE {_case('q1', domain.HORIZON_BY_OPTION, "'largo_plazo'")} END AS horizon,
       {_case('q2', domain.GOAL_BY_OPTION, "'crecimiento_equilibrado'")} AS goal, {_case('q4', domain.KNOWLEDGE_BY_OPTION, "'intermedio'")} AS knowledge,
       coalesce(q9 IN ('q9_a', 'q9_b'), false) AS esg_preference, CAST({_case('q8', domain.LOSS_BY_OPTION, 15.0)} AS DOUBLE) AS loss_tolerance_pct, coalesce(sectors, '') AS sectors
FROM chosen c JOIN profiles p ON p.portfolio_id = c.user_id LEFT JOIN picked USING (user_id)""")
def investor_profile(t: Tables):
    return advisor.investor_profiles(t.answers).select(
        "user_id", "risk_score", "risk_profile", "horizon", "goal", "knowledge", "esg_preference", "loss_tolerance_pct",
        F.array_join("sector_preferences", ",").alias("sectors"))


@query("E43_concentration", f"WITH {_PORTFOLIOS} SELECT portfolio_id, CAST(n_assets AS BIGINT) AS n_assets, round(hhi, 6) AS hhi FROM totals")
def concentration(t: Tables):
    return advisor.concentration(_base(t)).withColumn("hhi", F.round("hhi", 6))


@query("G4_largest_position", f"WITH {_PORTFOLIOS} SELECT portfolio_id, top_asset AS asset_id, round(top_share, 6) AS share FROM totals")
def largest_position(t: Tables):
    return advisor.largest_position(_base(t)).withColumn("share", F.round("share", 6))


@query("D20_sector_allocation", f"WITH {_PORTFOLIOS} SELECT portfolio_id, category, current_pct, ideal_pct FROM sectors")
def sector_allocation(t: Tables):
    return advisor.sector_allocation(_base(t), _profiles(t)).select("portfolio_id", "category", "current_pct", "ideal_pct")


@query("D20_region_allocation", f"WITH {_PORTFOLIOS} SELECT portfolio_id, category, current_pct, ideal_pct FROM regions")
def region_allocation(t: Tables):
    return advisor.region_allocation(_base(t), _profiles(t)).select("portfolio_id", "category", "current_pct", "ideal_pct")


@query("E44_allocation_status", f"""WITH {_PORTFOLIOS}
SELECT 'sector' AS side, portfolio_id, category, diff_pct + 0.0 AS diff_pct, {_STATUS} AS status FROM sectors
UNION ALL SELECT 'region', portfolio_id, category, diff_pct + 0.0, {_STATUS} FROM regions""")
def allocation_status(t: Tables):
    base, profiles = _base(t), _profiles(t)

    def side(name, df):
        return df.select(F.lit(name).alias("side"), "portfolio_id", "category", "diff_pct", "status")

    return side("sector", advisor.sector_allocation(base, profiles)).unionByName(side("region", advisor.region_allocation(base, profiles)))


@query("S3_category_union", f"""WITH {_PORTFOLIOS} SELECT portfolio_id, category FROM sector_now UNION SELECT portfolio_id, category FROM sector_ideal""")
def category_union(t: Tables):
    return advisor.sector_allocation(_base(t), _profiles(t)).select("portfolio_id", "category")


@query("E45_diversification", f"""WITH {_PORTFOLIOS}
SELECT portfolio_id, CAST(n_sectors AS BIGINT) AS n_sectors, CAST(n_regions AS BIGINT) AS n_regions,
       CAST(round_even(least(n_assets / 15, 1) * 30 + (1 - hhi) * 30 + least(n_sectors / 6, 1) * 20 + least(n_regions / 4, 1) * 20, 0) AS INTEGER) AS diversification_score
FROM totals JOIN spread USING (portfolio_id)""")
def diversification(t: Tables):
    return advisor.diversification(_base(t)).select("portfolio_id", "n_sectors", "n_regions", "diversification_score")


@query("E46_alignment", f"""WITH {_PORTFOLIOS}
SELECT portfolio_id, CAST(round_even(greatest(0, least(100, 100 - (s * 1.5 + r * 1.5))), 0) AS INTEGER) AS risk_alignment_score
FROM (SELECT portfolio_id, avg(abs(diff_pct)) AS s FROM sectors GROUP BY 1) JOIN (SELECT portfolio_id, avg(abs(diff_pct)) AS r FROM regions GROUP BY 1) USING (portfolio_id)""")
def alignment(t: Tables):
    base, profiles = _base(t), _profiles(t)
    return advisor.alignment(advisor.sector_allocation(base, profiles), advisor.region_allocation(base, profiles))


@query("E47_warnings", f"""WITH {_PORTFOLIOS},
extremes AS (SELECT portfolio_id, string_agg(category, ', ' ORDER BY category) FILTER (diff_pct > 15) AS over_list,
                    string_agg(category, ', ' ORDER BY category) FILTER (diff_pct < -15) AS under_list FROM sectors GROUP BY 1),
facts AS (SELECT *, {_case('risk_profile', domain.MIN_HOLDINGS, 6)} AS least_assets FROM totals JOIN spread USING (portfolio_id) JOIN named USING (portfolio_id) JOIN extremes USING (portfolio_id))
SELECT portfolio_id, 'few_assets' AS rule, 'Tu cartera tiene ' || n_assets || ' activos. Para tu perfil (' || risk_profile || ') se recomiendan al menos ' || least_assets || '.' AS message
  FROM facts WHERE n_assets < least_assets
UNION ALL SELECT portfolio_id, 'concentration', 'Alta concentración: ' || top_asset || ' representa el ' || printf('%.0f', top_share * 100) || '% de la cartera. Considera diversificar.' FROM facts WHERE hhi > 0.25
UNION ALL SELECT portfolio_id, 'over_sectors', 'Sobreexposición significativa en: ' || over_list || '. Esto aumenta el riesgo sectorial.' FROM facts WHERE over_list IS NOT NULL
UNION ALL SELECT portfolio_id, 'under_sectors', 'Infrarrepresentación significativa en: ' || under_list || '. Podrías estar perdiéndote oportunidades de diversificación.' FROM facts WHERE under_list IS NOT NULL
UNION ALL SELECT portfolio_id, 'single_region', 'Toda tu cartera está concentrada en una sola región geográfica. La diversificación geográfica reduce el riesgo país.' FROM facts WHERE n_regions <= 1""")
def warnings(t: Tables):
    base, profiles = _base(t), _profiles(t)
    return advisor.warnings(base, profiles, advisor.sector_allocation(base, profiles))


_OVER = """over_assets AS (SELECT a.portfolio_id, a.asset_id, s.category, s.diff_pct FROM sectors s JOIN assets a ON a.portfolio_id = s.portfolio_id AND contains(lower(s.category), lower(a.raw_sector))
                 WHERE s.diff_pct > 10)"""


@query("D26_overexposed_assets", f"WITH {_PORTFOLIOS}, {_OVER} SELECT portfolio_id, asset_id, category FROM over_assets")
def overexposed_assets(t: Tables):
    holdings = _holdings(t)
    return advisor.overexposed_assets(holdings, advisor.sector_allocation(advisor.composition(holdings), _profiles(t))).select("portfolio_id", "asset_id", "category")


def _reason(rule, what, current="current_pct", ideal="ideal_pct"):
    """The message text of a rule as a SQL expression."""
    values = {"0": what, "1": f"printf('%.0f', round_even({current}, 0))", "2": f"printf('%.0f', round_even({ideal}, 0))", "3": "risk_profile"}
    pieces = re.split(r"\{(\d)\}", domain.RECOMMENDATION_TEXTS[rule])
    return " || ".join(values[p] if k % 2 else f"'{p}'" for k, p in enumerate(pieces) if p)


@query("E48_recommendations", f"""WITH {_PORTFOLIOS},
over_named AS (SELECT a.portfolio_id, a.asset_id, a.name, s.category, s.diff_pct, s.current_pct, s.ideal_pct, risk_profile
               FROM sectors s JOIN assets a ON a.portfolio_id = s.portfolio_id AND contains(lower(s.category), lower(a.raw_sector)) JOIN named n ON n.portfolio_id = s.portfolio_id WHERE s.diff_pct > 10),
recs AS (
  SELECT portfolio_id, 'sector_over' AS rule, 'reducir' AS action, asset_id, name AS asset_name, category AS sector, CASE WHEN diff_pct > 20 THEN 'alta' ELSE 'media' END AS priority,
         {_reason('sector_over', 'category')} AS reason, NULL::DOUBLE AS current_weight, NULL::DOUBLE AS suggested_weight FROM over_named
  UNION ALL SELECT portfolio_id, 'sector_under', 'comprar', NULL, 'ETF/Fondo del sector ' || category, category, 'media', {_reason('sector_under', 'category')}, NULL, NULL
    FROM sectors JOIN named USING (portfolio_id) WHERE diff_pct < -10
  UNION ALL SELECT portfolio_id, 'position_cap', 'reducir', asset_id, name, raw_sector, 'alta', {_reason('position_cap', 'asset_id', 'amount / total * 100')}, round(amount / total * 100, 1), 15.0
    FROM assets JOIN totals USING (portfolio_id) JOIN named USING (portfolio_id) WHERE hhi > 0.25 AND amount / total * 100 > 25
  UNION ALL SELECT portfolio_id, 'region_under', 'comprar', NULL, 'ETF/Fondo de ' || category, 'Diversificación geográfica', 'media', {_reason('region_under', 'category')}, NULL, NULL
    FROM regions JOIN named USING (portfolio_id) WHERE diff_pct < -15)
SELECT * FROM recs UNION ALL SELECT portfolio_id, 'hold', 'mantener', NULL, 'Cartera actual', '', 'baja', {_reason('hold', "''")}, NULL, NULL FROM totals WHERE portfolio_id NOT IN (SELECT portfolio_id FROM recs)""")
def recommendations(t: Tables):
    holdings, profiles = cut_lineage(_holdings(t)), cut_lineage(_profiles(t))  # each is read by several rules
    base = advisor.composition(holdings)
    return advisor.recommendations(holdings, base, profiles, advisor.sector_allocation(base, profiles), advisor.region_allocation(base, profiles))
