"""Queries that run the four pipeline variants over labelled news and score them."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliowire import domain
from foliowire.operators import metrics, variants
from foliowire.plans.bindings import Tables
from foliowire.plans.evaluation import E21_SELECT, EVALUATED_FROM_JOIN
from foliowire.plans.matching_and_similarity import _BLEND
from foliowire.plans.registry import query
from foliowire.plans.streams import _PIPELINE_INPUTS, _alert_news, _half_up, _supplied
from foliowire.plans.text_and_scores import _LABEL

_RUNS = f"""{_PIPELINE_INPUTS},
layers AS MATERIALIZED (
  SELECT g.news_id, g.portfolio_id, coalesce(direct_score, 0) AS direct, coalesce(semantic_score, 0) AS close,
         CASE WHEN coalesce(assets, '') = '' THEN []::VARCHAR[] ELSE string_split(assets, ',') END AS assets, coalesce(direct_score, 0) AS direct_score
  FROM given g JOIN documents d ON d.doc_id = g.news_id LEFT JOIN rules r ON r.news_id = g.news_id AND r.portfolio_id = g.portfolio_id
       LEFT JOIN semantic s ON s.news_id = g.news_id AND s.portfolio_id = g.portfolio_id),
scored AS MATERIALIZED (SELECT l.*, variant, CASE WHEN variant = 'rules' THEN direct ELSE {_BLEND.format('close')} END AS first_score
           FROM layers l, (VALUES ('rules'), ('hybrid'), ('hybrid_nli'), ('full')) AS v(variant)),
raised AS (
  SELECT s.*, variant = 'full' AND first_score >= 0.3 AND first_score < 0.5 AS asked, ok, g_sev, g_dir, g_conf, g_event,
         CASE WHEN variant = 'full' AND first_score >= 0.3 AND first_score < 0.5 AND coalesce(ok, false) THEN greatest(first_score, v_score) ELSE first_score END AS relevance
  FROM scored s JOIN given USING (news_id, portfolio_id)),
stages AS MATERIALIZED (SELECT *, CASE WHEN asked AND NOT coalesce(ok, false) THEN 'relevance_llm' WHEN relevance < 0.5 THEN 'relevance' END AS discarded_at FROM raised),
impacts AS (
  SELECT s.news_id, portfolio_id, variant, e, g_sev, g_dir, g_conf, g_event, least(1.0, 0.3 * sc + 0.4 * ec + 0.3 * relevance) AS conf,
         CASE sentiment WHEN 'positive' THEN 0.5 + 0.3 * sc + 0.2 * bias WHEN 'negative' THEN -0.5 - 0.3 * sc + 0.2 * bias ELSE 0.5 * bias END AS ds,
         least(1.0, base * (0.7 + 0.3 * relevance) * CASE WHEN sc > 0.8 THEN 1.1 ELSE 1 END * CASE WHEN len(assets) > 1 THEN 1 + 0.05 * least(len(assets), 5) ELSE 1 END) AS full_sev
  FROM stages s JOIN news_items n ON n.news_id = s.news_id JOIN priors USING (e) WHERE discarded_at IS NULL AND variant IN ('hybrid_nli', 'full')),
estimated AS (
  SELECT *, {_half_up('full_sev')} AS sev, {_half_up('conf')} AS c4, CASE WHEN ds > 0.15 THEN 'alcista' WHEN ds < -0.15 THEN 'bajista' ELSE 'neutral' END AS dir FROM impacts),
folded AS (SELECT *, CASE WHEN variant = 'full' THEN least(greatest(g_sev, greatest(0.0, sev - 0.2)), least(1.0, sev + 0.2)) ELSE sev END AS moved FROM estimated),
labelled AS MATERIALIZED (
  SELECT news_id, portfolio_id, variant, CASE WHEN variant = 'full' THEN coalesce(g_event, e) ELSE e END AS event_type,
         CASE WHEN variant = 'full' AND (g_dir = dir OR g_conf >= 0.6) THEN g_dir ELSE dir END AS direction, {_half_up('moved')} AS severity,
         CASE WHEN variant = 'full' THEN {_LABEL.format('moved')} ELSE {_LABEL.format('full_sev')} END AS severity_label,
         CASE WHEN variant = 'full' THEN {_half_up('least(c4 * 0.5 + g_conf * 0.5, 1.0)')} ELSE c4 END AS confidence FROM folded),
runs AS (SELECT s.news_id, s.portfolio_id, s.variant, discarded_at IS NULL AS is_relevant, round(relevance, 4) AS relevance_score, assets,
                l.event_type, l.direction, l.severity, l.severity_label, l.confidence, discarded_at
         FROM stages s LEFT JOIN labelled l ON l.news_id = s.news_id AND l.portfolio_id = s.portfolio_id AND l.variant = s.variant)"""


def _runs(t: Tables):
    labelled = t["labels"].join(t["documents"].select("doc_id"), "doc_id", "left_semi").select(
        F.col("doc_id").alias("news_id"), F.concat(F.lit("W"), F.col("doc_id") % 4).alias("portfolio_id"))
    given = _supplied(t)
    return variants.variant_predictions(labelled, _alert_news(t), t.watch, given["vectors"], given["asset_vectors"], given["sentiments"],
                                        given["verdicts"], given["analyses"])


@query("E21_variant_predictions", f"""WITH RECURSIVE {_RUNS}
SELECT news_id, portfolio_id, variant, is_relevant, round(relevance_score, 3) AS relevance_score, array_to_string(assets, ',') AS assets, event_type, direction, severity_label, discarded_at FROM runs""")
def variant_predictions(t: Tables):
    return _runs(t).select(*variants.PAIR, "variant", "is_relevant", F.round("relevance_score", 3).alias("relevance_score"),
                           F.array_join("matched_assets", ",").alias("assets"), "event_type", "direction", "severity_label", "discarded_at")


_GOLD_SQL = """gold AS (SELECT doc_id AS id, quality = 1 AS g_rel, CASE WHEN doc_id % 2 = 0 THEN 'THE' ELSE 'WITH' END AS g_asset,
  CASE WHEN doc_id % 3 = 0 THEN 'macroeconomia' ELSE 'otro' END AS g_event, CASE doc_id % 3 WHEN 0 THEN 'alcista' WHEN 1 THEN 'neutral' ELSE 'bajista' END AS g_dir,
  ['muy_baja', 'baja', 'media', 'alta', 'muy_alta'][doc_id % 5 + 1] AS g_sev FROM labels),
preds AS (SELECT news_id AS id, variant, is_relevant AS rel, list_distinct(list_transform(assets, lambda x: upper(x))) AS assets, event_type AS event, direction AS dir, severity_label AS sev FROM runs)"""


@query("E21_ablation_run", f"WITH RECURSIVE {_RUNS}, {_GOLD_SQL}, {EVALUATED_FROM_JOIN} {E21_SELECT}")
def ablation_run(t: Tables):
    doc, levels = F.col("doc_id"), domain.SEVERITY_LEVELS
    gold = t["labels"].select(
        doc.alias("id"), (F.col("quality") == 1).alias("gold_relevant"), F.array(F.when(doc % 2 == 0, "THE").otherwise("WITH")).alias("gold_assets"),
        F.when(doc % 3 == 0, "macroeconomia").otherwise("otro").alias("gold_event"),
        F.when(doc % 3 == 0, "alcista").when(doc % 3 == 1, "neutral").otherwise("bajista").alias("gold_direction"),
        F.element_at(F.array(*[F.lit(x) for x in levels]), (doc % 5 + 1).cast("int")).alias("gold_severity"))
    return metrics.ablation_summary(metrics.evaluate(gold, _runs(t).withColumnRenamed("news_id", "id")))
