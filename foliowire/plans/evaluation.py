"""Queries over evaluation metrics, annotator agreement and model comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliowire import domain
from foliowire.functions import text
from foliowire.functions.scoring import kappa_label, severity_label
from foliowire.operators import agreement, metrics, modelcompare
from foliowire.plans.bindings import ALERTS, Tables
from foliowire.plans.registry import query
from foliowire.plans.text_and_scores import _ES, _LABEL, _WS

VARIANTS = ("rules", "hybrid", "hybrid_nli", "full")


def _round(df, places, *columns):
    for c in columns:
        df = df.withColumn(c, F.round(c, places))
    return df


# --- Classification ------------------------------------------------------------------------------

_PRF = """round(coalesce(tp / nullif(tp + fp, 0), 0), 4) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 4) AS recall,
       round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 4) AS f1"""


@query("E14_binary_metrics", f"""
WITH c AS (SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (t AND p) AS BIGINT) AS tp, CAST(count(*) FILTER (NOT t AND p) AS BIGINT) AS fp,
                  CAST(count(*) FILTER (t AND NOT p) AS BIGINT) AS fn, CAST(count(*) FILTER (NOT t AND NOT p) AS BIGINT) AS tn
           FROM (SELECT quality = 1 AS t, n_chars > 400 AS p FROM labels JOIN documents USING (doc_id)))
SELECT *, {_PRF}, round((tp + tn) / n, 4) AS accuracy FROM c""")
def binary_metrics(t: Tables):
    rows = t["labels"].join(t["documents"].select("doc_id", "n_chars"), "doc_id").select(
        (F.col("quality") == 1).alias("t"), (F.col("n_chars") > 400).alias("p"))
    return metrics.binary_metrics(rows, "t", "p")


_VOTED = f"""voted AS (SELECT lang AS t, CASE WHEN len(list_filter(list_filter(string_split_regex(lower(text), '[{_WS}]+'), lambda x: x <> '')[1:50], lambda x: x IN ({_ES}))) > 5
       THEN 'es' ELSE 'en' END AS p FROM documents),
label_set AS (SELECT t AS label FROM voted UNION SELECT p FROM voted),
classes AS (SELECT label, CAST(count(*) FILTER (t = label) AS BIGINT) AS support, count(*) FILTER (t = label AND p = label) AS tp,
                   count(*) FILTER (t <> label AND p = label) AS fp, count(*) FILTER (t = label AND p <> label) AS fn FROM label_set, voted GROUP BY 1),
class_metrics AS (SELECT label, support, {_PRF} FROM classes)"""


def _voted(t: Tables):
    return t["documents"].select(F.col("lang").alias("t"), text.vote_language(F.col("text")).alias("p"))


@query("E15_per_class", f"WITH {_VOTED} SELECT label, support, precision, recall, f1 FROM class_metrics")
def per_class(t: Tables):
    return metrics.per_class(metrics.contingency(_voted(t), "t", "p"))


@query("E16_averages", f"""WITH {_VOTED}
SELECT round(avg(precision), 4) AS macro_precision, round(avg(recall), 4) AS macro_recall, round(avg(f1), 4) AS macro_f1,
       round(sum(precision * support) / sum(support), 4) AS weighted_precision, round(sum(recall * support) / sum(support), 4) AS weighted_recall,
       round(sum(f1 * support) / sum(support), 4) AS weighted_f1, (SELECT CAST(count(*) AS BIGINT) FROM voted) AS n,
       (SELECT round(avg(CASE WHEN t = p THEN 1 ELSE 0 END), 4) FROM voted) AS accuracy FROM class_metrics""")
def averages(t: Tables):
    counts = metrics.contingency(_voted(t), "t", "p")
    return metrics.averages(counts, metrics.per_class(counts))


@query("E17_confusion_matrix", f"""WITH {_VOTED}
SELECT a.label AS true, b.label AS pred, CAST((SELECT count(*) FROM voted WHERE t = a.label AND p = b.label) AS BIGINT) AS n FROM label_set a, label_set b""")
def confusion_matrix(t: Tables):
    return metrics.confusion_matrix(metrics.contingency(_voted(t), "t", "p"))


@query("S2_label_union", f"WITH {_VOTED} SELECT label FROM label_set")
def label_union(t: Tables):
    return metrics.label_union(_voted(t), "t", "p")


@query("E18_set_metrics", """
WITH typed AS (SELECT DISTINCT l_orderkey, p_type, l_quantity > 25 AS big FROM lineitem JOIN part ON p_partkey = l_partkey),
per_order AS (SELECT l_orderkey, count(DISTINCT p_type) AS n_true, count(DISTINCT p_type) FILTER (big) AS n_pred FROM typed GROUP BY 1)
SELECT CAST(count(*) AS BIGINT) AS n, 1.0::DOUBLE AS micro_precision, round(sum(n_pred) / sum(n_true), 4) AS micro_recall,
       round(2 * sum(n_pred) / (sum(n_pred) + sum(n_true)), 4) AS micro_f1, round(avg(n_pred / n_true), 4) AS mean_jaccard,
       round(avg(CASE WHEN n_pred = n_true THEN 1 ELSE 0 END), 4) AS exact_match_rate FROM per_order""")
def set_metrics(t: Tables):
    typed = t["lineitem"].select("l_orderkey", "l_partkey", "l_quantity").join(
        t["part"].select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    per_order = typed.groupBy("l_orderkey").agg(
        F.collect_set("p_type").alias("gold"), F.collect_set(F.when(F.col("l_quantity") > 25, F.lower("p_type"))).alias("found"))
    return metrics.set_metrics(per_order, "gold", "found")


@query("E19_ordinal_metrics", f"""WITH {ALERTS},
ranked AS (SELECT list_position(['muy_baja', 'baja', 'media', 'alta', 'muy_alta'], severity_label) AS a,
                  list_position(['muy_baja', 'baja', 'media', 'alta', 'muy_alta'], CASE WHEN k % 20 = 0 THEN 'sin dato' ELSE {_LABEL.format('relevance')} END) AS b FROM alerts)
SELECT CAST(count(*) AS BIGINT) AS n, round(avg(abs(a - b)), 4) AS mae, round(avg(CASE WHEN a = b THEN 1 ELSE 0 END), 4) AS exact_match,
       round(avg(CASE WHEN abs(a - b) <= 1 THEN 1 ELSE 0 END), 4) AS off_by_one_or_less FROM ranked WHERE a IS NOT NULL AND b IS NOT NULL""")
def ordinal_metrics(t: Tables):
    other = F.when(F.col("k") % 20 == 0, "sin dato").otherwise(severity_label(F.col("relevance")))
    return metrics.ordinal_metrics(t.alerts.withColumn("other", other), "severity_label", "other")


def _gold(t: Tables):
    return t.alerts.select(
        F.col("alert_id").alias("id"), (F.col("k") % 4 != 0).alias("gold_relevant"),
        F.array(F.concat(F.lit("T"), F.col("k") % 5)).alias("gold_assets"), F.col("event_type").alias("gold_event"),
        F.col("direction").alias("gold_direction"), F.col("severity_label").alias("gold_severity"))


def _predictions(t: Tables):
    v, k = F.col("v"), F.col("k")
    rows = t.alerts.withColumn("v", F.explode(F.array(*[F.lit(i) for i in range(4)]))).where((F.col("alert_id") + v) % 17 != 0)
    late = v >= 2
    return rows.select(
        F.col("alert_id").alias("id"), F.element_at(F.array(*[F.lit(x) for x in VARIANTS]), v + 1).alias("variant"),
        ((k + v) % 5 != 0).alias("is_relevant"),
        F.when((k + v) % 3 == 0, F.array(F.concat(F.lit("t"), k % 5), F.lit("X"))).otherwise(F.array(F.concat(F.lit("T"), (k + v) % 5))).alias("matched_assets"),
        F.when(late, F.when((k + v) % 6 == 0, "otro").otherwise(F.col("event_type"))).alias("event_type"),
        F.when(late, F.when((F.col("alert_id") + v) % 7 == 0, "neutral").otherwise(F.col("direction"))).alias("direction"),
        F.when(late, severity_label(F.col("relevance"))).alias("severity_label"))


_EVALUATED = f"""{ALERTS},
gold AS (SELECT alert_id AS id, k % 4 <> 0 AS g_rel, 'T' || k % 5 AS g_asset, event_type AS g_event, direction AS g_dir, severity_label AS g_sev FROM alerts),
preds AS (
  SELECT alert_id AS id, ['rules', 'hybrid', 'hybrid_nli', 'full'][v + 1] AS variant, (k + v) % 5 <> 0 AS rel,
         CASE WHEN (k + v) % 3 = 0 THEN ['T' || k % 5, 'X'] ELSE ['T' || (k + v) % 5] END AS assets,
         CASE WHEN v >= 2 THEN CASE WHEN (k + v) % 6 = 0 THEN 'otro' ELSE event_type END END AS event,
         CASE WHEN v >= 2 THEN CASE WHEN (alert_id + v) % 7 = 0 THEN 'neutral' ELSE direction END END AS dir,
         CASE WHEN v >= 2 THEN {_LABEL.format('relevance')} END AS sev
  FROM alerts, unnest(range(0, 4)) AS r(v) WHERE (alert_id + v) % 17 <> 0),
joined AS (SELECT * FROM gold JOIN preds USING (id)),
rel AS (SELECT variant, count(*) FILTER (g_rel AND rel) AS tp, count(*) FILTER (NOT g_rel AND rel) AS fp, count(*) FILTER (g_rel AND NOT rel) AS fn,
               count(*) FILTER (NOT g_rel AND NOT rel) AS tn FROM joined GROUP BY 1),
sets AS (SELECT variant, list_contains(assets, g_asset) AS hit, len(assets) AS n FROM joined WHERE g_rel),
set_sums AS (SELECT variant, sum(hit::INT) AS tp, sum(n - hit::INT) AS fp, sum(1 - hit::INT) AS fn, avg(hit::INT / (n + 1 - hit::INT)) AS jac, avg((hit AND n = 1)::INT) AS exact FROM sets GROUP BY 1),
late AS (SELECT * FROM joined WHERE g_rel AND rel AND event IS NOT NULL),
ev_labels AS (SELECT DISTINCT variant, unnest([g_event, event]) AS label FROM late),
ev AS (SELECT l.variant, label, count(*) FILTER (g_event = label AND event = label) AS tp, count(*) FILTER (g_event <> label AND event = label) AS fp,
              count(*) FILTER (g_event = label AND event <> label) AS fn FROM ev_labels l JOIN late USING (variant) GROUP BY 1, 2),
ev_avg AS (SELECT variant, round(avg(f1), 4) AS macro FROM (SELECT variant, {_PRF} FROM ev) GROUP BY 1),
dr AS (SELECT variant, label, count(*) FILTER (g_dir = label AND dir = label) AS tp, count(*) FILTER (g_dir <> label AND dir = label) AS fp,
              count(*) FILTER (g_dir = label AND dir <> label) AS fn FROM late, (VALUES ('alcista'), ('bajista'), ('neutral')) AS d(label) GROUP BY 1, 2),
dr_avg AS (SELECT variant, round(avg(f1), 4) AS macro FROM (SELECT variant, {_PRF} FROM dr) GROUP BY 1),
acc AS (SELECT variant, round(avg((g_event = event)::INT), 4) AS ev_acc, round(avg((g_dir = dir)::INT), 4) AS dir_acc, count(*) AS n,
               avg(abs(list_position(['muy_baja', 'baja', 'media', 'alta', 'muy_alta'], g_sev) - list_position(['muy_baja', 'baja', 'media', 'alta', 'muy_alta'], sev))) AS mae,
               avg((abs(list_position(['muy_baja', 'baja', 'media', 'alta', 'muy_alta'], g_sev) - list_position(['muy_baja', 'baja', 'media', 'alta', 'muy_alta'], sev)) <= 1)::INT) AS within
        FROM late GROUP BY 1),
sizes AS (SELECT variant, count(*) AS n FROM preds GROUP BY 1)"""


@query("D17_gold_predictions", f"""WITH {_EVALUATED}
SELECT variant, (SELECT CAST(count(*) AS BIGINT) FROM gold) AS dataset_size, CAST(n AS BIGINT) AS predictions_count,
       CAST((SELECT count(*) FROM gold) - n AS BIGINT) AS missing_predictions FROM sizes""")
def gold_predictions(t: Tables):
    return metrics.evaluate(_gold(t), _predictions(t))["summary"]


@query("E20_evaluation", f"""WITH {_EVALUATED}
SELECT variant, CAST(r.tp AS BIGINT) AS tp, CAST(r.fp AS BIGINT) AS fp, CAST(r.fn AS BIGINT) AS fn, CAST(r.tn AS BIGINT) AS tn,
       round((r.tp + r.tn) / (r.tp + r.fp + r.fn + r.tn), 4) AS relevance_accuracy, round(s.tp / (s.tp + s.fp), 4) AS asset_precision,
       round(s.tp / (s.tp + s.fn), 4) AS asset_recall, round(s.exact, 4) AS asset_exact, CAST(coalesce(a.n, 0) AS BIGINT) AS n_severity
FROM rel r JOIN set_sums s USING (variant) LEFT JOIN acc a USING (variant)""")
def evaluation(t: Tables):
    tables = metrics.evaluate(_gold(t), _predictions(t))
    relevance = tables["relevance"].select("variant", "tp", "fp", "fn", "tn", F.col("accuracy").alias("relevance_accuracy"))
    assets = tables["matched_assets"].select("variant", F.col("micro_precision").alias("asset_precision"), F.col("micro_recall").alias("asset_recall"),
                                             F.col("exact_match_rate").alias("asset_exact"))
    severity = tables["severity"].select("variant", F.col("n").alias("n_severity"))
    return relevance.join(assets, "variant").join(severity, "variant", "left").na.fill(0, ["n_severity"])


E21_SELECT = """
SELECT variant, round(2 * r.tp / (2 * r.tp + r.fp + r.fn), 4) AS relevance_f1, round(r.tp / (r.tp + r.fp), 4) AS relevance_precision, round(r.tp / (r.tp + r.fn), 4) AS relevance_recall,
       round(2 * s.tp / (2 * s.tp + s.fp + s.fn), 4) AS matched_assets_f1, round(s.jac, 4) AS matched_assets_jaccard,
       coalesce(e.macro, 0) AS event_type_macro_f1, coalesce(a.ev_acc, 0) AS event_type_accuracy, coalesce(a.dir_acc, 0) AS direction_accuracy,
       coalesce(d.macro, 0) AS direction_macro_f1, coalesce(round(a.mae, 4), 0) AS severity_mae, coalesce(round(a.within, 4), 0) AS severity_off_by_one
FROM rel r JOIN set_sums s USING (variant) LEFT JOIN ev_avg e USING (variant) LEFT JOIN dr_avg d USING (variant) LEFT JOIN acc a USING (variant)"""
EVALUATED_FROM_JOIN = _EVALUATED[_EVALUATED.index("joined AS"):]


@query("E21_ablation_summary", f"WITH {_EVALUATED} {E21_SELECT}")
def ablation_summary(t: Tables):
    return metrics.ablation_summary(metrics.evaluate(_gold(t), _predictions(t)))


# --- Agreement --------------------------------------------------------------------------------------

_RATED = """levels AS (SELECT ['muy_baja', 'baja', 'media', 'alta', 'muy_alta'] AS names),
pairs AS (
  SELECT 'quality' AS dimension, doc_id AS item_id, CASE quality WHEN 1 THEN 'yes' ELSE 'no' END AS a, CASE toxic WHEN 0 THEN 'yes' ELSE 'no' END AS b FROM labels
  UNION ALL SELECT 'severity_label', o_orderkey, names[CAST(substr(o_orderpriority, 1, 1) AS INTEGER)], names[CAST(least(floor(o_totalprice / 100000), 4) AS INTEGER) + 1] FROM orders, levels),
ratings AS (
  SELECT dimension, item_id, a AS label FROM pairs UNION ALL SELECT dimension, item_id, b FROM pairs
  UNION ALL SELECT 'severity_label', o_orderkey, names[CAST(1 + o_custkey % 5 AS INTEGER)] FROM orders, levels
  UNION ALL SELECT 'quality', doc_id, CASE WHEN doc_id % 3 = 0 THEN 'no' ELSE 'yes' END FROM labels),
gappy AS (SELECT dimension, item_id, CASE WHEN (item_id + ascii(label)) % 4 = 0 THEN NULL ELSE label END AS label FROM ratings)"""


def _level(position):
    return F.element_at(F.array(*[F.lit(x) for x in domain.SEVERITY_LEVELS]), position.cast("int"))


def _pairs(t: Tables):
    nominal = t["labels"].select(
        F.lit("quality").alias("dimension"), F.col("doc_id").alias("item_id"), F.when(F.col("quality") == 1, "yes").otherwise("no").alias("a"),
        F.when(F.col("toxic") == 0, "yes").otherwise("no").alias("b"))
    ordinal = t["orders"].select(
        F.lit("severity_label").alias("dimension"), F.col("o_orderkey").alias("item_id"), _level(F.substring("o_orderpriority", 1, 1)).alias("a"),
        _level(F.least(F.floor(F.col("o_totalprice") / 100000), F.lit(4)) + 1).alias("b"))
    return nominal.unionByName(ordinal)


def _ratings(t: Tables):
    both = _pairs(t).select("dimension", "item_id", F.explode(F.array("a", "b")).alias("label"))
    third = t["orders"].select(F.lit("severity_label").alias("dimension"), F.col("o_orderkey").alias("item_id"), _level(1 + F.col("o_custkey") % 5).alias("label"))
    fourth = t["labels"].select(F.lit("quality").alias("dimension"), F.col("doc_id").alias("item_id"),
                                F.when(F.col("doc_id") % 3 == 0, "no").otherwise("yes").alias("label"))
    return both.unionByName(third).unionByName(fourth)


def _gappy(t: Tables):
    missing = (F.col("item_id") + F.ascii("label")) % 4 == 0
    return _ratings(t).withColumn("label", F.when(~missing, F.col("label")))


@query("E22_percentage_agreement", f"WITH {_RATED} SELECT dimension, round(avg((a = b)::INT), 6) AS agreement FROM pairs GROUP BY 1")
def percentage_agreement(t: Tables):
    return _round(agreement.percentage_agreement(_pairs(t)), 6, "agreement")


_KAPPA = """po AS (SELECT dimension, avg((a = b)::INT) AS po, count(*) AS n FROM pairs GROUP BY 1),
pe AS (SELECT x.dimension, sum(x.n * y.n) AS s FROM (SELECT dimension, a, count(*) AS n FROM pairs GROUP BY 1, 2) x
       JOIN (SELECT dimension, b, count(*) AS n FROM pairs GROUP BY 1, 2) y ON x.dimension = y.dimension AND x.a = y.b GROUP BY 1),
cohen AS (SELECT dimension, (po - s / (n * n)) / (1 - s / (n * n)) AS kappa FROM po JOIN pe USING (dimension))"""


@query("E23_cohen_kappa", f"WITH {_RATED}, {_KAPPA} SELECT dimension, round(kappa, 6) AS kappa FROM cohen")
def cohen_kappa(t: Tables):
    return _round(agreement.cohen_kappa(_pairs(t)), 6, "kappa")


_WEIGHTED = """coded AS (SELECT list_position(names, a) AS i, list_position(names, b) AS j FROM pairs, levels WHERE dimension = 'severity_label'),
ri AS (SELECT i, count(*) AS n FROM coded GROUP BY 1), cj AS (SELECT j, count(*) AS n FROM coded GROUP BY 1),
weighted AS (SELECT 1 - (SELECT sum(power(abs(i - j) / 4, 2)) FROM coded) / (SELECT sum(power(abs(i - j) / 4, 2) * ri.n * cj.n) / (SELECT count(*) FROM coded) FROM ri, cj) AS quadratic,
                    1 - (SELECT sum(abs(i - j) / 4) FROM coded) / (SELECT sum(abs(i - j) / 4 * ri.n * cj.n) / (SELECT count(*) FROM coded) FROM ri, cj) AS linear)"""


@query("E24_weighted_kappa", f"WITH {_RATED}, {_WEIGHTED} SELECT 'linear' AS weights, round(linear, 6) AS kappa FROM weighted UNION ALL SELECT 'quadratic', round(quadratic, 6) FROM weighted")
def weighted_kappa(t: Tables):
    ordinal = _pairs(t).where(F.col("dimension") == "severity_label")
    both = [agreement.weighted_kappa(ordinal, domain.SEVERITY_LEVELS, w).select(F.lit(w).alias("weights"), "kappa") for w in ("linear", "quadratic")]
    return _round(both[0].unionByName(both[1]), 6, "kappa")


@query("E25_fleiss_kappa", f"""WITH {_RATED},
cells AS (SELECT dimension, item_id, label, count(*) AS c FROM ratings GROUP BY 1, 2, 3),
items AS (SELECT dimension, item_id, sum(c * (c - 1)) / (sum(c) * (sum(c) - 1)) AS p FROM cells GROUP BY 1, 2),
shares AS (SELECT dimension, label, count(*) / sum(count(*)) OVER (PARTITION BY dimension) AS p FROM ratings GROUP BY 1, 2),
chance AS (SELECT dimension, sum(p * p) AS pe FROM shares GROUP BY 1)
SELECT dimension, round((avg(p) - any_value(pe)) / (1 - any_value(pe)), 6) AS kappa FROM items JOIN chance USING (dimension) GROUP BY 1""")
def fleiss_kappa(t: Tables):
    return _round(agreement.fleiss_kappa(_ratings(t)), 6, "kappa")


def _alpha_sql(distance, convention):
    factor = 1 if convention == "half" else 2
    return f"""
SELECT dimension, '{convention}' AS convention, round(1 - {factor} * sum(s / (m - 1)) / sum(m) / any_value(de), 6) AS alpha
FROM (SELECT dimension, item_id, m, coalesce(s, 0) AS s FROM used_items LEFT JOIN
        (SELECT x.dimension, x.item_id, sum({distance}) AS s FROM numbered x JOIN numbered y ON x.dimension = y.dimension AND x.item_id = y.item_id AND x.no < y.no GROUP BY 1, 2)
        USING (dimension, item_id))
JOIN (SELECT x.dimension, sum(({distance}) * x.n * y.n) / (sum(x.n * y.n) - any_value(z.n)) AS de FROM totals x JOIN totals y USING (dimension)
      JOIN (SELECT dimension, sum(n) AS n FROM totals GROUP BY 1) z ON z.dimension = x.dimension GROUP BY 1) USING (dimension) GROUP BY 1"""


_GAPPY = _RATED + """,
present AS (SELECT *, coalesce(list_position((SELECT names FROM levels), label), 0) AS r FROM gappy WHERE label IS NOT NULL),
used_items AS (SELECT dimension, item_id, count(*) AS m FROM present GROUP BY 1, 2 HAVING count(*) >= 2),
numbered AS (SELECT p.*, row_number() OVER (PARTITION BY dimension, item_id ORDER BY label) AS no FROM present p JOIN used_items USING (dimension, item_id)),
totals AS (SELECT dimension, label, r, count(*) AS n FROM numbered GROUP BY 1, 2, 3)"""


@query("E26_krippendorff_nominal", f"WITH {_GAPPY} {_alpha_sql('(x.label <> y.label)::INT', 'standard')}")
def krippendorff_nominal(t: Tables):
    return _round(agreement.krippendorff_alpha(_gappy(t)).withColumn("convention", F.lit("standard")), 6, "alpha")


@query("E26_krippendorff_ordinal", f"WITH {_GAPPY} SELECT * FROM ({_alpha_sql('power(x.r - y.r, 2)', 'standard')}) WHERE dimension = 'severity_label' "
       f"UNION ALL SELECT * FROM ({_alpha_sql('power(x.r - y.r, 2)', 'half')}) WHERE dimension = 'severity_label'")
def krippendorff_ordinal(t: Tables):
    rated = _gappy(t).where(F.col("dimension") == "severity_label")
    both = [agreement.krippendorff_alpha(rated, domain.SEVERITY_LEVELS, c).withColumn("convention", F.lit(c)) for c in ("standard", "half")]
    return _round(both[0].unionByName(both[1]), 6, "alpha")


_READING = ("CASE WHEN {0} < 0 THEN 'pobre' WHEN {0} <= 0.2 THEN 'leve' WHEN {0} <= 0.4 THEN 'aceptable' WHEN {0} <= 0.6 THEN 'moderado' "
            "WHEN {0} <= 0.8 THEN 'sustancial' ELSE 'casi_perfecto' END")


@query("E27_kappa_reading", f"SELECT event_id, {_READING.format('(value / 100 - 0.5)')} AS reading FROM events")
def kappa_reading(t: Tables):
    return t["events"].select("event_id", kappa_label(F.col("value") / 100 - 0.5).alias("reading"))


@query("E28_agreement_report", f"""WITH {_RATED}, {_KAPPA}, {_WEIGHTED},
two AS (SELECT list_position(names, a) AS i, list_position(names, b) AS j FROM pairs, levels WHERE dimension = 'severity_label'),
pool AS (SELECT unnest([i, j]) AS r FROM two),
alpha AS (SELECT 1 - ((SELECT sum(power(i - j, 2)) * 2 / (2 * count(*)) FROM two)) /
  (SELECT sum(power(x.r - y.r, 2) * x.n * y.n) / ((SELECT count(*) FROM pool) * ((SELECT count(*) FROM pool) - 1)) FROM (SELECT r, count(*) AS n FROM pool GROUP BY 1) x,
          (SELECT r, count(*) AS n FROM pool GROUP BY 1) y) AS a)
SELECT dimension, CAST(n AS BIGINT) AS n_common_items, round(po, 4) AS agreement, round(k, 4) AS kappa, CASE WHEN dimension = 'severity_label' THEN round((SELECT a FROM alpha), 4) END AS alpha,
       {_READING.format('k')} AS interpretation
FROM (SELECT dimension, n, po, CASE WHEN dimension = 'severity_label' THEN (SELECT quadratic FROM weighted) ELSE kappa END AS k FROM po JOIN cohen USING (dimension))""")
def agreement_report(t: Tables):
    return agreement.agreement_report(_pairs(t), {"severity_label": domain.SEVERITY_LEVELS})


_ANNOTATORS = """first AS (SELECT doc_id AS item_id, 'quality' AS dimension, CAST(quality AS VARCHAR) AS label FROM labels),
second AS (SELECT doc_id AS item_id, 'quality' AS dimension, CASE WHEN n_chars > 400 THEN '1' ELSE '0' END AS label FROM documents)"""


def _annotators(t: Tables):
    first = t["labels"].select(
        F.col("doc_id").alias("item_id"), F.lit("quality").alias("dimension"), F.col("quality").cast("string").alias("label"))
    second = t["documents"].select(
        F.col("doc_id").alias("item_id"), F.lit("quality").alias("dimension"), F.when(F.col("n_chars") > 400, "1").otherwise("0").alias("label"))
    return first, second


@query("D18_annotator_join", f"WITH {_ANNOTATORS} SELECT dimension, item_id, f.label AS a, s.label AS b FROM first f JOIN second s USING (dimension, item_id)")
def annotator_join(t: Tables):
    return agreement.common_items(*_annotators(t))


@query("S4_common_ids", f"WITH {_ANNOTATORS} SELECT item_id FROM first INTERSECT SELECT item_id FROM second")
def common_ids(t: Tables):
    return agreement.common_ids(*_annotators(t))


# --- Models -------------------------------------------------------------------------------------------

_TYPES = ", ".join(f"'{e}'" for e in domain.EVENT_TYPES)
_OUTPUTS = f"""outputs AS (
  SELECT event_id AS news_id, 'm' || m AS model, [{_TYPES}][1 + (event_id * m) % 12 // 3 * 3] AS event_type, ['alcista', 'bajista', 'neutral'][1 + (event_id + m // 3) % 3] AS direction,
         (event_id * m * 7 % 100) / 100.0::DOUBLE AS severity, (event_id * m * 3 % 100) / 100.0::DOUBLE AS confidence, (event_id + m) % 50 / 10.0::DOUBLE AS latency_s,
         CASE WHEN (event_id + m) % 11 = 0 THEN 'timeout' END AS error
  FROM events, unnest(range(1, 6)) AS r(m))"""


def _outputs(t: Tables):
    key, m = F.col("event_id"), F.col("m")
    types = F.array(*[F.lit(e) for e in domain.EVENT_TYPES])
    ways = F.array(*[F.lit(d) for d in domain.DIRECTIONS])
    rows = t["events"].select("event_id", F.explode(F.array(*[F.lit(i) for i in range(1, 6)])).alias("m"))
    return rows.select(
        key.alias("news_id"), F.concat(F.lit("m"), m).alias("model"),
        F.element_at(types, (1 + F.floor((key * m) % 12 / 3) * 3).cast("int")).alias("event_type"),
        F.element_at(ways, (1 + (key + F.floor(m / 3)) % 3).cast("int")).alias("direction"),
        ((key * m * 7 % 100) / F.lit(100.0)).alias("severity"), ((key * m * 3 % 100) / F.lit(100.0)).alias("confidence"),
        ((key + m) % 50 / F.lit(10.0)).alias("latency_s"), F.when((key + m) % 11 == 0, "timeout").alias("error"))


@query("D21_model_pairs", f"""WITH {_OUTPUTS}
SELECT a.news_id, a.model AS model_a, b.model AS model_b FROM outputs a JOIN outputs b ON a.news_id = b.news_id AND a.model < b.model WHERE a.error IS NULL AND b.error IS NULL""")
def model_pairs(t: Tables):
    return modelcompare.model_pairs(_outputs(t)).select("news_id", "model_a", "model_b")


@query("E39_model_agreement", f"""WITH {_OUTPUTS}
SELECT a.model AS model_a, b.model AS model_b, CAST(count(*) AS BIGINT) AS n, round(avg((a.event_type = b.event_type)::INT), 3) AS event_agreement,
       round(avg((a.direction = b.direction)::INT), 3) AS direction_agreement, round(avg(abs(a.severity - b.severity)), 4) AS severity_mae
FROM outputs a JOIN outputs b ON a.news_id = b.news_id AND a.model < b.model WHERE a.error IS NULL AND b.error IS NULL GROUP BY 1, 2""")
def model_agreement(t: Tables):
    return modelcompare.model_agreement(_outputs(t))


@query("E40_model_summary", f"""WITH {_OUTPUTS}
SELECT model, CAST(count(*) AS BIGINT) AS total, CAST(count(error) AS BIGINT) AS errors, round(avg(severity) FILTER (error IS NULL), 6) AS avg_severity,
       round(avg(confidence) FILTER (error IS NULL), 6) AS avg_confidence, round(avg(latency_s) FILTER (error IS NULL), 6) AS avg_latency,
       CAST(count(*) FILTER (error IS NULL AND direction = 'alcista') AS BIGINT) AS alcista, CAST(count(*) FILTER (error IS NULL AND direction = 'bajista') AS BIGINT) AS bajista,
       CAST(count(*) FILTER (error IS NULL AND direction = 'neutral') AS BIGINT) AS neutral FROM outputs GROUP BY 1""")
def model_summary(t: Tables):
    return _round(modelcompare.model_summary(_outputs(t)), 6, "avg_severity", "avg_confidence", "avg_latency")


@query("G3_top_events", f"""WITH {_OUTPUTS}
SELECT * FROM (SELECT model, event_type, CAST(count(*) AS BIGINT) AS n, CAST(row_number() OVER (PARTITION BY model ORDER BY count(*) DESC, event_type) AS INTEGER) AS rank
FROM outputs WHERE error IS NULL GROUP BY 1, 2) WHERE rank <= 5""")
def top_events(t: Tables):
    return modelcompare.top_events(_outputs(t))
