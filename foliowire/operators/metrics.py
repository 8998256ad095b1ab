"""Classification, set and ordinal metrics, all derived from one contingency table per grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliowire import domain
from foliowire.functions.scoring import safe_divide, severity_rank
from foliowire.session import cut_lineage


def _group(df: DataFrame, by: list[str]):
    return df.groupBy(*by) if by else df.groupBy()


def _prf(tp: Column, predicted: Column, actual: Column) -> tuple[Column, Column, Column]:
    p, r = safe_divide(tp, predicted), safe_divide(tp, actual)
    return p, r, safe_divide(2 * p * r, p + r)


def contingency(df: DataFrame, true: str, pred: str, by: list[str] | None = None) -> DataFrame:
    """Counts per (group, true label, predicted label)."""
    return df.groupBy(*(by or []), F.col(true).alias("true"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def binary_metrics(df: DataFrame, true: str, pred: str, by: list[str] | None = None) -> DataFrame:
    """Confusion counts, precision, recall, F1 and accuracy of boolean columns, to 4 places."""
    by = by or []
    t, p = F.col(true), F.col(pred)
    counts = _group(df, by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"),
        F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))
    return _binary_rates(counts)


def _binary_rates(counts: DataFrame) -> DataFrame:
    precision, recall, f1 = _prf(F.col("tp"), F.col("tp") + F.col("fp"), F.col("tp") + F.col("fn"))
    accuracy = safe_divide(F.col("tp") + F.col("tn"), F.col("n"))
    return counts.select("*", *[F.round(c, 4).alias(a) for c, a in (
        (precision, "precision"), (recall, "recall"), (f1, "f1"), (accuracy, "accuracy"))])


def label_union(df: DataFrame, true: str, pred: str) -> DataFrame:
    """Sorted distinct labels of both columns."""
    return df.select(F.col(true).alias("label")).union(df.select(pred)).distinct().orderBy("label")


def per_class(counts: DataFrame, by: list[str] | None = None, labels: tuple[str, ...] | None = None) -> DataFrame:
    """Precision, recall, F1 (4 places) and support per label of a contingency table.

    Without given labels, the labels are those that occur. Given labels are listed even without support.
    """
    by = by or []
    sides = F.array(
        F.struct(F.col("true").alias("label"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"),
                 F.when(F.col("true") == F.col("pred"), F.col("n")).otherwise(0).alias("tp")),
        F.struct(F.col("pred").alias("label"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted"),
                 F.lit(0).cast("bigint").alias("tp")))
    rows = counts.select(*by, F.inline(sides))
    if labels is not None:
        rows = rows.where(F.col("label").isin(*labels))
        zero = F.lit(0).cast("bigint")
        spine = (counts.select(*by).distinct() if by else counts.agg(F.count(F.lit(1)))).select(
            *by, F.explode(F.array(*[F.lit(x) for x in labels])).alias("label"), zero.alias("support"), zero.alias("predicted"), zero.alias("tp"))
        rows = rows.unionByName(spine)
    sums = rows.groupBy(*by, "label").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "tp")])
    precision, recall, f1 = _prf(F.col("tp"), F.col("predicted"), F.col("support"))
    return sums.select(*by, "label", F.round(precision, 4).alias("precision"), F.round(recall, 4).alias("recall"),
                       F.round(f1, 4).alias("f1"), "support")


def averages(counts: DataFrame, classes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Macro and support-weighted averages of the rounded class values, and accuracy over all pairs."""
    by = by or []
    parts = ("precision", "recall", "f1")
    means = _group(classes, by).agg(
        *[F.round(F.avg(c), 4).alias(f"macro_{c}") for c in parts],
        *[F.round(safe_divide(F.sum(F.col(c) * F.col("support")), F.sum("support")), 4).alias(f"weighted_{c}") for c in parts])
    hits = F.sum(F.when(F.col("true") == F.col("pred"), F.col("n")).otherwise(0))
    total = _group(counts, by).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(hits, F.lit(0)).alias("hits"))
    accuracy = total.select(*by, "n", F.round(safe_divide(F.col("hits"), F.col("n")), 4).alias("accuracy"))
    if by:
        return means.join(accuracy, by)
    return means.select("*", accuracy.select("n").scalar().alias("n"), accuracy.select("accuracy").scalar().alias("accuracy"))


def confusion_matrix(counts: DataFrame, labels: tuple[str, ...] | None = None) -> DataFrame:
    """(true, pred, n) for every pair of labels, zeros included; pairs outside given labels are dropped."""
    zero = F.lit(0).cast("bigint").alias("n")
    if labels is None:
        known = counts.agg(F.array_distinct(F.concat(F.collect_set("true"), F.collect_set("pred"))).alias("labels"))
    else:
        known = counts.agg(F.array(*[F.lit(x) for x in labels]).alias("labels"), F.count(F.lit(1))).select("labels")
    spine = known.select(F.explode("labels").alias("true"), "labels").select("true", F.explode("labels").alias("pred"), zero)
    kept = counts.select("true", "pred", "n") if labels is None else counts.where(
        F.col("true").isin(*labels) & F.col("pred").isin(*labels)).select("true", "pred", "n")
    return kept.unionByName(spine).groupBy("true", "pred").agg(F.sum("n").alias("n"))


def set_metrics(df: DataFrame, true: str, pred: str, by: list[str] | None = None) -> DataFrame:
    """Micro precision, recall and F1, mean Jaccard and exact-match rate of ticker arrays, ignoring case."""
    by = by or []

    def upper(column):
        return F.array_distinct(F.transform(column, F.upper))

    rows = df.select(*by, upper(true).alias("t"), upper(pred).alias("p"))
    both, only_p, only_t = F.size(F.array_intersect("t", "p")), F.size(F.array_except("p", "t")), F.size(F.array_except("t", "p"))
    union = both + only_p + only_t
    jaccard = F.when(union == 0, 1.0).otherwise(both / F.when(union == 0, 1).otherwise(union))
    sums = _group(rows, by).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(both), F.lit(0)).alias("tp"), F.coalesce(F.sum(only_p), F.lit(0)).alias("fp"),
        F.coalesce(F.sum(only_t), F.lit(0)).alias("fn"), F.coalesce(F.avg(jaccard), F.lit(0.0)).alias("jaccard"),
        F.coalesce(F.avg(((only_p + only_t) == 0).cast("double")), F.lit(0.0)).alias("exact"))
    return _set_rates(sums, by)


def _set_rates(sums: DataFrame, by: list[str]) -> DataFrame:
    precision, recall, f1 = _prf(F.col("tp"), F.col("tp") + F.col("fp"), F.col("tp") + F.col("fn"))
    return sums.select(*by, "n", F.round(precision, 4).alias("micro_precision"), F.round(recall, 4).alias("micro_recall"),
                       F.round(f1, 4).alias("micro_f1"), F.round("jaccard", 4).alias("mean_jaccard"),
                       F.round("exact", 4).alias("exact_match_rate"))


def ordinal_metrics(df: DataFrame, true: str, pred: str, by: list[str] | None = None) -> DataFrame:
    """Mean absolute rank distance, exact and within-one rates of severity labels; unknown labels are skipped."""
    by = by or []
    distance = F.abs(severity_rank(F.col(true)) - severity_rank(F.col(pred)))
    rows = df.select(*by, distance.alias("d"))

    def rate(value):
        return F.round(F.coalesce(F.avg(value), F.lit(0.0)), 4)

    known = F.col("d").isNotNull()
    return _group(rows, by).agg(
        F.count("d").alias("n"), rate(F.col("d")).alias("mae"),
        rate(F.when(known, (F.col("d") == 0).cast("double"))).alias("exact_match"),
        rate(F.when(known, (F.col("d") <= 1).cast("double"))).alias("off_by_one_or_less"))


def match_predictions(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """Gold labels (id, gold_*) with each variant's prediction of the same id."""
    return gold.join(predictions, "id")


GOLD = ("gold_relevant", "gold_event", "gold_direction", "gold_severity")
PREDICTED = ("is_relevant", "event_type", "direction", "severity_label")


def evaluation_cells(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """Counts and asset-set sums per variant and combination of gold and predicted labels.

    One join and one aggregation; the label domains bound the number of cells, and every evaluation table
    is derived from them.
    """
    matched = match_predictions(gold, predictions)
    found, right = F.transform("matched_assets", F.upper), F.transform("gold_assets", F.upper)
    rows = matched.select("variant", *GOLD, *PREDICTED, F.array_distinct(right).alias("t"), F.array_distinct(found).alias("p"))
    both, only_p, only_t = F.size(F.array_intersect("t", "p")), F.size(F.array_except("p", "t")), F.size(F.array_except("t", "p"))
    union = both + only_p + only_t
    jaccard = F.when(union == 0, 1.0).otherwise(both / F.nullif(union, F.lit(0)))
    return rows.groupBy("variant", *GOLD, *PREDICTED).agg(
        F.count(F.lit(1)).alias("n"), F.sum(both).alias("tp"), F.sum(only_p).alias("fp"), F.sum(only_t).alias("fn"),
        F.sum(jaccard).alias("jaccard"), F.count_if((only_p + only_t) == 0).alias("exact"))


def evaluate(gold: DataFrame, predictions: DataFrame) -> dict[str, DataFrame]:
    """All evaluation tables per variant.

    ``gold``: id, gold_relevant, gold_assets, gold_event, gold_direction, gold_severity. ``predictions``:
    id, variant, is_relevant, matched_assets, event_type, direction, severity_label. Assets are judged where
    gold is relevant; the later labels where both are relevant and the prediction has a value.
    """
    by = ["variant"]
    cells = cut_lineage(evaluation_cells(gold, predictions))
    size = gold.agg(F.count(F.lit(1))).scalar()
    found = cells.groupBy("variant").agg(F.sum("n").alias("matched"))
    summary = predictions.groupBy("variant").agg(F.count(F.lit(1)).alias("predictions_count")).join(found, "variant", "left").select(
        "variant", size.alias("dataset_size"), "predictions_count", (size - F.coalesce("matched", F.lit(0))).alias("missing_predictions"))
    judged = cells.where(F.col("gold_relevant") & F.col("is_relevant"))

    def labels(true, pred):
        known = judged.where(F.col(pred).isNotNull())
        return known.groupBy("variant", F.col(true).alias("true"), F.col(pred).alias("pred")).agg(F.sum("n").alias("n"))

    events, directions = labels("gold_event", "event_type"), labels("gold_direction", "direction")
    return {
        "summary": summary,
        "relevance": _binary_from(cells, by),
        "matched_assets": _sets_from(cells.where("gold_relevant"), by),
        "event_type": averages(events, per_class(events, by), by),
        "direction": averages(directions, per_class(directions, by, domain.DIRECTIONS), by),
        "severity": _ordinal_from(labels("gold_severity", "severity_label"), by),
    }


def _binary_from(cells: DataFrame, by: list[str]) -> DataFrame:
    t, p = F.col("gold_relevant"), F.col("is_relevant")

    def total(condition):
        return F.sum(F.when(condition, F.col("n")).otherwise(0))

    counts = cells.groupBy(*by).agg(F.sum("n").alias("n"), total(t & p).alias("tp"), total(~t & p).alias("fp"), total(t & ~p).alias("fn"),
                                    total(~t & ~p).alias("tn"))
    return _binary_rates(counts)


def _sets_from(cells: DataFrame, by: list[str]) -> DataFrame:
    sums = cells.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("n", "tp", "fp", "fn")],
                                  (F.sum("jaccard") / F.sum("n")).alias("jaccard"), (F.sum("exact") / F.sum("n")).alias("exact"))
    return _set_rates(sums, by)


def _ordinal_from(counts: DataFrame, by: list[str]) -> DataFrame:
    d = F.abs(severity_rank(F.col("true")) - severity_rank(F.col("pred")))
    rows = counts.withColumn("d", d).where(F.col("d").isNotNull())

    def rate(value):
        return F.round(safe_divide(F.sum(value * F.col("n")), F.sum("n")), 4)

    return rows.groupBy(*by).agg(F.sum("n").alias("n"), rate(F.col("d")).alias("mae"), rate((F.col("d") == 0).cast("int")).alias("exact_match"),
                                 rate((F.col("d") <= 1).cast("int")).alias("off_by_one_or_less"))


def ablation_summary(tables: dict[str, DataFrame]) -> DataFrame:
    """The headline metrics of every variant in one row; stages a variant skipped count as 0."""
    picks = {
        "relevance": {"f1": "relevance_f1", "precision": "relevance_precision", "recall": "relevance_recall"},
        "matched_assets": {"micro_f1": "matched_assets_f1", "mean_jaccard": "matched_assets_jaccard"},
        "event_type": {"macro_f1": "event_type_macro_f1", "accuracy": "event_type_accuracy"},
        "direction": {"accuracy": "direction_accuracy", "macro_f1": "direction_macro_f1"},
        "severity": {"mae": "severity_mae", "off_by_one_or_less": "severity_off_by_one"},
    }
    out = tables["summary"].select("variant")
    for name, columns in picks.items():
        out = out.join(tables[name].select("variant", *[F.col(c).alias(a) for c, a in columns.items()]), "variant", "left")
    return out.na.fill(0.0)
