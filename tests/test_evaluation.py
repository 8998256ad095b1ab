import random

import pytest
from pyspark.sql import functions as F

from foliowire import domain
from foliowire.functions.scoring import kappa_label
from foliowire.operators import agreement, metrics, modelcompare, quality


def pairs(rows, a, b, dimension="d"):
    return rows([(dimension, i, x, y) for i, (x, y) in enumerate(zip(a, b))], "dimension string, item_id int, a string, b string")


def value(df, column):
    return df.first()[column]


def test_binary_metrics(rows):
    df = rows([(True, True)] * 2 + [(False, True), (True, False), (False, False)], "t boolean, p boolean")
    m = metrics.binary_metrics(df, "t", "p").first()
    assert (m["tp"], m["fp"], m["fn"], m["tn"]) == (2, 1, 1, 1)
    assert (m["precision"], m["recall"], m["f1"], m["accuracy"]) == (0.6667, 0.6667, 0.6667, 0.6)
    empty = metrics.binary_metrics(df.limit(0), "t", "p").first()
    assert empty["n"] == 0 and empty["f1"] == 0.0 and empty["accuracy"] == 0.0


def test_per_class_and_averages(rows):
    df = rows([("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")], "t string, p string")
    counts = metrics.contingency(df, "t", "p")
    classes = metrics.per_class(counts)
    got = {r["label"]: (r["precision"], r["recall"], r["f1"], r["support"]) for r in classes.collect()}
    assert got == {"a": (0.5, 0.5, 0.5, 2), "b": (0.5, 1.0, 0.6667, 1), "c": (0.0, 0.0, 0.0, 1)}
    means = metrics.averages(counts, classes).first()
    assert means["macro_f1"] == round((0.5 + 0.6667 + 0) / 3, 4) and means["accuracy"] == 0.5 and means["n"] == 4
    listed = {r["label"] for r in metrics.per_class(counts, labels=("a", "z")).collect()}
    assert listed == {"a", "z"}
    matrix = {(r["true"], r["pred"]): r["n"] for r in metrics.confusion_matrix(counts, ("a", "b")).collect()}
    assert matrix == {("a", "a"): 1, ("a", "b"): 1, ("b", "b"): 1, ("b", "a"): 0}


def test_set_metrics(rows):
    df = rows([(["A", "B"], ["a", "C"]), ([], [])], "t array<string>, p array<string>")
    m = metrics.set_metrics(df, "t", "p").first()
    assert (m["micro_precision"], m["micro_recall"], m["mean_jaccard"], m["exact_match_rate"]) == (0.5, 0.5, 0.6667, 0.5)


def test_ordinal_metrics(rows):
    df = rows([("alta", "alta"), ("media", "alta"), ("baja", "muy_alta"), ("alta", "?")], "t string, p string")
    m = metrics.ordinal_metrics(df, "t", "p").first()
    assert (m["n"], m["mae"], m["exact_match"], m["off_by_one_or_less"]) == (3, 1.3333, 0.3333, 0.6667)


def test_evaluate_filters_by_stage(rows):
    gold = rows([("1", True, ["A"], "litigio", "bajista", "alta"), ("2", True, ["B"], "otro", "neutral", "baja"), ("3", False, [], "otro", "neutral", "baja")],
                "id string, gold_relevant boolean, gold_assets array<string>, gold_event string, gold_direction string, gold_severity string")
    predicted = rows([("1", "full", True, ["A"], "litigio", "bajista", "media"), ("2", "full", True, ["B"], "litigio", "neutral", "baja"),
                      ("1", "rules", True, ["A"], None, None, None), ("3", "rules", True, ["Z"], None, None, None)],
                     "id string, variant string, is_relevant boolean, matched_assets array<string>, event_type string, direction string, severity_label string")
    tables = metrics.evaluate(gold, predicted)
    summary = {r["variant"]: (r["dataset_size"], r["predictions_count"], r["missing_predictions"]) for r in tables["summary"].collect()}
    assert summary == {"full": (3, 2, 1), "rules": (3, 2, 1)}
    report = {r["variant"]: r for r in metrics.ablation_summary(tables).collect()}
    assert report["full"]["event_type_accuracy"] == 0.5 and report["full"]["severity_mae"] == 0.5 and report["full"]["matched_assets_f1"] == 1.0
    assert report["rules"]["event_type_accuracy"] == 0.0 and report["rules"]["relevance_precision"] == 0.5


def test_cohen_textbook(rows):
    a = ["y"] * 25 + ["n"] * 25
    b = ["y"] * 20 + ["n"] * 5 + ["y"] * 10 + ["n"] * 15
    assert value(agreement.cohen_kappa(pairs(rows, a, b)), "kappa") == pytest.approx(0.4)
    assert value(agreement.cohen_kappa(pairs(rows, ["x"] * 5, ["x"] * 5)), "kappa") == 1.0
    assert value(agreement.percentage_agreement(pairs(rows, a, b)), "agreement") == pytest.approx(0.7)


def weighted(a, b, order, power):
    k, n, rank = len(order), len(a), {c: i for i, c in enumerate(order)}
    obs = sum((abs(rank[x] - rank[y]) / (k - 1)) ** power for x, y in zip(a, b))
    exp = sum((abs(rank[x] - rank[y]) / (k - 1)) ** power for x in a for y in b) / n
    return 1.0 if exp == 0 else 1 - obs / exp


def alpha(units, delta, halved):
    used = [[v for v in u if v is not None] for u in units]
    used = [u for u in used if len(u) >= 2]
    values = [v for u in used for v in u]
    observed = sum(sum(delta(x, y) for i, x in enumerate(u) for y in u[i + 1:]) / (len(u) - 1) for u in used) / len(values)
    observed *= 1 if halved else 2
    expected = sum(delta(x, y) for i, x in enumerate(values) for j, y in enumerate(values) if i != j) / (len(values) * (len(values) - 1))
    return 1.0 if expected == 0 else 1 - observed / expected


def test_weighted_kappa_and_alpha_equal_enumeration(rows):
    rng, order = random.Random(1), domain.SEVERITY_LEVELS
    a = [rng.choice(order) for _ in range(60)]
    b = [x if rng.random() < 0.6 else rng.choice(order) for x in a]
    for weights, power in (("linear", 1), ("quadratic", 2)):
        assert value(agreement.weighted_kappa(pairs(rows, a, b), order, weights), "kappa") == pytest.approx(weighted(a, b, order, power))
    third = [None if rng.random() < 0.3 else rng.choice(order) for _ in a]
    ratings = rows([("d", i, v) for column in (a, b, third) for i, v in enumerate(column)], "dimension string, item_id int, label string")
    units, rank = list(zip(a, b, third)), {c: i for i, c in enumerate(order)}
    for convention in ("standard", "half"):
        nominal = value(agreement.krippendorff_alpha(ratings, convention=convention), "alpha")
        assert nominal == pytest.approx(alpha(units, lambda x, y: float(x != y), convention == "half"))
        ordinal = value(agreement.krippendorff_alpha(ratings, order, convention), "alpha")
        assert ordinal == pytest.approx(alpha(units, lambda x, y: (rank[x] - rank[y]) ** 2, convention == "half"))


def test_fleiss(rows):
    same = rows([("d", i, "x" if i % 2 else "y") for i in range(10) for _ in range(3)], "dimension string, item_id int, label string")
    assert value(agreement.fleiss_kappa(same), "kappa") == pytest.approx(1.0)
    uneven = rows([("d", 1, "x"), ("d", 1, "y"), ("d", 2, "x")], "dimension string, item_id int, label string")
    assert value(agreement.fleiss_kappa(uneven), "kappa") is None


def test_agreement_of_a_rater_with_themselves(rows):
    a = ["alta", "baja", "media", "alta"]
    both = pairs(rows, a, a, "severity_label").unionByName(pairs(rows, ["p", "q"], ["p", "q"], "event_type"))
    report = {r["dimension"]: r for r in agreement.agreement_report(both, {"severity_label": domain.SEVERITY_LEVELS}).collect()}
    assert all(r["kappa"] == 1.0 and r["agreement"] == 1.0 and r["interpretation"] == "casi_perfecto" for r in report.values())
    assert report["severity_label"]["alpha"] == 1.0 and report["event_type"]["alpha"] is None


def test_kappa_reading(spark):
    cuts = [-0.1, 0.0, 0.2, 0.21, 0.4, 0.6, 0.8, 0.81]
    got = [spark.range(1).select(kappa_label(F.lit(c))).first()[0] for c in cuts]
    assert got == ["pobre", "leve", "leve", "aceptable", "aceptable", "moderado", "sustancial", "casi_perfecto"]


def test_model_comparison_skips_errors(rows):
    outputs = rows([(1, "a", "otro", "neutral", 0.5, 0.5, 1.0, None), (1, "b", "otro", "alcista", 0.7, 0.5, 3.0, None), (1, "c", None, None, None, None, 9.0, "timeout"),
                    (2, "a", "litigio", "bajista", 0.1, 0.3, 2.0, None)],
                   "news_id int, model string, event_type string, direction string, severity double, confidence double, latency_s double, error string")
    pair = modelcompare.model_agreement(outputs).collect()
    assert [(p["model_a"], p["model_b"], p["n"], p["event_agreement"], p["direction_agreement"], p["severity_mae"]) for p in pair] == [("a", "b", 1, 1.0, 0.0, 0.2)]
    per = {r["model"]: r for r in modelcompare.model_summary(outputs).collect()}
    assert per["c"]["errors"] == 1 and per["c"]["avg_severity"] == 0.0 and per["c"]["avg_latency"] is None
    assert per["a"]["avg_severity"] == pytest.approx(0.3) and per["a"]["bajista"] == 1


def test_corpus_checks(rows):
    corpus = rows([(False, "P1", "otro", ["A"]), (True, "P2", "litigio", ["A"]), (False, "P9", "otro", [])],
                  "is_relevant boolean, portfolio_id string, event_type string, matched_assets array<string>")
    known = rows([("P1",), ("P2",), ("P2",)], "portfolio_id string")
    got = {r["rule"]: r["value"] for r in quality.corpus_checks(corpus, known).collect()}
    assert got == {"irrelevant_with_assets": 1, "unknown_portfolio": 1, "negatives": 2, "event_types": 2}
