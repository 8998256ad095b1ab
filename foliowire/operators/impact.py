"""Event keywords, impact direction, severity and confidence, and the merge with supplied analyses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliowire import domain
from foliowire.functions import scoring


def _any_of(text: Column, words) -> list[Column]:
    return [F.contains(text, F.lit(w)).cast("int") for w in words]


def classify_by_keywords(df: DataFrame, text: str) -> DataFrame:
    """Event type with the most distinct keywords in the text; earlier types win ties."""
    lower = F.lower(text)
    hits = {e: reduce(lambda a, b: a + b, _any_of(lower, words)) for e, words in domain.EVENT_KEYWORDS.items()}
    scored = df.withColumn("_hits", F.array(*hits.values()))
    best = F.array_max("_hits")
    names = F.array(*[F.lit(e) for e in hits])
    winner = F.element_at(names, F.array_position("_hits", best).cast("int"))
    return scored.withColumn("keyword_hits", best).withColumn(
        "event_type", F.when(best > 0, winner).otherwise("otro")
    ).withColumn(
        "event_confidence", F.when(best > 0, F.least(0.3 + best * F.lit(0.15), F.lit(0.85))).otherwise(0.1)
    ).drop("_hits")


def event_priors(event_type: Column) -> tuple[Column, Column]:
    """(base severity, direction bias) of an event type; an unknown one counts as 'otro'."""
    severity, bias = domain.IMPACT_PRIORS["otro"]
    base = scoring.lookup(event_type, {e: p[0] for e, p in domain.IMPACT_PRIORS.items()}, F.lit(severity))
    lean = scoring.lookup(event_type, {e: p[1] for e, p in domain.IMPACT_PRIORS.items()}, F.lit(bias))
    return base, lean


def direction_score(sentiment: Column, confidence: Column, bias: Column) -> Column:
    return (
        F.when(sentiment == "positive", 0.5 + confidence * 0.3 + bias * 0.2)
        .when(sentiment == "negative", -0.5 - confidence * 0.3 + bias * 0.2)
        .otherwise(bias * 0.5)
    )


def impact_severity(base: Column, relevance: Column, sentiment_confidence: Column, n_assets: Column) -> Column:
    """Base severity scaled by relevance, strong sentiment and the number of assets; at most 1."""
    scaled = base * (0.7 + relevance * 0.3)
    strong = F.when(sentiment_confidence > 0.8, scaled * 1.1).otherwise(scaled)
    crowd = 1.0 + F.least(n_assets, F.lit(5)) * 0.05
    return F.least(F.when(n_assets > 1, strong * crowd).otherwise(strong), F.lit(1.0))


def impact_confidence(sentiment_confidence: Column, event_confidence: Column, relevance: Column) -> Column:
    return F.least(sentiment_confidence * 0.3 + event_confidence * 0.4 + relevance * 0.3, F.lit(1.0))


def estimate_impact(df: DataFrame) -> DataFrame:
    """Impact columns from sentiment, sentiment_confidence, event_type, event_confidence, relevance, matched_assets."""
    base, bias = event_priors(F.col("event_type"))
    mood = F.coalesce("sentiment", F.lit("neutral"))
    mood_conf = F.coalesce("sentiment_confidence", F.lit(0.5))
    score = direction_score(mood, mood_conf, bias)
    severity = impact_severity(base, F.col("relevance"), mood_conf, F.size("matched_assets"))
    return (
        df.withColumn("_score", score).withColumn("_severity", severity)
        .withColumn("direction_score", F.round("_score", 4))
        .withColumn("direction", scoring.direction_from_score(F.col("_score")))
        .withColumn("severity", F.round("_severity", 4))
        .withColumn("severity_label", scoring.severity_label(F.col("_severity")))
        .withColumn("confidence", F.round(impact_confidence(mood_conf, F.col("event_confidence"), F.col("relevance")), 4))
        .drop("_score", "_severity")
    )


def merge_analyses(impact: DataFrame, analyses: DataFrame, keys: list[str],
                   band: float = domain.MERGE_SEVERITY_BAND, accept: float = domain.MERGE_DIRECTION_CONFIDENCE,
                   places: int = 4) -> DataFrame:
    """Fold supplied analyses (keys, severity, direction, confidence; any may be null) into the estimates.

    Severity moves at most ``band`` from its estimate; a differing direction needs ``accept`` confidence;
    confidences are averaged. Rows without an analysis keep their estimate.
    """
    given = analyses.select(*keys, F.lit(True).alias("_given"), F.col("severity").alias("_severity"),
                            F.col("direction").alias("_direction"), F.col("confidence").alias("_confidence"))
    raw_severity = F.coalesce(F.col("_severity"), F.col("severity"))
    raw_direction = F.coalesce(F.col("_direction"), F.col("direction"))
    raw_confidence = F.coalesce(F.col("_confidence"), F.col("confidence"))
    low, high = F.greatest(F.lit(0.0), F.col("severity") - band), F.least(F.lit(1.0), F.col("severity") + band)
    moved = F.least(F.greatest(raw_severity, low), high)
    taken = (raw_direction == F.col("direction")) | (raw_confidence >= accept)
    has = F.coalesce(F.col("_given"), F.lit(False))
    merged = {
        "enhanced": has,
        "severity_raw": F.when(has, F.round(raw_severity, places)),
        "direction_raw": F.when(has, raw_direction),
        "severity": F.when(has, F.round(moved, places)).otherwise(F.col("severity")),
        "severity_label": F.when(has, scoring.severity_label(moved)).otherwise(F.col("severity_label")),
        "direction": F.when(has & taken, raw_direction).otherwise(F.col("direction")),
        "confidence": F.when(has, F.round(F.least(F.col("confidence") * 0.5 + raw_confidence * 0.5, F.lit(1.0)), places))
        .otherwise(F.col("confidence")),
    }
    kept = [c for c in impact.columns if c not in merged]
    return impact.join(given, keys, "left").select(*kept, *[v.alias(k) for k, v in merged.items()])


def validate_analysis(df: DataFrame) -> DataFrame:
    """Normalise parsed analyses: unknown labels replaced, numbers clamped to 0-1 with default 0.5."""
    def unit(column):
        number = F.col(column).try_cast("double")
        return F.round(scoring.clamp(F.coalesce(number, F.lit(0.5))), 4)

    event, direction = F.col("event_type"), F.col("direction")
    return df.withColumn("event_type", F.when(event.isin(*domain.EVENT_TYPES), event).otherwise("otro")).withColumn(
        "direction", F.when(direction.isin(*domain.DIRECTIONS), direction).otherwise("neutral")
    ).withColumn("severity", unit("severity")).withColumn("confidence", unit("confidence"))


def extract_json(text: Column) -> Column:
    """The JSON object inside a model's answer: reasoning tags and code fences removed, else the outermost braces."""
    thoughtless = F.trim(F.regexp_replace(text, "(?s)<think>.*?</think>", ""))
    unfenced = F.trim(F.regexp_replace(thoughtless, "(?m)^\\s*```.*$", ""))
    outer = F.regexp_extract(unfenced, "(?s)\\{.*\\}", 0)
    whole = F.when(F.try_parse_json(unfenced).isNotNull(), unfenced)
    inner = F.when((outer != "") & F.try_parse_json(outer).isNotNull(), outer)
    return F.coalesce(whole, inner)


def first_flat_object(text: Column) -> Column:
    """Alternative rule: a fenced object, else the first brace pair without nesting, else the text itself."""
    fenced = F.regexp_extract(text, "(?s)```(?:json)?\\s*(\\{.*?\\})\\s*```", 1)
    flat = F.regexp_extract(text, "(?s)\\{[^{}]*\\}", 0)
    return F.when(fenced != "", fenced).when(flat != "", flat).otherwise(text)
