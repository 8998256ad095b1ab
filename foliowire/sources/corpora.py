"""Labelled corpora, portfolio files and annotation files; prediction and metric writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LABELS = "struct<is_relevant:boolean,matched_assets:array<string>,event_type:string,direction:string,severity_label:string>"
LABELLED_NEWS = ("id string, portfolio_id string, title string, summary string, content string, url string, "
                 f"source string, language string, labels {LABELS}")
ASSET = ("struct<ticker:string,name:string,sector:string,industry:string,country:string,weight:double,"
         "aliases:array<string>>")
PORTFOLIO = f"portfolio_id string, name string, assets array<{ASSET}>"
ANNOTATION_DIMENSIONS = ("is_relevant", "event_type", "direction", "severity_label")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def parse_corpus(lines: DataFrame, schema: str = LABELLED_NEWS) -> DataFrame:
    """Labelled news from JSON lines in ``value``; blank lines are skipped."""
    return lines.where(F.trim("value") != "").select(F.from_json("value", schema).alias("r")).select("r.*")


def read_portfolios(spark: SparkSession, path: str) -> DataFrame:
    """Portfolios from files that each hold one JSON array."""
    return spark.read.schema(PORTFOLIO).option("multiLine", True).json(path)


def flatten_portfolios(portfolios: DataFrame) -> DataFrame:
    """One row per asset of nested portfolios, with its position."""
    others = [c for c in portfolios.columns if c != "assets"]
    return portfolios.select(*others, F.posexplode("assets").alias("pos", "asset")).select(*others, "pos", "asset.*")


def parse_annotations(lines: DataFrame) -> DataFrame:
    """Item id and one column per label dimension, as text."""
    rows = parse_corpus(lines, f"id string, labels {LABELS}")
    return rows.select("id", *[F.col(f"labels.{d}").cast("string").alias(d) for d in ANNOTATION_DIMENSIONS])


def annotations_long(annotations: DataFrame, annotator: str) -> DataFrame:
    """(item_id, annotator, dimension, label) rows of an annotation table."""
    return annotations.unpivot("id", list(ANNOTATION_DIMENSIONS), "dimension", "label").select(
        F.col("id").alias("item_id"), F.lit(annotator).alias("annotator"), "dimension", "label")


def write_predictions(predictions: DataFrame, path: str) -> None:
    """JSON lines, one folder per variant."""
    predictions.hint("rebalance", "variant").write.mode("overwrite").partitionBy("variant").json(path)


def read_predictions(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)
