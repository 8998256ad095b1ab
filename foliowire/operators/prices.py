"""Price bars and the quote columns derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliowire.functions.scoring import change_pct

# History periods as calendar intervals; ytd and max are handled apart.
PERIODS = {"1d": "1 DAY", "5d": "5 DAYS", "1mo": "1 MONTH", "3mo": "3 MONTHS", "6mo": "6 MONTHS", "1y": "1 YEAR",
           "2y": "2 YEARS", "5y": "5 YEARS", "10y": "10 YEARS"}


def in_period(df: DataFrame, period: str, as_of: Column, dt: str = "dt") -> DataFrame:
    """Rows of the history period that ends at ``as_of``; a plain predicate on the date."""
    if period == "max":
        return df
    start = F.trunc(as_of, "year") if period == "ytd" else F.to_date(as_of - F.expr(f"INTERVAL {PERIODS[period]}"))
    return df.where((F.col(dt) >= start) & (F.col(dt) <= as_of))


def ohlcv(ticks: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """Daily bars per ticker from ticks (key, dt, price, quantity, pos) and the key's ticker.

    The names join first; a hot key is split by the planner, and one aggregation combines on the map side.
    ``pos`` orders the ticks of a day.
    """
    bars = ticks.join(names, key).groupBy("ticker", "dt").agg(
        F.min_by("price", "pos").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", "pos").alias("close"), F.sum("quantity").alias("volume"))
    return bars.select(
        "ticker", F.date_format("dt", "yyyy-MM-dd").alias("date"),
        *[F.round(c, 2).alias(c) for c in ("open", "high", "low", "close")], F.col("volume").cast("bigint").alias("volume"))


def daily_change(closes: DataFrame) -> DataFrame:
    """Change of every close on the previous trading day in percent (ticker, dt, close in)."""
    previous = F.lag("close").over(W.partitionBy("ticker").orderBy("dt"))
    return closes.withColumn("previous", previous).withColumn("change_pct", change_pct(F.col("close"), F.col("previous")))


def high_distance(closes: DataFrame, target: Column) -> DataFrame:
    """Percent distance of each close from its 52-week high, and the upside to a target price."""
    year = W.partitionBy("ticker").orderBy(F.datediff("dt", F.lit("1970-01-01"))).rangeBetween(-364, 0)
    high = F.max("close").over(year)
    return closes.withColumn("high_52w", high).withColumn(
        "from_high_pct", (F.col("close") - F.col("high_52w")) / F.col("high_52w") * 100
    ).withColumn("upside_pct", (target - F.col("close")) / F.col("close") * 100)
