"""Returns, portfolio series and risk measures.

A return table holds at most one row per ticker and day, so windows by ticker or portfolio are bounded
by the calendar however skewed the raw ticks are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliowire import domain

Z_05 = -1.6448536269514722  # fixed value: 5 % quantile of the standard normal


def simple_returns(closes: DataFrame, key: str = "ticker") -> DataFrame:
    """(key, dt, ret): close over previous close minus one, the first day dropped."""
    previous = F.lag("close").over(W.partitionBy(key).orderBy("dt"))
    return closes.select(key, "dt", (F.col("close") / previous - 1).alias("ret")).where(F.col("ret").isNotNull())


def returns_of(prices: DataFrame) -> DataFrame:
    """Returns of any price source: a table with ``ret`` is taken as it is, one with ``close`` is differenced."""
    return prices.select("ticker", "dt", "ret") if "ret" in prices.columns else simple_returns(prices)


def available_weights(weights: DataFrame, returns: DataFrame) -> DataFrame:
    """Weights of the tickers that have returns, renormalised per portfolio."""
    usable = weights.join(returns.select("ticker").distinct(), "ticker", "left_semi")
    totals = usable.groupBy("portfolio_id").agg(F.sum("weight").alias("total"), F.count(F.lit(1)).alias("n_tickers"))
    return usable.join(totals.where(F.col("total") > 0), "portfolio_id").select(
        "portfolio_id", "ticker", (F.col("weight") / F.col("total")).alias("weight"), "n_tickers")


def complete_dates(returns: DataFrame, requested: DataFrame, benchmark: DataFrame | None = None) -> DataFrame:
    """Dates on which every requested ticker (and the benchmark) has a return."""
    wanted = requested.select("ticker").distinct()
    present = returns.join(wanted, "ticker", "left_semi")
    needed = present.select("ticker").distinct().agg(F.count(F.lit(1))).scalar()
    dates = present.groupBy("dt").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == needed).select("dt")
    return dates if benchmark is None else dates.join(benchmark.select("dt"), "dt", "left_semi")


def portfolio_returns(weights: DataFrame, returns: DataFrame, benchmark: DataFrame | None = None) -> DataFrame:
    """(portfolio_id, dt, ret[, bench]): weighted return on the dates where all the portfolio's tickers have one."""
    usable = available_weights(weights, returns)
    daily = usable.join(returns, "ticker").groupBy("portfolio_id", "dt").agg(
        F.sum(F.col("weight") * F.col("ret")).alias("ret"), F.count(F.lit(1)).alias("n"), F.max("n_tickers").alias("needed"))
    series = daily.where(F.col("n") == F.col("needed")).select("portfolio_id", "dt", "ret")
    if benchmark is None:
        return series
    return series.join(benchmark.select("dt", F.col("ret").alias("bench")), "dt").select("portfolio_id", "dt", "ret", "bench")


def growth(ret: Column) -> Column:
    """Compounded growth of a return column as an aggregate; valid for losses of 100 % and more too."""
    return F.product(ret + 1)


def cumulative_returns(series: DataFrame, key: str = "portfolio_id") -> DataFrame:
    """Running compounded return per date."""
    running = W.partitionBy(key).orderBy("dt").rowsBetween(W.unboundedPreceding, W.currentRow)
    return series.withColumn("cumulative", growth(F.col("ret")).over(running) - 1)


def drawdowns(series: DataFrame, key: str = "portfolio_id") -> DataFrame:
    """Value of one unit over time, its running peak (at least the start) and the drawdown from it."""
    running = W.partitionBy(key).orderBy("dt").rowsBetween(W.unboundedPreceding, W.currentRow)
    value = series.withColumn("value", growth(F.col("ret")).over(running))
    return value.withColumn("peak", F.greatest(F.lit(1.0), F.max("value").over(running))).withColumn(
        "drawdown", F.col("value") / F.col("peak") - 1)


def risk_measures(series: DataFrame, as_of_year: int, key: str = "portfolio_id", periods: int = domain.TRADING_DAYS) -> DataFrame:
    """All portfolio measures of a (key, dt, ret, bench) series, as fractions, one row per key."""
    year = F.sqrt(F.lit(float(periods)))
    r, b = F.col("ret"), F.col("bench")
    ytd = F.when(F.col("dt") >= F.make_date(F.lit(as_of_year), F.lit(1), F.lit(1)), r)
    pathed = drawdowns(series, key)
    base = pathed.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), (growth(r) - 1).alias("total_return"),
        F.coalesce(growth(ytd) - 1, F.lit(0.0)).alias("ytd_return"),
        F.avg(r).alias("mean"), F.stddev_samp(r).alias("sd"),
        F.sqrt(F.avg(F.when(r < 0, r * r).otherwise(0.0))).alias("downside"),
        F.min("drawdown").alias("max_drawdown"), F.max(r).alias("best"), F.min(r).alias("worst"),
        (F.count_if(r > 0) / F.nullif(F.count_if(r != 0), F.lit(0))).alias("win_rate"),
        (growth(b) - 1).alias("bench_return"), F.regr_slope(r, b).alias("beta"))
    measured = base.select(
        key, "n", "total_return", "ytd_return", "max_drawdown", "best", "worst", "win_rate", "bench_return",
        F.when(F.col("total_return") > -1, F.pow(F.col("total_return") + 1, F.lit(float(periods)) / F.col("n")) - 1).alias("annual_return"),
        (F.col("sd") * year).alias("volatility"),
        F.when(F.col("sd") > 0, F.col("mean") / F.col("sd") * year).alias("sharpe"),
        F.when(F.col("downside") > 0, F.col("mean") / F.col("downside") * year).alias("sortino"),
        (F.col("mean") + F.col("sd") * Z_05).alias("var_95"),
        (F.col("total_return") - F.col("bench_return")).alias("excess_return"),
        F.coalesce("beta", F.lit(0.0)).alias("beta"))
    tail = series.join(measured.select(key, "var_95"), key).where(F.col("ret") < F.col("var_95")).groupBy(key).agg(
        F.avg("ret").alias("tail_mean"))
    return measured.join(tail, key, "left").withColumn("cvar_95", F.coalesce("tail_mean", "var_95")).drop("tail_mean").withColumn(
        "calmar", F.when(F.col("max_drawdown") < 0, F.col("annual_return") / F.abs("max_drawdown")))


def asset_performance(weights: DataFrame, returns: DataFrame, periods: int = domain.TRADING_DAYS) -> DataFrame:
    """Per portfolio and ticker: total return, volatility, Sharpe, weight and contribution in percent.

    The measures are computed once per ticker and then joined to every portfolio that holds it.
    """
    year = F.sqrt(F.lit(float(periods)))
    per_ticker = returns.groupBy("ticker").agg(
        (growth(F.col("ret")) - 1).alias("total_return"), F.stddev_samp("ret").alias("sd"), F.avg("ret").alias("mean"))
    usable = available_weights(weights, returns)
    return usable.join(per_ticker, "ticker").select(
        "portfolio_id", "ticker", (F.col("weight") * 100).alias("weight_pct"), (F.col("total_return") * 100).alias("return_pct"),
        (F.col("sd") * year * 100).alias("volatility_pct"),
        F.when(F.col("sd") > 0, F.col("mean") / F.col("sd") * year).otherwise(0.0).alias("sharpe"),
        (F.col("total_return") * F.col("weight") * 100).alias("contribution_pct"))
