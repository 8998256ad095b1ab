"""Queries over returns, portfolio measures, event studies and calibration."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliowire import session
from foliowire.functions.scoring import severity_label
from foliowire.operators import asof, calibration, eventstudy, timeseries
from foliowire.plans.bindings import ALERT_EVENTS, ALERTS, DAILY, MONTHLY, RETURNS, Tables
from foliowire.plans.registry import query
from foliowire.sources import pricefeed


def _rounded(df, columns, places=6):
    for c in columns:
        df = df.withColumn(c, F.round(c, places))
    return df


# --- Returns and portfolio series -------------------------------------------------------------

_SERIES = MONTHLY + """,
weights AS (SELECT portfolio_id, ticker, weight / sum(weight) OVER (PARTITION BY portfolio_id) AS weight, count(*) OVER (PARTITION BY portfolio_id) AS needed
            FROM raw_weights WHERE ticker IN (SELECT ticker FROM monthly_returns)),
series AS (
  SELECT portfolio_id, dt, sum(weight * r.ret) AS ret, any_value(b.ret) AS bench FROM weights JOIN monthly_returns r USING (ticker) JOIN monthly_benchmark b USING (dt)
  GROUP BY portfolio_id, dt HAVING count(*) = any_value(needed)),
paths AS (SELECT *, product(1 + ret) OVER (PARTITION BY portfolio_id ORDER BY dt ROWS UNBOUNDED PRECEDING) AS value FROM series),
dd AS (SELECT *, value / greatest(1, max(value) OVER (PARTITION BY portfolio_id ORDER BY dt ROWS UNBOUNDED PRECEDING)) - 1 AS drawdown FROM paths),
base AS (
  SELECT portfolio_id, count(*) AS n, product(1 + ret) - 1 AS total_return, coalesce(product(1 + ret) FILTER (dt >= DATE '2001-01-01') - 1, 0) AS ytd_return,
         avg(ret) AS mean, stddev_samp(ret) AS sd, sqrt(sum(least(ret, 0) * least(ret, 0)) / count(*)) AS downside, min(drawdown) AS max_drawdown,
         max(ret) AS best, min(ret) AS worst, count(*) FILTER (ret > 0) / count(*) FILTER (ret <> 0) AS win_rate,
         product(1 + bench) - 1 AS bench_return, regr_slope(ret, bench) AS beta FROM dd GROUP BY 1),
measures AS (
  SELECT *, power(1 + total_return, 252.0::DOUBLE / n) - 1 AS annual_return, sd * sqrt(252) AS volatility, mean / sd * sqrt(252) AS sharpe,
         mean / downside * sqrt(252) AS sortino, mean - 1.6448536269514722 * sd AS var_95, total_return - bench_return AS excess_return FROM base),
full_measures AS (
  SELECT m.*, coalesce((SELECT avg(ret) FROM series s WHERE s.portfolio_id = m.portfolio_id AND s.ret < m.var_95), var_95) AS cvar_95,
         annual_return / abs(max_drawdown) AS calmar FROM measures m)"""


def _monthly(t: Tables):
    benchmark = timeseries.simple_returns(t.monthly_market)
    return timeseries.simple_returns(t.monthly), benchmark


def _series(t: Tables):
    returns, benchmark = _monthly(t)
    return timeseries.portfolio_returns(t.weights, returns, benchmark)


def _measures(t: Tables):
    return timeseries.risk_measures(_series(t), 2001)


@query("F1_daily_returns", f"WITH {RETURNS} SELECT ticker, dt, round(ret, 6) AS ret FROM asset_returns")
def daily_returns(t: Tables):
    return _rounded(timeseries.simple_returns(t.daily), ["ret"])


@query("F2_complete_dates", f"""WITH {RETURNS}
SELECT dt FROM asset_returns WHERE dt IN (SELECT dt FROM market_returns) GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT ticker) FROM asset_returns)""")
def complete_dates(t: Tables):
    returns = timeseries.simple_returns(t.daily)
    requested = t["part"].select(F.col("p_type").alias("ticker"))
    return timeseries.complete_dates(returns, requested, timeseries.simple_returns(t.market))


@query("D24_available_weights", f"""WITH {_SERIES} SELECT portfolio_id, ticker, round(weight, 6) AS weight FROM weights""")
def available_weights(t: Tables):
    usable = timeseries.available_weights(t.weights, _monthly(t)[0])
    return _rounded(usable, ["weight"]).select("portfolio_id", "ticker", "weight")


@query("F3_portfolio_returns", f"""WITH {_SERIES} SELECT portfolio_id, dt, round(ret, 6) AS ret, round(bench, 6) AS bench FROM series""")
def portfolio_returns(t: Tables):
    return _rounded(_series(t), ["ret", "bench"])


@query("F4_cumulative_returns", f"""WITH {_SERIES} SELECT portfolio_id, dt, round((value - 1) * 100, 2) AS value_pct FROM paths""")
def cumulative_returns(t: Tables):
    return timeseries.cumulative_returns(_series(t)).select("portfolio_id", "dt", F.round(F.col("cumulative") * 100, 2).alias("value_pct"))


def _measure_query(name, *columns):
    listed = ", ".join(f"round({c}, 6) AS {c}" for c in columns)

    @query(name, f"WITH {_SERIES} SELECT portfolio_id, {listed} FROM full_measures")
    def run(t: Tables):
        return _rounded(_measures(t).select("portfolio_id", *columns), columns)


_measure_query("F5_total_return", "total_return")
_measure_query("F6_annual_return", "annual_return")
_measure_query("F7_ytd_return", "ytd_return")
_measure_query("F8_volatility", "volatility")
_measure_query("F9_sharpe", "sharpe")
_measure_query("F10_sortino", "sortino")
_measure_query("F11_max_drawdown", "max_drawdown")
_measure_query("F12_calmar", "calmar")
_measure_query("F13_value_at_risk", "var_95")
_measure_query("F14_tail_loss", "cvar_95")
_measure_query("F15_best_worst_win", "best", "worst", "win_rate")
_measure_query("F16_benchmark", "bench_return", "excess_return", "beta")


@query("F17_asset_performance", f"""WITH {_SERIES},
per AS (SELECT ticker, product(1 + ret) - 1 AS total, stddev_samp(ret) AS sd, avg(ret) AS mean FROM monthly_returns GROUP BY 1)
SELECT portfolio_id, ticker, round(weight * 100, 6) AS weight_pct, round(total * 100, 6) AS return_pct, round(sd * sqrt(252) * 100, 6) AS volatility_pct,
       round(mean / sd * sqrt(252), 6) AS sharpe, round(total * weight * 100, 6) AS contribution_pct FROM weights JOIN per USING (ticker)""")
def asset_performance(t: Tables):
    return _rounded(timeseries.asset_performance(t.weights, _monthly(t)[0]),
                    ["weight_pct", "return_pct", "volatility_pct", "sharpe", "contribution_pct"])


# --- Event study --------------------------------------------------------------------------------

_ALIGNED = RETURNS + """,
aligned AS (SELECT ticker, dt, a.ret, m.ret AS mkt, CAST(row_number() OVER (PARTITION BY ticker ORDER BY dt) - 1 AS INTEGER) AS idx,
                   count(*) OVER (PARTITION BY ticker) AS n_days FROM asset_returns a JOIN market_returns m USING (dt))"""

_ANCHORED = _ALIGNED + ", " + ALERT_EVENTS + """,
anchors AS (
  SELECT e.*, (SELECT min(a.dt) FROM aligned a WHERE a.ticker = e.ticker AND a.dt >= e.event_date) AS dt
  FROM (SELECT DISTINCT ticker, event_date FROM alert_events) e),
days AS (SELECT k.ticker, k.event_date, k.dt, a.idx, a.n_days FROM anchors k LEFT JOIN aligned a ON a.ticker = k.ticker AND a.dt = k.dt),
moments AS (
  SELECT d.ticker, d.event_date, count(*) AS n, avg(a.mkt) AS mx, avg(a.ret) AS my, var_pop(a.mkt) * count(*) AS sxx, var_pop(a.ret) * count(*) AS syy,
         covar_pop(a.ret, a.mkt) * count(*) AS sxy
  FROM days d JOIN aligned a ON a.ticker = d.ticker AND a.idx BETWEEN d.idx - 120 AND d.idx - 11 GROUP BY 1, 2),
fits AS (
  SELECT *, CASE WHEN n < 2 OR sxx = 0 THEN 0 ELSE sxy / sxx END AS beta,
         CASE WHEN n < 2 THEN 0 WHEN sxx = 0 THEN my ELSE my - sxy / sxx * mx END AS alpha,
         CASE WHEN n < 2 THEN 0 ELSE sqrt(greatest(0, syy - CASE WHEN sxx = 0 THEN 0 ELSE sxy * sxy / sxx END) / greatest(n - 2, 1)) END AS resid_std
  FROM moments),
models AS (
  SELECT d.*, coalesce(f.n, 0) AS n_estimation, alpha, beta, resid_std,
         CASE WHEN f.n < 2 OR sxx = 0 OR syy = 0 THEN 0 ELSE 1 - greatest(0, syy - sxy * sxy / sxx) / syy END AS r2
  FROM days d LEFT JOIN fits f USING (ticker, event_date)),
wins AS (SELECT * FROM (VALUES (-1, 1), (-1, 3), (-1, 5)) AS w(lo, hi)),
cars AS (
  SELECT m.ticker, m.event_date, w.lo, w.hi, sum(a.ret - (alpha + beta * a.mkt)) AS car, max(resid_std) AS resid_std
  FROM models m JOIN wins w ON m.idx + w.lo >= 0 AND m.idx + w.hi < m.n_days
       JOIN aligned a ON a.ticker = m.ticker AND a.idx BETWEEN m.idx + w.lo AND m.idx + w.hi
  WHERE m.n_estimation >= 30 AND m.resid_std >= 1e-12 GROUP BY 1, 2, 3, 4),
statuses AS (
  SELECT m.*, CASE WHEN m.dt IS NULL THEN 'event_after_data' WHEN m.idx - 11 <= greatest(0, m.idx - 120) THEN 'insufficient_estimation_window'
         WHEN m.n_estimation < 30 THEN 'too_few_estimation_days(' || m.n_estimation || ')' WHEN m.resid_std < 1e-12 THEN 'zero_residual_std'
         WHEN NOT EXISTS (SELECT 1 FROM cars c WHERE c.ticker = m.ticker AND c.event_date = m.event_date) THEN 'no_event_window_data' END AS status
  FROM models m),
results AS (SELECT e.alert_id, e.ticker, e.event_date, e.direction, e.severity, c.lo, c.hi, c.car, c.car / (c.resid_std * sqrt(c.hi - c.lo + 1)) AS t_stat
            FROM alert_events e JOIN cars c USING (ticker, event_date))"""


def _returns(t: Tables):
    return timeseries.simple_returns(t.daily), timeseries.simple_returns(t.market)


def _study(t: Tables, events=None):
    assets, market = _returns(t)
    return eventstudy.run_study(t.alert_events if events is None else events, assets, market)


def _results(t: Tables):
    return eventstudy.window_results(_study(t), ["alert_id", "ticker", "event_date", "direction", "severity"])


@query("D13_aligned_returns", f"WITH {_ALIGNED} SELECT ticker, dt, round(ret, 6) AS ret, round(mkt, 6) AS mkt FROM aligned")
def aligned_returns(t: Tables):
    return _rounded(eventstudy.align(*_returns(t)).select("ticker", "dt", "ret", "mkt"), ["ret", "mkt"])


@query("F18_trading_day_index", f"WITH {_ALIGNED} SELECT ticker, dt, idx, CAST(n_days AS BIGINT) AS n_days FROM aligned")
def trading_day_index(t: Tables):
    return eventstudy.align(*_returns(t)).select("ticker", "dt", "idx", "n_days")


@query("D14_event_anchor", f"""WITH {_ANCHORED}
SELECT e.alert_id, e.ticker, e.event_date, d.dt, CASE WHEN d.dt IS NULL THEN 'event_after_data' END AS anchor_error
FROM alert_events e JOIN days d USING (ticker, event_date)""")
def event_anchor(t: Tables):
    assets, market = _returns(t)
    placed = eventstudy.anchor(t.alert_events, eventstudy.align(assets, market), assets, market)
    return placed.select("alert_id", "ticker", "event_date", "dt", "anchor_error")


_HOURLY = """bars AS (SELECT event_type, date_trunc('hour', ts) AS bar_at, avg(value) AS close FROM events GROUP BY 1, 2),
framed AS (SELECT *, avg(close) OVER (PARTITION BY event_type ORDER BY bar_at ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS next_close,
                  avg(close) OVER (PARTITION BY event_type ORDER BY bar_at ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS past_close FROM bars)"""


@query("D14_intraday_anchor", f"""WITH {_HOURLY}
SELECT e.event_id, strftime(b.bar_at, '%Y-%m-%d %H:%M:%S') AS bar_at, round(b.close, 6) AS close FROM events e ASOF LEFT JOIN bars b ON e.event_type = b.event_type AND e.ts <= b.bar_at""")
def intraday_anchor(t: Tables):
    anchored = asof.asof_join(t["events"].select("event_id", "event_type", "ts"), _hourly(t).select("event_type", "bar_at", "close"), "event_type", "ts", "bar_at")
    return anchored.select("event_id", F.date_format("bar_at", "yyyy-MM-dd HH:mm:ss").alias("bar_at"), F.round("close", 6).alias("close"))


@query("D16_intraday_windows", f"""WITH {_HOURLY}
SELECT e.event_id, round(b.next_close - b.past_close, 6) AS change FROM events e ASOF LEFT JOIN framed b ON e.event_type = b.event_type AND e.ts <= b.bar_at""")
def intraday_windows(t: Tables):
    anchored = asof.asof_join(t["events"].select("event_id", "event_type", "ts"), _hourly(t), "event_type", "ts", "bar_at")
    return anchored.select("event_id", F.round(F.col("next_close") - F.col("past_close"), 6).alias("change"))


def _hourly(t: Tables):
    """Hourly bars of event values with the mean closes of the bars around each."""
    bars = t["events"].groupBy("event_type", F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("bar_at")).agg(F.avg("value").alias("close"))
    order = W.partitionBy("event_type").orderBy("bar_at")
    return bars.withColumn("next_close", F.avg("close").over(order.rowsBetween(0, 2))).withColumn("past_close", F.avg("close").over(order.rowsBetween(-5, -1)))


@query("D15_estimation_window", f"""WITH {_ANCHORED}
SELECT ticker, event_date, CAST(greatest(0, idx - 120) AS INTEGER) AS est_lo, CAST(idx - 11 AS INTEGER) AS est_hi, CAST(n_estimation AS BIGINT) AS n_estimation FROM models WHERE n_estimation >= 30""")
def estimation_window(t: Tables):
    study = _study(t, t.alert_events.select("ticker", "event_date").distinct())
    return study.where(F.col("n_estimation") >= 30).select(
        "ticker", "event_date", F.greatest(F.col("idx") - 120, F.lit(0)).alias("est_lo"), (F.col("idx") - 11).alias("est_hi"), "n_estimation")


@query("D16_event_windows", f"""WITH {_ANCHORED} SELECT alert_id, ticker, lo, hi FROM results""")
def event_windows(t: Tables):
    return _results(t).select("alert_id", "ticker", "lo", "hi")


@query("E29_market_model", f"""WITH {_ANCHORED}
SELECT ticker, event_date, round(alpha, 6) AS alpha, round(beta, 6) AS beta, round(resid_std, 6) AS resid_std, round(r2, 6) AS r2 FROM statuses
WHERE status IS NULL OR status IN ('zero_residual_std', 'no_event_window_data')""")
def market_model(t: Tables):
    study = _study(t, t.alert_events.select("ticker", "event_date").distinct())
    fitted = study.where(F.col("status").isNull() | F.col("status").isin("zero_residual_std", "no_event_window_data"))
    return _rounded(fitted.select("ticker", "event_date", "alpha", "beta", "resid_std", "r2"), ["alpha", "beta", "resid_std", "r2"])


@query("E29_grouped_model", f"""WITH {_ALIGNED}
SELECT ticker, CAST(count(*) AS BIGINT) AS n, round(regr_intercept(ret, mkt), 6) AS alpha, round(regr_slope(ret, mkt), 6) AS beta, round(regr_r2(ret, mkt), 6) AS r2
FROM aligned GROUP BY 1""")
def grouped_model(t: Tables):
    fit = eventstudy.ols_by_group(eventstudy.align(*_returns(t)), ["ticker"])
    return _rounded(fit.select("ticker", "n", "alpha", "beta", "r2"), ["alpha", "beta", "r2"])


@query("E30_event_car", f"""WITH {_ANCHORED}
SELECT alert_id, ticker, lo, hi, round(car, 6) AS car, round(t_stat, 6) AS t_stat, abs(t_stat) > 1.96 AS significant FROM results""")
def event_car(t: Tables):
    return _rounded(_results(t).select("alert_id", "ticker", "lo", "hi", "car", "t_stat", "significant"), ["car", "t_stat"])


@query("E31_event_status", f"""WITH {_ANCHORED} SELECT alert_id, ticker, status FROM alert_events JOIN statuses USING (ticker, event_date)
UNION ALL SELECT o_orderkey, 'UNLISTED', 'no_asset_data' FROM orders WHERE o_orderstatus = 'P'
UNION ALL SELECT o_orderkey, 'STANDARD', 'event_after_data' FROM orders WHERE o_orderstatus = 'F'""")
def event_status(t: Tables):
    orders = t["orders"]
    extra = [orders.where(F.col("o_orderstatus") == s).select(
        F.col("o_orderkey").alias("alert_id"), F.lit(k).alias("ticker"), day.alias("event_date"), F.lit("neutral").alias("direction"),
        F.lit(0.1).alias("severity")) for s, k, day in (("P", "UNLISTED", F.to_date("o_orderdate")), ("F", "STANDARD", F.lit("2030-01-01").cast("date")))]
    return _study(t, t.alert_events.unionByName(extra[0]).unionByName(extra[1])).select("alert_id", "ticker", "status")


_AGG = """SELECT lo, hi, CAST(count(*) AS BIGINT) AS n, round(avg(car), 6) AS mean_car, round(stddev_samp(car), 6) AS std_car,
       round(avg(car) / (stddev_samp(car) / sqrt(count(*))), 6) AS t_stat, round(avg(CASE WHEN car > 0 THEN 1 ELSE 0 END), 6) AS positive_rate,
       round(avg(abs(car)), 6) AS mean_abs_car FROM results GROUP BY 1, 2"""
_HIT = "avg(CASE WHEN CASE WHEN car > 0.005 THEN 'alcista' WHEN car < -0.005 THEN 'bajista' ELSE 'neutral' END = direction THEN 1 ELSE 0 END)"


@query("E32_window_statistics", f"WITH {_ANCHORED} {_AGG}")
def window_statistics(t: Tables):
    columns = ["mean_car", "std_car", "t_stat", "positive_rate", "mean_abs_car"]
    return _rounded(eventstudy.aggregate_windows(_results(t)).select("lo", "hi", "n", *columns), columns)


@query("E33_directional_hits", f"""WITH {_ANCHORED}
SELECT lo, hi, round({_HIT}, 6) AS directional_hit_rate, CAST(count(*) AS BIGINT) AS n_directional FROM results GROUP BY 1, 2""")
def directional_hits(t: Tables):
    stats = eventstudy.aggregate_windows(_results(t)).select("lo", "hi", "directional_hit_rate", "n_directional")
    return _rounded(stats, ["directional_hit_rate"])


@query("E34_error_histogram", f"""WITH {_ANCHORED}
SELECT coalesce(split_part(status, '(', 1), 'valid') AS outcome, CAST(count(*) AS BIGINT) AS n FROM alert_events JOIN statuses USING (ticker, event_date) GROUP BY 1""")
def error_histogram(t: Tables):
    return eventstudy.error_histogram(_study(t))


@query("E35_alert_backtest", f"""WITH {_ANCHORED}
SELECT (SELECT CAST(count(DISTINCT alert_id) AS BIGINT) FROM alert_events) AS n_alerts, CAST(count(*) AS BIGINT) AS n_car_observations, round(avg(car), 6) AS mean_car,
       round(avg(abs(car)), 6) AS mean_abs_car, round({_HIT}, 4) AS directional_hit_rate, CAST(count(*) AS BIGINT) AS n_directional
FROM results WHERE lo = -1 AND hi = 1""")
def alert_backtest(t: Tables):
    summary = eventstudy.backtest_summary(_study(t))
    return _rounded(_rounded(summary, ["mean_car", "mean_abs_car"]), ["directional_hit_rate"], 4)


_LABEL = "CASE WHEN severity >= 0.8 THEN 'muy_alta' WHEN severity >= 0.6 THEN 'alta' WHEN severity >= 0.4 THEN 'media' WHEN severity >= 0.2 THEN 'baja' ELSE 'muy_baja' END"


@query("E36_car_by_severity", f"""WITH {_ANCHORED}
SELECT {_LABEL} AS severity_label, CAST(count(*) AS BIGINT) AS n, round(avg(abs(car)), 6) AS mean_abs_car FROM results WHERE lo = -1 AND hi = 1 GROUP BY 1""")
def car_by_severity(t: Tables):
    events = t.alert_events.withColumn("severity_label", severity_label(F.col("severity")))
    return _rounded(eventstudy.car_by_severity(_study(t, events)), ["mean_abs_car"])


@query("F19_abnormal_path", f"""WITH {_ANCHORED},
valid AS (SELECT * FROM statuses WHERE status IS NULL AND idx - 1 >= 0 AND idx + 5 < n_days),
path AS (SELECT v.ticker, v.event_date, CAST(a.idx - v.idx AS INTEGER) AS day, a.ret - (alpha + beta * a.mkt) AS ar
         FROM valid v JOIN aligned a ON a.ticker = v.ticker AND a.idx BETWEEN v.idx - 1 AND v.idx + 5)
SELECT ticker, event_date, day, round(ar, 6) AS ar, round(sum(ar) OVER (PARTITION BY ticker, event_date ORDER BY day), 6) AS car FROM path""")
def abnormal_path(t: Tables):
    assets, market = _returns(t)
    events = t.alert_events.select("ticker", "event_date").distinct()
    return _rounded(eventstudy.abnormal_path(events, assets, market, ["ticker", "event_date"], (-1, 5)), ["ar", "car"])


@query("U3_price_sources", f"""WITH {RETURNS} SELECT 'close' AS source, ticker, CAST(count(*) AS BIGINT) AS n, round(sum(ret), 4) AS total FROM asset_returns GROUP BY 2
UNION ALL SELECT 'ret', ticker, CAST(count(*) AS BIGINT), round(sum(ret), 4) FROM asset_returns GROUP BY 2""")
def price_sources(t: Tables):
    def summed(source, returns):
        return returns.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("ret"), 4).alias("total")).select(
            F.lit(source).alias("source"), "ticker", "n", "total")

    closes = timeseries.returns_of(t.daily)
    return summed("close", closes).unionByName(summed("ret", timeseries.returns_of(closes)))


@query("U3_registered_source", f"""WITH {DAILY}
SELECT ticker, dt, round(close / before - 1, 6) AS ret FROM (SELECT ticker, dt, close, lag(close) OVER (PARTITION BY ticker ORDER BY dt) AS before FROM daily WHERE dt >= DATE '1996-01-01')
WHERE before IS NOT NULL""")
def registered_source(t: Tables):
    """Returns of closes that a registered provider serves from a folder per ticker."""
    folder = session.scratch_path(t.spark, "closes")
    t.daily.select("ticker", "dt", "close").write.partitionBy("ticker").parquet(folder)
    span = t.spark.read.parquet(folder).agg(F.min("dt").alias("a"), F.max("dt").alias("b")).first()
    known = [r.ticker for r in t.daily.select("ticker").distinct().collect()]
    pricefeed.register_prices(t.spark, "daily_closes", _folder_closes(folder), known if span.a else [], span.a, span.b, 5)
    closes = t.spark.read.format("daily_closes").load().where("dt >= DATE '1996-01-01'")
    return _rounded(timeseries.simple_returns(closes).select("ticker", "dt", "ret"), ["ret"])


def _folder_closes(folder: str):
    """A provider that reads the closes of a ticker from a folder that all executors share."""
    local = "/" + folder.removeprefix("file:").lstrip("/") if folder.startswith(("file:", "/")) else None

    def fetch(ticker, since, until):
        import pyarrow.dataset as ds
        from pyarrow import fs

        system, path = (fs.LocalFileSystem(), local) if local else fs.FileSystem.from_uri(folder)
        rows = ds.dataset(path, filesystem=system, format="parquet", partitioning="hive", exclude_invalid_files=False)
        wanted = (ds.field("ticker") == ticker) & (ds.field("dt") >= since) & (ds.field("dt") <= until)
        for batch in rows.to_batches(columns=["dt", "close"], filter=wanted):
            yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())

    return fetch


# --- Calibration ----------------------------------------------------------------------------------

@query("E37_isotonic_calibration", f"""WITH RECURSIVE {_ANCHORED},
points AS (SELECT severity AS x, sum(abs(car)) AS s, count(*)::DOUBLE AS w, row_number() OVER (ORDER BY severity) AS i FROM results WHERE lo = -1 AND hi = 1 AND car IS NOT NULL GROUP BY severity),
listed AS MATERIALIZED (SELECT list({{'lo': x, 'hi': x, 's': s, 'w': w}} ORDER BY i) AS p, count(*) AS n FROM points),
-- pool adjacent violators: a stack of blocks takes the next point, or joins its last two blocks while their means fall
pooled(i, blocks) AS (
  SELECT 0::BIGINT, []::STRUCT(lo DOUBLE, hi DOUBLE, s DOUBLE, w DOUBLE)[]
  UNION ALL
  SELECT CASE WHEN falls THEN i ELSE i + 1 END,
         CASE WHEN falls THEN list_append(blocks[:len(blocks) - 2], {{'lo': blocks[-2].lo, 'hi': blocks[-1].hi, 's': blocks[-2].s + blocks[-1].s, 'w': blocks[-2].w + blocks[-1].w}})
              ELSE list_append(blocks, p[i + 1]) END
  FROM (SELECT *, len(blocks) > 1 AND blocks[-2].s / blocks[-2].w >= blocks[-1].s / blocks[-1].w AS falls FROM pooled), listed
  WHERE falls OR i < n),
fitted AS (SELECT unnest(blocks) AS b FROM (SELECT blocks FROM pooled ORDER BY i DESC, len(blocks) LIMIT 1)),
knots AS (SELECT b.lo AS x, b.s / b.w AS y FROM fitted UNION SELECT b.hi, b.s / b.w FROM fitted),
grid AS (SELECT g / 20.0::DOUBLE AS x FROM unnest(range(0, 21)) AS r(g)),
beside AS (SELECT x, (SELECT max(k.x) FROM knots k WHERE k.x <= grid.x) AS x0, (SELECT min(k.x) FROM knots k WHERE k.x >= grid.x) AS x1 FROM grid)
SELECT beside.x, round(greatest(0, CASE WHEN x0 IS NULL THEN b.y WHEN x1 IS NULL OR x0 = x1 THEN a.y ELSE a.y + (beside.x - x0) / (x1 - x0) * (b.y - a.y) END), 8) AS y
FROM beside LEFT JOIN knots a ON a.x = x0 LEFT JOIN knots b ON b.x = x1""")
def isotonic_calibration(t: Tables):
    seen = eventstudy.primary_observations(_study(t)).where(F.col("car").isNotNull())
    return _rounded(calibration.fit_curve(seen.select(F.col("severity").alias("score"), F.abs("car").alias("abs_car"))), ["y"], 8)


_CURVE = ALERTS + """,
curve AS (SELECT CAST(i AS INTEGER) AS i, 0.1 * (SELECT count(*) FILTER (value <= i * 10) / count(*) FROM events) AS y FROM unnest(range(0, 21)) AS r(i)),
spots AS (SELECT alert_id, severity, least(greatest(severity, 0), 1) * 20 AS spot FROM alerts),
looked AS (SELECT alert_id, severity, a.y + (spot - floor(spot)) * (coalesce(b.y, a.y) - a.y) AS expected
           FROM spots JOIN curve a ON a.i = CAST(floor(spot) AS INTEGER) LEFT JOIN curve b ON b.i = a.i + 1)"""


def _curve(t: Tables):
    """A monotone curve read off the distribution of event values."""
    counts = t["events"].agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("value") <= i * 10).alias(f"c{i}") for i in range(21)])
    return counts.select(F.posexplode(F.array(*[F.col(f"c{i}") / F.col("n") for i in range(21)])).alias("i", "share")).select(
        (F.col("i") / 20).alias("x"), (F.col("share") * 0.1).alias("y"))


@query("E38_curve_lookup", f"WITH {_CURVE} SELECT alert_id, round(expected, 10) AS expected_abs_car FROM looked")
def curve_lookup(t: Tables):
    return _rounded(calibration.lookup_curve(t.alerts, _curve(t), "severity").select("alert_id", "expected_abs_car"), ["expected_abs_car"], 10)


@query("E5_calibrated_label", f"""WITH {_CURVE} SELECT alert_id, CASE WHEN expected < 0.005 THEN 'muy_baja' WHEN expected < 0.015 THEN 'baja'
WHEN expected < 0.03 THEN 'media' WHEN expected < 0.06 THEN 'alta' ELSE 'muy_alta' END AS label FROM looked""")
def calibrated_label(t: Tables):
    labelled = calibration.calibrated_labels(t.alerts, _curve(t))
    return labelled.select("alert_id", F.col("severity_label_calibrated").alias("label"))
