"""Market-model event study.

The model of an event depends only on its ticker and its anchor day. So models and abnormal returns are
computed once per (ticker, trading day) with row frames over the aligned series, and events of any
number meet them in one equi-join; nothing is expanded per event.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliowire import domain
from foliowire.session import cut_lineage


@dataclass(frozen=True)
class StudyConfig:
    estimation: tuple[int, int] = domain.ESTIMATION_WINDOW
    windows: tuple[tuple[int, int], ...] = domain.EVENT_WINDOWS
    min_days: int = domain.MIN_ESTIMATION_DAYS
    neutral_band: float = domain.NEUTRAL_BAND
    significant_t: float = domain.SIGNIFICANT_T
    zero_sd: float = 1e-12


def align(asset_returns: DataFrame, market_returns: DataFrame) -> DataFrame:
    """(ticker, dt, ret, mkt, idx, n_days): both returns present, positions counted per ticker from 0."""
    market = market_returns.where(F.col("ret").isNotNull()).select("dt", F.col("ret").alias("mkt"))
    joined = asset_returns.where(F.col("ret").isNotNull()).select("ticker", "dt", "ret").join(market, "dt")
    by_day = W.partitionBy("ticker").orderBy("dt")
    return joined.withColumn("idx", F.row_number().over(by_day) - 1).withColumn(
        "n_days", F.count(F.lit(1)).over(W.partitionBy("ticker")))


def fit_moments(n, mean_x, mean_y, sxx, syy, sxy):
    """(alpha, beta, resid_std, r2) of a least-squares line from its moments, with the degenerate cases."""
    flat = sxx == 0
    beta = F.when(flat | (n < 2), 0.0).otherwise(sxy / sxx)
    alpha = F.when(n < 2, 0.0).otherwise(mean_y - beta * mean_x)
    dof = F.greatest(n - 2, F.lit(1))
    explained = F.when(flat, 0.0).otherwise(sxy * sxy / sxx)
    sse = F.greatest(syy - explained, F.lit(0.0))
    resid = F.when(n < 2, 0.0).otherwise(F.sqrt(sse / dof))
    r2 = F.when((n < 2) | flat | (syy == 0), 0.0).otherwise(1 - sse / syy)
    return alpha, beta, resid, r2


def ols_by_group(df: DataFrame, keys: list[str], y: str = "ret", x: str = "mkt") -> DataFrame:
    """Market model per group in one aggregation pass."""
    n = F.count(F.lit(1))
    moments = df.groupBy(*keys).agg(
        n.alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), (F.var_pop(x) * n).alias("sxx"), (F.var_pop(y) * n).alias("syy"),
        (F.covar_pop(x, y) * n).alias("sxy"))
    alpha, beta, resid, r2 = fit_moments(*[F.col(c) for c in ("n", "mx", "my", "sxx", "syy", "sxy")])
    return moments.select(*keys, "n", alpha.alias("alpha"), beta.alias("beta"), resid.alias("resid_std"), r2.alias("r2"))


def models_by_day(aligned: DataFrame, cfg: StudyConfig = StudyConfig()) -> DataFrame:
    """For every ticker and anchor day: the market model of the days before, and one result per event window."""
    by_day = W.partitionBy("ticker").orderBy("dt")
    frame = by_day.rowsBetween(*cfg.estimation)
    n = F.count(F.lit(1)).over(frame)
    moments = aligned.select(
        "*", n.alias("n_estimation"), F.avg("mkt").over(frame).alias("mx"), F.avg("ret").over(frame).alias("my"),
        (F.var_pop("mkt").over(frame) * n).alias("sxx"), (F.var_pop("ret").over(frame) * n).alias("syy"),
        (F.covar_pop("mkt", "ret").over(frame) * n).alias("sxy"),
        *[F.sum(c).over(by_day.rowsBetween(lo, hi)).alias(f"{c}_{i}") for i, (lo, hi) in enumerate(cfg.windows) for c in ("ret", "mkt")])
    alpha, beta, resid, r2 = fit_moments(*[F.col(c) for c in ("n_estimation", "mx", "my", "sxx", "syy", "sxy")])
    fitted = moments.select(
        "ticker", "dt", "idx", "n_days", "n_estimation", alpha.alias("alpha"), beta.alias("beta"), resid.alias("resid_std"), r2.alias("r2"),
        *[c for c in moments.columns if c.startswith(("ret_", "mkt_"))])

    def window(i, lo, hi):
        length = hi - lo + 1
        car = F.col(f"ret_{i}") - F.col("alpha") * length - F.col("beta") * F.col(f"mkt_{i}")
        t = F.when(F.col("resid_std") > 0, car / (F.col("resid_std") * float(length) ** 0.5)).otherwise(0.0)
        inside = (F.col("idx") + lo >= 0) & (F.col("idx") + hi < F.col("n_days"))
        return F.when(inside, F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), car.alias("car"), t.alias("t_stat"),
                                       (F.abs(t) > cfg.significant_t).alias("significant")))

    results = F.array_compact(F.array(*[window(i, lo, hi) for i, (lo, hi) in enumerate(cfg.windows)]))
    return fitted.withColumn("windows", results).drop(*[c for c in fitted.columns if c.startswith(("ret_", "mkt_"))])


def anchor_calendar(aligned: DataFrame) -> DataFrame:
    """(ticker, event_date, dt): each calendar date up to the last trading day and the first trading day not before it."""
    previous = F.lag("dt").over(W.partitionBy("ticker").orderBy("dt"))
    first = F.coalesce(F.date_add(previous, 1), F.col("dt"))
    spans = aligned.select("ticker", "dt", first.alias("first"))
    return spans.select("ticker", "dt", F.explode(F.sequence("first", "dt")).alias("event_date"))


def anchor(events: DataFrame, aligned: DataFrame, asset_returns: DataFrame, market_returns: DataFrame) -> DataFrame:
    """Events with their anchor day ``dt`` or the data error that prevents one.

    A date before the series starts anchors on its first day.
    """
    spans = aligned.groupBy("ticker").agg(F.min("dt").alias("first_dt"), F.max("dt").alias("last_dt"))
    known = asset_returns.where(F.col("ret").isNotNull()).select("ticker").distinct().withColumn("has_data", F.lit(True))
    tickers = known.join(spans, "ticker", "left")
    market_days = market_returns.agg(F.count("ret")).scalar()
    looked_up = events.join(tickers, "ticker", "left").withColumn("market_days", market_days)
    error = (
        F.when(F.col("has_data").isNull(), "no_asset_data")
        .when(F.col("market_days") == 0, "no_benchmark_data")
        .when(F.col("first_dt").isNull(), "no_overlapping_dates")
        .when(F.col("event_date") > F.col("last_dt"), "event_after_data"))
    staged = looked_up.withColumn("anchor_error", error).withColumn(
        "search_date", F.when(F.col("anchor_error").isNull(), F.greatest("event_date", "first_dt")))
    calendar = anchor_calendar(aligned).withColumnRenamed("event_date", "search_date")
    return staged.join(calendar, ["ticker", "search_date"], "left").drop(
        "has_data", "first_dt", "last_dt", "market_days", "search_date")


def run_study(events: DataFrame, asset_returns: DataFrame, market_returns: DataFrame, cfg: StudyConfig = StudyConfig()) -> DataFrame:
    """One row per event: model, status and an array of window results.

    ``events`` carries ticker, event_date and whatever else should be kept. ``status`` is null for a
    valid event; errors follow the order in which the data can fail.
    """
    asset_returns, market_returns = cut_lineage(asset_returns), cut_lineage(market_returns)  # one row per ticker and day, read several times
    aligned = align(asset_returns, market_returns)
    models = models_by_day(aligned, cfg)
    placed = anchor(events, aligned, asset_returns, market_returns).join(models, ["ticker", "dt"], "left")
    low = F.greatest(F.col("idx") + cfg.estimation[0], F.lit(0))
    status = (
        F.when(F.col("anchor_error").isNotNull(), F.col("anchor_error"))
        .when(F.col("idx") + cfg.estimation[1] <= low, "insufficient_estimation_window")
        .when(F.col("n_estimation") < cfg.min_days, F.concat(F.lit("too_few_estimation_days("), "n_estimation", F.lit(")")))
        .when(F.col("resid_std") < cfg.zero_sd, "zero_residual_std")
        .when(F.size("windows") == 0, "no_event_window_data"))
    scored = placed.withColumn("status", status)
    fitted = F.col("status").isNull() | F.col("status").isin("zero_residual_std", "no_event_window_data")
    for column in ("alpha", "beta", "resid_std", "r2"):
        scored = scored.withColumn(column, F.when(fitted, F.col(column)).otherwise(0.0))
    none = F.array().cast(scored.schema["windows"].dataType)
    return scored.withColumn("n_estimation", F.when(fitted, F.col("n_estimation")).otherwise(0)).withColumn(
        "windows", F.when(F.col("status").isNull(), F.col("windows")).otherwise(none)).drop("anchor_error", "n_days")


def window_results(study: DataFrame, keys: list[str]) -> DataFrame:
    """Long form: one row per valid event and window."""
    return study.where(F.col("status").isNull()).select(*keys, F.inline("windows"))


def realised_direction(car, band: float):
    up, down, flat = domain.DIRECTIONS
    return F.when(car > band, up).when(car < -band, down).otherwise(flat)


def _hit_rate(direction, car, band):
    known = direction.isin(*domain.DIRECTIONS)
    return F.avg(F.when(known, (realised_direction(car, band) == direction).cast("double"))), F.count_if(known)


def aggregate_windows(results: DataFrame, cfg: StudyConfig = StudyConfig()) -> DataFrame:
    """Cross-event statistics per window, with the directional hit rate (null when no direction is known)."""
    rate, n_known = _hit_rate(F.col("direction"), F.col("car"), cfg.neutral_band)
    stats = results.groupBy("lo", "hi").agg(
        F.count(F.lit(1)).alias("n"), F.avg("car").alias("mean_car"), F.coalesce(F.stddev_samp("car"), F.lit(0.0)).alias("std_car"),
        F.avg((F.col("car") > 0).cast("double")).alias("positive_rate"), F.avg(F.abs("car")).alias("mean_abs_car"),
        rate.alias("directional_hit_rate"), n_known.alias("n_directional"))
    t = F.when(F.col("std_car") > 0, F.col("mean_car") / (F.col("std_car") / F.sqrt("n"))).otherwise(0.0)
    return stats.withColumn("t_stat", t)


def error_histogram(study: DataFrame) -> DataFrame:
    """Events per outcome: 'valid' or the error name without its detail."""
    name = F.regexp_extract(F.coalesce("status", F.lit("valid")), "^[^(:]+", 0)
    return study.groupBy(name.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def abnormal_path(events: DataFrame, asset_returns: DataFrame, market_returns: DataFrame, keys: list[str], window: tuple[int, int],
                  cfg: StudyConfig = StudyConfig()) -> DataFrame:
    """Abnormal return by relative day in one window, with its running sum, for valid events that cover it.

    The path is formed once per ticker and anchor day and unfolded after the event join.
    """
    lo, hi = window
    around = W.partitionBy("ticker").orderBy("dt").rowsBetween(lo, hi)
    asset_returns, market_returns = cut_lineage(asset_returns), cut_lineage(market_returns)
    segment = align(asset_returns, market_returns).select(
        "ticker", "dt", F.collect_list(F.struct("ret", "mkt")).over(around).alias("segment"))
    study = run_study(events, asset_returns, market_returns, cfg).where(F.col("status").isNull())
    covered = study.join(segment, ["ticker", "dt"]).where(F.size("segment") == hi - lo + 1)
    ar = F.transform("segment", lambda s: s["ret"] - (F.col("alpha") + F.col("beta") * s["mkt"]))
    arrays = covered.select(*keys, ar.alias("ar"))
    running = F.transform("ar", lambda _, i: F.aggregate(F.slice("ar", F.lit(1), i + 1), F.lit(0.0), lambda acc, x: acc + x))
    return arrays.select(*keys, F.posexplode(F.arrays_zip("ar", running.alias("running"))).alias("pos", "point")).select(
        *keys, (F.col("pos") + lo).alias("day"), F.col("point.ar").alias("ar"), F.col("point.running").alias("car"))


def primary_observations(study: DataFrame, cfg: StudyConfig = StudyConfig(), missing_as_zero: bool = False) -> DataFrame:
    """Valid alert-ticker rows with the CAR of the first configured window."""
    lo, hi = cfg.windows[0]
    first = F.try_element_at(F.filter("windows", lambda w: (w["lo"] == lo) & (w["hi"] == hi)), F.lit(1))["car"]
    rows = study.where(F.col("status").isNull()).withColumn("car", first)
    return rows.withColumn("car", F.coalesce("car", F.lit(0.0))) if missing_as_zero else rows


def backtest_summary(study: DataFrame, cfg: StudyConfig = StudyConfig()) -> DataFrame:
    """One row: alerts, observations, mean and absolute CAR and hit rate on the primary window."""
    rate, n_known = _hit_rate(F.col("direction"), F.col("car"), cfg.neutral_band)
    n_alerts = study.agg(F.countDistinct("alert_id")).scalar()
    seen = primary_observations(study, cfg).where(F.col("car").isNotNull())
    return seen.agg(
        F.count(F.lit(1)).alias("n_car_observations"), F.coalesce(F.avg("car"), F.lit(0.0)).alias("mean_car"),
        F.coalesce(F.avg(F.abs("car")), F.lit(0.0)).alias("mean_abs_car"), rate.alias("directional_hit_rate"),
        n_known.alias("n_directional")).withColumn("n_alerts", n_alerts)


def car_by_severity(study: DataFrame, cfg: StudyConfig = StudyConfig()) -> DataFrame:
    return primary_observations(study, cfg).where(F.col("car").isNotNull()).groupBy("severity_label").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs("car")).alias("mean_abs_car"))
