import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from foliowire.operators import asof, calibration, eventstudy, prices, timeseries
from foliowire.sources import pricefeed

START = pd.Timestamp("2023-01-02")
DAYS = [d.date() for d in pd.bdate_range(START, periods=200)]


def series(seed=7, beta=1.5, shocks=()):
    rng = np.random.default_rng(seed)
    market = rng.normal(0, 0.01, len(DAYS))
    asset = 0.0002 + beta * market + rng.normal(0, 0.004, len(DAYS))
    for day, size in shocks:
        asset[day] += size
    return asset, market


def tables(rows, asset, market, ticker="X", days=DAYS):
    a = rows([(ticker, d, float(r)) for d, r in zip(days, asset)], "ticker string, dt date, ret double")
    m = rows([(d, float(r)) for d, r in zip(days, market)], "dt date, ret double")
    return a, m


def events(rows, *items):
    return rows([(i, t, d, w) for i, (t, d, w) in enumerate(items)], "alert_id int, ticker string, event_date date, direction string")


def model(asset, market, t0):
    lo, hi = max(0, t0 - 120), t0 - 11
    x, y = market[lo:hi + 1], asset[lo:hi + 1]
    beta = np.cov(x, y, ddof=0)[0, 1] / np.var(x)
    alpha = y.mean() - beta * x.mean()
    resid = y - alpha - beta * x
    return alpha, beta, math.sqrt((resid ** 2).sum() / (len(x) - 2)), 1 - (resid ** 2).sum() / ((y - y.mean()) ** 2).sum()


def test_study_recovers_the_model_and_the_shock(rows):
    asset, market = series(shocks=[(150, 0.08), (151, 0.03)])
    study = eventstudy.run_study(events(rows, ("X", DAYS[150], "alcista")), *tables(rows, asset, market))
    row = study.first()
    alpha, beta, sd, r2 = model(asset, market, 150)
    assert row["status"] is None and row["n_estimation"] == 110
    assert (row["alpha"], row["beta"], row["resid_std"], row["r2"]) == pytest.approx((alpha, beta, sd, r2))
    assert row["beta"] == pytest.approx(1.5, abs=0.2)
    for w in row["windows"]:
        part = slice(150 + w["lo"], 150 + w["hi"] + 1)
        car = (asset[part] - alpha - beta * market[part]).sum()
        assert w["car"] == pytest.approx(car) and w["t_stat"] == pytest.approx(car / (sd * math.sqrt(w["hi"] - w["lo"] + 1)))
        assert w["significant"] and w["car"] > 0
    path = eventstudy.abnormal_path(events(rows, ("X", DAYS[150], "alcista")), *tables(rows, asset, market), ["alert_id"], (-1, 5)).orderBy("day").collect()
    assert [r["day"] for r in path] == list(range(-1, 6))
    assert path[-1]["car"] == pytest.approx(sum(r["ar"] for r in path)) and path[-1]["car"] == pytest.approx(row["windows"][2]["car"])


def test_study_statuses(rows):
    asset, market = series()
    weekend = next(d + dt.timedelta(1) for d in DAYS[100:] if d.weekday() == 4)
    batch = events(rows, ("X", DAYS[5], None), ("X", DAYS[35], None), ("X", DAYS[199] + dt.timedelta(40), None), ("Y", DAYS[100], None),
                   ("X", DAYS[199], None), ("X", weekend, None), ("X", DAYS[0] - dt.timedelta(3), None), ("X", DAYS[150], None))
    got = {r["alert_id"]: r for r in eventstudy.run_study(batch, *tables(rows, asset, market)).collect()}
    assert got[0]["status"] == "insufficient_estimation_window" and got[6]["status"] == "insufficient_estimation_window"
    assert got[1]["status"] == "too_few_estimation_days(25)"
    assert got[2]["status"] == "event_after_data" and got[3]["status"] == "no_asset_data"
    assert got[4]["status"] == "no_event_window_data"
    assert got[5]["status"] is None and got[5]["dt"].weekday() == 0
    assert got[7]["status"] is None
    outcomes = {r["outcome"]: r["n"] for r in eventstudy.error_histogram(eventstudy.run_study(batch, *tables(rows, asset, market))).collect()}
    assert outcomes == {"valid": 2, "insufficient_estimation_window": 2, "too_few_estimation_days": 1, "event_after_data": 1, "no_asset_data": 1,
                        "no_event_window_data": 1}


def test_study_degenerate_series(rows):
    flat = np.zeros(len(DAYS))
    asset, market = series()
    exact = eventstudy.run_study(events(rows, ("X", DAYS[150], None)), *tables(rows, 2 * market, market)).first()
    assert exact["status"] == "zero_residual_std"
    constant = eventstudy.run_study(events(rows, ("X", DAYS[150], None)), *tables(rows, asset, flat)).first()
    assert constant["beta"] == 0.0 and constant["alpha"] == pytest.approx(asset[30:140].mean()) and constant["r2"] == 0.0
    a, m = tables(rows, asset, market)
    assert eventstudy.run_study(events(rows, ("X", DAYS[150], None)), a, m.limit(0)).first()["status"] == "no_benchmark_data"
    later = [d + dt.timedelta(4000) for d in DAYS]
    assert eventstudy.run_study(events(rows, ("X", DAYS[150], None)), a, tables(rows, asset, market, days=later)[1]).first()["status"] == "no_overlapping_dates"


def test_grouped_ols_edges(rows):
    df = rows([("one", 1.0, 2.0), ("flat", 1.0, 1.0), ("flat", 3.0, 1.0), ("line", 1.0, 1.0), ("line", 3.0, 2.0), ("line", 5.0, 3.0)], "g string, ret double, mkt double")
    got = {r["g"]: r for r in eventstudy.ols_by_group(df, ["g"]).collect()}
    assert (got["one"]["alpha"], got["one"]["beta"], got["one"]["resid_std"]) == (0.0, 0.0, 0.0)
    assert got["flat"]["beta"] == 0.0 and got["flat"]["alpha"] == 2.0
    assert got["line"]["beta"] == pytest.approx(2.0) and got["line"]["r2"] == pytest.approx(1.0)


def test_hit_rates(rows):
    results = rows([(-1, 1, 0.02, "alcista"), (-1, 1, 0.02, "bajista"), (-1, 1, 0.001, "neutral"), (-1, 1, -0.02, "unknown")],
                   "lo int, hi int, car double, direction string")
    s = eventstudy.aggregate_windows(results).first()
    assert s["n"] == 4 and s["n_directional"] == 3 and s["directional_hit_rate"] == pytest.approx(2 / 3) and s["positive_rate"] == 0.75
    lonely = eventstudy.aggregate_windows(results.where("direction = 'unknown'")).first()
    assert lonely["directional_hit_rate"] is None and lonely["std_car"] == 0.0 and lonely["t_stat"] == 0.0


def pav(x, y):
    """Pool adjacent violators on points sorted by x, equal x averaged first."""
    points = {}
    for a, b in zip(x, y):
        points.setdefault(a, []).append(b)
    blocks = []
    for a in sorted(points):
        blocks.append([sum(points[a]), len(points[a]), [a]])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s, n, xs = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2] + xs]
    return {a: s / n for s, n, xs in blocks for a in xs}


def test_calibration_curve(rows):
    rng = np.random.default_rng(3)
    x = np.round(rng.uniform(0.1, 0.9, 300), 2)
    y = 0.05 * x + np.abs(rng.normal(0, 0.02, 300))
    pairs = rows([(float(a), float(b)) for a, b in zip(x, y)], "score double, abs_car double")
    curve = calibration.fit_curve(pairs).orderBy("x").collect()
    fitted = pav(x, y)
    knots = sorted(fitted)
    expected = np.interp(np.linspace(0, 1, 21), knots, [fitted[k] for k in knots])
    assert [c["y"] for c in curve] == pytest.approx(list(expected))
    assert all(b["y"] >= a["y"] for a, b in zip(curve, curve[1:]))
    points = rows([(i, float(v)) for i, v in enumerate([-0.5, 0.0, 0.333, 0.5, 1.0, 2.0])], "id int, score double")
    looked = [r["expected_abs_car"] for r in calibration.lookup_curve(points, calibration.fit_curve(pairs)).orderBy("id").collect()]
    assert looked == pytest.approx(list(np.interp([-0.5, 0.0, 0.333, 0.5, 1.0, 2.0], np.linspace(0, 1, 21), expected)))


def test_too_few_pairs_fall_back_to_bands(rows):
    pairs = rows([(i / 20, 0.01) for i in range(14)], "score double, abs_car double")
    curve = calibration.fit_curve(pairs)
    assert curve.count() == 0
    looked = calibration.calibrated_labels(rows([(0.9,), (0.1,)], "severity double"), curve).orderBy("severity").collect()
    assert [(round(r["expected_abs_car"], 4), r["severity_label_calibrated"]) for r in looked] == [(0.0025, "muy_baja"), (0.09, "muy_alta")]


def test_risk_measures(rows):
    r = [0.1, -0.2, 0.05, 0.0, -1.5, 0.3]
    df = rows([("P", d, x, x / 2) for d, x in zip(DAYS, r)], "portfolio_id string, dt date, ret double, bench double")
    m = timeseries.risk_measures(df, 2023).first()
    growth = np.cumprod(1 + np.array(r))
    assert m["total_return"] == pytest.approx(growth[-1] - 1) and m["ytd_return"] == pytest.approx(growth[-1] - 1)
    peak = np.maximum(1.0, np.maximum.accumulate(growth))
    assert m["max_drawdown"] == pytest.approx((growth / peak - 1).min())
    assert m["win_rate"] == pytest.approx(3 / 5) and m["beta"] == pytest.approx(2.0) and m["annual_return"] is None
    sd = np.std(r, ddof=1)
    assert m["sharpe"] == pytest.approx(np.mean(r) / sd * math.sqrt(252)) and m["var_95"] == pytest.approx(np.mean(r) - 1.6448536 * sd, abs=1e-6)
    assert m["cvar_95"] == pytest.approx(np.mean([x for x in r if x < m["var_95"]]))


def test_portfolio_returns_need_every_available_ticker(rows):
    returns = rows([("A", DAYS[0], 0.1), ("B", DAYS[0], 0.2), ("A", DAYS[1], 0.3)], "ticker string, dt date, ret double")
    weights = rows([("P", "A", 1.0), ("P", "B", 3.0), ("P", "GONE", 6.0)], "portfolio_id string, ticker string, weight double")
    got = [(r["dt"], round(r["ret"], 6)) for r in timeseries.portfolio_returns(weights, returns).collect()]
    assert got == [(DAYS[0], 0.175)]
    assert timeseries.portfolio_returns(weights.where("ticker = 'GONE'"), returns).count() == 0


def test_bars_and_periods(rows):
    ticks = rows([("k1", DAYS[0], 10.0, 1.0, 2), ("k1", DAYS[0], 12.0, 2.0, 3), ("k2", DAYS[0], 9.0, 4.0, 1)],
                 "key string, dt date, price double, quantity double, pos bigint")
    names = rows([("k1", "T"), ("k2", "T")], "key string, ticker string")
    bar = prices.ohlcv(ticks, names, "key").first()
    assert (bar["open"], bar["high"], bar["low"], bar["close"], bar["volume"]) == (9.0, 12.0, 9.0, 12.0, 7)
    days = rows([(dt.date(2023, 12, 31),), (dt.date(2024, 1, 1),), (dt.date(2024, 3, 1),), (dt.date(2024, 3, 20),)], "dt date")
    as_of = F.lit(dt.date(2024, 3, 20))
    counts = {p: prices.in_period(days, p, as_of).count() for p in ("max", "ytd", "1mo", "1y", "1d")}
    assert counts == {"max": 4, "ytd": 3, "1mo": 2, "1y": 4, "1d": 1}


def test_calibration_uses_exact_scores(rows):
    rng = np.random.default_rng(8)
    x = 0.5 + np.sort(rng.random(60)) * 1e-5  # all alike in four decimals
    y = np.sort(rng.random(60))
    curve = {r["x"]: r["y"] for r in calibration.fit_curve(rows(list(zip(map(float, x), map(float, y))), "score double, abs_car double")).collect()}
    fitted = pav(x, y)
    assert curve[0.0] == pytest.approx(fitted[x[0]]) and curve[1.0] == pytest.approx(fitted[x[-1]]) and curve[0.0] < 0.2 < 0.8 < curve[1.0]


def pooled(points):
    """Pool adjacent violators over (score, value) pairs, and the curve between their scores."""
    blocks = []
    for x in sorted({p[0] for p in points}):
        values = [y for s, y in points if s == x]
        blocks.append([sum(values), len(values), [x]])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            total, n, xs = blocks.pop()
            blocks[-1] = [blocks[-1][0] + total, blocks[-1][1] + n, blocks[-1][2] + xs]
    knots = [(x, b[0] / b[1]) for b in blocks for x in b[2]]
    return [max(0.0, float(np.interp(k / 20, [x for x, _ in knots], [y for _, y in knots]))) for k in range(21)]


@pytest.mark.parametrize("seed", range(4))
def test_calibration_equals_pooling(spark, seed):
    rng = np.random.default_rng(seed)
    n = 400
    scores = np.round(rng.uniform(-0.1, 1.2, n), (1, 2, 6, 6)[seed])
    values = (np.abs(rng.normal(size=n)), scores + 0.3 * rng.normal(size=n), -scores, scores**2)[seed]
    points = list(zip(map(float, scores), map(float, values)))
    df = spark.createDataFrame(points, "score double, abs_car double").repartition(7)
    curve = [r.y for r in calibration.fit_curve(df).orderBy("x").collect()]
    np.testing.assert_allclose(curve, pooled(points), atol=1e-12)


def test_calibration_of_a_million_monotone_scores(spark):
    """Every score is a block of its own; none of them reaches the driver."""
    n = 1_000_000
    df = spark.range(n).select((F.col("id") / n).alias("score"), (F.col("id") / n * 0.2).alias("abs_car"))
    curve = calibration.fit_curve(df).orderBy("x").collect()
    assert [r.x for r in curve] == [k / 20 for k in range(21)]
    np.testing.assert_allclose([r.y for r in curve], [min(k / 20, (n - 1) / n) * 0.2 for k in range(21)], atol=1e-9)


@pytest.fixture()
def many_partitions(spark):
    """Small sorts keep their range partitions."""
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(setting, "false")
    yield
    spark.conf.unset(setting)


@pytest.mark.parametrize("forward", [True, False])
def test_asof_join_equals_brute_force(spark, forward, many_partitions):
    rng = np.random.default_rng(11)
    base = dt.datetime(2024, 1, 1)

    def moments(n):
        return [base + dt.timedelta(seconds=int(x)) for x in rng.integers(0, 4000, n)]

    def keys(n):
        return [("hot", "a", "b", "only")[k] for k in rng.choice(3, n, p=[0.9, 0.06, 0.04])]

    left = [(i, k, t, 2**60 + i) for i, (k, t) in enumerate(zip(keys(900), moments(900)))] + [(9000, None, base, None), (9001, "hot", None, None), (9002, "only", base, 5)]
    right = [(k, t, float(i), i % 3 == 0 or None) for i, (k, t) in enumerate(zip(keys(300), moments(300)))] + [(None, base, 1.0, None), ("hot", None, 2.0, None)]
    a = spark.createDataFrame(left, "id long, key string, at timestamp, big long").repartition(5)
    b = spark.createDataFrame(right, "key string, bar timestamp, close double, odd boolean").repartition(3)
    got = {r.id: (r.big, r.bar, r.close, r.odd) for r in asof.asof_join(a, b, "key", "at", "bar", forward).collect()}
    assert len(got) == len(left)
    for i, k, t, big in left:
        on = [r for r in right if r[0] == k is not None and t is not None and r[1] is not None and (r[1] >= t if forward else r[1] <= t)]
        best = min(on, key=lambda r: (r[1] if forward else base - r[1], r[2]), default=(None,) * 4) if forward else min(
            on, key=lambda r: (-(r[1] - base).total_seconds(), r[2]), default=(None,) * 4)
        assert got[i] == (big, *best[1:]), (i, k, t)


def test_asof_spreads_a_hot_key(spark, many_partitions):
    """The rows of one key lie in many range partitions, most of which begin without a right row of their own."""
    left = spark.range(20000).select(F.lit("k").alias("key"), "id", (F.timestamp_seconds(F.col("id"))).alias("at"))
    right = spark.createDataFrame([("k", dt.datetime(1970, 1, 1, 5, 0), 1)], "key string, bar timestamp, v int")
    joined = asof.asof_join(left, right, "key", "at", "bar")
    assert joined.withColumn("p", F.spark_partition_id()).select("p").distinct().count() > 1
    assert joined.where("v = 1").count() == 18001 and joined.where("v is null").count() == 1999
    assert asof.asof_join(left, right.limit(0), "key", "at", "bar").where("v is not null").count() == 0
    assert asof.asof_join(left.limit(0), right, "key", "at", "bar").count() == 0


def test_registered_prices_take_filters(spark):
    """Only the partitions of the tickers and days asked for are made, and the rows are those of a filter."""
    setting = "spark.sql.python.filterPushdown.enabled"
    since, until = dt.date(2020, 3, 1), dt.date(2023, 2, 1)

    def fetch(ticker, a, b):
        return [(a + dt.timedelta(days=k), float(ord(ticker) + (a.toordinal() + k) % 3)) for k in range((b - a).days + 1)]

    def read():
        pricefeed.register_prices(spark, "test_prices", fetch, ["A", "B", "C"], since, until)
        return spark.read.format("test_prices").load()

    conditions = {"ticker = 'B'": 4, "ticker in ('A', 'C') and dt >= DATE '2021-06-01'": 6, "dt < DATE '2021-01-01'": 3, "dt = DATE '2022-05-05'": 3,
                  "dt > DATE '2020-12-31' and dt <= DATE '2021-12-31'": 3, "close > 66 and ticker = 'A'": 4, "ticker = 'none'": 0}
    plain = read()
    assert plain.rdd.getNumPartitions() == 12 and plain.count() == 3 * ((until - since).days + 1)
    expected = {c: sorted(map(tuple, plain.where(c).collect())) for c in conditions}
    spark.conf.set(setting, "true")
    try:
        for condition, partitions in conditions.items():
            pushed = read().where(condition)
            assert sorted(map(tuple, pushed.collect())) == expected[condition], condition
            assert pushed.rdd.getNumPartitions() == partitions or partitions == 0, condition
    finally:
        spark.conf.unset(setting)
    assert len(expected["ticker = 'B'"]) == (until - since).days + 1

