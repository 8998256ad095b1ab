"""Isotonic calibration of severity scores against realised |CAR|, and the lookup of the fitted curve.

The isotonic fit is the slope of the greatest convex minorant of the cumulated sums. Scores are sorted into range
partitions, each of which keeps the corners of its own minorant; the corners of the whole are among them. The slope at one place is
that of the tangent common to the corners before and behind it. A few passes over the corners find it for all places at
once: each takes, for a guess of every slope, the lowest corner on either side, and the line through the two is the next guess.
The corners stay in the tasks; the driver sees one sum per partition, a guess per place and the 21 points of the curve.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliowire import domain
from foliowire.functions.scoring import abs_car_label, expected_abs_car, severity_label
from foliowire.session import cut_lineage

GRID = 20  # segments of the curve: 21 points from 0 to 1
CURVE = "x double, y double"


def _corners(starts: dict[int, tuple[float, float]]):
    """Cumulated weight and sum at the corners of each partition's minorant; rows come sorted by score."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, blocks = None, []  # weight, sum of the pooled blocks, their means increasing
        for batch in batches:
            for row_part, weight, total in zip(batch["_part"], batch["weight"], batch["total"]):
                part = row_part
                while blocks and blocks[-1][1] * weight >= total * blocks[-1][0]:
                    earlier = blocks.pop()
                    weight, total = weight + earlier[0], total + earlier[1]
                blocks.append((weight, total))
        if blocks:
            ends = np.cumsum(np.array([(0.0, 0.0), *blocks]), axis=0) + np.array(starts[part])
            yield pd.DataFrame(ends, columns=["w", "s"])

    return run


def _lowest(places: np.ndarray, slopes: np.ndarray):
    """Per place the corner with the least s - slope * w at or before its begin, and at or behind its end."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            w, s = batch["w"].to_numpy(), batch["s"].to_numpy()
            out = []
            for k, ((begin, end), slope) in enumerate(zip(places, slopes)):
                height = s - slope * w
                for side, on in ((0, w <= begin), (1, w >= end)):
                    if on.any():
                        best = np.flatnonzero(on)[height[on].argmin()]
                        out.append((k, side, height[best], w[best], s[best]))
            yield pd.DataFrame(out, columns=["place", "side", "height", "w", "s"])

    return run


def _slopes(corners: DataFrame, places: np.ndarray, guess: float) -> np.ndarray:
    """Slope of the minorant of all corners between the begin and the end of each place."""
    slopes, low, high = np.full(len(places), guess), np.full(len(places), -np.inf), np.full(len(places), np.inf)
    through, settled = [None] * len(places), np.zeros(len(places), bool)
    while not settled.all():
        found = corners.mapInPandas(_lowest(places, slopes), "place int, side int, height double, w double, s double").groupBy("place", "side").agg(
            F.min(F.struct("height", "w", "s")).alias("best")).collect()
        best = {(r.place, r.side): r.best for r in found}
        for k in np.flatnonzero(~settled):
            a, b = best[k, 0], best[k, 1]
            new, corner = (b.s - a.s) / (b.w - a.w), (a.w, b.w)
            if b.height >= a.height:  # the difference falls with the slope and is zero at the tangent
                low[k] = slopes[k]
            else:
                high[k] = slopes[k]
            settled[k] = through[k] == corner or new in (low[k], high[k])
            slopes[k] = new if settled[k] or low[k] < new < high[k] else (low[k] + high[k]) / 2
            through[k] = corner
    return slopes


def fit_curve(pairs: DataFrame, min_pairs: int = domain.MIN_CALIBRATION_PAIRS) -> DataFrame:
    """(x, y) at 21 points of the monotone fit of abs_car on score; empty when there are too few pairs.

    Pairs of one score collapse to their weighted mean before the fit, on the map side; the isotonic solution of the weighted means
    equals that of the pairs. Between two scores the curve is a line, beyond the outermost it is level.
    """
    spark = pairs.sparkSession
    usable = pairs.where(F.col("score").isNotNull() & F.col("abs_car").isNotNull())
    points = usable.groupBy(F.col("score").cast("double").alias("score")).agg(F.sum("abs_car").alias("total"), F.count(F.lit(1)).cast("double").alias("weight"))
    placed = cut_lineage(points.orderBy("score").withColumn("_part", F.shiftright(F.monotonically_increasing_id(), 33)))
    sums = placed.groupBy("_part").agg(F.sum("weight").alias("w"), F.sum("total").alias("s")).orderBy("_part").collect()
    before = np.cumsum([(0.0, 0.0), *((r.w, r.s) for r in sums)], axis=0)
    if before[-1][0] < min_pairs or not len(sums):
        return spark.createDataFrame([], CURVE)
    starts = {r._part: tuple(b) for r, b in zip(sums, before)}
    corners = cut_lineage(placed.mapInPandas(_corners(starts), "w double, s double"))
    # the scores on either side of each point of the grid, and the weight before and up to them
    order = W.partitionBy("_part").orderBy("score")
    begins = F.create_map(*[F.lit(x) for part, b in starts.items() for x in (part, float(b[0]))])
    upto = placed.withColumn("upto", begins[F.col("_part")] + F.sum("weight").over(order))
    spot = F.struct("score", (F.col("upto") - F.col("weight")).alias("begin"), F.col("upto").alias("end"))
    grid = [k / GRID for k in range(GRID + 1)]
    near = upto.agg(*[F.max(F.when(F.col("score") <= x, spot)) for x in grid], *[F.min(F.when(F.col("score") >= x, spot)) for x in grid]).first()
    known = {tuple(n): None for n in near if n is not None}
    fitted = dict(zip(known, _slopes(corners, np.array([k[1:] for k in known]), float(before[-1][1] / before[-1][0]))))

    def value(x, left, right):
        (a, fa), (b, fb) = ((n.score, fitted[tuple(n)]) for n in (left or right, right or left))
        return float(max(0.0, fa if a == b else fa + (fb - fa) * (x - a) / (b - a)))

    return spark.createDataFrame([(x, value(x, near[k], near[k + GRID + 1])) for k, x in enumerate(grid)], CURVE)


def lookup_curve(df: DataFrame, curve: DataFrame, score: str = "score") -> DataFrame:
    """Adds expected_abs_car: linear interpolation on the 21-point curve, or the band mid-point without one.

    The grid is regular, so a score finds its segment by an equi-join on the segment number.
    """
    ordered = W.orderBy("x")  # 21 rows
    segments = curve.select(F.round(F.col("x") * GRID).cast("int").alias("segment"), F.col("y").alias("y0"),
                            F.coalesce(F.lead("y").over(ordered), F.col("y")).alias("y1"))
    spot = F.least(F.greatest(F.col(score), F.lit(0.0)), F.lit(1.0)) * GRID
    placed = df.withColumn("spot", spot).withColumn("segment", F.floor("spot").cast("int"))
    joined = placed.join(F.broadcast(segments), "segment", "left")
    between = F.col("y0") + (F.col("spot") - F.col("segment")) * (F.col("y1") - F.col("y0"))
    fallback = expected_abs_car(severity_label(F.col(score)))
    return joined.withColumn("expected_abs_car", F.coalesce(between, fallback)).drop("spot", "segment", "y0", "y1")


def calibrated_labels(df: DataFrame, curve: DataFrame, score: str = "severity") -> DataFrame:
    """Severity rows with expected |CAR| and the label of its band."""
    return lookup_curve(df, curve, score).withColumn("severity_label_calibrated", abs_car_label(F.col("expected_abs_car")))


def save_curve(curve: DataFrame, path: str) -> None:
    curve.coalesce(1).write.mode("overwrite").json(path)


def load_curve(spark, path: str) -> DataFrame:
    return spark.read.schema(CURVE).json(path)
