"""Rate limits on alerts by clock hour and by hours anchored at their first alert."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliowire import domain
from foliowire.operators.similarity import in_key_order


def first_per_hour(alerts: DataFrame, key: str, ts: str, tie: str, cap: int = domain.ALERTS_PER_HOUR, stored: DataFrame | None = None) -> DataFrame:
    """The first ``cap`` alerts of every key and clock hour, alerts already stored in that hour included in the count.

    The rank filter is applied inside each task before the shuffle, so a hot hour moves at most ``cap``
    rows per task.
    """
    hour = F.date_trunc("hour", ts)
    order = W.partitionBy(key, "_hour").orderBy(ts, tie)
    ranked = alerts.withColumn("_hour", hour).withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= cap)
    if stored is not None:
        used = stored.groupBy(F.col(key), hour.alias("_hour")).agg(F.count(F.lit(1)).alias("_used"))
        ranked = ranked.join(used, [key, "_hour"], "left").where(F.col("_rank") + F.coalesce("_used", F.lit(0)) <= cap).drop("_used")
    return ranked.drop("_hour", "_rank")


def seconds_of(times: pd.Series) -> np.ndarray:
    return times.astype("datetime64[us]").astype("int64").to_numpy() / 1e6


def anchored_hours(start: float | None, count: int, seconds: np.ndarray, duplicate: np.ndarray, cap: int,
                   span: float = 3600.0, stored: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float | None, int]:
    """Which of the ordered items pass, the start of the window each meets, and the window and count afterwards.

    A window opens at its first item and is replaced by the first item more than ``span`` later. Only
    non-duplicates count; nothing passes once ``cap`` is reached. ``stored`` holds the window start of items
    that passed earlier and NaN for new ones; what is stored stands and counts in its window.
    """
    passed, starts = np.zeros(len(seconds), dtype=bool), np.zeros(len(seconds))
    for i, now in enumerate(seconds):
        if stored is not None and stored[i] == stored[i]:
            if start != stored[i]:
                start, count = float(stored[i]), 0
            count += int(not duplicate[i])
        else:
            if start is None or now - start > span:
                start, count = float(now), 0
            if count < cap:
                passed[i] = True
                count += int(not duplicate[i])
        starts[i] = start
    return passed, starts, start, count


def first_per_anchored_hour(alerts: DataFrame, key: str, order: tuple[str, ...] = ("created_at", "alert_id"),
                            cap: int = domain.ALERTS_PER_HOUR, stored: DataFrame | None = None) -> DataFrame:
    """Alerts that pass the anchored-hour limiter of their key, with ``hour_start`` in seconds; needs is_duplicate.

    ``stored`` alerts (key, order columns, is_duplicate, hour_start) passed before; they count and are not returned.
    """
    new = alerts.withColumn("hour_start", F.lit(None).cast("double"))
    columns = new.columns
    both = new if stored is None else new.unionByName(stored.select(key, *order, "is_duplicate", "hour_start"), allowMissingColumns=True)

    def step(state, rows):
        passed, starts, *state = anchored_hours(*state, seconds_of(rows[order[0]]), rows["is_duplicate"].to_numpy(bool), cap,
                                                stored=rows["hour_start"].to_numpy("float64"))
        return state, rows.assign(hour_start=starts).loc[passed, columns]

    return in_key_order(both.select(*columns), [key], list(order), lambda: [None, 0], step, new.schema)
