"""Keyed stateful operators of the alert stream: anchored-hour limiter and greedy duplicate filter.

Both run in event time. Rows wait in state until the watermark has passed them and are then settled in order, so
a late row within the allowed lateness is judged as if it had come in time, and results do not depend on how
the input is cut into micro-batches.

Time is cut into buckets of fixed width. The rows that a micro-batch brings for a bucket of a key are one entry of a map state. A
timer at the end of the earliest open bucket reads, settles and deletes the entries of the buckets that have ended, and waits for
the next one. An entry is thus written once, read once and deleted once, and what is held in memory are the ended buckets of
one key, in pieces of bounded size. A row is settled up to one width after the watermark has passed it.

The limiter has many keys with few rows each. They are dealt into a fixed number of slots, so an entry holds the rows of all keys
of a slot, and the number of state calls depends on slots and buckets, not on keys.

The session has to use a state store with state variables and timers; see ``STATE_STORE``.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegralType, StructType

from foliowire import domain
from foliowire.operators.limiter import anchored_hours, seconds_of
from foliowire.operators.similarity import greedy_filter

STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
LATENESS = "2 days"
HOUR, DAY = 3600.0, 86400.0
#: Keys whose kept vectors a task remembers besides the state.
HELD_KEYS = 64
#: Slots that the keys of a limiter are dealt into; a stream keeps its number as long as its checkpoint.
SLOTS = 512
#: Rows of ended buckets that are settled together, and one bucket.
HELD_ROWS = 200_000


def check_state_store(spark: SparkSession) -> None:
    """These operators need the RocksDB state store; the session's owner chooses it."""
    if spark.conf.get(STATE_STORE[0], "") != STATE_STORE[1]:
        raise ValueError(f"start the session with {STATE_STORE[0]}={STATE_STORE[1]}")


def _packed(rows: pd.DataFrame) -> bytes:
    """Rows as one Arrow message."""
    batch = pa.RecordBatch.from_pandas(rows, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(data).read_pandas()


class InEventTime(StatefulProcessor):
    """Buffers the rows of a key by time bucket and settles the buckets, in order, once the watermark has passed their ends."""

    def __init__(self, schema: StructType, order: list[str], width: float, keep_seconds: float):
        self.order, self.columns = order, schema.names
        self.width = int(width * 1000)
        self.keep = -(-int(keep_seconds * 1000) // self.width) * self.width  # whole buckets

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "buckets array<bigint>, entries array<int>")
        self.waiting = handle.getMapState("waiting", "bucket long, entry int", "rows binary")

    def settle(self, key, rows: pd.DataFrame, buckets: np.ndarray) -> pd.DataFrame:
        """The result rows of ordered rows and the buckets they lie in."""
        raise NotImplementedError

    def forget(self, key, settled: int) -> None:
        """Drop state that no row can need once all before ``settled`` (in milliseconds) are settled."""
        raise NotImplementedError

    def end(self, bucket: int) -> int:
        return (bucket + 1) * self.width

    def _opened(self) -> dict[int, int]:
        return dict(zip(*self.open.get())) if self.open.exists() else {}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self._opened()
        first = min(known, default=None)
        for batch in rows:
            buckets = np.floor_divide(np.round(seconds_of(batch[self.order[0]]) * 1e6).astype("int64"), self.width * 1000)
            values = batch[self.columns]
            for bucket in np.unique(buckets).tolist():
                self.waiting.updateValue((bucket, known.get(bucket, 0)), (_packed(values[buckets == bucket]),))
                known[bucket] = known.get(bucket, 0) + 1
        if known and min(known) != first:
            self.handle.registerTimer(self.end(min(known)))
        self._keep_open(known)
        return iter(())

    def _keep_open(self, known: dict[int, int]) -> None:
        if known:
            self.open.update((list(known), list(known.values())))
        elif self.open.exists():
            self.open.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed, known = timerValues.getCurrentWatermarkInMs(), self._opened()
        due = sorted(b for b in known if self.end(b) <= passed)
        if due:
            parts, of = [], []
            for bucket in due:
                for entry in range(known.pop(bucket)):
                    parts.append(_unpacked(self.waiting.getValue((bucket, entry))[0]))
                    of.append(np.full(len(parts[-1]), bucket))
                    self.waiting.removeKey((bucket, entry))
                if bucket == due[-1] or sum(map(len, parts)) >= HELD_ROWS:
                    rows = pd.concat(parts, ignore_index=True).sort_values(self.order, kind="stable")
                    yield self.settle(key, rows, np.concatenate(of)[rows.index])
                    parts, of = [], []
            self._keep_open(known)
            if known:
                self.handle.registerTimer(self.end(min(known)))
            if self.end(due[-1]) + self.keep > passed:
                self.handle.registerTimer(self.end(due[-1]) + self.keep)
        self.forget(key, passed // self.width * self.width)  # rows of the open bucket still wait

    def close(self) -> None:
        pass


class AnchoredHourLimiter(InEventTime):
    """State: of every key of the slot with an open window, its start and the alerts counted in it, as one entry.

    ``key`` is the column of the keys; without it all rows have the same.
    """

    def __init__(self, schema: StructType, order: list[str], cap: int, width: float, key: str | None = None):
        super().__init__(schema, order, width, HOUR)
        self.cap, self.key = cap, key

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.window = handle.getValueState("window", "windows binary")

    def _windows(self) -> dict:
        if not self.window.exists():
            return {}
        known = _unpacked(self.window.get()[0])
        return {k: (start, n) for k, start, n in zip(_names(known["key"]), known["start"].tolist(), known["n"].tolist())}

    def _keep_windows(self, windows: dict) -> None:
        if windows:
            starts, counts = zip(*windows.values())
            self.window.update((_packed(pd.DataFrame({"key": pd.Series(list(windows), dtype=object), "start": starts, "n": counts})),))
        elif self.window.exists():
            self.window.clear()

    def settle(self, key, rows: pd.DataFrame, buckets: np.ndarray) -> pd.DataFrame:
        windows, passed = self._windows(), np.zeros(len(rows), bool)
        seconds, duplicate = seconds_of(rows[self.order[0]]), rows["is_duplicate"].to_numpy(bool)
        codes, keys = (np.zeros(len(rows), int), [None]) if self.key is None else pd.factorize(rows[self.key], use_na_sentinel=False)
        by_key = np.argsort(codes, kind="stable")  # the rows of a key stay in order
        for k, own in zip(_names(keys), np.split(by_key, np.searchsorted(codes[by_key], np.arange(1, len(keys))))):
            start, count = windows.get(k, (None, 0))
            passed[own], _, start, count = anchored_hours(start, count, seconds[own], duplicate[own], self.cap)
            windows[k] = (float(start), int(count))
        self._keep_windows(windows)
        return rows.loc[passed]

    def forget(self, key, settled: int) -> None:
        windows = self._windows()
        left = {k: w for k, w in windows.items() if (w[0] + HOUR) * 1000 >= settled}
        if len(left) < len(windows):
            self._keep_windows(left)


def _names(keys) -> list:
    """Keys with one value for null."""
    return [None if pd.isna(k) else k for k in keys]


def _timed(rows: DataFrame, column: str, lateness: str) -> DataFrame:
    return rows.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, lateness)


def limit_stream(alerts: DataFrame, key: str, cap: int = domain.ALERTS_PER_HOUR, order: tuple[str, ...] = ("created_at", "alert_id"),
                 lateness: str = LATENESS, width: float = DAY) -> DataFrame:
    """Alerts that pass the anchored-hour limiter of their key, settled once the watermark has passed their bucket of ``width`` seconds; needs is_duplicate."""
    check_state_store(alerts.sparkSession)
    timed = _timed(alerts, order[0], lateness)
    # rows of many keys meet in a frame, where a null would turn the whole numbers of all others into floating point; names of its columns begin with a letter
    whole = [f.name for f in timed.schema.fields if isinstance(f.dataType, IntegralType)]
    filled = timed.select(*[F.coalesce(c, F.lit(0).cast(timed.schema[c].dataType)).alias(c) if c in whole else c for c in timed.columns],
                          *[F.col(c).isNull().alias(f"{c}__null") for c in whole], F.col(key).cast("string").alias("key__name"))
    placed = [x for c in order for x in ((f"{c}__null", c) if c in whole else (c,))]
    processor = AnchoredHourLimiter(filled.schema, placed, cap, width, "key__name")
    slotted = filled.withColumn("slot__number", F.pmod(F.xxhash64("key__name"), F.lit(SLOTS)).cast("int"))
    passed = slotted.groupBy("slot__number").transformWithStateInPandas(processor, filled.schema, "Append", "EventTime")
    return passed.select(*[F.when(~F.col(f"{c}__null"), F.col(c)).alias(c) if c in whole else c for c in timed.columns])


class GreedyDuplicateFilter(InEventTime):
    """State: the kept vectors with their times, an entry per bucket, and how many each has.

    A bucket's entry is written when it is settled, and deleted when it expires or the newest ``store`` vectors no longer reach it.
    A task reads the entries of a key once and then remembers them, for a bounded number of keys.
    """

    def __init__(self, schema: StructType, id_col: str, order: list[str], threshold: float, store: int, memory: int, ttl_seconds: float, width: float):
        super().__init__(schema, order, width, ttl_seconds)
        self.id_col, self.threshold, self.store, self.memory, self.ttl = id_col, threshold, store, memory, ttl_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.kept = handle.getMapState("kept", "bucket long", "times binary, vectors binary")
        self.filled = handle.getValueState("filled", "buckets array<bigint>, counts array<bigint>")
        self.held: OrderedDict = OrderedDict()

    def _filled(self) -> dict[int, int]:
        return dict(zip(*self.filled.get())) if self.filled.exists() else {}

    def _known(self, key, filled: dict[int, int], dimension: int) -> tuple[np.ndarray, np.ndarray]:
        """Kept vectors and their times, oldest first."""
        if key in self.held:
            return self.held[key]
        entries = [self.kept.getValue((b,)) for b in filled]
        times = np.frombuffer(b"".join(bytes(e[0]) for e in entries), "f8")
        vectors = np.frombuffer(b"".join(bytes(e[1]) for e in entries), "f8")
        return vectors.reshape(len(times), -1 if len(times) else dimension)[-self.store:], times[-self.store:]

    def settle(self, key, rows: pd.DataFrame, buckets: np.ndarray) -> pd.DataFrame:
        matrix = np.stack(rows["vector"].to_numpy()).astype("float64")
        length = np.linalg.norm(matrix, axis=1, keepdims=True)
        matrix = np.divide(matrix, length, out=np.zeros_like(matrix), where=length > 0)
        filled, times = self._filled(), seconds_of(rows[self.order[0]])
        similarity, duplicate, *kept = greedy_filter(*self._known(key, filled, matrix.shape[1]), matrix, times, self.threshold, self.store, self.memory, self.ttl)
        for bucket in np.unique(buckets[~duplicate]).tolist():
            own = ~duplicate & (buckets == bucket)
            self.kept.updateValue((bucket,), (times[own].astype("f8").tobytes(), matrix[own].tobytes()))
            filled[bucket] = int(own.sum())
        self._drop(filled, lambda oldest: sum(filled.values()) - filled[oldest] >= self.store)  # the newest do not reach it
        self.held[key] = kept
        self.held.move_to_end(key)
        if len(self.held) > HELD_KEYS:
            self.held.popitem(last=False)
        return pd.DataFrame({self.id_col: rows[self.id_col], "max_similarity": np.round(similarity, 4), "is_duplicate": duplicate})

    def forget(self, key, settled: int) -> None:
        filled = self._filled()
        if filled and self.end(min(filled)) + self.keep <= settled:
            self._drop(filled, lambda oldest: self.end(oldest) + self.keep <= settled)

    def _drop(self, filled: dict[int, int], while_true) -> None:
        """Delete the entries of the oldest buckets and write what is left of ``filled``."""
        while filled and while_true(min(filled)):
            self.kept.removeKey((min(filled),))
            del filled[min(filled)]
        if filled:
            self.filled.update((list(filled), list(filled.values())))
        elif self.filled.exists():
            self.filled.clear()


def flag_duplicates_stream(items: DataFrame, key: str, id_col: str, order: tuple[str, ...], threshold: float = domain.DEDUP_SIMILARITY,
                           store: int = domain.HISTORY_STORE, memory: int = domain.HISTORY_MEMORY,
                           ttl_days: float = domain.RETENTION_DAYS, lateness: str = LATENESS, width: float = DAY) -> DataFrame:
    """Greedy duplicate flags per key; the state is bounded by ``store`` vectors and a bucket, and expires after ``ttl_days``."""
    check_state_store(items.sparkSession)
    timed = _timed(items.withColumn("vector", F.col("vector").cast("array<double>")), order[0], lateness)
    id_type = items.schema[id_col].dataType.simpleString()
    out = StructType.fromDDL(f"{id_col} {id_type}, max_similarity double, is_duplicate boolean")
    processor = GreedyDuplicateFilter(timed.schema, id_col, list(order), threshold, store, memory, ttl_days * DAY, width)
    return timed.groupBy(key).transformWithStateInPandas(processor, out, "Append", "EventTime")
