"""Price providers as Spark data sources: a function that fetches bars of one ticker becomes a source registered by name.

``spark.read.format(name).load()`` has ticker, dt and close, one partition per ticker and span of years. Filters on ticker and dt are
pushed into the source where the session allows it (``spark.sql.python.filterPushdown.enabled``): other tickers are never asked for
and a partition outside the dates is not made. Without that setting Spark filters what the source returns; the rows are the same.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual)

BARS = "ticker string, dt date, close double"
#: fetch(ticker, first day, last day) gives the (dt, close) of the days between them, both included.
Fetch = Callable[[str, dt.date, dt.date], Iterable[tuple[dt.date, float]]]
#: Rows of one Arrow batch.
BATCH_ROWS = 10_000


@dataclass
class Span(InputPartition):
    ticker: str
    since: dt.date
    until: dt.date


class BarReader(DataSourceReader):
    """Reads the tickers and days asked for."""

    def __init__(self, fetch: Fetch, tickers: list[str], since: dt.date, until: dt.date, years: int):
        self.fetch, self.tickers, self.since, self.until, self.years = fetch, sorted(set(tickers)), since, until, years

    def partitions(self) -> list[Span]:
        edges = [self.since, *(dt.date(y, 1, 1) for y in range(self.since.year + 1, self.until.year + 1, self.years))]
        ends = [*(e - dt.timedelta(days=1) for e in edges[1:]), self.until]
        return [Span(t, a, b) for t in self.tickers for a, b in zip(edges, ends) if a <= b]

    def read(self, partition: Span | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark asks for where there is no partition
            return
        days, closes = [], []
        for day, close in self.fetch(partition.ticker, partition.since, partition.until):
            days.append(day)
            closes.append(close)
            if len(days) == BATCH_ROWS:
                yield self._batch(partition.ticker, days, closes)
                days, closes = [], []
        yield self._batch(partition.ticker, days, closes)

    def _batch(self, ticker: str, days: list, closes: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([ticker] * len(days), pa.string()), pa.array(days, pa.date32()), pa.array(closes, pa.float64())], ["ticker", "dt", "close"])


class PushingReader(BarReader):
    """Takes filters on ticker and dt; gives the others back."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        day = dt.timedelta(days=1)
        for f in filters:
            column = getattr(f, "attribute", None)
            if column == ("ticker",) and isinstance(f, (EqualTo, In)):
                asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.tickers = [t for t in self.tickers if t in asked]
            elif column == ("dt",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.since = max(self.since, f.value + day * isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.until = min(self.until, f.value - day * isinstance(f, LessThan))
            else:
                yield f


def register_prices(spark: SparkSession, name: str, fetch: Fetch, tickers: list[str], since: dt.date, until: dt.date, years: int = 1) -> None:
    """Register a provider of the bars of ``tickers`` from ``since`` to ``until`` as the source ``name``."""
    reader = PushingReader if spark.conf.get("spark.sql.python.filterPushdown.enabled", "false") == "true" else BarReader

    class Prices(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return BARS

        def reader(self, schema) -> DataSourceReader:
            return reader(fetch, tickers, since, until, years)

    spark.dataSource.register(Prices)
