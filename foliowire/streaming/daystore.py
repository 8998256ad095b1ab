"""A table that micro-batches append to, in folders by day and batch, read without listing or scanning what is old.

Each batch writes three things, all safe to repeat because a replay overwrites what the same batch wrote: its rows below
``rows/day=D/batch=N``; below ``filters/day=D/batch=N`` a bit set of the key values in that folder; and below ``marks/batch=N``
the newest time so far with the days that can still matter. A batch reads the mark of the one before it, the filters of those
days, and only the folders whose filters may hold one of its own keys. None of these grows with the age of the store.
"""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from foliowire.session import cut_lineage, drop_folder

#: Bits of a filter; it is kept in bitmaps of 32768 bits, of which only those with a bit set are written.
FILTER_BITS = 1 << 20
#: The folder of rows without a time.
UNDATED = dt.date(1970, 1, 1)
MARK = "newest timestamp, days array<date>"


def _bit(key: str) -> list[Column]:
    """Bitmap number and position of a key value in a filter."""
    at = F.pmod(F.xxhash64(F.col(key)), F.lit(FILTER_BITS))
    return [F.floor(at / 32768).cast("int").alias("bitmap"), (at % 32768).cast("int").alias("position")]


class DayStore:
    """Rows with a timestamp column ``time`` and a column ``key`` that batches look up; ``keep_days`` still matter."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, time: str, key: str, keep_days: float):
        self.spark, self.path, self.schema, self.time, self.key, self.keep = spark, path.rstrip("/"), schema, time, key, dt.timedelta(days=keep_days)

    def mark(self, batch_id: int) -> tuple[dt.datetime | None, list[dt.date]]:
        """Newest time and the days that matter, as the batches before ``batch_id`` left them."""
        read = self.spark.read.schema(MARK)
        try:
            found = read.parquet(f"{self.path}/marks/batch={batch_id - 1}").first()
        except AnalysisException:  # batch numbers with a gap, or the first batch
            try:
                earlier = read.schema(MARK + ", batch bigint").parquet(f"{self.path}/marks").where(F.col("batch") < batch_id)
            except AnalysisException:
                return None, []
            found = earlier.orderBy(F.desc("batch")).first()
        return (found.newest, found.days) if found else (None, [])

    def _folders(self, kind: str, days: list[dt.date], schema: str) -> DataFrame:
        base = f"{self.path}/{kind}"
        return self.spark.read.schema(schema).option("basePath", base).parquet(*[f"{base}/day={d}" for d in days])

    def rows(self, folders: list[tuple[dt.date, int]]) -> DataFrame:
        """The rows of some folders."""
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        base = f"{self.path}/rows"
        return self.spark.read.schema(self.schema).option("basePath", base).parquet(*[f"{base}/day={d}/batch={n}" for d, n in folders]).select(*self.schema.names)

    def days(self) -> list[dt.date]:
        """All days that have rows, old ones too."""
        try:
            stored = self.spark.read.schema("bitmap int, day date, batch bigint").parquet(f"{self.path}/filters")
        except AnalysisException:
            return []
        return sorted(r.day for r in stored.select("day").distinct().collect())

    def folders(self, days: list[dt.date], batch_id: int, keys: DataFrame | None = None) -> list[tuple[dt.date, int]]:
        """Folders of other batches in these days; with ``keys`` only those that may hold one of its values."""
        if not days:
            return []
        filters = self._folders("filters", days, "bitmap int, bits binary, day date, batch bigint").where(F.col("batch") != batch_id)
        if keys is not None:
            asked = keys.where(F.col(self.key).isNotNull()).select(*_bit(self.key)).distinct()
            byte = F.conv(F.hex(F.substring("bits", F.floor(F.col("position") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
            filters = filters.join(asked, "bitmap").where(F.getbit(byte, F.col("position") % 8) == 1)
        return sorted((r.day, r.batch) for r in filters.select("day", "batch").distinct().collect())

    def write(self, df: DataFrame, batch_id: int) -> None:
        """Make ``df`` the rows of a batch, and write its filters and the mark."""
        newest, days = self.mark(batch_id)
        placed = cut_lineage(df.select(*self.schema.names).withColumn("day", F.coalesce(F.to_date(self.time), F.lit(UNDATED))).withColumn("batch", F.lit(batch_id)))
        bit = placed.where(F.col(self.key).isNotNull()).select("day", "batch", *_bit(self.key))
        filters = bit.groupBy("day", "batch", "bitmap").agg(F.bitmap_construct_agg("position").alias("bits")).unionByName(
            placed.select("day", "batch", F.lit(-1).alias("bitmap")).distinct(), allowMissingColumns=True)  # every folder is known
        for kind, part in (("rows", placed), ("filters", filters)):
            part.write.partitionBy("day", "batch").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{self.path}/{kind}")
        own = placed.groupBy("day").agg(F.max(self.time).alias("newest")).collect()
        newest = max((x for x in [newest, *(r.newest for r in own)] if x is not None), default=None)
        least = UNDATED if newest is None else (newest - self.keep).date()
        kept = sorted({d for d in [*days, *(r.day for r in own)] if d >= least or d == UNDATED})
        self.spark.createDataFrame([(newest, kept)], MARK).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/marks/batch={batch_id}")

    def purge_before(self, first: dt.date) -> list[dt.date]:
        """Drop the days before ``first`` while the stream goes on; returns the dropped days.

        Rows without a time stay, and so do the days that the next batch, or a replay of the last one, may still open: those of the
        two newest marks. Rows go before filters, so a purge that died half way finds the same days again.
        """
        try:
            marks = self.spark.read.schema(MARK + ", batch bigint").parquet(f"{self.path}/marks").orderBy(F.desc("batch")).take(2)
        except AnalysisException:  # nothing stored yet
            return []
        needed = {UNDATED, *(d for m in marks for d in m.days)}
        old = [d for d in self.days() if d < first and d not in needed]
        for day in old:
            for kind in ("rows", "filters"):
                drop_folder(self.spark, f"{self.path}/{kind}/day={day}")
        return old
