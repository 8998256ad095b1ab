"""As-of join on timestamps: each row meets the first row of its key at or after it (or the last at or before it).

Both tables are laid into one order by key and time, cut into range partitions, so a key with most of the rows is spread over
many tasks. Every task streams its rows and remembers the last row of the right table; what a partition needs from those before it
is one small row per partition, which passes through the driver. Nothing is expanded and no key is gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from foliowire.session import cut_lineage


def asof_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, forward: bool = True) -> DataFrame:
    """The columns of ``left``, and those of ``right`` but the key, null where no row matches.

    Of right rows of one key and time the least (the other columns in their order) matches; rows without key or time match nothing.
    """
    values = [c for c in right.columns if c != key]
    micros = F.unix_micros(F.col("_time"))
    order = -micros if forward else micros  # a task meets the matching row before those it matches
    known = F.col(left_time).isNotNull() & F.col(key).isNotNull()
    lefts = left.where(known).select(F.col(key).alias("_key"), F.col(left_time).cast("timestamp").alias("_time"), F.lit(False).alias("_right"),
                                     F.struct(*left.columns).alias("_row"))
    rights = right.where(F.col(key).isNotNull() & F.col(right_time).isNotNull()).select(
        F.col(key).alias("_key"), F.col(right_time).cast("timestamp").alias("_time"), F.lit(True).alias("_right"), F.struct(*values).alias("_value"))
    rights = rights.groupBy("_key", "_time", "_right").agg(F.min("_value").alias("_value"))
    both = lefts.unionByName(rights, allowMissingColumns=True).withColumn("_at", order)
    placed = cut_lineage(both.orderBy("_key", "_at", F.desc("_right")).withColumn("_part", F.shiftright(F.monotonically_increasing_id(), 33).cast("int")))
    # the last right row of each partition, which those behind it may continue
    lasts = placed.where("_right").groupBy("_part").agg(F.max(F.struct("_key", "_at", "_value")).alias("last")).select("_part", "last._key", "last._value").toArrow()
    written = to_arrow_schema(StructType([placed.schema["_row"], placed.schema["_value"]]))
    carry_type = written.field("_value").type
    carried = {p: (k, v) for p, k, v in zip(lasts.column("_part").to_pylist(), lasts.column("_key").to_pylist(), range(lasts.num_rows))}
    ends = lasts.column("_value").combine_chunks().cast(carry_type) if lasts.num_rows else pa.nulls(0, carry_type)
    before = {p: max((q for q in carried if q < p), default=None) for p in range(placed.rdd.getNumPartitions())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held = None, pa.nulls(1, carry_type)
        first = True
        for batch in batches:
            if not batch.num_rows:
                continue
            earlier = before[batch.column("_part")[0].as_py()] if first else None
            if earlier is not None:
                held_key, place = carried[earlier]
                held = ends.slice(place, 1)
            first = False
            keys, is_right = batch.column("_key").to_numpy(zero_copy_only=False), batch.column("_right").to_numpy(zero_copy_only=False).astype(bool)
            places = np.arange(len(keys))
            begins = np.maximum.accumulate(np.where(np.r_[True, keys[1:] != keys[:-1]], places, 0))
            last = np.maximum.accumulate(np.where(is_right, places, -1))
            # 0 is the row held from before, beyond the end stands for none
            source = np.where(last >= begins, last + 1, np.where((begins == 0) & (keys == held_key), 0, len(keys) + 1))
            pool = pa.concat_arrays([held, batch.column("_value"), pa.nulls(1, carry_type)])
            wanted = np.flatnonzero(~is_right)
            yield pa.RecordBatch.from_arrays([batch.column("_row").take(pa.array(wanted)), pool.take(pa.array(source[wanted]))], schema=written)
            if last[-1] >= 0:
                held_key, held = keys[last[-1]], batch.column("_value").slice(int(last[-1]), 1)

    slim = placed.select("_key", "_right", "_row", "_value", "_part")
    joined = slim.mapInArrow(run, StructType([placed.schema["_row"], placed.schema["_value"]])).select("_row.*", *[F.col(f"_value.{c}").alias(c) for c in values])
    return joined.unionByName(left.where(~known), allowMissingColumns=True)
