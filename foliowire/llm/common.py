"""What the operators of this folder share: words, written intermediate tables, checked broadcasts."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from foliowire.session import scratch_path

#: A word is a run of characters other than space and the ASCII controls from tab to carriage return.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
WORD = re.compile(WORD_PATTERN)

#: What str.split takes for blanks although it belongs to words here.
_OTHER_BLANKS = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_ASCII_BLANKS = "\x1c\x1d\x1e\x1f"



def split_words(text: str | None) -> list[str]:
    """The words of a text, by the faster str.split where it agrees."""
    if not text:
        return []
    other = any(c in text for c in _ASCII_BLANKS) if text.isascii() else _OTHER_BLANKS.search(text)
    return WORD.findall(text) if other else text.split()


def lower_ascii(text: str) -> str:
    """A-Z in lower case, all else unchanged."""
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, name: str, **options) -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and read it again; ``options`` go to the writer.

    Cuts the lineage so that a lost executor repeats only the tasks it held, and unlike a checkpoint keeps the
    columns compressed and prunable.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Whole numbers beside nulls, which plain pandas columns would turn into floating point.
_EXACT = {pa.int8(): pd.Int8Dtype(), pa.int16(): pd.Int16Dtype(), pa.int32(): pd.Int32Dtype(), pa.int64(): pd.Int64Dtype()}


def map_frames(df: DataFrame, function: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str | StructType) -> DataFrame:
    """mapInPandas that keeps whole numbers exact beside nulls, in the columns a function reads and in those it passes on.

    Columns are matched by name. Rows built one by one go into frames of objects, which keep None and integers apart.
    """
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    written = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in function(b.to_pandas(types_mapper=_EXACT.get if any(c.null_count for c in b.columns) else None) for b in batches):
            yield pa.RecordBatch.from_pandas(frame, schema=written, preserve_index=False)

    return df.mapInArrow(run, schema)


def small_side(df: DataFrame, row_limit: int = 20_000) -> DataFrame:
    """Mark a written table for broadcast if its row count is within the limit; else leave the join to the planner."""
    return F.broadcast(df) if df.limit(row_limit + 1).count() <= row_limit else df


def unused(name: str, taken) -> str:
    """A column name close to ``name`` that does not occur in ``taken``, whatever the letter case."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name
