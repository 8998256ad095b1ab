"""Score tables: results of models kept outside Spark arrive as tables or are produced by a batch scorer."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def attach_scores(pairs: DataFrame, tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """Left-join score tables by their keys; each column arrives as <table>_<column>."""
    out = pairs
    for name, (table, keys) in tables.items():
        renamed = table.select(*keys, *[table[c].alias(f"{name}_{c}") for c in table.columns if c not in keys])
        out = out.join(renamed, keys, "left")
    return out


def batch_score(df: DataFrame, make_scorer: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """Apply a user's pandas scorer to Arrow batches; the scorer is built once per task and reused."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = make_scorer()
        for batch in batches:
            yield score(batch)

    return df.mapInPandas(run, schema)
