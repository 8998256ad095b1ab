"""Readable portfolio lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def portfolio_lines(assets: Column) -> Column:
    """One line per nested asset with its sector, country and weight in percent; a notice when empty."""
    def tagged(tag, value):
        return F.when(value != "", F.concat(F.lit(tag), value))

    def line(a):
        weight = F.when(a["weight"] > 0, F.concat(F.lit("Peso: "), F.format_string("%.1f", a["weight"] * 100), F.lit("%")))
        return F.concat_ws(" | ", F.concat(a["ticker"], F.lit(" — "), a["name"]), tagged("Sector: ", a["sector"]),
                           tagged("País: ", a["country"]), weight)

    return F.when(F.size(assets) > 0, F.array_join(F.transform(assets, line), "\n")).otherwise("Cartera vacía")
