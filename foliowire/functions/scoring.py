"""Column expressions for labels, bands, clamping and numeric cleaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliowire import domain


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def severity_label(score: Column) -> Column:
    """Ordinal label of a 0-1 severity score; lower edges are inclusive."""
    label = F.lit(domain.SEVERITY_LEVELS[0])
    for name, cut in reversed(domain.SEVERITY_SCORE_CUTS):
        label = F.when(score >= cut, name).otherwise(label)
    return label


def abs_car_label(abs_car: Column) -> Column:
    """Severity label of an absolute abnormal return; outside every band it is the top label."""
    label = F.lit(domain.SEVERITY_LEVELS[-1])
    for name, low, high in domain.ABS_CAR_BANDS:
        label = F.when((abs_car >= low) & (abs_car < high), name).otherwise(label)
    return label


def expected_abs_car(label: Column) -> Column:
    """Mid-point of a label's |CAR| band, the top band being capped; unknown labels use the lowest band."""
    middles = {name: (low + min(high, domain.TOP_BAND_CAP)) / 2 for name, low, high in domain.ABS_CAR_BANDS}
    value = F.lit(middles[domain.SEVERITY_LEVELS[0]])
    for name, middle in middles.items():
        value = F.when(label == name, middle).otherwise(value)
    return value


def severity_rank(label: Column) -> Column:
    """Position of a severity label; null for an unknown one."""
    rank = F.lit(None).cast("int")
    for i, name in enumerate(domain.SEVERITY_LEVELS):
        rank = F.when(label == name, i).otherwise(rank)
    return rank


def direction_from_score(score: Column, cut: float = domain.DIRECTION_CUT) -> Column:
    up, down, flat = domain.DIRECTIONS
    return F.when(score > cut, up).when(score < -cut, down).otherwise(flat)


def kappa_label(value: Column) -> Column:
    label = F.lit(domain.KAPPA_TOP)
    for cut, name in reversed(domain.KAPPA_BANDS):
        label = F.when(value <= cut, name).otherwise(label)
    return F.when(value < 0, domain.KAPPA_POOR).otherwise(label)


def safe_float(value: Column, default: float | None = 0.0) -> Column:
    """Number rounded to 4 places; missing, unparseable, NaN and infinite values become ``default``."""
    number = value.try_cast("double")
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) != float("inf"))
    return F.when(finite, F.round(number, 4)).otherwise(F.lit(default).cast("double"))


def safe_divide(num: Column, den: Column, otherwise: float = 0.0) -> Column:
    return F.when(den != 0, num / den).otherwise(F.lit(otherwise))


def change_pct(price: Column, previous: Column) -> Column:
    """Percent change on the previous price, 0 where that is missing or not positive."""
    return F.when(previous > 0, F.round((price - previous) / previous * 100, 2)).otherwise(F.lit(0.0))


def lookup(key: Column, table: dict, default: Column | None = None) -> Column:
    """Value of a small fixed table as one map literal."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    found = F.try_element_at(F.create_map(*pairs), key)
    return found if default is None else F.coalesce(found, default)


def risk_profile(score: Column) -> Column:
    label = F.lit(domain.TOP_RISK_BAND)
    for top, name in reversed(domain.RISK_BANDS):
        label = F.when(score <= top, name).otherwise(label)
    return label


def canonical_sector(sector: Column) -> Column:
    """Standard sector of a spelling; an unknown spelling is kept, a missing one is Other."""
    trimmed = F.trim(sector)
    known = lookup(F.lower(trimmed), domain.SECTOR_NAMES, trimmed)
    return F.when(sector.isNull() | (sector == ""), "Other").otherwise(known)


def canonical_region(country: Column) -> Column:
    spelled = F.lower(F.trim(country))
    region = F.lit("Other")
    for name, countries in domain.REGION_COUNTRIES.items():
        region = F.when(spelled.isin(*countries), name).otherwise(region)
    return region
