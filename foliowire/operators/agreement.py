"""Inter-annotator agreement from contingency counts and moments; no pair of ratings is ever enumerated.

Input of the two-rater measures: rows (dimension, a, b), one per item both raters labelled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliowire.functions.scoring import kappa_label


def common_items(first: DataFrame, second: DataFrame) -> DataFrame:
    """(dimension, item_id, a, b) of the items both annotators rated."""
    return first.select("dimension", "item_id", F.col("label").alias("a")).join(
        second.select("dimension", "item_id", F.col("label").alias("b")), ["dimension", "item_id"])


def common_ids(first: DataFrame, second: DataFrame) -> DataFrame:
    return first.select("item_id").intersect(second.select("item_id"))


def _table(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("dimension", "a", "b").agg(F.count(F.lit(1)).alias("n"))


def percentage_agreement(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("dimension").agg(F.avg(F.col("a").eqNullSafe(F.col("b")).cast("double")).alias("agreement"))


def cohen_kappa(pairs: DataFrame) -> DataFrame:
    """Nominal kappa per dimension; 1 where chance agreement is certain."""
    table = _table(pairs)
    sides = F.array(F.struct(F.col("a").alias("label"), F.col("n").alias("na"), F.lit(0).cast("bigint").alias("nb")),
                    F.struct(F.col("b").alias("label"), F.lit(0).cast("bigint").alias("na"), F.col("n").alias("nb")))
    marginal = table.select("dimension", F.inline(sides)).groupBy("dimension", "label").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"))
    chance = marginal.groupBy("dimension").agg(F.sum(F.col("na") * F.col("nb")).alias("products"))
    seen = table.groupBy("dimension").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("a").eqNullSafe(F.col("b")), F.col("n")).otherwise(0)).alias("hits"))
    po = F.col("hits") / F.col("n")
    pe = F.col("products") / (F.col("n") * F.col("n"))
    return seen.join(chance, "dimension").select("dimension", F.when(pe == 1, 1.0).otherwise((po - pe) / F.nullif(1 - pe, F.lit(0.0))).alias("kappa"))


def weighted_kappa(pairs: DataFrame, categories: tuple[str, ...], weights: str = "linear") -> DataFrame:
    """Kappa with linear or quadratic weights over ordered categories, in one pass over the contingency table.

    Pairs with a label outside ``categories`` do not count.
    """
    k = len(categories)
    power = 2 if weights == "quadratic" else 1
    if k <= 1:
        return pairs.select("dimension").distinct().select("dimension", F.lit(1.0).alias("kappa"))
    rank = {c: i for i, c in enumerate(categories)}
    ranks = F.create_map(*[F.lit(x) for item in rank.items() for x in item])
    table = _table(pairs).select("dimension", ranks[F.col("a")].alias("i"), ranks[F.col("b")].alias("j"), "n").where("i is not null and j is not null")
    observed = F.sum(F.pow(F.abs(F.col("i") - F.col("j")) / (k - 1), F.lit(float(power))) * F.col("n")).alias("observed")
    rows = [F.sum(F.when(F.col("i") == x, F.col("n")).otherwise(0)).alias(f"r{x}") for x in range(k)]
    cols = [F.sum(F.when(F.col("j") == x, F.col("n")).otherwise(0)).alias(f"c{x}") for x in range(k)]
    sums = table.groupBy("dimension").agg(F.sum("n").alias("n"), observed, *rows, *cols)
    expected = sum((F.col(f"r{x}") * F.col(f"c{y}") * float((abs(x - y) / (k - 1)) ** power) for x in range(k) for y in range(k) if x != y),
                   F.lit(0.0)) / F.col("n")
    return sums.withColumn("expected", expected).select(
        "dimension", F.when(F.col("expected") == 0, 1.0).otherwise(1 - F.col("observed") / F.nullif(F.col("expected"), F.lit(0.0))).alias("kappa"))


def fleiss_kappa(ratings: DataFrame) -> DataFrame:
    """Kappa of any number of raters per dimension from (dimension, item_id, label) rows.

    Every item of a dimension needs the same number of ratings; otherwise the result is null.
    """
    cells = ratings.groupBy("dimension", "item_id", "label").agg(F.count(F.lit(1)).alias("c"))
    items = cells.groupBy("dimension", "item_id").agg(F.sum("c").alias("m"), F.sum(F.col("c") * (F.col("c") - 1)).alias("agree"))
    overall = items.groupBy("dimension").agg(
        F.count(F.lit(1)).alias("items"), F.min("m").alias("low"), F.max("m").alias("high"), F.sum("agree").alias("agree"))
    labels = cells.groupBy("dimension", "label").agg(F.sum("c").alias("c")).groupBy("dimension").agg(F.sum(F.col("c") * F.col("c")).alias("squares"))
    m, n = F.col("high"), F.col("items")
    p_bar = F.col("agree") / F.nullif(n * m * (m - 1), F.lit(0))
    p_e = F.col("squares") / (n * m * n * m)
    value = F.when(F.col("low") != m, F.lit(None)).when(m <= 1, 1.0).when(p_e == 1, 1.0).otherwise((p_bar - p_e) / F.nullif(1 - p_e, F.lit(0.0)))
    return overall.join(labels, "dimension").select("dimension", value.cast("double").alias("kappa"))


def krippendorff_alpha(ratings: DataFrame, categories: tuple[str, ...] | None = None, convention: str = "standard") -> DataFrame:
    """Alpha per dimension from (dimension, item_id, label) rows with missing ratings allowed.

    With ``categories`` the distance is the squared rank distance, otherwise nominal. ``convention`` "half"
    counts observed pairs once and expected pairs twice, so its alpha is (1 + standard) / 2.

    Sums of squared distances over pairs follow from counts and moments: for ranks m*sum(r^2) - sum(r)^2,
    for labels (m^2 - sum of squared label counts) / 2.
    """
    present = ratings.where(F.col("label").isNotNull())
    factor = 1.0 if convention == "half" else 2.0
    if categories is not None:
        ranks = F.create_map(*[F.lit(x) for i, c in enumerate(categories) for x in (c, i)])
        ranked = present.select("dimension", "item_id", ranks[F.col("label")].cast("bigint").alias("r")).where("r is not null")
        items = ranked.groupBy("dimension", "item_id").agg(
            F.count(F.lit(1)).alias("m"), F.sum("r").alias("s1"), F.sum(F.col("r") * F.col("r")).alias("s2")).where("m >= 2")
        pooled = items.groupBy("dimension").agg(
            F.sum("m").alias("total"), F.sum((F.col("m") * F.col("s2") - F.col("s1") * F.col("s1")) / (F.col("m") - 1)).alias("observed"),
            F.sum("s1").alias("t1"), F.sum("s2").alias("t2"))
        both_ways = 2 * (F.col("total") * F.col("t2") - F.col("t1") * F.col("t1"))
    else:
        cells = present.groupBy("dimension", "item_id", "label").agg(F.count(F.lit(1)).alias("c"))
        # An item's list holds one entry per distinct label, however many ratings it has.
        items = cells.groupBy("dimension", "item_id").agg(
            F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("squares"), F.collect_list(F.struct("label", "c")).alias("labels")).where("m >= 2")
        pairs = (F.col("m") * F.col("m") - F.col("squares")) / 2
        per_dimension = items.groupBy("dimension").agg(F.sum("m").alias("total"), F.sum(pairs / (F.col("m") - 1)).alias("observed"))
        by_label = items.select("dimension", F.inline("labels")).groupBy("dimension", "label").agg(F.sum("c").alias("c"))
        squares = by_label.groupBy("dimension").agg(F.sum(F.col("c") * F.col("c")).alias("label_squares"))
        pooled = per_dimension.join(squares, "dimension")
        both_ways = F.col("total") * F.col("total") - F.col("label_squares")
    d_o = factor * F.col("observed") / F.col("total")
    d_e = both_ways / (F.col("total") * (F.col("total") - 1))
    return pooled.select("dimension", F.when(d_e == 0, 1.0).otherwise(1 - d_o / F.nullif(d_e, F.lit(0.0))).alias("alpha"))


def agreement_report(pairs: DataFrame, ordinal: dict[str, tuple[str, ...]], convention: str = "standard") -> DataFrame:
    """Per dimension: share of agreement, kappa (quadratic for ordinal dimensions), alpha (ordinal only) and its reading."""
    share = percentage_agreement(pairs)
    sizes = pairs.groupBy("dimension").agg(F.count(F.lit(1)).alias("n_common_items"))
    kappas = cohen_kappa(pairs.where(~F.col("dimension").isin(*ordinal)) if ordinal else pairs)
    alphas = None
    for dimension, categories in ordinal.items():
        mine = pairs.where(F.col("dimension") == dimension)
        kappas = kappas.unionByName(weighted_kappa(mine, categories, "quadratic"))
        ratings = mine.select("dimension", "item_id", F.explode(F.array("a", "b")).alias("label"))
        alpha = krippendorff_alpha(ratings, categories, convention)
        alphas = alpha if alphas is None else alphas.unionByName(alpha)
    out = sizes.join(share, "dimension").join(kappas, "dimension")
    out = out.withColumn("alpha", F.lit(None).cast("double")) if alphas is None else out.join(alphas, "dimension", "left")
    return out.select("dimension", "n_common_items", F.round("agreement", 4).alias("agreement"), F.round("kappa", 4).alias("kappa"),
                      F.round("alpha", 4).alias("alpha"), kappa_label(F.col("kappa")).alias("interpretation"))
