"""Investor profiles from questionnaires and portfolio suitability.

Holdings: portfolio_id, asset_id, weight, sector, country (raw spellings). Everything after the first
aggregation works on at most a dozen rows per portfolio, however many assets one portfolio holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliowire import domain
from foliowire.functions.scoring import canonical_region, canonical_sector, lookup, risk_profile
from foliowire.functions.text import filled
from foliowire.session import cut_lineage

BALANCED, OVER, UNDER = "equilibrado", "sobreexpuesto", "infraexpuesto"  # fixed values


def question_weights(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(q, w) for q, (w, _) in domain.RISK_QUESTIONS.items()], "question_id string, weight double")


def option_scores(spark: SparkSession) -> DataFrame:
    rows = [(q, o, s) for q, (_, options) in domain.RISK_QUESTIONS.items() for o, s in options.items()]
    return spark.createDataFrame(rows, "question_id string, option_id string, score int")


def scored_answers(answers: DataFrame) -> DataFrame:
    """Answers to risk questions with their option's score and question's weight; unknown options fall out."""
    spark = answers.sparkSession
    return answers.join(F.broadcast(option_scores(spark)), ["question_id", "option_id"]).join(
        F.broadcast(question_weights(spark)), "question_id")


def risk_scores(answers: DataFrame) -> DataFrame:
    """Weighted mean score per user, rounded half to even; the default where no risk question is answered."""
    sums = scored_answers(answers).groupBy("user_id").agg(
        F.sum(F.col("score") * F.col("weight")).alias("points"), F.sum("weight").alias("total"))
    users = answers.select("user_id").distinct()
    score = F.coalesce(F.bround(F.col("points") / F.col("total")), F.lit(float(domain.DEFAULT_RISK_SCORE))).cast("int")
    return users.join(sums, "user_id", "left").select("user_id", score.alias("risk_score"))


def investor_profiles(answers: DataFrame) -> DataFrame:
    """Risk score and profile, horizon, goal, knowledge, ESG preference, sectors and tolerated loss per user."""
    def answer(question):
        return F.max(F.when(F.col("question_id") == question, F.col("option_id")))

    chosen = answers.groupBy("user_id").agg(
        answer("q1_horizon").alias("q1"), answer("q2_goal").alias("q2"), answer("q4_knowledge").alias("q4"),
        answer("q8_max_loss").alias("q8"), answer("q9_esg").alias("q9"), answer("q10_sectors").alias("q10"))
    listed = F.transform(F.split(F.coalesce("q10", F.lit("")), ","), lambda o: F.trim(o))
    sectors = F.array_compact(F.transform(listed, lambda o: lookup(o, domain.SECTOR_BY_OPTION)))
    horizon = F.when(F.col("q1").isNull(), "medio_plazo").otherwise(lookup(F.col("q1"), domain.HORIZON_BY_OPTION, F.lit("largo_plazo")))
    mapped = chosen.select(
        "user_id", horizon.alias("horizon"), F.coalesce(lookup(F.col("q2"), domain.GOAL_BY_OPTION), F.lit("crecimiento_equilibrado")).alias("goal"),
        F.coalesce(lookup(F.col("q4"), domain.KNOWLEDGE_BY_OPTION), F.lit("intermedio")).alias("knowledge"),
        F.coalesce(F.col("q9").isin(*domain.ESG_OPTIONS), F.lit(False)).alias("esg_preference"), sectors.alias("sector_preferences"),
        F.coalesce(lookup(F.col("q8"), domain.LOSS_BY_OPTION), F.lit(15.0)).alias("loss_tolerance_pct"))
    return risk_scores(answers).join(mapped, "user_id").withColumn("risk_profile", risk_profile(F.col("risk_score")))


def composition(holdings: DataFrame) -> DataFrame:
    """The one aggregation over holdings: sums per portfolio, canonical sector and region, with the largest position.

    At most a few dozen rows per portfolio. It is materialised, as every measure below reads it.
    """
    return cut_lineage(holdings.groupBy(
        "portfolio_id", canonical_sector(F.col("sector")).alias("sector"), canonical_region(F.col("country")).alias("region")).agg(
        F.sum("weight").alias("w"), F.sum(F.col("weight") * F.col("weight")).alias("squares"), F.count(F.lit(1)).alias("n"),
        F.max(F.struct("weight", (-F.col("asset_id")).alias("o"), "asset_id")).alias("top")))


def _totals(base: DataFrame) -> DataFrame:
    return base.groupBy("portfolio_id").agg(
        F.sum("w").alias("total"), F.sum("squares").alias("squares"), F.sum("n").alias("n_assets"), F.max("top").alias("top"))


def _equal_or(value: Column) -> Column:
    """Weights that sum to nothing count as equal weights."""
    return F.when(F.col("total") < 0.01, F.lit(1.0) / F.col("n_assets")).otherwise(value)


def concentration(base: DataFrame) -> DataFrame:
    """Herfindahl index of the normalised weights, from two sums."""
    return _totals(base).select("portfolio_id", "n_assets", _equal_or(F.col("squares") / (F.col("total") * F.col("total"))).alias("hhi"))


def largest_position(base: DataFrame) -> DataFrame:
    return _totals(base).select("portfolio_id", F.col("top.asset_id").alias("asset_id"), _equal_or(F.col("top.weight") / F.col("total")).alias("share"))


def shares(base: DataFrame, category: str) -> DataFrame:
    """Percent of each portfolio per sector or region."""
    sums = base.groupBy("portfolio_id", F.col(category).alias("category")).agg(F.sum("w").alias("w"), F.sum("n").alias("n"))
    whole = W.partitionBy("portfolio_id")
    total, count = F.sum("w").over(whole), F.sum("n").over(whole)
    pct = F.when(total < 0.01, F.col("n") / count).otherwise(F.col("w") / total) * 100
    return sums.select("portfolio_id", "category", pct.alias("pct"))


def ideal_table(spark: SparkSession, ideals: dict[str, dict[str, float]]) -> DataFrame:
    rows = [(p, c, float(v)) for p, categories in ideals.items() for c, v in categories.items()]
    return spark.createDataFrame(rows, "risk_profile string, category string, ideal double")


def known_profiles(portfolios: DataFrame, profiles: DataFrame) -> DataFrame:
    """(portfolio_id, risk_profile) with the default for a missing or unknown profile."""
    named = F.col("risk_profile")
    return portfolios.select("portfolio_id").distinct().join(profiles.select("portfolio_id", "risk_profile"), "portfolio_id", "left").select(
        "portfolio_id", F.when(named.isin(*domain.IDEAL_SECTORS), named).otherwise(domain.DEFAULT_PROFILE).alias("risk_profile"))


def allocation(current: DataFrame, profiles: DataFrame, ideals: dict[str, dict[str, float]]) -> DataFrame:
    """Current and ideal percent per category of either side, the difference and its status.

    Both sides are stacked and summed per category, which equals a full outer join in one shuffle.
    """
    spark = current.sparkSession
    wanted = known_profiles(current, profiles).join(F.broadcast(ideal_table(spark, ideals)), "risk_profile").select(
        "portfolio_id", "category", F.lit(0.0).alias("pct"), "ideal")
    both = current.select("portfolio_id", "category", "pct", F.lit(0.0).alias("ideal")).unionByName(wanted)
    merged = both.groupBy("portfolio_id", "category").agg(
        F.round(F.sum("pct"), 1).alias("current_pct"), F.round(F.sum("ideal"), 1).alias("ideal_pct"))
    out = merged.withColumn("diff_pct", F.round(F.col("current_pct") - F.col("ideal_pct"), 1))
    status = F.when(F.abs("diff_pct") <= 5, BALANCED).when(F.col("diff_pct") > 0, OVER).otherwise(UNDER)
    return out.withColumn("status", status)


def sector_allocation(base: DataFrame, profiles: DataFrame) -> DataFrame:
    return allocation(shares(base, "sector"), profiles, domain.IDEAL_SECTORS)


def region_allocation(base: DataFrame, profiles: DataFrame) -> DataFrame:
    return allocation(shares(base, "region"), profiles, domain.IDEAL_REGIONS)


def _facts(base: DataFrame) -> DataFrame:
    """Concentration, largest position and the numbers of sectors and regions with weight, one row per portfolio."""
    present = F.when((F.col("w") > 0) | (F.col("total") < 0.01), F.col("category"))
    totals = _totals(base)
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("category")) for s in ("sector", "region")])
    named = base.select("portfolio_id", "w", F.inline(sides)).groupBy("portfolio_id", "side", "category").agg(F.sum("w").alias("w"))
    counted = named.join(totals.select("portfolio_id", "total"), "portfolio_id").groupBy("portfolio_id").agg(
        F.count(F.when(F.col("side") == "sector", present)).alias("n_sectors"), F.count(F.when(F.col("side") == "region", present)).alias("n_regions"))
    return totals.join(counted, "portfolio_id").select(
        "portfolio_id", "n_assets", "n_sectors", "n_regions", _equal_or(F.col("squares") / (F.col("total") * F.col("total"))).alias("hhi"),
        F.col("top.asset_id").alias("asset_id"), _equal_or(F.col("top.weight") / F.col("total")).alias("share"))


def diversification(base: DataFrame) -> DataFrame:
    """Score 0-100 from the numbers of assets, sectors and regions and the concentration."""
    points = (
        F.least(F.col("n_assets") / 15, F.lit(1.0)) * 30 + (1 - F.col("hhi")) * 30
        + F.least(F.col("n_sectors") / 6, F.lit(1.0)) * 20 + F.least(F.col("n_regions") / 4, F.lit(1.0)) * 20)
    return _facts(base).withColumn("diversification_score", F.bround(points).cast("int"))


def alignment(sectors: DataFrame, regions: DataFrame) -> DataFrame:
    """Score 0-100: 100 less 1.5 times the mean absolute sector and region differences."""
    def gap(slices, name):
        return slices.groupBy("portfolio_id").agg(F.avg(F.abs("diff_pct")).alias(name))

    both = gap(sectors, "s").join(gap(regions, "r"), "portfolio_id")
    raw = 100 - (F.col("s") * 1.5 + F.col("r") * 1.5)
    return both.select("portfolio_id", F.bround(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw))).cast("int").alias("risk_alignment_score"))


def warnings(base: DataFrame, profiles: DataFrame, sectors: DataFrame) -> DataFrame:
    """(portfolio_id, rule, message) of every risk warning that applies."""
    def outliers(condition):
        return F.array_join(F.array_sort(F.collect_list(F.when(condition, F.col("category")))), ", ")

    extremes = sectors.groupBy("portfolio_id").agg(
        outliers(F.col("diff_pct") > 15).alias("over"), outliers(F.col("diff_pct") < -15).alias("under"))
    facts = _facts(base).join(known_profiles(base, profiles), "portfolio_id").join(extremes, "portfolio_id")
    least_assets = lookup(F.col("risk_profile"), domain.MIN_HOLDINGS)

    def rule(condition, name, message):
        return F.when(condition, F.struct(F.lit(name).alias("rule"), message.alias("message")))

    pct = F.format_string("%.0f", F.col("share") * 100)
    texts, c = domain.WARNING_TEXTS, F.col
    found = F.array_compact(F.array(
        rule(c("n_assets") < least_assets, "few_assets", filled(texts["few_assets"], c("n_assets"), c("risk_profile"), least_assets)),
        rule(c("hhi") > 0.25, "concentration", filled(texts["concentration"], c("asset_id"), pct)),
        rule(c("over") != "", "over_sectors", filled(texts["over_sectors"], c("over"))),
        rule(c("under") != "", "under_sectors", filled(texts["under_sectors"], c("under"))),
        rule(c("n_regions") <= 1, "single_region", F.lit(texts["single_region"]))))
    return facts.select("portfolio_id", F.inline(found))


def overexposed_assets(holdings: DataFrame, sectors: DataFrame) -> DataFrame:
    """Assets whose sector name is part of the name of a sector overexposed by more than 10 points."""
    over = sectors.where((F.col("status") == OVER) & (F.col("diff_pct") > 10)).select("portfolio_id", "category", "diff_pct", "current_pct", "ideal_pct")
    named = holdings.where(F.col("sector").isNotNull() & (F.col("sector") != ""))
    return named.join(over, "portfolio_id").where(F.contains(F.lower("category"), F.lower("sector")))


def recommendations(holdings: DataFrame, base: DataFrame, profiles: DataFrame, sectors: DataFrame, regions: DataFrame) -> DataFrame:
    """Rule-based recommendations with their reasons: reduce, buy, cap, diversify, or hold where no rule applies.

    ``holdings`` may carry the asset's name. Portfolios and sectors a rule concerns are found among a few rows per portfolio first;
    only then do they meet the holdings.
    """
    none, text = F.lit(None), domain.RECOMMENDATION_TEXTS
    held = holdings if "name" in holdings.columns else holdings.withColumn("name", F.lit(""))
    known = known_profiles(base, profiles)

    def rows(df, action, rule, asset, name, sector, priority, reason, current=none, suggested=none):
        return df.select("portfolio_id", F.lit(rule).alias("rule"), F.lit(action).alias("action"), asset.cast("bigint").alias("asset_id"),
                         name.alias("asset_name"), sector.alias("sector"), priority.alias("priority"), reason.alias("reason"),
                         current.cast("double").alias("current_weight"), suggested.cast("double").alias("suggested_weight"))

    def whole(value):
        return F.format_string("%.0f", F.bround(value))

    def told(rule, what):
        return filled(text[rule], what, whole(F.col("current_pct")), whole(F.col("ideal_pct")), F.col("risk_profile"))

    blank, medium, high, category = F.lit(""), F.lit("media"), F.lit("alta"), F.col("category")
    profiled = sectors.join(known, "portfolio_id")
    over = overexposed_assets(held, sectors).join(known, "portfolio_id")
    reduce_ = rows(over, "reducir", "sector_over", F.col("asset_id"), F.col("name"), category,
                   F.when(F.col("diff_pct") > 20, high).otherwise(medium), told("sector_over", category))
    buy = rows(profiled.where((F.col("status") == UNDER) & (F.col("diff_pct") < -10)), "comprar", "sector_under", none,
               F.concat(F.lit("ETF/Fondo del sector "), category), category, medium, told("sector_under", category))
    totals = _totals(base).where(F.col("squares") > F.col("total") * F.col("total") * 0.25).select("portfolio_id", "total").join(known, "portfolio_id")
    pct = F.col("weight") / F.col("total") * 100
    cap = rows(held.join(totals, "portfolio_id").where(pct > 25), "reducir", "position_cap", F.col("asset_id"), F.col("name"),
               F.coalesce("sector", blank), high, filled(text["position_cap"], F.col("asset_id"), whole(pct), blank, F.col("risk_profile")),
               F.round(pct, 1), F.lit(15.0))
    abroad = rows(regions.join(known, "portfolio_id").where((F.col("status") == UNDER) & (F.col("diff_pct") < -15)), "comprar", "region_under", none,
                  F.concat(F.lit("ETF/Fondo de "), category), F.lit("Diversificación geográfica"), medium, told("region_under", category))
    acted = cut_lineage(reduce_.unionByName(buy).unionByName(cap).unionByName(abroad))  # read as rows and for the portfolios without any
    idle = base.select("portfolio_id").distinct().join(acted.select("portfolio_id").distinct(), "portfolio_id", "left_anti")
    return acted.unionByName(rows(idle, "mantener", "hold", none, F.lit("Cartera actual"), blank, F.lit("baja"), F.lit(text["hold"])))
