"""Semantic and hybrid relevance of news for portfolios."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliowire import domain
from foliowire.functions.vectors import cosine, norm
from foliowire.operators.similarity import _unit, ball_join, block_join
from foliowire.session import cut_lineage

def semantic_relevance(news: DataFrame, assets: DataFrame, id_col: str = "news_id",
                       minimum: float | None = domain.RELEVANCE_BORDERLINE) -> DataFrame:
    """Per (news, portfolio): largest and mean cosine to the portfolio's asset vectors (not below 0) and the best asset.

    Pairs whose score reaches ``minimum`` are found by a join of balls of vectors, which skips those that cannot hold one; the mean
    cosine is the product with the mean of the portfolio's unit vectors. None returns all pairs, compared block by
    block. Of equally close assets the first by position and ticker is the best.
    """
    slim = assets.select("portfolio_id", "ticker", F.col("pos").cast("bigint").alias("pos"), "vector")
    if minimum is None or minimum <= 0:
        return _all_pairs(news, slim, id_col, minimum)
    id_type = news.schema[id_col].dataType.simpleString()

    def match(batch: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if batch.empty or held.empty:
            return pd.DataFrame({id_col: [], "portfolio_id": [], "score": [], "pos": [], "ticker": []})
        # one row per news and portfolio: the best of the portfolio's assets in this ball
        held = held.sort_values(["portfolio_id", "pos", "ticker"], kind="stable")
        similar = np.round(np.stack(batch["vector"]) @ np.stack(held["vector"]).T, 12)  # copies in other tasks stay equal
        starts = np.unique(held["portfolio_id"].to_numpy(), return_index=True)[1]
        best = np.maximum.reduceat(similar, starts, axis=1)
        i, j = np.nonzero(best >= minimum - 1e-12)
        ends = [*starts[1:], len(held)]
        at = np.array([starts[b] + similar[a, starts[b]:ends[b]].argmax() for a, b in zip(i, j)], dtype=int)
        found = held.iloc[at]
        return pd.DataFrame({id_col: batch[id_col].to_numpy()[i], "portfolio_id": found["portfolio_id"].to_numpy(), "score": best[i, j],
                             "pos": found["pos"].to_numpy(), "ticker": found["ticker"].to_numpy()})

    near = ball_join(news.select(id_col, "vector"), slim.withColumn("_asset", F.struct("portfolio_id", "pos", "ticker")), id_col, "_asset", minimum, match,
                     f"{id_col} {id_type}, portfolio_id string, score double, pos bigint, ticker string")
    best = near.groupBy(id_col, "portfolio_id").agg(F.min(F.struct((-F.col("score")).alias("away"), "pos", "ticker")).alias("best"))
    pairs = best.join(news.select(id_col, "vector"), id_col).join(_means(slim), "portfolio_id")
    return pairs.select(id_col, "portfolio_id", (-F.col("best.away")).alias("semantic_score"), F.greatest(
        cosine(F.col("vector"), F.col("mean")) * F.col("reach"), F.lit(0.0)).alias("semantic_mean_score"), F.col("best.ticker").alias("best_asset"))


def _means(assets: DataFrame) -> DataFrame:
    """(portfolio_id, mean, reach): the mean of the portfolio's unit vectors, and its length."""
    length = norm(F.col("vector"))
    entries = assets.select("portfolio_id", F.posexplode(F.transform(F.col("vector").cast("array<double>"), lambda x: F.coalesce(F.try_divide(x, length), F.lit(0.0)))).alias("k", "x"))
    means = entries.groupBy("portfolio_id", "k").agg(F.avg("x").alias("x")).groupBy("portfolio_id").agg(F.sort_array(F.collect_list(F.struct("k", "x"))).alias("m"))
    mean = means.select("portfolio_id", F.transform("m", lambda e: e["x"]).alias("mean"))
    return mean.withColumn("reach", norm(F.col("mean")))


def _all_pairs(news: DataFrame, slim: DataFrame, id_col: str, minimum: float | None) -> DataFrame:
    """Every pair, the assets of a portfolio in one block."""
    id_type = news.schema[id_col].dataType.simpleString()
    columns = [id_col, "portfolio_id", "semantic_score", "semantic_mean_score", "best_asset"]

    def match(batch: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame(columns=columns)]
        if not batch.empty and not held.empty:
            held = held.sort_values(["portfolio_id", "pos", "ticker"], kind="stable")
            similar = _unit(batch["vector"]) @ _unit(held["vector"]).T
            portfolios, starts = np.unique(held["portfolio_id"].to_numpy(), return_index=True)
            tickers, ids = held["ticker"].to_numpy(), batch[id_col].to_numpy()
            for portfolio, low, high in zip(portfolios, starts, [*starts[1:], len(held)]):
                part = similar[:, low:high]
                best = np.maximum(part.max(axis=1), 0.0)
                keep = np.ones(len(best), bool) if minimum is None else best >= minimum
                out.append(pd.DataFrame({
                    id_col: ids[keep], "portfolio_id": portfolio, "semantic_score": best[keep],
                    "semantic_mean_score": np.maximum(part.mean(axis=1), 0.0)[keep], "best_asset": tickers[low:high][part.argmax(axis=1)][keep]}))
        return pd.concat(out[1:] or out)

    return block_join(news.select(id_col, "vector"), slim, id_col, "portfolio_id", match,
                      f"{id_col} {id_type}, portfolio_id string, semantic_score double, semantic_mean_score double, best_asset string")


def blend(direct: Column, semantic: Column) -> Column:
    """Weighted score: the rules dominate a direct mention, the embedding a weak one; at most 1."""
    mixed = (
        F.when(direct >= 0.8, direct * 0.7 + semantic * 0.3)
        .when(direct >= 0.5, direct * 0.5 + semantic * 0.5)
        .otherwise(direct * 0.3 + semantic * 0.7))
    return F.least(mixed, F.lit(1.0))


def hybrid_relevance(rules: DataFrame, semantic: DataFrame, id_col: str = "news_id") -> DataFrame:
    """Combined relevance of every pair known to either layer."""
    pairs = semantic.join(rules, [id_col, "portfolio_id"], "full_outer")
    direct = F.coalesce("direct_score", F.lit(0.0))
    close = F.coalesce("semantic_score", F.lit(0.0))
    return pairs.select(
        id_col, "portfolio_id", F.round(blend(direct, close), 4).alias("relevance_score"),
        F.coalesce("matched_assets", F.array().cast("array<string>")).alias("matched_assets"),
        F.round(direct, 4).alias("direct_score"), F.round(close, 4).alias("semantic_score"),
        F.round(F.coalesce("semantic_mean_score", F.lit(0.0)), 4).alias("semantic_mean_score"), "best_asset",
        F.coalesce("sector_match", F.lit(False)).alias("sector_match"), F.coalesce("country_match", F.lit(False)).alias("country_match"))


def externally_scored_relevance(rules: DataFrame, scores: DataFrame, assets: DataFrame, id_col: str = "news_id") -> DataFrame:
    """Variant with a supplied score table (id, portfolio, score, assets) instead of embeddings.

    A direct score of 0.8 stands alone. Otherwise the supplied score is blended in and its assets are
    added, as far as the portfolio holds them.
    """
    held = assets.select("portfolio_id", "ticker").distinct()
    named = scores.select(id_col, "portfolio_id", F.explode("assets").alias("ticker")).join(held, ["portfolio_id", "ticker"], "left_semi")
    valid = named.groupBy(id_col, "portfolio_id").agg(F.collect_set("ticker").alias("extra"))
    supplied = scores.select(id_col, "portfolio_id", "score").join(valid, [id_col, "portfolio_id"], "left")
    both = rules.join(supplied, [id_col, "portfolio_id"], "full_outer")
    direct = F.coalesce("direct_score", F.lit(0.0))
    alone = direct >= 0.8
    score = F.when(alone, direct).otherwise(blend(direct, F.coalesce("score", F.lit(0.0))))
    empty = F.array().cast("array<string>")
    own, extra = F.coalesce("matched_assets", empty), F.coalesce("extra", empty)
    return both.select(
        id_col, "portfolio_id", score.alias("relevance_score"),
        F.when(alone, own).otherwise(F.array_union(own, extra)).alias("matched_assets"),
        F.coalesce("sector_match", F.lit(False)).alias("sector_match"))


def gated_hybrid_relevance(news: DataFrame, rules: DataFrame, assets: DataFrame, minimum: float = domain.RELEVANCE_BORDERLINE,
                           id_col: str = "news_id") -> DataFrame:
    """Hybrid relevance of exactly the pairs that reach ``minimum``, without scoring every news item against every portfolio.

    A pair without a rule signal needs a cosine of minimum / 0.7, which the similarity join finds. Pairs
    with a signal are scored against the assets of their own portfolio only.
    """
    rules = cut_lineage(rules)  # read for the pairs and for their scores
    slim = assets.select("portfolio_id", "ticker", F.col("pos").cast("bigint").alias("pos"), F.col("vector").alias("asset_vector"))
    near = semantic_relevance(news, assets, id_col, minimum / 0.7 - 1e-6)
    pairs = near.select(id_col, "portfolio_id").unionByName(rules.select(id_col, "portfolio_id")).distinct()
    scored = pairs.join(news.select(id_col, "vector"), id_col).join(slim, "portfolio_id").select(
        id_col, "portfolio_id", "ticker", "pos", cosine(F.col("vector"), F.col("asset_vector")).alias("s"))
    best = F.min(F.struct((-F.col("s")).alias("away"), "pos", "ticker"))  # ties go to the first by position and ticker
    semantic = scored.groupBy(id_col, "portfolio_id").agg(
        F.greatest(F.max("s"), F.lit(0.0)).alias("semantic_score"), F.greatest(F.avg("s"), F.lit(0.0)).alias("semantic_mean_score"),
        best["ticker"].alias("best_asset"))
    return hybrid_relevance(rules, semantic, id_col).where(F.col("relevance_score") >= minimum)
