"""Scores of signals and runs: confidence, gates, category scores, sufficiency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrace.functions import columns as C
from veritrace.functions import fixed


def apply_credibility(signals: DataFrame) -> DataFrame:
    """confidence_score times the factor of source_credibility and independent_source_count, within 0 and 1."""
    return signals.withColumn("confidence_score", C.clamp01(F.col("confidence_score") * C.confidence_factor("source_credibility", "independent_source_count")))


def severity_gate(signals: DataFrame) -> DataFrame:
    """HIGH and CRITICAL of one low-trust source become MEDIUM, unverified and due for review."""
    gated = C.severity_rank("severity").isin(3, 4) & C.tier_of("credibility_tier").isin("GENERAL", "LOW") & (F.col("independent_source_count") < 2)
    return signals.withColumns(
        {
            "severity": F.when(gated, "MEDIUM").otherwise(F.col("severity")),
            "is_unverified": gated | F.coalesce("is_unverified", F.lit(False)) if "is_unverified" in signals.columns else gated,
            "requires_human_review": gated | F.coalesce("requires_human_review", F.lit(False)) if "requires_human_review" in signals.columns else gated,
        }
    )


def category_scores(signals: DataFrame, *by: str) -> DataFrame:
    """(*by, risk_category, n, score): the mean of weight, confidence and recency, on a scale to 10; a recency that is null or 0 counts as 1."""
    s = C.severity_weight("severity") * F.col("confidence_score") * F.coalesce(F.nullif(F.col("temporal_weight"), F.lit(0.0)), F.lit(1.0))
    return signals.groupBy(*by, "risk_category").agg(F.count("*").alias("n"), F.round(F.least(F.lit(10.0), F.avg(s) * 10), 2).alias("score"))


def overall_score(scores: DataFrame, *by: str) -> DataFrame:
    """(*by, overall): rounded category scores weighted by their signals; 0 without any."""
    out = scores.groupBy(*by).agg(F.round(F.sum(F.col("score") * F.col("n")) / F.nullif(F.sum("n"), F.lit(0)), 2).alias("overall"))
    return out.withColumn("overall", F.coalesce("overall", F.lit(0.0)))


def category_radar(scores: DataFrame) -> DataFrame:
    """All categories in display order with their score to one place, 0 without one."""
    dim = scores.sparkSession.createDataFrame([(i, c) for i, c in enumerate(fixed.CATEGORIES)], "place int, risk_category string")
    return dim.join(scores, "risk_category", "left").select("place", "risk_category", F.round(F.coalesce("score", F.lit(0.0)), 1).alias("score"))


def sufficiency_of(n: Column, kinds: Column) -> Column:
    out = F.when(F.lit(False), F.lit("SPARSE"))
    for tier, least, distinct in fixed.SUFFICIENCY:
        out = out.when((n >= least) & (kinds >= distinct), tier)
    return out.otherwise("SPARSE")


def sufficiency(documents: DataFrame, *by: str, kind: str = "source_type") -> DataFrame:
    """(*by, n_docs, n_types, tier)."""
    out = documents.groupBy(*by).agg(F.count("*").alias("n_docs"), F.countDistinct(kind).alias("n_types"))
    return out.withColumn("tier", sufficiency_of(F.col("n_docs"), F.col("n_types")))


def critical_inflation(signals: DataFrame, *by: str) -> DataFrame:
    """(*by, share, inflated): whether over a tenth is CRITICAL."""
    out = signals.groupBy(*by).agg(F.coalesce(F.avg((F.col("severity") == "CRITICAL").cast("double")), F.lit(0.0)).alias("share"))
    return out.withColumn("inflated", F.col("share") > fixed.INFLATION)


def extraction_stats(anchored: DataFrame, *by: str) -> DataFrame:
    """(*by, extracted, kept, rejected, flagged, pass_rate) of rows with an anchor verdict."""
    kept, lost = F.count_if(F.col("verdict") != "REJECT"), F.count_if(F.col("verdict") == "REJECT")
    out = anchored.groupBy(*by).agg(F.count("*").alias("extracted"), kept.alias("kept"), lost.alias("rejected"), F.count_if(F.col("verdict") == "FLAG").alias("flagged"))
    return out.withColumn("pass_rate", F.coalesce(F.col("kept") / F.nullif(F.col("kept") + F.col("rejected"), F.lit(0)), F.lit(0.0)))


def llm_cost(calls: DataFrame) -> DataFrame:
    """calls (model, prompt_tokens, completion_tokens) with cost_usd; unknown models at the fallback price."""
    spark = calls.sparkSession
    prices = spark.createDataFrame(fixed.PRICES, "model string, price_in double, price_out double")
    p = calls.join(F.broadcast(prices), "model", "left")  # three rows
    cost = F.col("prompt_tokens") * F.coalesce("price_in", F.lit(fixed.FALLBACK_PRICE[0])) + F.col("completion_tokens") * F.coalesce("price_out", F.lit(fixed.FALLBACK_PRICE[1]))
    return p.withColumn("cost_usd", cost).drop("price_in", "price_out")
