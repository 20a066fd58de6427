"""Folding factor percentiles into composites, health scores and themes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Which measures belong to which theme.
THEMES = {
    "earnings quality": ("accruals", "cash_conversion"),
    "profitability": ("return_on_assets", "gross_profitability", "operating_margin_change"),
    "growth": ("revenue_growth", "asset_turnover_change"),
    "discipline": ("asset_growth", "net_share_issuance"),
    "solvency": ("leverage_change", "cash_to_assets"),
    "valuation": ("earnings_yield", "cash_flow_yield", "sales_yield", "book_to_price"),
    "price behaviour": ("momentum", "volatility"),
}
# Measures that say nothing about a financial company or a utility.
IRRELEVANT = {
    "Financials": ("leverage_change", "asset_growth", "cash_conversion", "accruals",
                   "cash_flow_yield", "cash_to_assets", "asset_turnover_change"),
    "Utilities": ("leverage_change", "asset_growth"),
}
# Health tests as (measure, comparison, bound).
HEALTH_TESTS = (("return_on_assets", ">", 0.0), ("cash_conversion", ">", 1.0), ("accruals", "<", 0.0),
                ("leverage_change", "<=", 0.0), ("operating_margin_change", ">", 0.0),
                ("asset_turnover_change", ">", 0.0), ("net_share_issuance", "<=", 0.0))
# Scores keep guard digits: means of four-digit percentiles end within eight.
SCORE_DIGITS = 8
MIN_FACTORS = 4
MIN_THEMES = 3
RND_INTENSITY, REDUCED = 0.10, 0.4


def theme_of(key: Column) -> Column:
    out = F.lit(None).cast("string")
    for theme, keys in THEMES.items():
        out = F.when(key.isin(*keys), theme).otherwise(out)
    return out


def relevance(key: Column, sector: Column, rnd_intensity: Column | None = None) -> Column:
    """0 where the measure describes the business model, 0.4 for book value at research-heavy firms."""
    out = F.lit(1.0)
    if rnd_intensity is not None:
        heavy = F.coalesce((key == "book_to_price") & (rnd_intensity >= RND_INTENSITY), F.lit(False))
        out = F.when(heavy, REDUCED).otherwise(out)
    for name, keys in IRRELEVANT.items():
        out = F.when(F.coalesce((sector == name) & key.isin(*keys), F.lit(False)), 0.0).otherwise(out)
    return out


def flat_composite(scored: DataFrame) -> DataFrame:
    """Mean percentile over at least four factors, with the extreme readings named."""
    p = F.col("percentile")
    g = scored.groupBy("as_of", "entity_id").agg(
        F.avg("percentile").alias("score"), F.count(F.lit(1)).alias("factor_count"),
        F.array_sort(F.collect_list(F.when((p <= 0.1) | (p >= 0.9), F.col("key")))).alias("extremes"))
    return g.filter(F.col("factor_count") >= MIN_FACTORS).withColumn("score", F.round("score", SCORE_DIGITS))


def theme_scores(scored: DataFrame, rnd_intensity: Column | None = None) -> DataFrame:
    w = relevance(F.col("key"), F.col("sector"), rnd_intensity)
    d = scored.withColumn("_w", w).withColumn("theme", theme_of(F.col("key")))
    d = d.filter((F.col("_w") > 0) & F.col("theme").isNotNull())
    adjusted = 0.5 + (F.col("percentile") - 0.5) * F.col("_w")
    return d.groupBy("as_of", "entity_id", "theme").agg(F.avg(adjusted).alias("theme_score"), F.count(F.lit(1)).alias("n"))


def weighted_composite(scored: DataFrame, rnd_intensity: Column | None = None) -> DataFrame:
    """Mean within a theme, then across at least three themes, so a crowded theme weighs no more."""
    g = theme_scores(scored, rnd_intensity).groupBy("as_of", "entity_id").agg(
        F.avg("theme_score").alias("score"), F.sum("n").alias("factor_count"), F.count(F.lit(1)).alias("themes"))
    return g.filter(F.col("themes") >= MIN_THEMES).withColumn("score", F.round("score", SCORE_DIGITS))


def health_score(values: DataFrame) -> DataFrame:
    """Tests passed out of the tests whose inputs exist."""
    key, value = F.col("key"), F.col("value")
    passed = F.lit(False)
    for k, op, bound in HEALTH_TESTS:
        hit = {">": value > bound, "<": value < bound, "<=": value <= bound}[op]
        passed = F.when(key == k, hit).otherwise(passed)
    tests = values.filter(key.isin(*[k for k, _, _ in HEALTH_TESTS])).withColumn("_ok", passed)
    return tests.groupBy("as_of", "entity_id").agg(
        F.count_if("_ok").alias("passed"), F.count(F.lit(1)).alias("available"),
        F.array_sort(F.collect_list(F.when(~F.col("_ok"), key))).alias("failed"))


def composite_rows(scored: DataFrame) -> DataFrame:
    """The conditional score where it exists, else the flat one; both kept."""
    flat = flat_composite(scored).withColumnsRenamed({"score": "flat_score", "factor_count": "flat_count"})
    cond = weighted_composite(scored).withColumnsRenamed({"score": "conditional_score", "factor_count": "conditional_count"})
    return flat.join(cond, ["as_of", "entity_id"], "full").select(
        "as_of", "entity_id", F.coalesce("conditional_score", "flat_score").alias("score"),
        "flat_score", "conditional_score", F.coalesce("conditional_count", "flat_count").alias("factor_count"))
