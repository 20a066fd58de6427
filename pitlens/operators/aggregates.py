"""Grouped statistics over findings, returns and decisions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitlens.functions import stats


def coverage(findings: DataFrame, as_of: str) -> DataFrame:
    """What was held about each entity by the end of that day."""
    seen = findings.filter(F.col("occurred_at") < F.date_add(F.lit(as_of).cast("date"), 1))
    return seen.groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("findings"), F.countDistinct("document_id").alias("documents"),
        F.min("day").alias("first_day"), F.max("day").alias("last_day"),
        F.countDistinct(F.when(F.col("genre").isin("10-K", "10-Q"), F.col("document_id"))).alias("periodic"))


def document_directional_counts(findings: DataFrame) -> DataFrame:
    """Positive and negative findings per document; documents with neither stay as zeros."""
    return findings.groupBy("document_id", "entity_id", "genre").agg(
        F.count_if(F.col("direction") == "positive").alias("positive"),
        F.count_if(F.col("direction") == "negative").alias("negative"))


def monthly_returns(bars: DataFrame) -> DataFrame:
    """Month-over-month return of the last adjusted close; one row per series and month."""
    m = bars.groupBy("brand", F.trunc("session_date", "month").alias("month")).agg(
        F.max_by("adjusted_close", "session_date").alias("price"), F.sum("volume").alias("volume"))
    w = Window.partitionBy("brand").orderBy("month")
    return m.withColumn("ret", F.col("price") / F.lag("price").over(w) - 1).filter(F.col("ret").isNotNull())


def hhi(df: DataFrame, keys: Sequence[str], weight: str) -> DataFrame:
    """Concentration: sum of squared shares of absolute weight."""
    return df.groupBy(*keys).agg(F.expr(
        f"CASE WHEN sum(abs({weight})) > 0 THEN sum(power({weight}, 2)) / power(sum(abs({weight})), 2) END").alias("hhi"))


def risk_ratios(df: DataFrame, keys: Sequence[str], r: str, periods: int, population: bool = False) -> DataFrame:
    """Annualised volatility, downside deviation, Sharpe and Sortino; null where the spread is."""
    sd = f"{'stddev_pop' if population else 'stddev_samp'}({r})"
    down = f"CASE WHEN count({r}) >= 2 THEN sqrt(sum(power(least(0D, {r}), 2)) / (count({r}) - 1)) END"
    year = f"sqrt({float(periods)}D)"
    return df.groupBy(*keys).agg(
        F.expr(f"{sd} * {year} AS annualised"), F.expr(f"{down} AS downside"),
        F.expr(f"avg({r}) / nullif({sd}, 0) * {year} AS sharpe"),
        F.expr(f"avg({r}) / nullif({down}, 0) * {year} AS sortino"),
        (F.product(1 + F.col(r)) - 1).alias("compound"))


def max_drawdown(df: DataFrame, keys: Sequence[str], order: str, r: str) -> DataFrame:
    """Deepest fall from the running peak, the peak starting at one."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    level = df.withColumn("_level", F.product(1 + F.col(r)).over(w))
    peak = level.withColumn("_peak", F.greatest(F.lit(1.0), F.max("_level").over(w)))
    return peak.groupBy(*keys).agg(F.least(F.lit(0.0), F.min(F.col("_level") / F.col("_peak") - 1)).alias("max_drawdown"))


def path_ratios(r: str, periods: int) -> list[str]:
    """What risk_ratios and max_drawdown say, of an array of returns in order: columns of the row that holds it."""
    n, year = f"size({r})", f"sqrt({float(periods)}D)"
    mean = f"aggregate({r}, 0D, (a, x) -> a + x) / {n}"
    root = lambda e: f"sqrt(aggregate({r}, 0D, (a, x) -> a + power({e}, 2)) / nullif({n} - 1, 0))"
    sd, down = root(f"x - {mean}"), root("least(0D, x)")
    fall = (f"aggregate({r}, struct(1D AS level, 1D AS peak, 0D AS depth), (a, x) -> struct(a.level * (1 + x) AS level, greatest(a.peak, a.level * (1 + x)) AS peak,"
            " least(a.depth, a.level * (1 + x) / greatest(a.peak, a.level * (1 + x)) - 1) AS depth)).depth")
    return [f"{sd} * {year} AS annualised", f"{down} AS downside", f"{mean} / nullif({sd}, 0) * {year} AS sharpe", f"{mean} / nullif({down}, 0) * {year} AS sortino",
            f"aggregate({r}, 1D, (a, x) -> a * (1 + x)) - 1 AS compound", f"{fall} AS max_drawdown"]


def calibration_bins(df: DataFrame, keys: Sequence[str], confidence: str, won: str) -> DataFrame:
    b = F.expr(f"least(4, int({confidence} * 5))").alias("bin")
    return df.groupBy(*keys, b).agg(
        F.count(F.lit(1)).alias("n"), F.avg(confidence).alias("mean_confidence"), F.avg(won).alias("win_rate"),
        F.sum(F.expr(f"power({confidence} - {won}, 2)")).alias("sq"))


def calibration(df: DataFrame, keys: Sequence[str], confidence: str, won: str) -> DataFrame:
    """Brier score, expected calibration error and rank discrimination; needs ten rows."""
    bins = calibration_bins(df, keys, confidence, won)
    g = bins.groupBy(*keys).agg(
        F.sum("n").alias("n"), (F.sum("sq") / F.sum("n")).alias("brier"),
        (F.sum(F.col("n") * F.abs(F.col("mean_confidence") - F.col("win_rate"))) / F.sum("n")).alias("ece"))
    rho = stats.spearman(df, keys, confidence, won, "discrimination").drop("n")
    return g.filter(F.col("n") >= 10).join(rho, list(keys), "left")


def entropy(df: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    counts = df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"))
    # H = log2 N - sum(n log2 n) / N needs no second pass over the shares
    return counts.groupBy(*keys).agg((F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")).alias("bits"))


def mean_abs_gap(df: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    """Mean absolute pairwise difference inside groups of two or more, without forming pairs.

    Sorted values x_0..x_{n-1} contribute (2i - n + 1) x_i to the sum over pairs.
    """
    from pitlens.operators.ranks import average_rank

    d = average_rank(df, keys, x, "_i", "_n").filter(F.col("_n") >= 2)
    g = d.groupBy(*keys).agg(F.sum((2 * F.col("_i") - F.col("_n") + 1) * F.col(x)).alias("gap"),
                             F.max(F.col("_n") * (F.col("_n") - 1) / 2).alias("pairs"))
    return g.agg((F.sum("gap") / F.sum("pairs")).alias("mean_abs_gap"), F.sum("pairs").cast("long").alias("pairs"))
