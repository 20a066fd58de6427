"""Analysis of decision books by arm: pairing, decomposition, anchoring, audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitlens.functions import stats

CELL = ("cust", "y")


def paired_arms(books: DataFrame, control: str, columns: Sequence[str], cell: Sequence[str] = CELL) -> DataFrame:
    """Each treatment book beside its own control book."""
    base = books.filter(F.col("arm") == control).select(*cell, *[F.col(c).alias(f"control_{c}") for c in columns])
    return books.filter(F.col("arm") != control).join(base, list(cell))


def paired_effects(weights: DataFrame, control: str, returns: DataFrame, cell: Sequence[str] = CELL) -> DataFrame:
    """Contribution of each treatment position against the control's exposure to the same name."""
    base = weights.filter(F.col("arm") == control).select(*cell, "brand", F.col("w").alias("control_w"))
    covered = base.select(*cell).distinct()
    d = weights.filter(F.col("arm") != control).join(covered, list(cell), "left_semi").join(base, [*cell, "brand"], "left").join(returns, ["y", "brand"], "left")
    d = d.selectExpr(*cell, "arm", "brand", "w - coalesce(control_w, 0D) AS delta", "coalesce(total, 0D) AS r")
    return d.withColumn("contribution", F.col("delta") * F.col("r")).withColumn("kind", F.expr(
        "CASE WHEN abs(delta) < 1e-9 THEN 'unchanged' WHEN contribution < 0 THEN CASE WHEN r > 0 THEN 'missed_upside' ELSE 'added_loss' END"
        " ELSE CASE WHEN r < 0 THEN 'avoided_loss' ELSE 'captured_upside' END END"))


def decompose(weights: DataFrame, control: str, returns: DataFrame, cell: Sequence[str] = CELL) -> DataFrame:
    """Weight change times excess return, split by what it won or lost, with how positions changed."""
    base = weights.filter(F.col("arm") == control).select(*cell, "brand", F.col("w").alias("wc"))
    treated = weights.filter(F.col("arm") != control)
    # every treatment cell meets the union of both books' names
    names = treated.select(*cell, "arm").distinct().join(base, list(cell)).select(*cell, "arm", "brand", "wc")
    d = treated.join(base.select(*cell).distinct(), list(cell), "left_semi").select(*cell, "arm", "brand", F.col("w").alias("wt")).join(names, [*cell, "arm", "brand"], "full")
    d = d.join(returns, ["y", "brand"]).selectExpr(*cell, "arm", "coalesce(wt, 0D) AS wt", "coalesce(wc, 0D) AS wc", "total - bench AS excess")
    d = d.withColumn("delta", F.expr("wt - wc")).filter("abs(delta) >= 1e-9")
    effect = "CASE WHEN delta > 0 THEN CASE WHEN excess > 0 THEN 'captured_upside' ELSE 'added_loss' END ELSE CASE WHEN excess > 0 THEN 'missed_upside' ELSE 'avoided_loss' END END"
    change = "CASE WHEN wc = 0 THEN 'added' WHEN wt = 0 THEN 'removed' WHEN signum(wt) <> signum(wc) THEN 'flipped' ELSE 'resized' END"
    return d.selectExpr(*cell, "arm", "delta * excess AS contribution", f"{effect} AS effect", f"{change} AS change")


def anchoring(weights: DataFrame, meta: DataFrame, cell: Sequence[str] = CELL) -> DataFrame:
    """How often held signs agree with the stated verdict and with the evidence, per book.

    Held names are joined to the panel; the panel's own totals per date close the
    denominators, so names a book does not hold need no rows of their own.
    """
    totals = meta.groupBy("y").agg(F.expr("count_if(verdict <> 0) AS stated"), F.expr("count_if(evidence <> 0) AS leaning"))
    d = weights.join(meta, ["y", "brand"]).withColumn("s", F.signum("w"))
    g = d.groupBy(*cell, "arm").agg(
        F.expr("count_if(verdict <> 0 AND s = verdict) AS agree_verdict"), F.expr("count_if(evidence <> 0 AND s = evidence) AS agree_evidence"),
        F.expr("sum(CASE WHEN verdict = 0 AND evidence <> 0 THEN abs(w) ELSE 0D END) AS silent_exposure"), F.expr("count_if(verdict = 0 AND evidence <> 0) AS silent_held"))
    return g.join(totals, "y").selectExpr(*cell, "arm", "agree_verdict / nullif(stated, 0) AS with_verdict", "agree_evidence / nullif(leaning, 0) AS with_evidence", "silent_exposure", "silent_held")


def amplification(pairs: DataFrame, metric: str) -> DataFrame:
    """Slope and correlation of treatment on control, arms with at least four pairs."""
    x, y = f"control_{metric}", metric
    return pairs.groupBy("arm").agg(F.count(F.lit(1)).alias("n"), F.expr(f"{stats.slope(x, y)} AS slope"), F.expr(f"{stats.pearson(x, y)} AS corr")).filter("n >= 4")


def arm_report(pairs: DataFrame, metrics: Sequence[str], flips: int = 0) -> DataFrame:
    """Contrast of each arm and metric with its control: mean, t, p, BH inside the metric; with `flips` also the sign-flip p."""
    entries = ", ".join(f"struct('{m}' AS metric, {m} - control_{m} AS delta)" for m in metrics)
    long = pairs.selectExpr("cust", "y", "arm", f"inline(array({entries}))").filter("delta IS NOT NULL")
    # what two equal books differ by in the last bits of their sums is no gain
    g = long.groupBy("metric", "arm").agg(F.count(F.lit(1)).alias("n"), F.avg("delta").alias("estimate"), F.expr(f"{stats.t_of_mean('delta', 2)} AS t"), F.expr("count_if(delta > 1e-12) AS positive"))
    g = g.withColumn("p", F.expr(stats.student_p("t", "n - 1")))
    out = stats.benjamini_hochberg(g, ["metric"], "p", "arm", "p_bh")
    if not flips:
        return out
    rows = long.select("metric", "arm", F.concat_ws(":", "cust", "y").alias("pair"), "delta")
    return out.join(stats.sign_flip(rows, ["metric", "arm"], "pair", "delta", flips).select("metric", "arm", F.col("p").alias("p_flip")), ["metric", "arm"])


def normalise_decisions(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Drop unusable rows, sign by direction, and scale a book above full size down to it."""
    from pyspark.sql import Window
    ok = rows.filter("action IN ('buy', 'short') AND weight > 0").withColumn("w", F.expr("CASE WHEN action = 'buy' THEN weight ELSE -weight END"))
    gross = F.sum(F.abs("w")).over(Window.partitionBy(*key))
    return ok.withColumn("w", F.col("w") / F.greatest(F.lit(1.0), gross)).drop("weight", "action")


def parse_decisions(texts: DataFrame, key: Sequence[str], text: str) -> DataFrame:
    """Positions out of a JSON object buried in free text; what cannot be read yields no rows."""
    schema = "positions array<struct<ticker: string, action: string, weight: double>>"
    body = f"from_json(regexp_extract({text}, '(?s)\\\\{{.*\\\\}}', 0), '{schema}')"
    return texts.selectExpr(*key, f"inline({body}.positions)")


def lookahead_audit(sources: dict[str, tuple[DataFrame, str]], as_of: str) -> DataFrame:
    """Newest date each source contributed, and whether it stays at or before the decision date."""
    parts = [df.agg(F.max(col).alias("newest")).select(F.lit(kind).alias("kind"), "newest") for kind, (df, col) in sources.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("passes", F.col("newest") <= F.lit(as_of).cast("date"))


def validate_books(weights: DataFrame, universe: DataFrame, cell: Sequence[str]) -> DataFrame:
    """Per book: names outside the universe, universe names missing, gross above full size."""
    size = universe.agg(F.count(F.lit(1)).alias("universe"))
    known = weights.join(universe.withColumn("known", F.lit(True)), "brand", "left")
    g = known.groupBy(*cell).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("brand").alias("names"), F.count("known").alias("inside"), F.sum(F.abs("w")).alias("gross"))
    return g.join(F.broadcast(size)).selectExpr(*cell, "rows - names AS duplicates", "rows - inside AS extra", "universe - inside AS missing", "gross > 1.001 AS oversized")
