"""Rules over structured facts and cross-source contradictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_INSIDERS, MIN_TRADE_USD = 3, 50_000
SPIKE_RATIO = 1.2
STRONG_TONE, WEAK, STRONG = 0.3, 0.2, 0.8


def insider_cluster(trades: DataFrame, selling: bool, window_days: int) -> DataFrame:
    """Newest day closing a window with at least three distinct open-market traders.

    Trades fold to one row per entity and day first; a day then visits the anchors
    it can fall under, so no entity's trades are ordered in one place.
    """
    side = trades.filter(F.col("open_market") & (F.col("disposed") == selling) & (F.col("usd") >= MIN_TRADE_USD))
    daily = side.groupBy("entity_id", "day").agg(F.collect_set("owner").alias("owners"), F.count(F.lit(1)).alias("n"),
                                                 F.sum("usd").alias("usd"), F.sum("shares").alias("shares"))
    anchors = daily.select("entity_id", F.col("day").alias("anchor"))
    spread = daily.withColumn("anchor", F.explode(F.sequence("day", F.date_add("day", window_days))))
    g = spread.join(anchors, ["entity_id", "anchor"], "left_semi").groupBy("entity_id", "anchor").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("owners")))).alias("insiders"), F.sum("n").alias("transactions"),
        F.sum("usd").alias("total_usd"), F.sum("shares").alias("total_shares")).filter(F.col("insiders") >= MIN_INSIDERS)
    last = g.groupBy("entity_id").agg(*[F.max_by(c, "anchor").alias(c) for c in ("insiders", "transactions", "total_usd", "total_shares")],
                                      F.max("anchor").alias("occurred_on"))
    return last.withColumn("rule", F.lit("insider_sell_cluster" if selling else "insider_buy_cluster")).withColumn(
        "magnitude", F.when(F.col("insiders") > MIN_INSIDERS, "moderate").otherwise("minor")).withColumn(
        "direction", F.lit("negative" if selling else "positive"))


def short_interest_spike(readings: DataFrame, key: str) -> DataFrame:
    """Latest reading at least a fifth above the one before."""
    from pitlens.operators.feeds import newest_per_key
    two = newest_per_key(readings.filter("value IS NOT NULL"), [key], [F.col("at").desc()], 2)
    g = two.groupBy(key).agg(F.max_by("value", "at").alias("latest"), F.min_by("value", "at").alias("previous"), F.max("at").alias("occurred_on"), F.count(F.lit(1)).alias("n"))
    g = g.filter(f"n = 2 AND previous > 0 AND latest >= previous * {SPIKE_RATIO}")
    pct = (F.col("latest") / F.col("previous") - 1) * 100
    return g.select(key, "occurred_on", "previous", "latest", F.round(pct, 1).alias("increase_percent"), F.when(pct >= 50, "moderate").otherwise("minor").alias("magnitude"))


def evaluate_rules(rules, *tables: DataFrame, failed: list | None = None) -> list[DataFrame]:
    """Every rule is a DataFrame function of the same inputs; adding one is adding to the list.

    With `failed`, a rule that cannot be planned is put there with its error and the others go on.
    """
    found = []
    for rule in rules:
        try:
            found.append(rule(*tables))
        except Exception as error:
            if failed is None:
                raise
            failed.append((rule, error))
    return found


def build_cluster(findings: DataFrame, window_days: int, baseline_days: int) -> DataFrame:
    """Findings bunched before an entity's newest one, with the triggers that make them a pattern."""
    # Finding types that can form a pattern.
    kinds = ("new_risk_factor", "notable_quote", "guidance_change", "qoq_anomaly", "sentiment_shift")
    d = findings.filter(F.col("finding_type").isin(*kinds))
    anchor = d.groupBy("entity_id").agg(F.max("occurred_at").alias("anchor"))
    age = "unix_micros(anchor) - unix_micros(occurred_at)"
    day = 86_400_000_000
    d = d.join(anchor, "entity_id").withColumn("inside", F.expr(f"{age} <= {window_days * day}")).withColumn(
        "before", F.expr(f"{age} > {window_days * day} AND {age} <= {(window_days + baseline_days) * day}"))
    g = d.groupBy("entity_id", "anchor").agg(
        F.count_if("inside").alias("findings"), F.expr("count(DISTINCT CASE WHEN inside THEN document_id END) AS documents"),
        F.expr("count_if(inside AND direction = 'positive') AS positive"), F.expr("count_if(inside AND direction = 'negative') AS negative"),
        F.expr("count_if(inside AND magnitude = 'major') AS major"),
        F.expr("avg(CASE WHEN inside THEN sentiment END) - avg(CASE WHEN before THEN sentiment END) AS sentiment_delta"))
    g = g.withColumns({"drumbeat": F.expr("greatest(positive, negative) >= 3"), "corroborated": F.expr("major > 0 AND findings >= 2"),
                       "swing": F.expr("coalesce(abs(sentiment_delta) >= 0.5, false)")})
    return g.filter("documents >= 2 AND (drumbeat OR corroborated OR swing)").withColumn(
        "dominant", F.expr("CASE WHEN positive + negative = 0 THEN NULL WHEN positive >= negative THEN 'positive' ELSE 'negative' END"))


def contradictions(wide: DataFrame) -> DataFrame:
    """Seven places where an entity's own sources disagree; one row per contradiction found."""
    directional = "stance IN ('positive', 'strong_positive', 'negative', 'strong_negative')"
    reads_well = "stance LIKE '%positive'"
    cheap = " + ".join(f"int(coalesce({k} <= {WEAK}, false))" for k in ("earnings_yield", "sales_yield", "book_to_price"))
    tests = {
        "tone_vs_cash": f"tone >= {STRONG_TONE} AND accruals <= {WEAK}",
        "tone_vs_insiders": f"tone >= {STRONG_TONE} AND insider = 'negative'",
        "growth_vs_quality": f"revenue_growth >= {STRONG} AND accruals <= {WEAK}",
        "expansion_vs_returns": f"asset_growth <= {WEAK} AND return_on_assets >= {STRONG}",
        "price_vs_value": f"momentum >= {STRONG} AND ({cheap}) >= 2",
        "reading_vs_numbers": f"{directional} AND (({reads_well} AND composite <= {WEAK}) OR (NOT {reads_well} AND composite >= {STRONG}))",
        "reading_vs_tape": f"{directional} AND move_material AND ({reads_well}) <> (move_percent > 0)",
    }
    found = ", ".join(f"CASE WHEN {t} THEN '{k}' END" for k, t in tests.items())
    return wide.selectExpr("entity_id", f"explode(filter(array({found}), x -> x IS NOT NULL)) AS contradiction")


def earnings_outlook(events: DataFrame, today: str) -> DataFrame:
    """Next scheduled report and the record of past surprises, per entity."""
    at = f"date'{today}'"
    upcoming = f"NOT reported AND report_date >= {at}"
    surprise = "CASE WHEN reported THEN surprise END"
    g = events.groupBy("entity_id").agg(
        F.expr(f"min(CASE WHEN {upcoming} THEN report_date END) AS next_date"),
        *[F.expr(f"min_by({c}, CASE WHEN {upcoming} THEN report_date END) AS {c}") for c in ("hour_label", "eps_estimate")],
        F.expr(f"count({surprise}) AS reports_seen"), F.expr(f"count_if(({surprise}) > 0) AS beats"), F.expr(f"count_if(({surprise}) < 0) AS misses"),
        F.expr(f"round(avg({surprise}), 6) AS average_surprise"),
        F.expr(f"max_by(surprise, CASE WHEN reported AND surprise IS NOT NULL THEN report_date END) AS last_surprise"))
    return g.withColumn("days_until", F.expr(f"datediff(next_date, {at})")).withColumn("is_imminent", F.expr("coalesce(days_until <= 7, false)"))
