"""Folding an entity's findings into a stance, its drivers and its case."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitlens.functions.findings import MAGNITUDE_WEIGHT, is_stale, lookup
from pitlens.functions.text import jaccard, tokens

STRONG, LEAN = 0.55, 0.15
STALE_DISCOUNT, RESTATED_DISCOUNT, FLOOR = 0.4, 0.25, 0.10
DUPLICATE_OVERLAP, MAX_DRIVERS, MAX_POINTS = 0.4, 3, 12


def reading_window(findings: DataFrame, now: str, window_days: int, fallback_days: int) -> DataFrame:
    """Live findings of the window; an entity with none there is read over the fallback window."""
    live = findings.filter("NOT dismissed").withColumn("age", F.datediff(F.lit(now).cast("date"), "day")).filter(F.col("age") <= fallback_days)
    near = live.groupBy("entity_id").agg(F.min("age").alias("nearest"))
    d = live.join(near, "entity_id")
    return d.filter(f"age <= CASE WHEN nearest <= {window_days} THEN {window_days} ELSE {fallback_days} END").withColumn(
        "fell_back", F.col("nearest") > window_days).drop("nearest")


def fold(read: DataFrame, residual: DataFrame) -> DataFrame:
    """Stance and confidence per entity from weighted, norm-adjusted findings.

    `read` carries sign, excess, parity, is_restated, priority and source; `residual`
    is the entity's incidence residual over the same findings.
    """
    discount = f"CASE WHEN is_restated THEN {RESTATED_DISCOUNT} ELSE 1D END"
    stale = f"CASE WHEN {is_stale('occurred_at', 'quote')} THEN {STALE_DISCOUNT} ELSE 1D END"
    weight = f"{lookup('magnitude', MAGNITUDE_WEIGHT, '1D')} * greatest(priority, 0.05D) * parity * {discount} * {stale}"
    counted = f"sign IS NOT NULL AND sign <> 0 AND abs(excess) >= {FLOOR}"
    d = read.withColumn("w", F.expr(f"CASE WHEN {counted} THEN {weight} ELSE 0D END")).withColumn(
        "effective", F.expr(f"CASE WHEN {counted} THEN parity * {discount} ELSE 0D END"))
    g = d.groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("findings"), F.expr("count_if(sign > 0) AS positive"), F.expr("count_if(sign < 0) AS negative"),
        F.count("sign").alias("informative_n"), F.expr("count_if(finding_type <> 'notable_quote') AS capable"), F.countDistinct("source").alias("sources"),
        F.expr("sum(w * coalesce(excess, 0D)) / nullif(sum(w), 0D) AS weighted"), F.sum("effective").alias("informative"),
        F.avg("confidence").alias("mean_confidence"), F.first("fell_back").alias("fell_back"))
    g = g.join(residual, "entity_id", "left").withColumn("mean", F.coalesce("residual", "weighted", F.lit(0.0)))
    thin = "informative < 3 OR sources < 2"
    raw = (f"CASE WHEN mean <= -{STRONG} THEN CASE WHEN {thin} THEN 'negative' ELSE 'strong_negative' END WHEN mean <= -{LEAN} THEN 'negative'"
           f" WHEN mean >= {STRONG} THEN CASE WHEN {thin} THEN 'positive' ELSE 'strong_positive' END WHEN mean >= {LEAN} THEN 'positive' ELSE 'mixed' END")
    g = g.withColumn("stance", F.expr(
        "CASE WHEN coalesce((positive + negative) / nullif(capable, 0), 0) < 0.4 THEN 'insufficient' WHEN (positive + negative) / findings < 0.25 THEN 'quiet'"
        f" WHEN informative_n < 2 THEN 'insufficient' ELSE {raw} END"))
    agree = "coalesce(greatest(positive, negative) / nullif(positive + negative, 0), 0D)"
    score = f"0.4D * least(sources / 3, 1D) + 0.25D * {agree} + 0.15D * least(informative / 3, 1D) + 0.2D * mean_confidence"
    return g.withColumn("confidence", F.expr(f"CASE WHEN stance = 'insufficient' THEN 0D ELSE least(1D, greatest(0D, {score})) END"))


def pick_distinct(read: DataFrame, rounds: int = MAX_DRIVERS) -> DataFrame:
    """Best findings per entity that do not repeat each other, taken greedily.

    Each round is an argmax with a map-side partial step over the findings that do not
    overlap what was already chosen, so no entity is collected.
    """
    rank = F.struct(
        F.expr(f"coalesce(abs(excess) >= {FLOOR}, true)").alias("informative"), F.col("unusual"), F.coalesce(F.abs("excess"), F.lit(0.0)).alias("gap"),
        F.col("priority"), (-F.col("finding_id")).alias("tie"), F.col("finding_id").alias("id"))
    d = read.select("entity_id", "finding_id", F.expr(tokens("summary")).alias("toks"), rank.alias("rank"))
    left, chosen = d, None
    for i in range(rounds):
        best = left.groupBy("entity_id").agg(F.max(F.struct("rank", "toks")).alias("b")).select(
            "entity_id", F.col("b.rank.id").alias("finding_id"), F.col("b.toks").alias("best_toks"), F.lit(i + 1).alias("place"))
        row = best.select("entity_id", "finding_id", "place")
        chosen = row if chosen is None else chosen.unionByName(row)
        if i + 1 < rounds:
            left = left.join(best.select("entity_id", "best_toks"), "entity_id").filter(
                F.expr(f"{jaccard('toks', 'best_toks')} < {DUPLICATE_OVERLAP}")).drop("best_toks")
    return chosen


def driver_support(drivers: DataFrame, read: DataFrame) -> DataFrame:
    """Other findings of the entity overlapping a driver; at most three drivers meet each finding."""
    toks = read.select("entity_id", F.col("finding_id").alias("other"), "source", F.expr(tokens("summary")).alias("b"))
    own = toks.selectExpr("other AS finding_id", "source AS own_source", "b AS a")
    d = drivers.join(own, "finding_id").join(toks, "entity_id").filter(F.expr(f"other = finding_id OR {jaccard('a', 'b')} >= {DUPLICATE_OVERLAP}"))
    return d.groupBy("entity_id", "finding_id", "place").agg((F.count(F.lit(1)) - 1).alias("supporting"), F.array_sort(F.collect_set("source")).alias("sources"))


def counterpoint(read: DataFrame, stances: DataFrame) -> DataFrame:
    """Strongest finding against a directional stance."""
    d = read.join(stances, "entity_id").filter("(stance LIKE '%positive' AND sign < 0) OR (stance LIKE '%negative' AND sign > 0)")
    key = F.struct(F.coalesce(F.abs("excess"), F.lit(0.0)), F.col("priority"), -F.col("finding_id"))
    return d.groupBy("entity_id").agg(F.max_by("finding_id", key).alias("finding_id"))


def side_ages(read: DataFrame, age: str) -> DataFrame:
    """Median effective age of each side (two findings or more) and whether they differ by half a year.

    Ages are whole days, so a median is over a bounded set of distinct values.
    """
    d = read.selectExpr("entity_id", "direction", f"int({age}) AS age").filter("direction IS NOT NULL")
    side = lambda s: F.expr(f"CASE WHEN count_if(direction = '{s}') >= 2 THEN int(percentile(CASE WHEN direction = '{s}' THEN age END, 0.5)) END AS {s}_days")
    g = d.groupBy("entity_id").agg(side("positive"), side("negative"))
    return g.withColumn("gap_days", F.abs(F.col("positive_days") - F.col("negative_days"))).withColumn("is_imbalanced", F.expr("coalesce(gap_days >= 180, false)"))


def case_points(points: DataFrame, limit: int = MAX_POINTS) -> DataFrame:
    """Weight first, directional before unclear; one point per headline; the overflow stays, marked withheld."""
    from pyspark.sql import Window
    directional = "side <> 'unclear'"
    once = points.withColumn("_h", F.lower(F.trim("headline"))).groupBy("entity_id", "_h").agg(
        F.max(F.struct("weight", F.expr(directional).alias("d"), F.col("key").alias("k"), F.col("side").alias("s"))).alias("p"))
    d = once.selectExpr("entity_id", "_h AS headline", "p.weight AS weight", "p.s AS side", "p.k AS key")
    w = Window.partitionBy("entity_id").orderBy(F.col("weight").desc(), F.expr(directional).desc(), F.col("key"))
    return d.withColumn("place", F.row_number().over(w)).withColumn("withheld", F.col("place") > limit)


def strongest_against(points: DataFrame, stances: DataFrame) -> DataFrame:
    d = points.join(stances, "entity_id").filter("(stance LIKE '%positive' AND side = 'against') OR (stance LIKE '%negative' AND side = 'for')")
    return d.groupBy("entity_id").agg(F.max_by("key", F.struct("weight", "key")).alias("key"), F.max("weight").alias("weight"))
