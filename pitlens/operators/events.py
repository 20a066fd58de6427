"""What followed an event, measured against the benchmark, and whether calls were right."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitlens.functions import stats
from pitlens.operators import prices
from pitlens.session import cut_lineage

MIN_SAMPLE_FOR_VERDICT = 30
POSITIVE, NEGATIVE = "direction = 'positive'", "direction = 'negative'"


def abnormal_outcomes(events: DataFrame, bars: DataFrame, market: DataFrame, date_col: str, sessions: int) -> DataFrame:
    """Forward percent change of the series and of the benchmark, entry strictly after the event.

    Measured once per distinct (series, day) and joined back.
    """
    days = events.select("brand", F.col(date_col).alias("_at")).distinct()
    own = prices.forward_return(days, bars, "_at", sessions, "own_pct").select("brand", "_at", "own_pct")
    bench = market.withColumn("brand", F.lit("benchmark"))
    at = days.select("_at").distinct().withColumn("brand", F.lit("benchmark"))
    ref = prices.forward_return(at, bench, "_at", sessions, "market_pct").select("_at", "market_pct")
    d = own.join(ref, "_at").withColumn("abnormal_pct", F.round(F.col("own_pct") - F.col("market_pct"), 4))
    return events.join(d.withColumnRenamed("_at", date_col), ["brand", date_col], "left")


def outcomes_by_horizon(events: DataFrame, bars: DataFrame, market: DataFrame, date_col: str, horizons: Sequence[int]) -> DataFrame:
    """abnormal_outcomes at every horizon: `events` with horizon and abnormal_pct, a row each; days are measured once for all horizons."""
    days = events.select("brand", F.col(date_col).alias("_at")).distinct()
    own = prices.forward_returns(days, bars, "_at", horizons, "own_pct")
    at = days.select("_at").distinct().withColumn("brand", F.lit("benchmark"))
    ref = prices.forward_returns(at, market.withColumn("brand", F.lit("benchmark")), "_at", horizons, "market_pct").drop("brand")
    d = own.join(ref, ["_at", "horizon"]).select("brand", F.col("_at").alias(date_col), "horizon", F.round(F.col("own_pct") - F.col("market_pct"), 4).alias("abnormal_pct"))
    return events.join(d, ["brand", date_col])


def agreement_with_prices(calls: DataFrame, keys: Sequence[str], score: str, at_least: int = 10) -> DataFrame:
    """Per subject and horizon: rank correlation of scores that lean with what followed, mean excess on either side, their spread."""
    d = calls.filter(f"abnormal_pct IS NOT NULL AND abs({score}) >= 1e-9").withColumn("v", F.col(score).cast("double"))
    side = lambda s: F.avg(F.when(F.signum("v") == s, F.col("abnormal_pct")))
    g = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), ((F.min("v") < F.max("v")) & (F.min("abnormal_pct") < F.max("abnormal_pct"))).alias("_varied"),
        F.round(side(1) + 1e-9, 4).alias("mean_excess_positive"), F.round(side(-1) + 1e-9, 4).alias("mean_excess_negative"), F.round(side(1) - side(-1) + 1e-9, 4).alias("spread"))
    g = g.filter(F.col("n") >= at_least)
    varied = d.join(g.filter("_varied").select(*keys), list(keys), "left_semi")
    rho = stats.spearman(varied, keys, "v", "abnormal_pct", "spearman", digits=6).drop("n")
    return g.drop("_varied").join(rho, list(keys), "left")


def agreement(calls: DataFrame, keys: Sequence[str], said: str, after: str) -> DataFrame:
    """Per subject: calls that lean, how many what came after agreed with in sign, and the exact two-sided p against a fair coin."""
    g = calls.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.signum(said) == F.signum(after)).alias("agree"))
    return g.withColumn("agreement", F.col("agree") / F.col("n")).withColumn("p_vs_coinflip", F.expr(stats.binomial_p("agree", "n")))


def cluster_by_event(outcomes: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """One call per entity and day: a strength-weighted vote with a floor under each weight."""
    w = "greatest(strength, 0.05D)"
    sign = "CASE direction WHEN 'positive' THEN 1 WHEN 'negative' THEN -1 ELSE 0 END"
    g = outcomes.groupBy(*extra, "entity_id", "day").agg(
        F.expr(f"sum({w} * ({sign})) AS vote"), F.expr(f"sum({w}) AS total"), F.max("abnormal_pct").alias("abnormal_pct"))
    return g.selectExpr(*extra, "entity_id", "day", "abnormal_pct", "round(abs(vote) / total, 4) AS strength",
                        "CASE WHEN vote > 1e-12 THEN 'positive' WHEN vote < -1e-12 THEN 'negative' ELSE 'neutral' END AS direction")


def summarise(outcomes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Hit rate against the dominant direction, spread, Welch t and rank IC per subject."""
    d = outcomes.filter("abnormal_pct IS NOT NULL").selectExpr(
        *keys, "abnormal_pct AS a", "direction",
        "CASE direction WHEN 'positive' THEN strength WHEN 'negative' THEN -strength ELSE 0D END AS signed")
    right = "(direction = 'positive' AND a > 0) OR (direction = 'negative' AND a < 0)"
    directional = "direction IN ('positive', 'negative')"
    down = "count_if(a < 0) / count(1)"
    mean = lambda x: f"avg(CASE WHEN direction = '{x}' THEN a END)"
    g = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("evaluated"), F.expr(f"count_if({directional}) AS directional"),
        F.expr(f"round(count_if({right}) / nullif(count_if({directional}), 0), 4) AS hit_rate"),
        F.expr(f"round(greatest({down}, 1 - {down}), 4) AS baseline"),
        # outcomes have four digits, so a mean can lie half-way between two; the last bit of a sum is not to decide it
        *[F.expr(f"round({mean(x)} + 1e-9, 4) AS mean_{x}") for x in ("positive", "negative", "neutral")],
        F.expr(f"round({stats.welch_t('a', POSITIVE, NEGATIVE)}, 3) AS t"))
    ic = stats.spearman(d, keys, "signed", "a", "ic", digits=4).drop("n")
    return g.join(ic, list(keys), "left").withColumn("spread", F.round(F.col("mean_positive") - F.col("mean_negative"), 4)).withColumn(
        "verdict", F.expr(f"CASE WHEN directional < {MIN_SAMPLE_FOR_VERDICT} THEN 'too few' WHEN spread IS NULL THEN 'no spread'"
                          " WHEN t IS NULL THEN 'one-sided' WHEN abs(t) < 2 THEN 'chance' WHEN spread > 0 THEN 'as predicted' ELSE 'opposite' END"))


def reliability(reports: DataFrame) -> DataFrame:
    from pitlens.functions.findings import reliability_multiplier
    return reports.withColumn("edge", F.round(F.col("hit_rate") - F.col("baseline"), 4)).withColumn(
        "multiplier", F.round(F.expr(reliability_multiplier("directional", "t", "edge")), 4))


def survives(reports: DataFrame, trials: int) -> DataFrame:
    return reports.filter(F.abs("t") >= stats.multiple_testing_threshold(trials))


def sector_move_after(probes: DataFrame, bars: DataFrame, market: DataFrame, members: DataFrame, date_col: str,
                      minimum_peers: int = 5) -> DataFrame:
    """Peers' mean move against the market, and the series' own move against its peers.

    Every member of a sector is measured once per date; a series' peers are the
    sector totals less itself, so no series-by-series pairs are formed.
    """
    days = probes.select("brand", F.col(date_col).alias("at_date")).distinct().join(members, "brand")
    grid = days.select("sector", "at_date").distinct().join(members, "sector").withColumn(
        "until", F.date_add("at_date", prices.REACTION_DAYS))
    r = prices.total_return(grid, bars, "at_date", "until", "own")
    tot = r.groupBy("sector", "at_date").agg(F.sum("own").alias("s"), F.count("own").alias("n"))
    mine = r.filter("own IS NOT NULL").join(days.select("brand", "at_date"), ["brand", "at_date"]).join(tot, ["sector", "at_date"])
    mine = prices.market_return(mine, market, "at_date", "until", "market").withColumn("peers", F.col("n") - 1)
    mine = mine.filter(f"market IS NOT NULL AND peers >= {minimum_peers}").withColumn("grp", (F.col("s") - F.col("own")) / F.col("peers"))
    return mine.selectExpr("brand", "at_date", "peers", "round((grp - market) * 100, 2) AS peers_percent",
                           "round((own - grp) * 100, 2) AS versus_peers_percent").withColumn(
        "moved_together", F.abs("peers_percent") >= F.abs("versus_peers_percent"))


def position_blocks(cells: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """What finds the value at a position of a record from its distinct values and counts (keys, move, c): the width of a record's
    blocks of positions, and its values by the blocks they reach into, with positions start <= pos < upto.

    A block is as wide as a value has rows on average, so values and blocks come to at most three rows a distinct value, whatever
    the counts.
    """
    width = cells.groupBy(*keys).agg(F.expr("sum(c) DIV count(1)").alias("width"))
    upto = F.sum("c").over(Window.partitionBy(*keys).orderBy("move"))
    placed = cells.withColumn("upto", upto).join(width, list(keys)).selectExpr(*keys, "move AS at_move", "width", "upto - c AS start", "upto")
    return width, placed.selectExpr(*keys, "at_move", "start", "upto", "explode(sequence(start DIV width, (upto - 1) DIV width)) AS block")


def precedent_lookup(cases: DataFrame, min_cases: int = 12, min_companies: int = 8, min_sector: int = 20) -> DataFrame:
    """For each (topic, entity) the record of everyone else: its sector's when large enough, else all.

    Counts, sums and shares leave an entity out by subtraction, and so do the order
    statistics: between two neighbours of an entity's own moves the number of own moves
    below is fixed, k, and there the value at position i without them is the value at
    i + k of the whole record. One of those places lies inside its own stretch. Moves
    carry two decimals, so a record is its distinct values with counts; a position finds
    its value through a block of positions, and no row stands for a position alone.
    """
    keys = ["topic", "scope"]
    scoped = cases.selectExpr("topic", "ticker", "move", "inline(array(struct(sector AS scope), struct('*' AS scope)))").filter("scope IS NOT NULL")
    held = cut_lineage(scoped.groupBy(*keys, "ticker", "move").agg(F.count(F.lit(1)).alias("c")))
    own = held.groupBy(*keys, "ticker").agg(F.sum("c").alias("n"), F.sum(F.col("move") * F.col("c")).alias("s"), F.sum(F.expr("move * move * c")).alias("q"),
                                            F.sum(F.expr("CASE WHEN move < 0 THEN c ELSE 0 END")).alias("neg"), F.min("move").alias("least"))
    total = own.groupBy(*keys).agg(*[F.sum(c).alias(f"t_{c}") for c in ("n", "s", "q", "neg")], F.count(F.lit(1)).alias("entities"))
    width, blocks = position_blocks(held.groupBy(*keys, "move").agg(F.sum("c").alias("c")), keys)
    left = own.join(total, keys).join(width, keys).selectExpr(
        *keys, "ticker", "least", "width", "t_n - n AS cases", "entities - 1 AS companies", "t_s - s AS s", "t_q - q AS q", "t_neg - neg AS neg")
    left = left.filter(f"cases >= {min_cases} AND companies >= {min_companies} AND (scope = '*' OR cases >= {min_sector})")
    mine = Window.partitionBy(*keys, "ticker").orderBy("move")
    stretches = held.select(*keys, "ticker", F.sum("c").over(mine).alias("k"), F.col("move").alias("low"), F.lead("move").over(mine).alias("below"))
    stretches = left.select(*keys, "ticker", "cases", "width").join(stretches, [*keys, "ticker"]).unionByName(
        left.select(*keys, "ticker", "cases", "width", F.lit(0).cast("long").alias("k"), F.lit(None).cast("double").alias("low"), F.col("least").alias("below")))
    probes = stretches.selectExpr(*keys, "ticker", "low", "below", "k", "width", "inline(array(struct('m1' AS what, (cases - 1) DIV 2 AS i), struct('m2' AS what, cases DIV 2 AS i),"
                                  " struct('low' AS what, bigint(floor(cases * 0.1)) AS i), struct('high' AS what, bigint(floor(cases * 0.9)) AS i)))")
    probes = probes.withColumn("pos", F.col("i") + F.col("k")).withColumn("block", F.expr("pos DIV width")).join(blocks, [*keys, "block"])
    hit = probes.filter("pos >= start AND pos < upto AND (low IS NULL OR at_move >= low) AND (below IS NULL OR at_move < below)").groupBy(*keys, "ticker").agg(
        *[F.min(F.expr(f"CASE WHEN what = '{w}' THEN at_move END")).alias(w) for w in ("m1", "m2", "low", "high")])
    g = left.join(hit, [*keys, "ticker"])
    sd = "sqrt(greatest(q / cases - power(s / cases, 2), 0D))"
    ok = g.selectExpr("topic", "ticker", "scope", "cases", "companies", "round((m1 + m2) / 2, 3) AS median_percent", "round(neg / cases, 3) AS share_negative",
                      "round(low, 1) AS low", "round(high, 1) AS high", f"round(CASE WHEN {sd} > 0 THEN (s / cases) / ({sd} / sqrt(cases)) END, 2) AS t")
    best = ok.withColumn("_r", F.row_number().over(Window.partitionBy("topic", "ticker").orderBy(F.col("scope") == "*")))
    one_sided = "greatest(share_negative, 1 - share_negative) >= 0.70"
    return best.filter("_r = 1").drop("_r").withColumn("is_directional", F.expr(
        f"{one_sided} AND CASE WHEN t IS NULL THEN abs(median_percent) >= 1.0 ELSE abs(t) >= 2.9 END"))
