"""Back-tests and books; formation dates are a column, never a loop."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitlens.functions import stats
from pitlens.operators import aggregates, composites, factors, prices, ranks
from pitlens.session import cut_lineage

QUANTILES, MIN_LEG = 5, 5
FACTOR_KEYS = tuple(f.key for f in factors.factor_registry())
#: Steps of all paths up to which they go to every task.
SMALL_STEPS = 1_000_000


def rebalance_dates(start: str, end: str, step: int) -> list[str]:
    """Evenly spaced formation dates; the last one has no forward window and is dropped."""
    from datetime import date, timedelta
    d, stop, out = date.fromisoformat(start), date.fromisoformat(end), []
    while d <= stop:
        out.append(d.isoformat())
        d += timedelta(days=step)
    return out[:-1] if len(out) > 1 else []


def ranking_keys(scored: DataFrame, factor_keys: Sequence[str] = FACTOR_KEYS) -> DataFrame:
    """Every score back-tested as its own key: factors, both composites, each theme. One row a date and entity with a column a
    key, null where there is no score; what is joined to a name is joined before `each_key` deals the columns out."""
    d = scored.groupBy("as_of", "entity_id").agg(F.first("sector").alias("_sector"), *[F.max(F.when(F.col("key") == k, F.col("percentile"))).alias(k) for k in factor_keys])

    def total(cols):
        out = F.lit(0.0)
        for c in cols:
            out = out + F.coalesce(c, F.lit(0.0))
        return out

    held = lambda cols: total([F.when(c.isNotNull(), 1.0) for c in cols])
    mean = lambda cols: total(cols) / F.when(held(cols) > 0, held(cols))
    weight = {k: composites.relevance(F.lit(k), F.col("_sector")) for k in factor_keys}
    themes = {f"theme:{t}": [F.when(weight[k] > 0, 0.5 + (F.col(k) - 0.5) * weight[k]) for k in ks if k in weight] for t, ks in composites.THEMES.items()}
    themes = {t: cols for t, cols in themes.items() if cols}
    d = d.select("*", *[mean(cols).alias(t) for t, cols in themes.items()])
    flat, parts = [F.col(k) for k in factor_keys], [F.col(f"`{t}`") for t in themes]
    several = held(parts) >= composites.MIN_THEMES
    rounded = lambda c: F.round(c, composites.SCORE_DIGITS)
    return d.select(
        "as_of", "entity_id", *factor_keys, F.when(held(flat) >= composites.MIN_FACTORS, rounded(mean(flat))).alias("composite"),
        F.when(several, rounded(mean(parts))).alias("composite_conditional"), *[F.when(several, rounded(c)).alias(t) for t, c in zip(themes, parts)])


def each_key(wide: DataFrame, beside: Sequence[str]) -> DataFrame:
    """`ranking_keys` dealt out: a row for each key that has a score, beside the named columns."""
    keys = [c for c in wide.columns if c not in beside]
    rows = F.array(*[F.struct(F.lit(k).alias("key"), F.col(f"`{k}`").alias("score")) for k in keys])
    return wide.select(*beside, F.inline(rows)).filter("score IS NOT NULL")


def forward_returns(names: DataFrame, entities: DataFrame, bars: DataFrame, step: int) -> DataFrame:
    """Return of every name (as_of, entity_id; each once) over the step."""
    names = names.select("as_of", "entity_id").join(entities.select("entity_id", "brand"), "entity_id")
    pairs = names.select("brand", "as_of").distinct().withColumn("until", F.date_add("as_of", step))
    r = prices.total_return(pairs, bars, "as_of", "until", "forward").filter("forward IS NOT NULL")
    return names.join(r.select("brand", "as_of", "forward"), ["brand", "as_of"]).select("as_of", "entity_id", "forward")


def months(keys: DataFrame, forward: DataFrame, market: DataFrame, step: int) -> DataFrame:
    """One row per (date, key): leg returns, universe and benchmark, information coefficient; `keys` are wide (`ranking_keys`).

    A date needs 25 names with a forward return, and so does a key on that date.
    """
    floor, pool = QUANTILES * MIN_LEG, ["as_of", "key"]
    universe = cut_lineage(forward.groupBy("as_of").agg(F.avg("forward").alias("universe"), F.count(F.lit(1)).alias("names")).filter(f"names >= {floor}"))
    bench = universe.select("as_of").withColumn("until", F.date_add("as_of", step))
    bench = prices.market_return(bench, market, "as_of", "until", "benchmark").select("as_of", "benchmark")
    # no key has more names than its date; where one range is enough, places, ranks and legs share an exchange
    slices = ranks.slices_for(universe.agg(F.max("names")).first()[0] or 0)
    d = each_key(keys.join(forward, ["as_of", "entity_id"]).join(universe.select("as_of"), "as_of", "left_semi"), ["as_of", "entity_id", "forward"])
    d = ranks.position(d, pool, "score", ["entity_id"], "pos", "n", slices=slices)
    d = d.filter(f"n >= {floor}").withColumn("leg", F.expr(f"n DIV {QUANTILES}"))
    d = ranks.average_rank(ranks.average_rank(d, pool, "score", "_rx", None, slices), pool, "forward", "_ry", None, slices)
    legs = d.groupBy(*pool).agg(
        F.expr("avg(CASE WHEN pos <= leg THEN forward END) AS short_return"), F.expr("avg(CASE WHEN pos > n - leg THEN forward END) AS long_return"),
        F.max("n").alias("names"), F.max("leg").alias("leg"), F.expr(f"round({stats.pearson('_rx', '_ry')}, 4) AS ic"))
    return legs.join(universe.select("as_of", "universe"), "as_of").join(bench, "as_of", "left").withColumn(
        "spread", F.col("long_return") - F.col("short_return")).withColumn("long_excess", F.col("long_return") - F.col("benchmark"))


def factor_results(by_month: DataFrame) -> DataFrame:
    return by_month.groupBy("key").agg(
        F.count(F.lit(1)).alias("months"), F.avg("spread").alias("mean_spread"), F.expr(f"{stats.t_of_mean('spread', 8)} AS t"),
        F.expr("count_if(spread > 0) / count(1) AS hit_rate"), F.avg("ic").alias("mean_ic"), F.avg("long_excess").alias("mean_long_excess"))


# ---- session windows and books ------------------------------------------------
def calendar(market: DataFrame) -> DataFrame:
    """Benchmark sessions numbered in order; one row per session ever traded."""
    return market.select("session_date", F.col("adjusted_close").alias("market_price"),
                         (F.row_number().over(Window.orderBy("session_date")) - 1).alias("idx"))


def on_calendar(dates: DataFrame, cal: DataFrame, at: str, horizon: int) -> DataFrame:
    """Entry session (last one at or before the date) with the full window behind it in the data."""
    nxt = F.lead("session_date").over(Window.orderBy("session_date"))
    days = cal.withColumn("_next", F.coalesce(nxt, F.date_add("session_date", 1))).select(
        F.explode(F.sequence("session_date", F.date_sub("_next", 1))).alias(at), F.col("idx").alias("entry"), F.col("market_price").alias("_in"))
    out = cal.select((F.col("idx") - horizon).alias("entry"), F.col("market_price").alias("_out"))
    return dates.join(days, at).join(out, "entry").withColumn("bench", F.col("_out") / F.col("_in") - 1).drop("_in", "_out")


def indexed_returns(bars: DataFrame, cal: DataFrame) -> DataFrame:
    """Per (series, session index) the price and the return over the session just before it."""
    d = bars.join(cal.select("session_date", "idx"), "session_date").filter("adjusted_close > 0").select("brand", "idx", F.col("adjusted_close").alias("price"))
    w = Window.partitionBy("brand").orderBy("idx")
    return d.withColumn("ret", F.when(F.lag("idx").over(w) == F.col("idx") - 1, F.col("price") / F.lag("price").over(w) - 1))


def window_totals(pairs: DataFrame, indexed: DataFrame, horizon: int) -> DataFrame:
    """Total return of each (series, entry) when both end sessions exist."""
    a = indexed.select("brand", F.col("idx").alias("entry"), F.col("price").alias("_a"))
    b = indexed.select("brand", (F.col("idx") - horizon).alias("entry"), F.col("price").alias("_b"))
    return pairs.join(a, ["brand", "entry"]).join(b, ["brand", "entry"]).withColumn("total", F.col("_b") / F.col("_a") - 1).drop("_a", "_b")


def measure_books(weights: DataFrame, indexed: DataFrame, horizon: int, keys: Sequence[str], periods: int, entries: DataFrame | None = None) -> DataFrame:
    """Path statistics of every book over its window; a name needs every session of it.

    `weights` holds keys, brand, sector, w, entry, bench. A book's sessions are an array of sums, so its weights meet once
    and no session is a row. `entries` holds every entry of the weights; without it they are read off the weights, which
    works these out a second time.
    """
    keys = list(keys)
    entries = (weights if entries is None else entries).select("entry").distinct()
    steps = entries.selectExpr("entry", f"explode(sequence(entry + 1, entry + {horizon})) AS idx")
    path = steps.join(indexed.select("brand", "idx", "ret"), "idx").filter("ret IS NOT NULL").groupBy("brand", "entry").agg(
        F.sort_array(F.collect_list(F.struct("idx", "ret"))).alias("path")).filter(F.size("path") == horizon)
    # a path is a row a series and window, so few meet many weights; how many there are is counted, not guessed
    path = cut_lineage(path.selectExpr("brand", "entry", "transform(path, r -> r.ret) AS path", "aggregate(path, 1D, (a, r) -> a * (1 + r.ret)) - 1 AS total"))
    path = F.broadcast(path) if path.count() * horizon <= SMALL_STEPS else path
    held = "path IS NOT NULL"
    books = weights.join(path, ["brand", "entry"], "left").groupBy(*keys).agg(
        F.expr(f"array({', '.join(f'sum(w * get(path, {i}))' for i in range(horizon))}) AS r"), F.expr(f"max(CASE WHEN {held} THEN bench END) AS bench"),
        F.expr(f"count_if({held}) AS names"), F.expr(f"count_if({held} AND w > 0 AND total > bench) / nullif(count_if({held} AND w > 0), 0) AS hit_rate"),
        F.sum(F.abs("w")).alias("gross"), F.max(F.abs("w")).alias("max_weight"), F.sum(F.expr("w * w")).alias("q"))
    measured = books.filter("names > 0").selectExpr(*keys, "bench", "names", "hit_rate", "gross", "max_weight", "q", *aggregates.path_ratios("r", periods))
    return measured.selectExpr(
        *keys, "compound AS ret", "compound - bench AS excess", "annualised AS volatility", "downside", "sharpe", "sortino", "max_drawdown",
        "q / (gross * gross) AS hhi", "names", "gross", "max_weight", "1 - gross AS cash", "hit_rate")


def equal_weights(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.withColumn("w", 1.0 / F.count(F.lit(1)).over(Window.partitionBy(*keys)))


def quintile_arms(scores: DataFrame, keys: Sequence[str], quintile: float = 0.2) -> DataFrame:
    """Weights of four arms per key group: equal, top quintile, long-short, sized by tilt."""
    d = ranks.position(scores, keys, "score", ["entity_id"], "down", "n", descending=True)
    tilts = d.groupBy(*keys).agg(F.sum(F.abs(F.col("score") - 0.5)).alias("tilt"))
    d = d.join(tilts, list(keys)).withColumn("cut", F.expr(f"greatest(5, int(n * {quintile}))"))
    top, bottom = "down <= cut", "down > n - cut"
    arms = ("array(struct('control_equal' AS arm, 1D / n AS w), struct('long' AS arm, CASE WHEN " + top + " THEN 1D / cut ELSE 0D END AS w),"
            f" struct('long_short' AS arm, (CASE WHEN {top} THEN 0.5D / cut ELSE 0D END) - (CASE WHEN {bottom} THEN 0.5D / cut ELSE 0D END) AS w),"
            " struct('sized' AS arm, coalesce((score - 0.5) / nullif(tilt, 0), 0D) AS w))")
    return d.selectExpr(*keys, "entity_id", "score", f"inline({arms})").filter("w <> 0")


def alpha(books: DataFrame, control: DataFrame, lags: int, skip: int) -> DataFrame:
    """Beta-adjusted alpha per arm: residual over the control arm with OLS, NW and non-overlapping t."""
    d = books.join(control.select("as_of", F.col("ret").alias("x")), "as_of")
    beta = d.groupBy("arm").agg(F.expr(f"{stats.slope('x', 'ret')} AS beta"), F.count(F.lit(1)).alias("n"))
    d = d.join(beta, "arm").withColumn("adj", F.col("ret") - F.col("beta") * F.col("x"))
    pos = F.row_number().over(Window.partitionBy("arm").orderBy("as_of")) - 1
    d = d.withColumn("sub", F.when(pos % skip == 0, F.col("adj")))
    g = d.groupBy("arm", "beta").agg(F.count(F.lit(1)).alias("n"), F.avg("adj").alias("alpha"), F.expr(f"{stats.t_of_mean('adj', 2)} AS t_ols"),
                                     F.expr(f"{stats.t_of_mean('sub', 2)} AS t_sub"), F.count("sub").alias("n_sub"))
    nw = stats.newey_west(d, ["arm"], "as_of", "adj", lags).selectExpr("arm", "t AS t_nw", "p AS p_nw")
    g = g.join(nw, "arm").withColumn("family", F.lit(1))
    return stats.benjamini_hochberg(g, ["family"], "p_nw", "arm", "p_bh").drop("family")
