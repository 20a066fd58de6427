"""Price operators over daily bars (brand, session_date, close, adjusted_close).

Bars are unique per (series, day), so a window over one series is bounded by the
trading calendar no matter how many trades stand behind the bars.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitlens.operators.pit import nearby, on_or_before

MAX_LOOKBACK_DAYS = 7
REACTION_SESSIONS = 10
VOLATILITY_LOOKBACK_DAYS = int(126 * 1.6)
REACTION_DAYS = int(REACTION_SESSIONS * 1.6) + 4
MIN_VOLATILITY_OBSERVATIONS = 30


def price_on_or_before(probes: DataFrame, bars: DataFrame, date_col: str, out: str, keys=("brand",)) -> DataFrame:
    """Last session that had closed by the date, null when the hole exceeds a week."""
    return on_or_before(probes, bars, list(keys), date_col, "session_date",
                        ["close", "adjusted_close"], MAX_LOOKBACK_DAYS, out)


def total_return(probes: DataFrame, bars: DataFrame, start: str, end: str, out: str, keys=("brand",)) -> DataFrame:
    """Adjusted return between two dates; null unless both sides resolve to different sessions."""
    d = price_on_or_before(price_on_or_before(probes, bars, start, "_a", keys), bars, end, "_b", keys)
    ok = (F.col("_a.adjusted_close") > 0) & (F.col("_a.at") < F.col("_b.at"))
    return d.withColumn(out, F.when(ok, F.col("_b.adjusted_close") / F.col("_a.adjusted_close") - 1)).drop("_a", "_b")


def market_return(probes: DataFrame, market: DataFrame, start: str, end: str, out: str) -> DataFrame:
    """`total_return` on the benchmark; measured once per distinct date pair."""
    pairs = probes.select(start, end).distinct().withColumn("_m", F.lit(1))
    series = market.withColumn("_m", F.lit(1))
    measured = total_return(pairs, series, start, end, out, keys=("_m",)).drop("_m")
    return probes.join(measured, [start, end], "left")


def session_returns(bars: DataFrame, keys=("brand",)) -> DataFrame:
    """Return of each stored session over the previous stored one."""
    w = Window.partitionBy(*keys).orderBy("session_date")
    d = bars.select(*keys, "session_date", "adjusted_close",
                    F.lag("session_date").over(w).alias("prev_date"),
                    F.lag("adjusted_close").over(w).alias("prev_close"))
    return d.filter(F.col("prev_close") > 0).select(
        *keys, "session_date", "prev_date", (F.col("adjusted_close") / F.col("prev_close") - 1).alias("ret"))


def market_sessions(market: DataFrame) -> DataFrame:
    """Benchmark returns; one row per session of the calendar, so one ordered pass suffices."""
    return session_returns(market.withColumn("_m", F.lit(1)), ("_m",)).select(
        "session_date", F.col("prev_date").alias("market_prev"), F.col("ret").alias("market_ret"))


def abnormal_daily(bars: DataFrame, market: DataFrame) -> DataFrame:
    """Own session return minus the benchmark's, on matching dates only."""
    return session_returns(bars).join(market_sessions(market), "session_date").select(
        "brand", "session_date", F.least("prev_date", "market_prev").alias("prev_date"),
        (F.col("ret") - F.col("market_ret")).alias("abnormal"))


def typical_move(probes: DataFrame, abnormal: DataFrame, date_col: str, out: str) -> DataFrame:
    """Normal ten-session move: population sd of abnormal returns strictly before the date."""
    back = VOLATILITY_LOOKBACK_DAYS
    got = nearby(probes, abnormal, ["brand"], date_col, "session_date", back, 0, ["prev_date", "abnormal"], "_near")
    inside = f"filter(_near, r -> r.at < {date_col} AND datediff({date_col}, r.prev_date) <= {back})"
    got = got.selectExpr("*", f"transform({inside}, r -> r.abnormal) AS _v")
    got = got.selectExpr("*", "aggregate(_v, 0D, (a, x) -> a + x) / size(_v) AS _mean")
    # two passes keep the variance free of cancellation
    sd = "sqrt(aggregate(_v, 0D, (a, x) -> a + (x - _mean) * (x - _mean)) / size(_v))"
    got = got.selectExpr("*", f"CASE WHEN size(_v) >= {MIN_VOLATILITY_OBSERVATIONS} THEN {sd} END AS _sd")
    return got.selectExpr(*[f"`{c}`" for c in probes.columns],
                          f"CASE WHEN _sd > 0 THEN _sd * sqrt({REACTION_SESSIONS}D) END AS {out}")


def move_after(probes: DataFrame, bars: DataFrame, market: DataFrame, date_col: str) -> DataFrame:
    """Fortnight move against the benchmark and its size in normal moves, per distinct (series, date)."""
    pairs = probes.select("brand", F.col(date_col).alias("at_date")).distinct().withColumn(
        "until", F.date_add("at_date", REACTION_DAYS))
    d = total_return(pairs, bars, "at_date", "until", "own")
    d = market_return(d.filter(F.col("own").isNotNull()), market, "at_date", "until", "market")
    d = typical_move(d, abnormal_daily(bars, market), "at_date", "typical")
    gap = F.col("own") - F.coalesce("market", F.lit(0.0))
    sigma = F.round(gap / F.col("typical"), 2)
    return d.select("brand", "at_date", "own", "market", gap.alias("abnormal"),
                    F.round(gap * 100, 2).alias("abnormal_percent"), sigma.alias("sigma"),
                    F.coalesce(F.abs(sigma) >= 1.5, F.lit(False)).alias("is_material"),
                    F.coalesce(F.abs(sigma) >= 3.0, F.lit(False)).alias("is_striking"))


def session_days(bars: DataFrame, value: str = "adjusted_close") -> DataFrame:
    """For every calendar day the first session strictly after it, by series.

    One row per (series, day) lets an event find its entry by equi-join; days
    before the first session are reached through `first_day` clamping.
    """
    w = Window.partitionBy("brand").orderBy("session_date")
    d = bars.select("brand", "session_date", F.col(value).alias("price"),
                    (F.row_number().over(w) - 1).alias("idx"), F.lag("session_date").over(w).alias("prev"))
    first = F.coalesce("prev", F.date_sub("session_date", 1))
    return d.select("brand", F.explode(F.sequence(first, F.date_sub("session_date", 1))).alias("day"),
                    "session_date", "price", "idx")


def forward_return(events: DataFrame, bars: DataFrame, date_col: str, sessions: int, out: str) -> DataFrame:
    """Percent change from the first session after the event to `sessions` later; null past the data."""
    w = Window.partitionBy("brand").orderBy("session_date")
    exits = bars.select("brand", (F.row_number().over(w) - 1 - sessions).alias("idx"),
                        F.col("adjusted_close").alias("exit_price"))
    entries = session_days(bars).join(exits, ["brand", "idx"]).select(
        "brand", "day", F.col("session_date").alias("entry_date"),
        F.round((F.col("exit_price") / F.when(F.col("price") != 0, F.col("price")) - 1) * 100, 4).alias(out))
    firsts = bars.groupBy("brand").agg(F.date_sub(F.min("session_date"), 1).alias("_first"))
    probes = events.join(firsts, "brand", "left").withColumn("day", F.greatest(F.col(date_col), F.col("_first")))
    return probes.join(entries, ["brand", "day"], "left").drop("day", "_first")


def forward_returns(events: DataFrame, bars: DataFrame, date_col: str, horizons: Sequence[int], out: str) -> DataFrame:
    """forward_return at every horizon, a row each: the columns of `events`, horizon and `out`.

    One pass over a series looks all its sessions ahead, and one join finds an event's entry, however many horizons are asked.
    """
    w = Window.partitionBy("brand").orderBy("session_date")
    ahead = [F.struct(F.lit(h).alias("horizon"), F.lead("adjusted_close", h).over(w).alias("exit")) for h in horizons]
    exits = bars.select("brand", (F.row_number().over(w) - 1).alias("idx"), F.array(*ahead).alias("exits"))
    entries = session_days(bars).join(exits, ["brand", "idx"]).select("brand", "day", F.transform("exits", lambda e: F.struct(
        e["horizon"].alias("horizon"), F.round((e["exit"] / F.when(F.col("price") != 0, F.col("price")) - 1) * 100, 4).alias(out))).alias("_outcomes"))
    none = F.array(*[F.struct(F.lit(h).alias("horizon"), F.lit(None).cast("double").alias(out)) for h in horizons])
    firsts = bars.groupBy("brand").agg(F.date_sub(F.min("session_date"), 1).alias("_first"))
    probes = events.join(firsts, "brand", "left").withColumn("day", F.greatest(F.col(date_col), F.col("_first")))
    return probes.join(entries, ["brand", "day"], "left").drop("day", "_first").withColumn("_o", F.explode(F.coalesce("_outcomes", none))).select(
        *events.columns, "_o.horizon", f"_o.{out}")
