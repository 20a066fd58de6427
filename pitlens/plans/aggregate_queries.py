"""Aggregations and statistics."""

from pyspark.sql import functions as F

from pitlens.functions import findings as fx
from pitlens.functions import stats
from pitlens.operators import aggregates as agg
from pitlens.plans.registry import query
from pitlens.plans.views import R, view

AS_OF = "2024-01-20"

view("monthly", """select * from (select brand, month, price, volume, price / lag(price) over (partition by brand order by month) - 1 ret from (
 select brand, date_trunc('month', session_date)::date as month, arg_max(adjusted_close, session_date) price, sum(volume) volume from bars group by 1,2)) where ret is not null""", "bars")
view("decisions", """select o_orderkey id, o_custkey entity_id, o_orderpriority cohort, o_orderkey % 2 = 0 used, case when o_orderstatus='F' then 'pass' else 'buy' end action,
 least(o_totalprice / 500000, 1.0) conviction, o_totalprice / 1000000 weight, case when o_orderstatus <> 'P' then ((o_orderkey * 37) % 200 - 100) / 10.0::double end abnormal, o_orderdate::date as day from orders""")


def decisions(t):
    return t.orders.selectExpr(
        "o_orderkey AS id", "o_custkey AS entity_id", "o_orderpriority AS cohort", "o_orderkey % 2 = 0 AS used",
        "CASE WHEN o_orderstatus = 'F' THEN 'pass' ELSE 'buy' END AS action", "least(o_totalprice / 500000, 1D) AS conviction",
        "o_totalprice / 1000000 AS weight", "CASE WHEN o_orderstatus <> 'P' THEN ((o_orderkey * 37) % 200 - 100) / 10D END AS abnormal",
        "to_date(o_orderdate) AS day")


@query("coverage_by_entity", "AGG-01", f"""select entity_id, count(*) findings, count(distinct document_id) documents, min(day)::varchar first_day, max(day)::varchar last_day,
 count(distinct case when genre in ('10-K','10-Q') then document_id end) periodic from findings where day <= date '{AS_OF}' group by 1""", "findings")
def _(t):
    return agg.coverage(t.findings, AS_OF)


@query("coverage_index", "AGG-02", f"select entity_id, count(*) findings, count(distinct document_id) documents from findings where day <= date '{AS_OF}' and not (k >= 92) group by 1 order by 2 desc, 1 limit 50", "findings")
def _(t):
    told = t.findings.filter(f"day <= date'{AS_OF}' AND NOT ({fx.DISMISSED})")
    return told.groupBy("entity_id").agg(F.count(F.lit(1)).alias("findings"), F.countDistinct("document_id").alias("documents")).orderBy(
        F.col("findings").desc(), "entity_id").limit(50)


@query("coverage_totals", "AGG-03", """select count(*) findings, count(distinct entity_id) entities, count(distinct document_id) documents,
 count(*) filter (direction is not null) directional, count(*) filter (magnitude='major') major, count(*) filter (sentiment is not null) toned,
 count(*) filter (confidence >= 0.5) confident, max(day)::varchar newest from findings""", "findings")
def _(t):
    return t.findings.agg(
        F.count(F.lit(1)).alias("findings"), F.countDistinct("entity_id").alias("entities"), F.countDistinct("document_id").alias("documents"),
        F.count("direction").alias("directional"), F.count_if(F.col("magnitude") == "major").alias("major"),
        F.count("sentiment").alias("toned"), F.count_if(F.col("confidence") >= 0.5).alias("confident"), F.max("day").alias("newest"))


@query("run_status", "AGG-04", f"""select count(*) runs, count(*) filter (o_orderstatus='F') failed, sum(n)::bigint calls, {R('sum(o_totalprice)', 2)} as cost
 from orders join (select l_orderkey, count(*) n from lineitem group by 1) on l_orderkey=o_orderkey""")
def _(t):
    calls = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    return t.orders.join(calls, "o_orderkey").agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(F.col("o_orderstatus") == "F").alias("failed"), F.sum("n").alias("calls"),
        F.round(F.sum("o_totalprice"), 2).alias("cost"))


@query("document_counts", "AGG-05", "select entity_id, count(distinct document_id) documents from findings where magnitude <> 'minor' group by 1", "findings")
def _(t):
    return t.findings.filter(F.col("magnitude") != "minor").groupBy("entity_id").agg(F.countDistinct("document_id").alias("documents"))


@query("label_counts", "AGG-06", """select kind, count(*) filter (v=1) accepted, count(*) filter (v=0) rejected from (
 select 'quality' kind, quality v from labels union all select 'toxic', toxic from labels) group by 1""")
def _(t):
    long = t.labels.selectExpr("stack(2, 'quality', quality, 'toxic', toxic) AS (kind, v)")
    return long.groupBy("kind").agg(F.count_if(F.col("v") == 1).alias("accepted"), F.count_if(F.col("v") == 0).alias("rejected"))


@query("document_directional_counts", "AGG-07", """select document_id, entity_id, genre, count(*) filter (direction='positive') positive,
 count(*) filter (direction='negative') negative from findings group by 1,2,3""", "findings")
def _(t):
    return agg.document_directional_counts(t.findings)


@query("shrunk_rates_and_means", "AGG-08 AGG-09 AGG-11", f"""select entity_id, event_type, {R('(hits + 10 * base) / (n + 10.0)', 8)} rate,
 {R('(total + 8 * mean_all) / (n + 8.0)', 8)} mean_value, {R('case when base > 0 then (hits + 10 * base) / (n + 10.0) / base end', 8)} lift
 from (select entity_id, event_type, count(*) n, count(*) filter (magnitude='major') hits, sum(value) total from findings group by 1,2)
 join (select event_type, count(*) filter (magnitude='major') / count(*)::double base, avg(value) mean_all from findings group by 1) using (event_type)""", "findings")
def _(t):
    own = t.findings.groupBy("entity_id", "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("magnitude") == "major").alias("hits"), F.sum("value").alias("total"))
    base = own.groupBy("event_type").agg((F.sum("hits") / F.sum("n")).alias("base"), (F.sum("total") / F.sum("n")).alias("mean_all"))
    rate = stats.shrunk_rate("hits", "n", "base", 10)
    return own.join(base, "event_type").selectExpr(
        "entity_id", "event_type", f"round({rate}, 8) AS rate", f"round({stats.shrunk_mean('total', 'n', 'mean_all', 8)}, 8) AS mean_value",
        f"round(CASE WHEN base > 0 THEN {rate} / base END, 8) AS lift")


@query("entity_z_scores", "AGG-10", f"""select entity_id, {R('m', 8)} mean_value, {R('v', 8)} variance, {R('(m - avg(m) over ()) / nullif(stddev_pop(m) over (), 0)', 6)} z
 from (select entity_id, avg(value) m, var_pop(value) v from findings group by 1)""", "findings")
def _(t):
    g = t.findings.groupBy("entity_id").agg(F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    overall = g.agg(F.avg("m").alias("mu"), F.stddev_pop("m").alias("sd"))
    return g.join(F.broadcast(overall)).selectExpr("entity_id", "round(m, 8) AS mean_value", "round(v, 8) AS variance",
                                                   f"round({stats.z_score('m', 'mu', 'sd')}, 6) AS z")


@query("population_rates", "AGG-12", f"""select event_type, magnitude, {R('n / sum(n) over (partition by event_type)', 8)} share from (
 select event_type, magnitude, count(*) n from findings where occurred_at >= timestamp '2024-01-15' - interval 10 day and occurred_at < timestamp '2024-01-15' group by 1,2)""", "findings")
def _(t):
    seen = t.findings.filter("occurred_at >= timestamp'2024-01-15' - interval 10 days AND occurred_at < timestamp'2024-01-15'")
    labels = ("minor", "moderate", "major")
    wide = seen.groupBy("event_type").agg(*[F.count_if(F.col("magnitude") == m).alias(m) for m in labels])
    long = wide.selectExpr("event_type", "minor + moderate + major AS total", "stack(3, 'minor', minor, 'moderate', moderate, 'major', major) AS (magnitude, n)")
    return long.filter("n > 0").selectExpr("event_type", "magnitude", "round(CASE WHEN total = 0 THEN 1 / 3D ELSE n / total END, 8) AS share")


view("monthly_ranked", """select *, rank() over (partition by brand order by volume) + (count(*) over (partition by brand, volume) - 1) / 2.0 rv,
 rank() over (partition by brand order by ret) + (count(*) over (partition by brand, ret) - 1) / 2.0 rr from monthly""", "monthly")


@query("rank_correlation", "AGG-13 AGG-14", f"""select brand, count(*) n, {R('corr(rv, rr)', 4)} spearman, {R('corr(volume, ret)', 6)} pearson from monthly_ranked group by 1 having count(*) >= 3""", "monthly_ranked")
def _(t):
    m = agg.monthly_returns(t.bars)
    rho = stats.spearman(m, ["brand"], "volume", "ret", "spearman", digits=4)
    return rho.join(m.groupBy("brand").agg(F.expr(f"round({stats.pearson('volume', 'ret')}, 6) AS pearson")), "brand")


@query("welch_by_direction", "AGG-15", f"""select event_type, {R('(avg(value) filter (a) - avg(value) filter (b)) / sqrt(var_samp(value) filter (a) / count(*) filter (a) + var_samp(value) filter (b) / count(*) filter (b))', 3)} t
 from (select *, k % 2 = 0 a, k % 2 = 1 b from findings) group by 1""", "findings")
def _(t):
    return t.findings.groupBy("event_type").agg(F.expr(f"round({stats.welch_t('value', 'k % 2 = 0', 'k % 2 = 1')}, 3) AS t"))


_THETA = "atan(abs(t) / sqrt(d))"
P_SQL = f"""case when d % 2 = 0 then 1 - sin({_THETA}) * list_sum(list_transform(range(0, d // 2), lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1.0)) / sqrt(pi()) * pow(cos({_THETA}), 2 * k)))
 else 1 - 2 / pi() * ({_THETA} + sin({_THETA}) * coalesce(list_sum(list_transform(range(0, (d - 1) // 2), lambda k: sqrt(pi()) / 2 * exp(lgamma(k + 1.0) - lgamma(k + 1.5)) * pow(cos({_THETA}), 2 * k + 1))), 0)) end"""


@query("mean_t_tests", "AGG-16 AGG-17 FN-23", f"""select brand, n, {R('t', 6)} t, {R(P_SQL, 8)} p from (select brand, count(*) n, avg(ret) / (stddev_samp(ret) / sqrt(count(*))) t, count(*) - 1 d from monthly group by 1)""", "monthly")
def _(t):
    g = agg.monthly_returns(t.bars).groupBy("brand").agg(F.count("ret").alias("n"), F.expr(f"{stats.t_of_mean('ret', 2)} AS t"))
    return g.selectExpr("brand", "n", "round(t, 6) AS t", f"round({stats.student_p('t', 'n - 1')}, 8) AS p")


_NW = """select brand, count(*) n, avg(ret) mean, avg(e*e) + 2 * (0.75 * coalesce(sum(e*l1),0) + 0.5 * coalesce(sum(e*l2),0) + 0.25 * coalesce(sum(e*l3),0)) / count(*) v from (
 select *, lag(e,1) over w l1, lag(e,2) over w l2, lag(e,3) over w l3 from (select *, ret - avg(ret) over (partition by brand) e from monthly) window w as (partition by brand order by month)) group by 1"""
view("nw", f"select brand, n, mean, case when v > 0 then mean / sqrt(v / n) end t, n - 1 d from ({_NW})", "monthly")
view("nw_p", f"select brand, n, mean, t, {P_SQL} p from nw", "nw")


@query("newey_west_t", "AGG-18", f"select brand, n, {R('mean', 8)} mean, {R('t', 6)} t, {R('p', 8)} p from nw_p", "nw_p")
def _(t):
    d = stats.newey_west(agg.monthly_returns(t.bars), ["brand"], "month", "ret", 3)
    return d.select("brand", "n", *[F.round(c, k).alias(c) for c, k in (("mean", 8), ("t", 6), ("p", 8))])


@query("benjamini_hochberg", "AGG-21", f"""select brand, {R('least(1.0, min(s) over (order by p desc, brand desc rows unbounded preceding))', 8)} p_adjusted from (
 select brand, p, p * count(*) over () / row_number() over (order by p, brand) s from nw_p)""", "nw_p")
def _(t):
    d = stats.newey_west(agg.monthly_returns(t.bars), ["brand"], "month", "ret", 3).withColumn("family", F.lit("brands"))
    return stats.benjamini_hochberg(d, ["family"], "p", "brand").select("brand", F.round("p_adjusted", 8).alias("p_adjusted"))


@query("beta_to_market", "AGG-22", f"""select brand, {R('regr_slope(ret, market)', 6)} beta from monthly join (
 select date_trunc('month', session_date)::date as month, avg(market_ret) market from market_returns group by 1) using (month) group by 1""", "monthly market_returns")
def _(t):
    from pitlens.operators.prices import market_sessions
    m = market_sessions(t.benchmark_bars).groupBy(F.trunc("session_date", "month").alias("month")).agg(F.avg("market_ret").alias("market"))
    return agg.monthly_returns(t.bars).join(m, "month").groupBy("brand").agg(F.expr(f"round({stats.slope('market', 'ret')}, 6) AS beta"))


@query("concentration_hhi", "AGG-23", f"""select user_id, {R('hhi', 8)} hhi, {R('sector_hhi', 8)} sector_hhi from (select user_id, sum(pow(w,2)) / pow(sum(w),2) hhi from (
 select user_id, brand, shares * cost_basis w from positions) group by 1) join (select user_id, sum(pow(w,2)) / pow(sum(w),2) sector_hhi from (
 select user_id, cast(replace(brand,'Brand#','') as int) % 5 sector, sum(shares * cost_basis) w from positions group by 1,2) group by 1) using (user_id)""", "positions")
def _(t):
    p = t.positions.selectExpr("user_id", "int(replace(brand, 'Brand#', '')) % 5 AS sector", "shares * cost_basis AS w")
    by_sector = p.groupBy("user_id", "sector").agg(F.sum(F.abs("w")).alias("s"), F.sum(F.expr("w * w")).alias("q"), F.sum(F.abs("w")).alias("a"))
    return by_sector.groupBy("user_id").agg(F.expr("round(sum(q) / power(sum(a), 2), 8) AS hhi"), F.expr("round(sum(s * s) / power(sum(s), 2), 8) AS sector_hhi"))


_DOWN = "sqrt(sum(pow(least(0.0, ret), 2)) / (count(*) - 1))"


@query("risk_ratios", "AGG-24 AGG-25", f"""select brand, {R('stddev_samp(ret) * sqrt(12)')} annualised, {R(_DOWN)} downside, {R('avg(ret) / stddev_samp(ret) * sqrt(12)')} sharpe,
 {R(f'avg(ret) / {_DOWN} * sqrt(12)')} sortino, {R('product(1 + ret) - 1')} compound from monthly group by 1""", "monthly")
def _(t):
    d = agg.risk_ratios(agg.monthly_returns(t.bars), ["brand"], "ret", 12)
    return d.select("brand", *[F.round(c, 6).alias(c) for c in d.columns[1:]])


@query("max_drawdown", "WIN-15", f"""select brand, {R('least(0, min(level / greatest(1, peak) - 1))', 6)} max_drawdown from (select *, max(level) over (partition by brand order by month rows unbounded preceding) peak from (
 select brand, month, (product(1 + ret) over (partition by brand order by month rows unbounded preceding)) level from monthly)) group by 1""", "monthly")
def _(t):
    return agg.max_drawdown(agg.monthly_returns(t.bars), ["brand"], "month", "ret").withColumn("max_drawdown", F.round("max_drawdown", 6))


view("calls", "select cohort, conviction, case when abnormal > 0 then 1.0::double else 0.0 end won from decisions where abnormal is not null", "decisions")


@query("calibration", "AGG-26", f"""select cohort, sum(n)::bigint n, {R('sum(sq) / sum(n)', 6)} brier, {R('sum(n * abs(c - w)) / sum(n)', 6)} ece, {R('any_value(rho)', 6)} discrimination from (
 select cohort, least(4, floor(conviction * 5)::int) b, count(*) n, sum(pow(conviction - won, 2)) sq, avg(conviction) c, avg(won) w from calls group by 1,2)
 join (select cohort, corr(rc, rw) rho from (select cohort, rank() over (partition by cohort order by conviction) + (count(*) over (partition by cohort, conviction) - 1) / 2.0 rc,
  rank() over (partition by cohort order by won) + (count(*) over (partition by cohort, won) - 1) / 2.0 rw from calls) group by 1) using (cohort) group by 1 having sum(n) >= 10""", "calls")
def _(t):
    d = decisions(t).filter("abnormal IS NOT NULL").selectExpr("cohort", "conviction", "CASE WHEN abnormal > 0 THEN 1D ELSE 0D END AS won")
    return agg.calibration(d, ["cohort"], "conviction", "won").select("cohort", "n", *[F.round(c, 6).alias(c) for c in ("brier", "ece", "discrimination")])


@query("label_entropy", "AGG-27", f"""select entity_id, {R('-sum(p * log2(p))', 8)} bits from (select entity_id, n / sum(n) over (partition by entity_id) p from (
 select entity_id, event_type, count(*) n from findings group by 1,2)) group by 1""", "findings")
def _(t):
    return agg.entropy(t.findings, ["entity_id"], "event_type").withColumn("bits", F.round(F.col("bits") + 0.0, 8))


@query("binomial_two_sided", "AGG-28", f"""select entity_id, k, n, {R('case when 2 * m = n then 1.0::double else least(1.0, 2 * list_sum(list_transform(range(0, m + 1), lambda j: exp(lgamma(n + 1.0) - lgamma(j + 1.0) - lgamma(n - j + 1.0) - n * ln(2.0::double))))) end', 8)} p
 from (select entity_id, count(*) filter (direction='positive') k, count(*) n, least(count(*) filter (direction='positive'), count(*) filter (direction='negative')) m from findings where direction is not null group by 1)""", "findings")
def _(t):
    g = t.findings.filter("direction IS NOT NULL").groupBy("entity_id").agg(F.count_if(F.col("direction") == "positive").alias("k"), F.count(F.lit(1)).alias("n"))
    return g.selectExpr("entity_id", "k", "n", f"round({stats.binomial_p('k', 'n')}, 8) AS p")


@query("median_and_tails", "AGG-29", f"""select event_type, genre, n, {R('med', 6)} median_value, {R('v[(n * 0.1)::int + 1]', 6)} low, {R('v[floor(n * 0.9)::int + 1]', 6)} high from (
 select event_type, genre, count(*) n, median(value) med, list_sort(list(value)) v from findings group by 1,2)""".replace("(n * 0.1)::int", "floor(n * 0.1)::int"), "findings")
def _(t):
    """Tails are picked by index from value counts, so a hot group is its distinct values only."""
    from pyspark.sql import Window
    keys = ["event_type", "genre"]
    counts = t.findings.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(*keys)
    run = counts.withColumn("upto", F.sum("c").over(w.orderBy("value"))).withColumn("n", F.sum("c").over(w))
    at = lambda i: F.expr(f"min(CASE WHEN upto > {i} THEN value END)")
    g = run.groupBy(*keys).agg(F.max("n").alias("n"), at("floor(n * 0.1)").alias("low"), at("floor(n * 0.9)").alias("high"),
                               at("(n - 1) DIV 2").alias("m1"), at("n DIV 2").alias("m2"))
    return g.selectExpr(*keys, "n", "round((m1 + m2) / 2, 6) AS median_value", "round(low, 6) AS low", "round(high, 6) AS high")


@query("mean_abs_gap", "AGG-30", f"""select {R('avg(abs(a.value - b.value))', 8)} mean_abs_gap, count(*) pairs from findings a join findings b
 on a.entity_id=b.entity_id and a.event_type=b.event_type and a.finding_id < b.finding_id""", "findings")
def _(t):
    return agg.mean_abs_gap(t.findings, ["entity_id", "event_type"], "value").withColumn("mean_abs_gap", F.round("mean_abs_gap", 8))


view("trades", """select finding_id, entity_id, day, k % 2 = 1 disposed, value * 1000 usd, value shares, 'owner' || (k % 7) as owner, k % 5 <> 0 open_market from findings where event_type='signup'""", "findings")


def trades(t):
    return t.findings.filter("event_type = 'signup'").selectExpr(
        "finding_id", "entity_id", "day", "k % 2 = 1 AS disposed", "value * 1000 AS usd", "value AS shares",
        "concat('owner', k % 7) AS owner", "k % 5 <> 0 AS open_market")


@query("insider_activity", "AGG-31", f"""select entity_id, {R('coalesce(sum(usd) filter (disposed), 0)', 2)} sold, {R('coalesce(sum(usd) filter (not disposed), 0)', 2)} bought,
 {R('sum(case when disposed then -usd else usd end)', 2)} net, count(distinct owner) insiders from trades where open_market and day >= date '2024-01-10' group by 1""", "trades")
def _(t):
    d = trades(t).filter("open_market AND day >= date'2024-01-10'")
    return d.groupBy("entity_id").agg(
        F.expr("round(coalesce(sum(CASE WHEN disposed THEN usd END), 0D), 2) AS sold"), F.expr("round(coalesce(sum(CASE WHEN NOT disposed THEN usd END), 0D), 2) AS bought"),
        F.expr("round(sum(CASE WHEN disposed THEN -usd ELSE usd END), 2) AS net"), F.countDistinct("owner").alias("insiders"))


@query("cohort_summary", "AGG-32", f"""select cohort, used, count(*) decisions, count(*) filter (action='pass') passes, count(*) filter (conviction >= 0.5) cited,
 {R('avg(conviction)', 8)} mean_conviction, {R('avg(abnormal)', 8)} mean_abnormal, count(abnormal) scored from decisions group by 1,2""", "decisions")
def _(t):
    return decisions(t).groupBy("cohort", "used").agg(
        F.count(F.lit(1)).alias("decisions"), F.count_if(F.col("action") == "pass").alias("passes"), F.count_if(F.col("conviction") >= 0.5).alias("cited"),
        F.round(F.avg("conviction"), 8).alias("mean_conviction"), F.round(F.avg("abnormal"), 8).alias("mean_abnormal"), F.count("abnormal").alias("scored"))


view("last_close", "select brand, arg_max(close, session_date) as close from bars group by 1", "bars")


@query("portfolio_totals", "AGG-34", f"""select user_id, count(*) filter (shares > 0) held, {R('sum(shares * close)', 4)} as value, {R('sum(shares * cost_basis)', 4)} as cost,
 {R('sum(shares * close) - sum(shares * cost_basis)', 4)} unrealised, {R('(sum(shares * close) / sum(shares * cost_basis) - 1) * 100', 6)} unrealised_pct
 from positions left join last_close using (brand) where shares > 0 and close is not null group by 1""", "positions last_close")
def _(t):
    last = t.bars.groupBy("brand").agg(F.max_by("close", "session_date").alias("close"))
    d = t.positions.filter("shares > 0").join(last, "brand")
    v, c = "sum(shares * close)", "sum(shares * cost_basis)"
    return d.groupBy("user_id").agg(F.count(F.lit(1)).alias("held"), F.expr(f"round({v}, 4) AS value"), F.expr(f"round({c}, 4) AS cost"),
                                    F.expr(f"round({v} - {c}, 4) AS unrealised"), F.expr(f"round(({v} / nullif({c}, 0) - 1) * 100, 6) AS unrealised_pct"))


@query("filing_counts", "AGG-35", "select entity, count(*) filings from filings where subtype in ('en','fr') group by 1", "filings")
def _(t):
    return t.filings.filter(F.col("subtype").isin("en", "fr")).groupBy("entity").agg(F.count(F.lit(1)).alias("filings"))


@query("bootstrap_interval", "AGG-19 UDF-04")
def _(t):
    d = stats.block_bootstrap(agg.monthly_returns(t.bars), ["brand"], "month", "ret", resamples=10_000)
    return d.select("brand", *[F.round(c, 8).alias(c) for c in ("point", "low", "high")], "draws")


@query("sign_flip_permutation", "AGG-20")
def _(t):
    d = stats.sign_flip(agg.monthly_returns(t.bars), ["brand"], "month", "ret", flips=10_000)
    return d.select("brand", "n", F.round("mean", 8).alias("mean"), F.round("p", 6).alias("p"))


# The bounds are random, so the twin says where they have to lie: a normal interval of the mean is near the bootstrap's.
view("resampled", """select brand, count(*) n, avg(ret) mean, median(ret) mid, sum(ret) / sum(abs(ret)) ratio, stddev_samp(ret) / sqrt(count(*)) se from monthly group by 1""", "monthly")


@query("resampled_statistics", "AGG-19 UDF-04", f"""select brand, statistic, n, {R('point', 8)} point, 10000 draws, true around, true width from resampled, lateral (select unnest(['mean', 'median', 'ratio']) statistic, unnest([mean, mid, ratio]) point)""", "resampled")
def _(t):
    m = agg.monthly_returns(t.bars).withColumn("size", F.abs("ret"))
    d = stats.resample_statistics(m, ["brand"], "month", ["ret", "size"], {"mean": stats.mean_of("ret"), "median": stats.median_of("ret"), "ratio": stats.ratio_of("ret", "size")})
    se = stats.block_error(m, ["brand"], "month", "ret")
    width = (F.col("statistic") != "mean") | ((F.col("high") - F.col("low")) / (2 * 1.96 * F.col("se"))).between(0.5, 1.5)
    return d.join(se, "brand").select("brand", "statistic", F.col("n").cast("long").alias("n"), F.round("point", 8).alias("point"), "draws",
                                      ((F.col("low") <= F.col("point")) & (F.col("point") <= F.col("high"))).alias("around"), width.alias("width"))


@query("paired_return_effects", "AGG-20", f"""select brand, n, {R('estimate', 8)} estimate, {R('t', 6)} t, {R(P_SQL, 8)} p_t, positive n_positive, {R('mid', 8)} median, true has_p, true around
 from (select brand, count(*) n, avg(ret) estimate, avg(ret) / (stddev_samp(ret) / sqrt(count(*))) t, count(*) - 1 d, count(*) filter (ret > 0) positive, median(ret) mid from monthly group by 1)""", "monthly")
def _(t):
    d = stats.paired_effect(agg.monthly_returns(t.bars), ["brand"], "month", "ret")
    return d.select("brand", "n", F.round("estimate", 8).alias("estimate"), F.round("t", 6).alias("t"), F.round("p_t", 8).alias("p_t"), "n_positive", F.round("median", 8).alias("median"),
                    F.col("p_permutation").between(0, 1).alias("has_p"), ((F.col("ci_low") <= F.col("estimate")) & (F.col("estimate") <= F.col("ci_high"))).alias("around"))
