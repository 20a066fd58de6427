"""Factor library, pools, composites and the many-date panel."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from pitlens.operators import composites, factors, ranks
from pitlens.plans.price_queries import _ret, asof_sql
from pitlens.plans.registry import query
from pitlens.plans.views import R, view

AS_OF = "2000-06-30"
PANEL = [f"{y}-{m:02d}-{d}" for y in (1999, 2000) for m, d in
         ((1, 31), (2, 28), (3, 31), (4, 30), (5, 31), (6, 30), (7, 31), (8, 31), (9, 30), (10, 31), (11, 30), (12, 31))]
QUARTERLY = PANEL[2::3]


# ---- twins ---------------------------------------------------------------
def factor_views(tag: str, dates: list[str]) -> None:
    """CTEs that say the factor library over a list of dates."""
    v = lambda n, s, needs="": view(f"{tag}_{n}", s, needs)
    T = tag
    v("dates", "select unnest([" + ", ".join(f"date '{d}'" for d in dates) + "]) as_of")
    v("vis", f"select d.as_of, f.* from facts_restated f join {T}_dates d on f.filed_on <= d.as_of", f"facts_restated {T}_dates")
    v("live", f"select as_of, entity_id, max(filed_on) newest from {T}_vis group by 1,2 having as_of - max(filed_on) <= 400", f"{T}_vis")
    v("hist", f"""select as_of, entity_id, metric, period, period_end, arg_max(value, filed_on) as value, any_value(newest) newest
 from {T}_vis join {T}_live using (as_of, entity_id) group by 1,2,3,4,5""", f"{T}_vis {T}_live")
    v("inst", f"select as_of, entity_id, metric, period_end, value, newest from {T}_hist where period='instant'", f"{T}_hist")
    v("yr", f"""select as_of, entity_id, metric, period_end, value, row_number() over (partition by as_of, entity_id, metric order by period_end desc) - 1 as back,
 newest - period_end <= 500 fresh from {T}_hist where period='year'""", f"{T}_hist")
    def pair(a, b):
        return f"""select as_of, entity_id, period_end, a.value a, b.value b, a.fresh, row_number() over (partition by as_of, entity_id order by period_end desc) - 1 as back
 from (select * from {T}_yr where metric='{a}') a join (select as_of, entity_id, period_end, value from {T}_yr where metric='{b}') b using (as_of, entity_id, period_end)"""
    v("ni_ocf", pair("net_income", "operating_cash_flow"), f"{T}_yr")
    v("rev_op", pair("revenue", "operating_income"), f"{T}_yr")
    v("assets", f"select as_of, entity_id, period_end, value from {T}_inst where metric='assets'", f"{T}_inst")
    v("avg_assets", f"""select y.as_of, y.entity_id, y.period_end, c.value closing, coalesce((c.value + p.value)/2, c.value) avg_assets
 from (select distinct as_of, entity_id, period_end from {T}_yr) y join {T}_assets c on c.as_of=y.as_of and c.entity_id=y.entity_id and abs(c.period_end - y.period_end) <= 14
 left join {T}_assets p on p.as_of=y.as_of and p.entity_id=y.entity_id and p.period_end < c.period_end and abs(p.period_end - (c.period_end - 365)) <= 60""", f"{T}_yr {T}_assets")
    v("now", f"""select * from (select *, row_number() over (partition by as_of, entity_id, metric order by period_end desc) rn from {T}_inst) where rn=1 and newest - period_end <= 500""", f"{T}_inst")
    v("prior", f"""select n.as_of, n.entity_id, n.metric, n.period_end, n.value, p.period_end prior_end, p.value prior_value from {T}_now n
 join {T}_inst p on p.as_of=n.as_of and p.entity_id=n.entity_id and p.metric=n.metric and p.period_end < n.period_end and abs(p.period_end - (n.period_end - 365)) <= 60""", f"{T}_now {T}_inst")
    v("brands", f"select distinct brand, as_of, (as_of - 395)::date f, (as_of - 30)::date t from entities, {T}_dates", f"entities {T}_dates")
    v("last", "select brand, as_of, b_close price from (" + asof_sql(f"{T}_brands", "as_of", "b") + ") where as_of - b_date <= 7", f"{T}_brands bars")
    v("mom", _ret(f"{T}_brands", "f", "t", "momentum"), f"{T}_brands bars")
    v("vol", f"""select p.brand, p.as_of, stddev_samp(ret) * sqrt(252) volatility from {T}_brands p join returns r on r.brand=p.brand and r.session_date <= p.as_of
 and r.prev_date >= p.as_of - 365 group by 1,2 having count(*) >= 120""", f"{T}_brands returns")
    v("cap", f"""select s.as_of, s.entity_id, price * s.value cap from (select as_of, entity_id, max(period_end) period_end, arg_max(value, period_end) as value
 from {T}_inst where metric='shares_outstanding' group by 1,2) s join entities e using (entity_id) join {T}_last l on l.brand=e.brand and l.as_of=s.as_of
 where s.value > 0 and price > 0 and s.as_of - s.period_end <= 200""", f"{T}_inst entities {T}_last")
    y = lambda m, b=0: f"(select * from {T}_yr where metric='{m}' and back={b} and fresh)"
    ratio = lambda top, bottom: f"case when abs({bottom}) >= 1 then ({top}) / ({bottom}) end"
    growth = lambda key, m: (f"select n.as_of, n.entity_id, '{key}' as key, {ratio('n.value - p.value', 'abs(p.value)')} as value"
                             f" from {y(m)} n join {y(m, 1)} p using (as_of, entity_id)")
    on_assets = lambda key, m: (f"select as_of, entity_id, '{key}', {ratio('n.value', 'avg_assets')} from {y(m)} n"
                                f" join {T}_avg_assets using (as_of, entity_id, period_end)")
    yld = lambda key, m: f"select as_of, entity_id, '{key}', {ratio('n.value', 'cap')} from {y(m)} n join {T}_cap using (as_of, entity_id)"
    no = f"(select * from {T}_ni_ocf where back=0 and fresh)"
    ro = lambda b: f"(select * from {T}_rev_op where back={b} and fresh)"
    at = lambda src, col: f"{T}_assets {src} on {src}.as_of=n.as_of and {src}.entity_id=n.entity_id and abs({src}.period_end - {col}) <= 14"
    parts = [
        growth("revenue_growth", "revenue"), growth("net_share_issuance", "shares_diluted"),
        f"select as_of, entity_id, 'accruals', {ratio('a - b', 'avg_assets')} from {no} join {T}_avg_assets using (as_of, entity_id, period_end)",
        f"select as_of, entity_id, 'cash_conversion', case when a > 0 then {ratio('b', 'a')} end from {no}",
        f"select as_of, entity_id, 'asset_growth', {ratio('value - prior_value', 'abs(prior_value)')} from {T}_prior where metric='assets'",
        on_assets("gross_profitability", "gross_profit"), on_assets("return_on_assets", "net_income"),
        f"select n.as_of, n.entity_id, 'operating_margin_change', {ratio('n.b', 'n.a')} - {ratio('p.b', 'p.a')} from {ro(0)} n join {ro(1)} p using (as_of, entity_id)",
        f"""select n.as_of, n.entity_id, 'asset_turnover_change', {ratio('n.value', 'x.value')} - {ratio('p.value', 'z.value')} from {y('revenue')} n
 join {y('revenue', 1)} p on p.as_of=n.as_of and p.entity_id=n.entity_id join {at('x', 'n.period_end')} join {at('z', 'p.period_end')}""",
        f"""select n.as_of, n.entity_id, 'leverage_change', {ratio('n.value', 'x.value')} - {ratio('n.prior_value', 'z.value')} from (select * from {T}_prior where metric='liabilities') n
 join {at('x', 'n.period_end')} join {at('z', 'n.prior_end')}""",
        yld("earnings_yield", "net_income"), yld("cash_flow_yield", "operating_cash_flow"), yld("sales_yield", "revenue"),
        f"select as_of, entity_id, 'book_to_price', case when value > 0 then {ratio('value', 'cap')} end from {T}_now join {T}_cap using (as_of, entity_id) where metric='equity'",
        f"select l.as_of, l.entity_id, 'momentum', momentum from {T}_live l join entities e using (entity_id) join {T}_mom m on m.brand=e.brand and m.as_of=l.as_of",
        f"select l.as_of, l.entity_id, 'volatility', volatility from {T}_live l join entities e using (entity_id) join {T}_vol m on m.brand=e.brand and m.as_of=l.as_of",
        f"select n.as_of, n.entity_id, 'cash_to_assets', {ratio('n.value', 'x.value')} from (select * from {T}_now where metric='cash') n join {at('x', 'n.period_end')}"]
    v("raw", "select * from (" + " union all ".join(parts) + ") where value is not null",
      f"{T}_yr {T}_avg_assets {T}_ni_ocf {T}_rev_op {T}_prior {T}_assets {T}_cap {T}_now {T}_mom {T}_vol {T}_live entities")
    low = "'accruals','asset_growth','net_share_issuance','leverage_change','volatility'"
    v("pools", f"""select as_of, entity_id, sector, case when count(*) over (partition by as_of, sector) >= 8 then sector else 'universe' end pool
 from (select distinct as_of, entity_id from {T}_raw) join entities using (entity_id)""", f"{T}_raw entities")
    v("scored", f"""select as_of, entity_id, sector, key, pool, value, universe_size, (round(case when key in ({low}) then 1 - p else p end, 4) + 0.0) percentile
 from (select *, count(*) over (partition by as_of, key, pool) universe_size,
 (rank() over (partition by as_of, key, pool order by value) - 1 + (count(*) over (partition by as_of, key, pool, value) - 1) / 2.0)
  / greatest(count(*) over (partition by as_of, key, pool) - 1, 1) p
 from {T}_raw join {T}_pools using (as_of, entity_id)) where universe_size >= 8""", f"{T}_raw {T}_pools")
    v("flat", f"""select as_of, entity_id, (round(avg(percentile), 8) + 0.0) score, count(*) factor_count,
 coalesce(array_to_string(list_sort(list(key) filter (percentile <= 0.1 or percentile >= 0.9)), ','), '') extremes from {T}_scored group by 1,2 having count(*) >= 4""", f"{T}_scored")
    theme = "case " + " ".join(f"when key in ({', '.join(repr(k) for k in ks)}) then '{th}'" for th, ks in composites.THEMES.items()) + " end"
    v("themes", f"select as_of, entity_id, {theme} theme, avg(percentile) theme_score, count(*) n from {T}_scored group by 1,2,3", f"{T}_scored")
    v("cond", f"select as_of, entity_id, (round(avg(theme_score), 8) + 0.0) score, sum(n)::bigint factor_count, count(*) themes from {T}_themes group by 1,2 having count(*) >= 3", f"{T}_themes")


factor_views("one", [AS_OF])
factor_views("panel", PANEL)


def scored(t, dates):
    return factors.score_universe(t.facts_restated, t.bars, t.entities, dates)


def values(t, dates):
    return factors.factor_values(factors.wide_panel(t.facts_restated, t.bars, t.entities, dates))


# ---- flagship ------------------------------------------------------------
@query("revenue_growth_ranked", "FAC-08 WIN-05", f"""select entity_id, pool, {R('value', 8)} as value, universe_size, (round(
 (rank() over (partition by pool order by value) - 1 + (count(*) over (partition by pool, value) - 1) / 2.0) / greatest(universe_size - 1, 1), 4) + 0.0) percentile
 from (select *, count(*) over (partition by pool) universe_size from (select entity_id, value,
 case when count(*) over (partition by sector) >= 8 then sector else 'universe' end pool
 from one_raw join entities using (entity_id) where key='revenue_growth')) where universe_size >= 8""", "one_raw entities")
def revenue_growth_ranked(t):
    only = [f for f in factors.factor_registry() if f.key == "revenue_growth"]
    rows = factors.factor_rows(factors.company_view(t.facts_restated, [AS_OF]).join(
        t.entities.select("entity_id", "sector", "size"), "entity_id"), only)
    return factors.score(rows).select("entity_id", "pool", F.round("value", 8).alias("value"), "percentile", "universe_size")


@query("factor_library", "FAC-01 FAC-02 FAC-03 FAC-04 FAC-05 FAC-06 FAC-07 FAC-08 FAC-09 FAC-10 FAC-11 FAC-12 FAC-13 FAC-14 FAC-15"
       " FAC-16 FAC-17 FAC-18 FAC-19 FN-03 UDF-01", f"select entity_id, key, {R('value', 8)} as value from one_raw", "one_raw")
def _(t):
    return values(t, [AS_OF]).select("entity_id", "key", F.round("value", 8).alias("value"))


@query("score_universe", "XS-01 FN-02 WIN-05", f"select entity_id, sector, key, pool, {R('value', 8)} as value, percentile, universe_size from one_scored", "one_scored")
def score_universe(t):
    return scored(t, [AS_OF]).select("entity_id", "sector", "key", "pool", F.round("value", 8).alias("value"), "percentile", "universe_size")


@query("score_universe_coverage", "XS-01", """select (select count(distinct entity_id) from one_raw) scored,
 (select count(*) from (select entity_id from one_vis group by 1 having date '2000-06-30' - max(filed_on) > 400)) skipped_stale,
 (select count(*) from entities e where not exists (select 1 from one_vis v where v.entity_id=e.entity_id)) skipped_thin,
 (select count(*) from one_live l join entities e using (entity_id) where not exists (select 1 from bars b where b.brand=e.brand)) without_prices""",
       "one_raw one_vis one_live entities bars")
def _(t):
    seen = t.facts_restated.filter(F.col("filed_on") <= F.lit(AS_OF).cast("date")).groupBy("entity_id").agg(F.max("filed_on").alias("newest"))
    priced = t.bars.select("brand").distinct().withColumn("priced", F.lit(True))
    raw = values(t, [AS_OF]).select("entity_id").distinct().withColumn("scored", F.lit(True))
    d = t.entities.join(seen, "entity_id", "left").join(priced, "brand", "left").join(raw, "entity_id", "left")
    age = F.datediff(F.lit(AS_OF).cast("date"), F.col("newest"))
    return d.agg(F.count("scored").alias("scored"), F.count_if(age > 400).alias("skipped_stale"),
                 F.count_if(F.col("newest").isNull()).alias("skipped_thin"),
                 F.count_if((age <= 400) & F.col("priced").isNull()).alias("without_prices"))


@query("composite_flat", "XS-02", "select entity_id, score, factor_count, extremes from one_flat", "one_flat")
def _(t):
    return composites.flat_composite(scored(t, [AS_OF])).select("entity_id", "score", "factor_count", F.array_join("extremes", ",").alias("extremes"))


def _health_sql():
    case = " or ".join(f"(key='{k}' and value {op} {b})" for k, op, b in composites.HEALTH_TESTS)
    keys = ", ".join(f"'{k}'" for k, _, _ in composites.HEALTH_TESTS)
    return f"""select entity_id, count(*) filter ({case}) passed, count(*) available,
 coalesce(array_to_string(list_sort(list(key) filter (not ({case}))), ','), '') failed from one_raw where key in ({keys}) group by 1"""


@query("health_score", "XS-03", _health_sql(), "one_raw")
def _(t):
    return composites.health_score(values(t, [AS_OF])).select("entity_id", "passed", "available", F.array_join("failed", ",").alias("failed"))


@query("composite_by_theme", "XS-04 FN-29", "select entity_id, score, factor_count, themes from one_cond_rnd", "one_cond_rnd")
def _(t):
    panel = factors.wide_panel(t.facts_restated, t.bars, t.entities, [AS_OF])
    rnd = panel.select("entity_id", (F.col("y_rnd_expense_0.value") / F.col("y_revenue_0.value")).alias("rnd"))
    s = factors.score(factors.factor_rows(panel)).join(rnd, "entity_id", "left")
    return composites.weighted_composite(s, F.col("rnd")).select("entity_id", "score", "factor_count", "themes")


_adj = "0.5 + (percentile - 0.5) * case when key='book_to_price' and rnd >= 0.1 then 0.4 else 1.0 end"
view("one_rnd", """select r.entity_id, d.value / r.value rnd from (select * from one_yr where metric='revenue' and back=0 and fresh) r
 join (select * from one_yr where metric='rnd_expense' and back=0 and fresh) d using (entity_id)""", "one_yr")
view("one_cond_rnd", f"""select entity_id, (round(avg(ts), 8) + 0.0) score, sum(n)::bigint factor_count, count(*) themes from (
 select entity_id, case """ + " ".join(f"when key in ({', '.join(repr(k) for k in ks)}) then '{th}'" for th, ks in composites.THEMES.items()) +
     f""" end theme, avg({_adj}) ts, count(*) n from one_scored left join one_rnd using (entity_id) group by 1,2) group by 1 having count(*) >= 3""", "one_scored one_rnd")


@query("composite_rows", "XS-05", """select f.entity_id, coalesce(c.score, f.score) score, f.score flat_score, c.score conditional_score,
 coalesce(c.factor_count, f.factor_count) factor_count from one_flat f full join one_cond c using (as_of, entity_id)""", "one_flat one_cond")
def _(t):
    return composites.composite_rows(scored(t, [AS_OF])).drop("as_of")


@query("score_panel_many_dates", "XS-06 FN-31", "select as_of::varchar as_of, entity_id, score, factor_count, extremes from panel_flat", "panel_flat")
def score_panel(t):
    return composites.flat_composite(scored(t, PANEL)).withColumn("extremes", F.array_join("extremes", ","))


@query("peer_ranks_as_of", "XS-07", """select s.entity_id, s.as_of::varchar as_of, key, percentile, universe_size from panel_scored s
 join (select entity_id, max(as_of) as_of from panel_scored where as_of <= date '2000-02-15' group by 1) m using (entity_id, as_of)""", "panel_scored")
def _(t):
    s = scored(t, [d for d in PANEL if d <= "2000-02-15"])
    newest = F.max("as_of").over(Window.partitionBy("entity_id"))
    return s.withColumn("_n", newest).filter(F.col("as_of") == F.col("_n")).select("entity_id", "as_of", "key", "percentile", "universe_size")


def percentile_phrase(p: Column) -> Column:
    return (F.when(p >= 0.9, "among the best").when(p >= 0.7, "better than most").when(p >= 0.3, "middle of the pack")
            .when(p >= 0.1, "worse than most").when(p.isNotNull(), "among the worst"))


def composite_phrase(s: Column) -> Column:
    return (F.when(s.isNull(), "not enough figures").when(s >= 0.75, "stronger than most").when(s >= 0.55, "a little better than average")
            .when(s >= 0.45, "about average").when(s >= 0.25, "weaker than most").otherwise("among the weakest"))


@query("percentile_phrases", "FN-05", """select entity_id, key, case when percentile >= 0.9 then 'among the best' when percentile >= 0.7 then 'better than most'
 when percentile >= 0.3 then 'middle of the pack' when percentile >= 0.1 then 'worse than most' else 'among the worst' end phrase,
 case when score is null then 'not enough figures' when score >= 0.75 then 'stronger than most' when score >= 0.55 then 'a little better than average'
 when score >= 0.45 then 'about average' when score >= 0.25 then 'weaker than most' else 'among the weakest' end composite
 from one_scored left join (select entity_id, score from one_flat) using (entity_id)""", "one_scored one_flat")
def _(t):
    s = scored(t, [AS_OF])
    flat = composites.flat_composite(s).select("entity_id", "score")
    return s.join(flat, "entity_id", "left").select("entity_id", "key", percentile_phrase(F.col("percentile")).alias("phrase"),
                                                    composite_phrase(F.col("score")).alias("composite"))


# ---- boards over the panel -------------------------------------------------
@query("leaderboard", "TOP-01", """select entity_id, score from panel_cond where as_of = (select max(as_of) from panel_cond)
 order by score desc, entity_id limit 20""", "panel_cond")
def _(t):
    d = composites.weighted_composite(scored(t, PANEL[-1:]))
    return d.orderBy(F.col("score").desc(), "entity_id").limit(20).select("entity_id", "score")


@query("entity_factors_worst_first", "TOP-02", """select entity_id, key, percentile, row_number() over (partition by entity_id order by coalesce(percentile, 1.0), key) pos
 from (select r.entity_id, r.key, s.percentile from one_raw r left join one_scored s using (entity_id, key))""", "one_raw one_scored")
def _(t):
    raw, s = values(t, [AS_OF]), scored(t, [AS_OF]).select("entity_id", "key", "percentile")
    w = Window.partitionBy("entity_id").orderBy(F.coalesce("percentile", F.lit(1.0)), "key")
    return raw.select("entity_id", "key").join(s, ["entity_id", "key"], "left").withColumn("pos", F.row_number().over(w).cast("long"))


def crossed(before: Column, now: Column) -> Column:
    low, high = 0.15, 0.85
    return (F.when((now <= low) & (before > low), "entered_low").when((now >= high) & (before < high), "entered_high")
            .when((before <= low) & (now > low), "left_low").when((before >= high) & (now < high), "left_high"))


_CROSS = """case when now <= 0.15 and was > 0.15 then 'entered_low' when now >= 0.85 and was < 0.85 then 'entered_high'
 when was <= 0.15 and now > 0.15 then 'left_low' when was >= 0.85 and now < 0.85 then 'left_high' end"""
view("factor_changes", f"""select entity_id, key, was, now, {_CROSS} crossing from (select entity_id, key, percentile now, as_of from panel_scored where as_of = date '{PANEL[-1]}')
 join (select entity_id, key, percentile was from panel_scored where as_of = date '{PANEL[-2]}') using (entity_id, key) where {_CROSS} is not null""", "panel_scored")


def factor_changes(t):
    s = scored(t, PANEL[-2:])
    pick = lambda d: F.max(F.when(F.col("as_of") == F.lit(d).cast("date"), F.col("percentile")))
    g = s.groupBy("entity_id", "key").agg(pick(PANEL[-2]).alias("was"), pick(PANEL[-1]).alias("now"))
    return g.withColumn("crossing", crossed(F.col("was"), F.col("now"))).filter(F.col("crossing").isNotNull())


@query("factor_tail_crossings", "WIN-14", "select * from factor_changes", "factor_changes")
def _(t):
    return factor_changes(t)
