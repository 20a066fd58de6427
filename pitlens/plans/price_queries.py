"""Price grain: as-of lookups, returns, moves against the benchmark."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from pitlens.operators import prices
from pitlens.operators.pit import nearby
from pitlens.plans.registry import query
from pitlens.plans.views import R, view

AS_OF = "2000-06-30"

view("returns", """select * from (select brand, session_date, adjusted_close / lag(adjusted_close) over w - 1 ret,
 lag(session_date) over w prev_date from bars window w as (partition by brand order by session_date)) where ret is not null""", "bars")
view("market_returns", """select * from (select session_date, adjusted_close / lag(adjusted_close) over w - 1 market_ret,
 lag(session_date) over w market_prev from benchmark_bars window w as (order by session_date)) where market_ret is not null""", "benchmark_bars")
view("abnormal", """select brand, session_date, least(prev_date, market_prev) prev_date, ret - market_ret abnormal
 from returns join market_returns using (session_date)""", "returns market_returns")
view("finding_days", "select distinct brand, price_day at_date, (price_day + 20)::date until from findings", "findings")


def asof_sql(src: str, date_col: str, tag: str, on_brand: bool = True) -> str:
    """Backward as-of on bars as a lateral top row."""
    key = "b.brand=s.brand and" if on_brand else ""
    table = "bars" if on_brand else "benchmark_bars"
    return (f"select s.*, b.session_date {tag}_date, b.close {tag}_close, b.adjusted_close {tag}_adj from {src} s"
            f" asof left join {table} b on {key} s.{date_col} >= b.session_date")


def _ret(src: str, start: str, end: str, out: str, on_brand: bool = True) -> str:
    a = asof_sql(src, start, "a", on_brand)
    b = asof_sql(f"({a})", end, "b", on_brand)
    ok = (f"{start} - a_date <= 7 and {end} - b_date <= 7 and a_adj > 0 and a_date < b_date")
    return f"select * exclude (a_date,a_close,a_adj,b_date,b_close,b_adj), case when {ok} then b_adj/a_adj - 1 end {out} from ({b})"


view("own_moves", _ret("finding_days", "at_date", "until", "own"), "finding_days bars")
view("both_moves", _ret("(select * from own_moves where own is not null)", "at_date", "until", "market", False), "own_moves benchmark_bars")
view("typical", """select m.brand, m.at_date, case when count(*) >= 30 and stddev_pop(abnormal) > 0
 then stddev_pop(abnormal) * sqrt(10) end typical from both_moves m join abnormal a on a.brand=m.brand
 and a.session_date < m.at_date and a.session_date >= m.at_date - 201 and a.prev_date >= m.at_date - 201 group by 1,2""", "both_moves abnormal")
view("moves", """select m.brand, m.at_date, own, market, own - coalesce(market, 0) abnormal,
 (round((own - coalesce(market, 0)) * 100, 2) + 0.0) abnormal_percent, (round((own - coalesce(market, 0)) / typical, 2) + 0.0) sigma
 from both_moves m left join typical using (brand, at_date)""", "both_moves typical")


@query("price_on_or_before", "JON-01", f"""select brand, month_end::varchar month_end, case when month_end - b_date <= 7 then b_date::varchar end session_date,
 case when month_end - b_date <= 7 then {R('b_close')} end as close from (""" + asof_sql("probes", "month_end", "b") + ")", "probes bars")
def _(t):
    return prices.price_on_or_before(_probes(t), t.bars, "month_end", "p").select(
        "brand", "month_end", F.col("p.at").alias("session_date"), F.round("p.close", 6).alias("close"))


view("probes", """select distinct brand, last_day(make_date(y, m, 1))::date month_end from (select p_brand brand,
 year(l_shipdate) y, month(l_shipdate) m from lineitem join part on l_partkey=p_partkey)""")


def _probes(t):
    return t.bars.select("brand", F.last_day("session_date").alias("month_end")).distinct()


@query("total_return_between_dates", "WIN-07", f"select brand, month_end::varchar month_end, {R('ret', 8)} ret from ("
       + _ret("(select brand, month_end, (month_end + 91)::date until from probes)", "month_end", "until", "ret") + ")", "probes bars")
def _(t):
    p = _probes(t).withColumn("until", F.date_add("month_end", 91))
    return prices.total_return(p, t.bars, "month_end", "until", "ret").select("brand", "month_end", F.round("ret", 8).alias("ret"))


@query("daily_session_returns", "WIN-06", f"""select brand, session_date::varchar session_date, prev_date::varchar prev_date, {R('ret', 8)} ret
 from returns where prev_date >= date '1999-07-01' and session_date <= date '{AS_OF}'""", "returns")
def _(t):
    w = t.bars.filter(F.col("session_date").between(F.lit("1999-07-01").cast("date"), F.lit(AS_OF).cast("date")))
    return prices.session_returns(w).withColumn("ret", F.round("ret", 8))


@query("price_window_and_coverage", "WIN-08", f"""select brand, count(*) filter (session_date between date '{AS_OF}' - 365 and date '{AS_OF}') sessions,
 max(session_date)::varchar newest, coalesce(bool_or(session_date between date '{AS_OF}' - 395 - 7 and date '{AS_OF}' - 395), false) covers
 from bars group by 1""", "bars")
def _(t):
    at = F.lit(AS_OF).cast("date")
    d = F.col("session_date")
    edge = F.date_sub(at, 395)
    return t.bars.groupBy("brand").agg(
        F.count_if(d.between(F.date_sub(at, 365), at)).alias("sessions"), F.max(d).alias("newest"),
        F.coalesce(F.bool_or(d.between(F.date_sub(edge, 7), edge)), F.lit(False)).alias("covers"))


@query("abnormal_daily_returns", "JON-06", f"select brand, session_date::varchar session_date, {R('abnormal', 8)} abnormal from abnormal", "abnormal")
def _(t):
    return prices.abnormal_daily(t.bars, t.benchmark_bars).select("brand", "session_date", F.round("abnormal", 8).alias("abnormal"))


@query("typical_move", "WIN-18", f"""select p.brand, p.month_end::varchar month_end, {R('case when count(abnormal) >= 30 and stddev_pop(abnormal) > 0 then stddev_pop(abnormal)*sqrt(10) end', 8)} typical
 from probes p left join abnormal a on a.brand=p.brand and a.session_date < p.month_end and a.session_date >= p.month_end - 201
 and a.prev_date >= p.month_end - 201 group by 1, p.month_end""", "probes abnormal")
def _(t):
    d = prices.typical_move(_probes(t), prices.abnormal_daily(t.bars, t.benchmark_bars), "month_end", "typical")
    return d.select("brand", "month_end", F.round("typical", 8).alias("typical"))


@query("move_after_disclosure", "EVT-01", """select brand, at_date::varchar at_date, abnormal_percent, sigma,
 coalesce(abs(sigma) >= 1.5, false) is_material, coalesce(abs(sigma) >= 3, false) is_striking from moves""", "moves")
def _(t):
    return prices.move_after(t.findings, t.bars, t.benchmark_bars, "price_day").select(
        "brand", "at_date", "abnormal_percent", "sigma", "is_material", "is_striking")


_CH = {"1m": 21, "3m": 63, "6m": 126, "1y": 252}


@query("range_standing", "WIN-16", "select brand, " + f"{R('last_close', 2)} last_close, " + ", ".join(
    f"{R(f'ret_{k}*100', 2)} change_{k}" for k in _CH) +
    f""", case when n >= 30 and hi > lo then {R('(here - lo)/(hi - lo)', 3)} end range_position, case when n >= 30 and hi > 0 then {R('1 - here/hi', 3)} end drawdown
 from (select brand, count(*) n, min(adjusted_close) lo, max(adjusted_close) hi, arg_max(adjusted_close, session_date) here from bars
 where session_date between date '{AS_OF}' - 365 and date '{AS_OF}' group by 1) join standing_base using (brand)""", "standing_base bars")
def _(t):
    at = F.lit(AS_OF).cast("date")
    base = prices.price_on_or_before(t.bars.select("brand").distinct().withColumn("d", at), t.bars, "d", "last")
    base = base.filter(F.col("last").isNotNull())
    for k, n in _CH.items():
        base = base.withColumn("then", F.date_sub("d", int(n * 1.45)))
        base = prices.total_return(base, t.bars, "then", "d", f"ret_{k}").drop("then")
    year = t.bars.filter(F.col("session_date").between(F.date_sub(at, 365), at)).groupBy("brand").agg(
        F.count("*").alias("n"), F.min("adjusted_close").alias("lo"), F.max("adjusted_close").alias("hi"),
        F.max_by("adjusted_close", "session_date").alias("here"))
    n, lo, hi, here = (F.col(c) for c in ("n", "lo", "hi", "here"))
    return base.join(year, "brand").select(
        "brand", F.round("last.close", 2).alias("last_close"),
        *[F.round(F.col(f"ret_{k}") * 100, 2).alias(f"change_{k}") for k in _CH],
        F.when((n >= 30) & (hi > lo), F.round((here - lo) / (hi - lo), 3)).alias("range_position"),
        F.when((n >= 30) & (hi > 0), F.round(1 - here / hi, 3)).alias("drawdown"))


_src = f"(select brand, date '{AS_OF}' d, b_close last_close from (" + asof_sql(
    f"(select distinct brand, date '{AS_OF}' d from bars)", "d", "b") + ") where d - b_date <= 7)"
for _k, _n in _CH.items():
    _src = "(" + _ret(f"(select *, (d - {int(_n * 1.45)})::date then_{_k} from {_src})", f"then_{_k}", "d", f"ret_{_k}") + ")"
view("standing_base", f"select * from {_src}", "bars")


@query("market_context_series", "WIN-17", """select brand, n points, """ + ", ".join(
    f"(round(((p1 / p{k + 1}) - 1) * 100, 2) + 0.0) change_{k}" for k in (5, 21, 63, 126)) + f""",
 {R('lo', 4)} low, {R('hi', 4)} high, case when hi > lo then {R('(p1-lo)/(hi-lo)', 4)} end position from (
 select brand, count(*) n, min(adjusted_close) filter (rn <= 252) lo, max(adjusted_close) filter (rn <= 252) hi, """ + ", ".join(
     f"max(adjusted_close) filter (rn = {k}) p{k}" for k in (1, 6, 22, 64, 127)) + """
 from (select *, row_number() over (partition by brand order by session_date desc) rn from bars) group by 1) where n >= 20""", "bars")
def _(t):
    w = Window.partitionBy("brand").orderBy(F.col("session_date").desc())
    d = t.bars.withColumn("rn", F.row_number().over(w))
    at = lambda k: F.max(F.when(F.col("rn") == k, F.col("adjusted_close"))).alias(f"p{k}")
    recent = F.when(F.col("rn") <= 252, F.col("adjusted_close"))
    g = d.groupBy("brand").agg(F.count("*").alias("points"), F.min(recent).alias("lo"), F.max(recent).alias("hi"),
                               *[at(k) for k in (1, 6, 22, 64, 127)]).filter(F.col("points") >= 20)
    change = lambda k: F.round((F.col("p1") / F.col(f"p{k + 1}") - 1) * 100, 2).alias(f"change_{k}")
    lo, hi = F.col("lo"), F.col("hi")
    return g.select("brand", "points", *[change(k) for k in (5, 21, 63, 126)], F.round(lo, 4).alias("low"),
                    F.round(hi, 4).alias("high"), F.when(hi > lo, F.round((F.col("p1") - lo) / (hi - lo), 4)).alias("position"))


view("days_after", """select f.*, (select min(session_date) from bars b where b.brand=f.brand and b.session_date > f.price_day) entry_date
 from findings f""", "findings bars")
view("indexed", "select brand, session_date, adjusted_close, row_number() over (partition by brand order by session_date) - 1 idx from bars", "bars")
view("market_indexed", "select session_date, adjusted_close, row_number() over (order by session_date) - 1 idx from benchmark_bars", "benchmark_bars")


@query("session_after_event", "JON-02", f"""select finding_id, e.entry_date::varchar entry_date, {R('(x.adjusted_close / i.adjusted_close - 1) * 100', 4)} forward_pct
 from days_after e left join indexed i on i.brand=e.brand and i.session_date=e.entry_date
 left join indexed x on x.brand=e.brand and x.idx=i.idx+5 where x.idx is not null""", "days_after indexed")
def _(t):
    d = prices.forward_return(t.findings.select("finding_id", "brand", "price_day"), t.bars, "price_day", 5, "forward_pct")
    return d.filter(F.col("entry_date").isNotNull()).select("finding_id", "entry_date", "forward_pct")
