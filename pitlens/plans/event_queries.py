"""Event studies, call evaluation and precedents."""

from pyspark.sql import functions as F

from pitlens.functions import stats
from pitlens.functions import text as tx
from pitlens.operators import events, prices
from pitlens.plans.feed_queries import briefs, ranked
from pitlens.plans.finding_queries import signed
from pitlens.plans.registry import query
from pitlens.plans.scoring import QUARTERLY, factor_views, scored
from pitlens.plans.views import R, view
from pitlens.session import cut_lineage

for h in (1, 2, 5, 21, 63):
    view(f"fwd_{h}", f"""select d.brand, d.price_day, (round((x.adjusted_close / i.adjusted_close - 1) * 100, 4) + 0.0) own_pct from days_needed d
 join indexed i on i.brand=d.brand and i.session_date=(select min(session_date) from bars b where b.brand=d.brand and b.session_date > d.price_day)
 join indexed x on x.brand=d.brand and x.idx=i.idx+{h}""", "days_needed indexed bars")
    view(f"mkt_{h}", f"""select d.price_day, (round((x.adjusted_close / i.adjusted_close - 1) * 100, 4) + 0.0) market_pct from (select distinct price_day from days_needed) d
 join market_indexed i on i.session_date=(select min(session_date) from benchmark_bars b where b.session_date > d.price_day) join market_indexed x on x.idx=i.idx+{h}""", "days_needed market_indexed benchmark_bars")
    view(f"outcome_{h}", f"select brand, price_day, (round(own_pct - market_pct, 4) + 0.0) abnormal_pct from fwd_{h} join mkt_{h} using (price_day)", f"fwd_{h} mkt_{h}")
factor_views("qtr", QUARTERLY)
view("days_needed", "select distinct brand, price_day from findings union select distinct brand, as_of from qtr_brands", "findings qtr_brands")


def _vote(src: str, keys: str) -> str:
    w = "greatest(strength, 0.05)"
    v = f"sum({w} * case direction when 'positive' then 1 when 'negative' then -1 else 0 end)"
    return (f"select {keys} entity_id, day, max(abnormal_pct) abnormal_pct, round(abs({v}) / sum({w}), 4) strength, case when {v} > 1e-12 then 'positive' when {v} < -1e-12 then 'negative' else 'neutral' end direction"
            f" from {src} group by all")


def _summary(src: str, key: str) -> str:
    return f"""select *, (round(mean_positive - mean_negative, 4) + 0.0) spread, case when directional < 30 then 'too few' when mean_positive - mean_negative is null then 'no spread' when t is null then 'one-sided' when abs(t) < 2 then 'chance' when mean_positive - mean_negative > 0 then 'as predicted' else 'opposite' end verdict
 from (select {key}, count(*) evaluated, count(*) filter (dir) directional, (round(count(*) filter (ok) / nullif(count(*) filter (dir), 0)::double, 4) + 0.0) hit_rate,
 (round(greatest(count(*) filter (a < 0) / count(*)::double, 1 - count(*) filter (a < 0) / count(*)::double), 4) + 0.0) baseline, {R("avg(a) filter (direction='positive') + 1e-9", 4)} mean_positive,
 {R("avg(a) filter (direction='negative') + 1e-9", 4)} mean_negative, {R("avg(a) filter (direction='neutral') + 1e-9", 4)} mean_neutral,
 {R("case when count(*) filter (direction='positive') >= 2 and count(*) filter (direction='negative') >= 2 then (avg(a) filter (direction='positive') - avg(a) filter (direction='negative')) / sqrt(var_samp(a) filter (direction='positive') / count(*) filter (direction='positive') + var_samp(a) filter (direction='negative') / count(*) filter (direction='negative')) end", 3)} t,
 {R('case when count(*) >= 3 and min(rs) < max(rs) and min(ra) < max(ra) then corr(rs, ra) end', 4)} ic from (select *, rank() over (partition by {key} order by s) + (count(*) over (partition by {key}, s) - 1) / 2.0 rs,
 rank() over (partition by {key} order by a) + (count(*) over (partition by {key}, a) - 1) / 2.0 ra from (select *, abnormal_pct a, direction <> 'neutral' dir, (direction='positive' and abnormal_pct > 0) or (direction='negative' and abnormal_pct < 0) ok,
 case direction when 'positive' then strength when 'negative' then -strength else 0.0 end s from {src} where abnormal_pct is not null)) group by {key})"""


_calls = "(select finding_id, entity_id, day, finding_type, coalesce(direction, 'neutral') direction, priority strength, abnormal_pct from ranked_findings left join outcome_{h} using (brand, price_day))"


def outcomes(t, h):
    d = ranked(t).selectExpr("finding_id", "entity_id", "day", "finding_type", "brand", "price_day", "coalesce(direction, 'neutral') AS direction", "priority AS strength")
    return events.abnormal_outcomes(d, t.bars, t.benchmark_bars, "price_day", h)


@query("abnormal_outcomes", "EVT-03", "select finding_id, (round(abnormal_pct, 4) + 0.0) abnormal_pct from " + _calls.format(h=5) + " where abnormal_pct is not null", "ranked_findings outcome_5")
def _(t):
    return outcomes(t, 5).filter("abnormal_pct IS NOT NULL").select("finding_id", "abnormal_pct")


@query("one_call_per_entity_day", "EVT-04", "select entity_id, day::varchar as day, abnormal_pct, strength, direction from (" + _vote(_calls.format(h=5), "") + ")", "ranked_findings outcome_5")
def _(t):
    return events.cluster_by_event(outcomes(t, 5))


for h in (1, 2, 5):
    view(f"clustered_{h}", _vote(_calls.format(h=h), ""), f"ranked_findings outcome_{h}")


@query("evaluate_findings", "EVT-05 EVT-06", _summary("(select 1 horizon, * from clustered_1 union all select 2, * from clustered_2 union all select 5, * from clustered_5)", "horizon"), "clustered_1 clustered_2 clustered_5")
def _(t):
    d = ranked(t).selectExpr("finding_id", "entity_id", "day", "finding_type", "brand", "price_day", "coalesce(direction, 'neutral') AS direction", "priority AS strength")
    told = events.outcomes_by_horizon(d, t.bars, t.benchmark_bars, "price_day", (1, 2, 5))
    return events.summarise(events.cluster_by_event(told, ["horizon"]), ["horizon"])


view("by_type", _summary("(" + _vote(_calls.format(h=5), "finding_type,") + ")", "finding_type"), "ranked_findings outcome_5")


def by_type(t):
    return events.summarise(events.cluster_by_event(outcomes(t, 5), ["finding_type"]), ["finding_type"])


@query("survives_multiple_testing", "EVT-07 FN-22", f"select finding_type, t from by_type where abs(t) >= {stats.multiple_testing_threshold(5)}", "by_type")
def _(t):
    return events.survives(by_type(t), 5).select("finding_type", "t")


@query("reliability_by_type", "EVT-08 FN-21", """select finding_type, directional observations, hit_rate, baseline, spread, t, (round(hit_rate - baseline, 4) + 0.0) edge,
 case when directional >= 30 and abs(t) >= 2 and hit_rate is not null then round(greatest(0.8, least(1.25, 1 + round(hit_rate - baseline, 4) / 0.1 * 0.25)), 4) else 1.0 end::double multiplier from by_type""", "by_type")
def _(t):
    d = events.reliability(by_type(t))
    return d.selectExpr("finding_type", "directional AS observations", "hit_rate", "baseline", "spread", "t", "edge", "multiplier")


view("read_calls", """select 'read' source, b.entity_id, b.generated_on as day, 'Brand#' || (b.entity_id % 25 + 1) brand, (b.generated_on - 8766)::date price_day, case when stance like '%negative' then 'negative' else 'positive' end direction, confidence strength
 from briefs b where stance <> 'mixed'""", "briefs")
view("number_calls", """select 'numbers' source, c.entity_id, c.as_of as day, brand, c.as_of price_day, case when score >= 0.6 then 'positive' else 'negative' end direction, abs(score - 0.5) strength
 from qtr_cond c join entities using (entity_id) where score >= 0.6 or score <= 0.4""", "qtr_cond entities")
view("verdict_calls", "select c.*, abnormal_pct from (select * from read_calls union all select * from number_calls) c left join outcome_5 using (brand, price_day)", "read_calls number_calls outcome_5")
view("days_needed", "select distinct brand, price_day from findings union select distinct brand, as_of from qtr_brands union select 'Brand#' || (entity_id % 25 + 1), (generated_on - 8766)::date from briefs", "findings qtr_brands briefs")


@query("read_versus_number_calls", "EVT-09", _summary("(" + _vote("verdict_calls", "source,") + ")", "source"), "verdict_calls")
def _(t):
    d = events.abnormal_outcomes(verdict_calls(t), t.bars, t.benchmark_bars, "price_day", 5)
    return events.summarise(events.cluster_by_event(d, ["source"]), ["source"])


def verdict_calls(t):
    """What briefs said and what the numbers said, a call each."""
    from pitlens.operators import composites
    b = briefs(t).filter("stance <> 'mixed'").selectExpr(
        "'read' AS source", "entity_id", "generated_on AS day", "concat('Brand#', entity_id % 25 + 1) AS brand", "date_sub(generated_on, 8766) AS price_day",
        "CASE WHEN stance LIKE '%negative' THEN 'negative' ELSE 'positive' END AS direction", "confidence AS strength")
    c = composites.weighted_composite(scored(t, QUARTERLY)).filter("score >= 0.6 OR score <= 0.4").join(t.entities.select("entity_id", "brand"), "entity_id").selectExpr(
        "'numbers' AS source", "entity_id", "as_of AS day", "brand", "as_of AS price_day", "CASE WHEN score >= 0.6 THEN 'positive' ELSE 'negative' END AS direction", "abs(score - 0.5) AS strength")
    return cut_lineage(b.unionByName(c))


_by_horizon = lambda calls, hs: "(" + " union all ".join(f"select {h} horizon, c.*, abnormal_pct from {calls} c left join outcome_{h} using (brand, price_day)" for h in hs) + ")"
_outcomes = lambda hs: " ".join(f"outcome_{h}" for h in hs)


def _keyed_summary(src, keys):
    """A summary by source and horizon, as one key and told apart again."""
    return f"select * exclude (k), split_part(k, '|', 1) source, split_part(k, '|', 2)::int horizon from ({_summary(f'(select *, source || chr(124) || horizon k from {src})', 'k')})"


view("all_calls", "select * from read_calls union all select * from number_calls", "read_calls number_calls")


@query("verdicts_by_horizon", "EVT-09", _keyed_summary("(" + _vote(_by_horizon("all_calls", (1, 5, 21)), "horizon, source,") + ")", "source"), "all_calls " + _outcomes((1, 5, 21)))
def _(t):
    d = events.outcomes_by_horizon(verdict_calls(t), t.bars, t.benchmark_bars, "price_day", (1, 5, 21))
    return events.summarise(events.cluster_by_event(d, ["source", "horizon"]), ["source", "horizon"])


view("assessment_calls", """select 'assessments' source, external_id, a.entity_id, a.day, f.brand, f.price_day, a.direction, a.score strength from assessed a join findings f on f.finding_id = a.external_id where a.score > 0
 union all select 'findings', finding_id, entity_id, day, brand, price_day, coalesce(direction, 'neutral'), priority from ranked_findings""", "assessed findings ranked_findings")


@query("evaluate_assessments", "EVT-06", _keyed_summary("(" + _vote(_by_horizon("assessment_calls", (1, 5, 21)), "horizon, source,") + ")", "source"), "assessment_calls " + _outcomes((1, 5, 21)))
def _(t):
    from pitlens.plans.stream_queries import assessed
    f = t.findings.select(F.col("finding_id").alias("external_id"), "brand", "price_day")
    a = assessed(t).filter("score > 0").select("external_id", "entity_id", "day", "direction", F.col("score").alias("strength")).join(f, "external_id").withColumn("source", F.lit("assessments"))
    r = ranked(t).selectExpr("finding_id AS external_id", "entity_id", "day", "coalesce(direction, 'neutral') AS direction", "priority AS strength", "brand", "price_day", "'findings' AS source")
    d = events.outcomes_by_horizon(cut_lineage(a.unionByName(r)), t.bars, t.benchmark_bars, "price_day", (1, 5, 21))
    return events.summarise(events.cluster_by_event(d, ["source", "horizon"]), ["source", "horizon"])


view("scored_briefs", """select entity_id, 'Brand#' || (entity_id % 25 + 1) brand, (generated_on - 8766)::date price_day, case stance when 'strong_negative' then -2.0 when 'negative' then -1.0 when 'positive' then 1.0 when 'strong_positive' then 2.0 else 0.0 end::double v,
 case when n >= 4 then 'several' else 'few' end depth from briefs""", "briefs")


@query("verdicts_versus_prices", "EVT-10", f"""select depth, horizon, count(*) n, {R('case when min(rv) < max(rv) and min(ra) < max(ra) then corr(rv, ra) end', 6)} spearman, {R('avg(a) filter (v > 0) + 1e-9', 4)} mean_excess_positive, {R('avg(a) filter (v < 0) + 1e-9', 4)} mean_excess_negative,
 {R('avg(a) filter (v > 0) - avg(a) filter (v < 0) + 1e-9', 4)} spread from (select *, rank() over (partition by depth, horizon order by v) + (count(*) over (partition by depth, horizon, v) - 1) / 2.0 rv, rank() over (partition by depth, horizon order by a) + (count(*) over (partition by depth, horizon, a) - 1) / 2.0 ra
 from (select *, abnormal_pct a from {_by_horizon('scored_briefs', (21, 63))} where abnormal_pct is not null and v <> 0)) group by 1, 2 having count(*) >= 10""", "scored_briefs " + _outcomes((21, 63)))
def _(t):
    b = briefs(t).selectExpr("entity_id", "concat('Brand#', entity_id % 25 + 1) AS brand", "date_sub(generated_on, 8766) AS price_day", "CASE WHEN n >= 4 THEN 'several' ELSE 'few' END AS depth",
                             "CASE stance WHEN 'strong_negative' THEN -2D WHEN 'negative' THEN -1D WHEN 'positive' THEN 1D WHEN 'strong_positive' THEN 2D ELSE 0D END AS v")
    d = events.outcomes_by_horizon(cut_lineage(b), t.bars, t.benchmark_bars, "price_day", (21, 63))
    return events.agreement_with_prices(d, ["depth", "horizon"], "v")


view("verdict_later", """select b.entity_id, b.generated_on, case when stance like '%negative' then -1.0 when stance like '%positive' then 1.0 else 0.0 end v, avg(s.sign) later, b.n,
 case when b.n >= 8 then 'deep' when b.n >= 4 then 'some' else 'thin' end depth from briefs b join signed s on s.entity_id=b.entity_id and s.day > b.generated_on and s.day <= b.generated_on + 9 and s.sign is not null group by 1,2,3,5""", "briefs signed")


@query("verdict_versus_later_findings", "EVT-10", f"""select depth, count(*) n, count(*) filter (sign(v)=sign(later)) agree, {R('case when min(rv) < max(rv) then corr(rv, rl) end', 6)} spearman from (select *, rank() over (partition by depth order by v) + (count(*) over (partition by depth, v) - 1) / 2.0 rv,
 rank() over (partition by depth order by l) + (count(*) over (partition by depth, l) - 1) / 2.0 rl from (select *, round(later, 9) l from verdict_later)) group by 1 having count(*) >= 3""", "verdict_later")
def _(t):
    d = verdicts_and_later(t)
    rho = stats.spearman(d, ["depth"], "v", "later", "spearman", digits=6)
    agree = d.groupBy("depth").agg(F.count_if(F.signum("v") == F.signum("later")).alias("agree"))
    return rho.filter("n >= 3").join(agree, "depth")


def verdicts_and_later(t):
    """v, later, depth: what each brief said, and the mean sign of the findings of the nine days after it."""
    from pitlens.operators.feeds import daily_window_sum
    daily = signed(t).filter("sign IS NOT NULL").groupBy("entity_id", "day").agg(F.sum("sign").alias("s"), F.count(F.lit(1)).alias("c"))
    b = briefs(t)
    later = daily_window_sum(b.select("entity_id", "generated_on"), daily, ["entity_id"], "generated_on", 9, ["s", "c"]).filter("c > 0")
    return b.join(later, ["entity_id", "generated_on"]).selectExpr(
        "CASE WHEN stance LIKE '%negative' THEN -1D WHEN stance LIKE '%positive' THEN 1D ELSE 0D END AS v", "round(s / c, 9) AS later",
        "CASE WHEN n >= 8 THEN 'deep' WHEN n >= 4 THEN 'some' ELSE 'thin' END AS depth")


_log_choose = "lgamma(n + 1.0) - lgamma(j + 1.0) - lgamma(n - j + 1.0)"


@query("verdict_agreement", "EVT-10", f"""select depth, n, agree, {R('agree / n::double', 6)} agreement, {R(f'case when 2 * m = n then 1.0::double else least(1.0, 2 * list_sum(list_transform(range(0, m + 1), lambda j: exp({_log_choose} - n * ln(2.0::double))))) end', 8)} p_vs_coinflip
 from (select depth, count(*) n, count(*) filter (sign(v)=sign(later)) agree, least(count(*) filter (sign(v)=sign(later)), count(*) filter (sign(v)<>sign(later))) m from verdict_later where v <> 0 group by 1)""", "verdict_later")
def _(t):
    d = events.agreement(verdicts_and_later(t).filter("v <> 0"), ["depth"], "v", "later")
    return d.select("depth", "n", "agree", F.round("agreement", 6).alias("agreement"), F.round("p_vs_coinflip", 8).alias("p_vs_coinflip"))


# ---- sector moves and precedents ------------------------------------------------
view("brand_sectors", "select distinct p_brand brand, cast(replace(p_brand,'Brand#','') as int) % 4 sector from part")
from pitlens.plans.price_queries import _ret  # noqa: E402

view("grid", "select m.brand, m.sector, g.at_date, (g.at_date + 20)::date until from (select distinct sector, at_date from finding_days join brand_sectors using (brand)) g join brand_sectors m using (sector)", "finding_days brand_sectors")
view("grid_own", _ret("grid", "at_date", "until", "own"), "grid bars")
view("grid_market", _ret("(select distinct at_date, until from grid)", "at_date", "until", "market", False), "grid benchmark_bars")


@query("sector_move_after", "EVT-02", f"""select brand, at_date::varchar at_date, peers, peers_percent, versus_peers_percent, abs(peers_percent) >= abs(versus_peers_percent) moved_together from (
 select o.brand, o.at_date, s.n - 1 peers, {R('((s.s - own) / (s.n - 1) - market) * 100', 2)} peers_percent, {R('(own - (s.s - own) / (s.n - 1)) * 100', 2)} versus_peers_percent
 from grid_own o join (select sector, at_date, sum(own) s, count(own) n from grid_own group by 1,2) s using (sector, at_date) join grid_market m on m.at_date=o.at_date
 join finding_days f on f.brand=o.brand and f.at_date=o.at_date where own is not null and market is not null and s.n - 1 >= 5)""", "grid_own grid_market finding_days")
def _(t):
    members = t.part.select(F.col("p_brand").alias("brand")).distinct().withColumn("sector", F.expr("int(replace(brand, 'Brand#', '')) % 4"))
    return events.sector_move_after(t.findings, t.bars, t.benchmark_bars, members, "price_day")


view("cases", """select distinct x.topic, h.sector, f.entity_id ticker, f.day, m.abnormal_percent move from findings f join topic_hits x using (finding_id) join holders h on h.entity_id=f.entity_id
 join moves m on m.brand=f.brand and m.at_date=f.price_day""", "findings topic_hits holders moves")


def cases(t):
    f = t.findings.select("entity_id", "brand", "day", "price_day", F.expr(f"explode({tx.topics_of('summary')})").alias("topic")).dropDuplicates(["entity_id", "day", "topic"])
    m = prices.move_after(t.findings, t.bars, t.benchmark_bars, "price_day").select("brand", F.col("at_date").alias("price_day"), F.col("abnormal_percent").alias("move"))
    # topics multiply findings, which the size estimate of a broadcast does not see
    return f.hint("merge").join(m, ["brand", "price_day"]).join(t.holders.select("entity_id", "sector"), "entity_id").select("topic", "sector", F.col("entity_id").alias("ticker"), "day", "move")


@query("precedent_cases", "EVT-11", "select topic, sector, ticker, day::varchar as day, move from cases", "cases")
def _(t):
    return cases(t)


_rec = """select c.topic, a.ticker, {scope} as scope, count(*) cases, count(distinct c.ticker) companies, median(move) med, count(*) filter (move < 0) / count(*)::double neg, list_sort(list(move)) v, avg(move) m, stddev_pop(move) sd
 from (select distinct topic, ticker, sector from cases) a join cases c on c.topic=a.topic and c.ticker <> a.ticker {extra} group by all having count(*) >= {least} and count(distinct c.ticker) >= 8"""
view("records", _rec.format(scope="a.sector", extra="and c.sector=a.sector", least=20) + " union all " + _rec.format(scope="'*'", extra="", least=12), "cases")


@query("precedents", "EVT-12", f"""select topic, ticker, scope, cases, companies, median_percent, share_negative, low, high, t, greatest(share_negative, 1 - share_negative) >= 0.70 and case when t is null then abs(median_percent) >= 1.0 else abs(t) >= 2.9 end is_directional
 from (select topic, ticker, scope, cases, companies, {R('med', 3)} median_percent, {R('neg', 3)} share_negative, {R('v[floor(cases * 0.1)::int + 1]', 1)} low, {R('v[floor(cases * 0.9)::int + 1]', 1)} high,
 {R('case when sd > 0 then m / (sd / sqrt(cases)) end', 2)} t from records qualify row_number() over (partition by topic, ticker order by scope='*') = 1)""", "records")
def _(t):
    return events.precedent_lookup(cases(t))
