"""Rules, briefs, cases, summaries and digests."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from pitlens.functions import findings as fx
from pitlens.functions import text as tx
from pitlens.operators import briefs as br
from pitlens.operators import composites, feeds, norms, prices, rules
from pitlens.plans.aggregate_queries import trades
from pitlens.plans.feed_queries import _PRIORITY, ranked
from pitlens.plans.finding_queries import NOW, measured, signed
from pitlens.plans.registry import query
from pitlens.plans.scoring import AS_OF, scored
from pitlens.plans.views import R, view
from pitlens.session import cut_lineage

WINDOW, FALLBACK = 2, 12
_iw = 5


# ---- rules -------------------------------------------------------------------
def _ins(selling: str) -> str:
    return f"""select entity_id, arg_max(insiders, anchor) insiders, arg_max(transactions, anchor) transactions, (round(arg_max(total_usd, anchor), 4) + 0.0) total_usd, max(anchor)::varchar occurred_on,
 case when arg_max(insiders, anchor) > 3 then 'moderate' else 'minor' end magnitude, '{'insider_sell_cluster' if selling == 'true' else 'insider_buy_cluster'}' rule from (select a.entity_id, a.anchor, count(distinct owner)::int insiders, count(*) transactions, sum(usd) total_usd from
 (select distinct entity_id, day anchor from trades where open_market and disposed={selling} and usd >= 50000) a join trades t on t.entity_id=a.entity_id and t.day <= a.anchor and t.day >= a.anchor - {_iw} and open_market and disposed={selling} and usd >= 50000 group by 1,2 having count(distinct owner) >= 3) group by 1"""


@query("insider_clusters", "RUL-01 UDF-05", _ins("true") + " union all " + _ins("false"), "trades")
def _(t):
    both = rules.evaluate_rules([lambda d: rules.insider_cluster(d, True, _iw), lambda d: rules.insider_cluster(d, False, _iw)], trades(t))
    return both[0].unionByName(both[1]).select("entity_id", "insiders", "transactions", F.round("total_usd", 4).alias("total_usd"), "occurred_on", "magnitude", "rule")


@query("short_interest_spikes", "RUL-02", f"""select brand, mon::varchar occurred_on, previous, latest, {R('(latest / previous - 1) * 100', 1)} increase_percent, case when (latest / previous - 1) * 100 >= 50 then 'moderate' else 'minor' end magnitude from (
 select brand, month mon, volume latest, lag(volume) over (partition by brand order by month) previous, row_number() over (partition by brand order by month desc) r from (select brand, date_trunc('month', session_date)::date as month, arg_max(volume, session_date) volume from bars group by 1,2))
 where r = 1 and previous > 0 and latest >= previous * 1.2""", "bars")
def _(t):
    # the position of a month is the one of its last session, the settlement
    r = t.bars.groupBy("brand", F.trunc("session_date", "month").alias("at")).agg(F.max_by("volume", "session_date").alias("value"))
    return rules.short_interest_spike(r, "brand")


@query("finding_clusters", "RUL-03", f"""select entity_id, findings, documents, positive, negative, major, {R('delta', 6)} sentiment_delta, greatest(positive, negative) >= 3 drumbeat, major > 0 and findings >= 2 corroborated, coalesce(abs(delta) >= 0.5, false) swing,
 case when positive + negative = 0 then null when positive >= negative then 'positive' else 'negative' end dominant from (select entity_id, count(*) filter (i) findings, count(distinct document_id) filter (i) documents, count(*) filter (i and direction='positive') positive,
 count(*) filter (i and direction='negative') negative, count(*) filter (i and magnitude='major') major, avg(sentiment) filter (i) - avg(sentiment) filter (b) delta from (select *, occurred_at >= a - interval 2 day i, occurred_at < a - interval 2 day and occurred_at >= a - interval 22 day b
 from (select *, max(occurred_at) over (partition by entity_id) a from findings where finding_type <> 'insider_activity')) group by 1) where documents >= 2 and (greatest(positive, negative) >= 3 or (major > 0 and findings >= 2) or coalesce(abs(delta) >= 0.5, false))""", "findings")
def _(t):
    return rules.build_cluster(t.findings, 2, 20).withColumn("sentiment_delta", F.round("sentiment_delta", 6)).drop("anchor")


def earnings(t):
    """Report calendar per customer: every order is a report, pending ones are still to come."""
    cents = lambda x: f"round({x} * 100, 0) / 100"  # a half cent is settled on the product in doubles, not on the shortest decimal of the figure
    actual = cents("(o_totalprice / 100000 * (1 + ((o_orderkey % 21) - 10) / 100D))")
    estimate = cents("(o_totalprice / 100000)")
    d = t.orders.selectExpr("o_custkey AS entity_id", "to_date(o_orderdate) AS report_date", "o_orderkey", "o_orderstatus <> 'P' AS reported", f"{estimate} AS eps_estimate",
                            f"CASE WHEN o_orderstatus <> 'P' THEN {actual} END AS eps_actual", "element_at(array('before open', 'after close', 'during hours'), int(o_orderkey % 3) + 1) AS hour_label")
    return d.withColumn("surprise", F.expr("CASE WHEN reported AND eps_estimate <> 0 THEN round((eps_actual - eps_estimate) / abs(eps_estimate) * 100, 2) END"))


view("earnings_raw", """select o_custkey entity_id, o_orderdate::date report_date, o_orderkey, o_orderstatus <> 'P' reported, round(o_totalprice / 100000, 2) eps_estimate, case when o_orderstatus <> 'P' then round(o_totalprice / 100000 * (1 + ((o_orderkey % 21) - 10) / 100.0::double), 2) end eps_actual,
 ['before open', 'after close', 'during hours'][o_orderkey % 3 + 1] hour_label from orders""")
view("earnings", "select *, case when reported and eps_estimate <> 0 then (round((eps_actual - eps_estimate) / abs(eps_estimate) * 100, 2) + 0.0) end surprise from earnings_raw qualify row_number() over (partition by entity_id, report_date order by o_orderkey desc) = 1", "earnings_raw")
TODAY = "2001-06-01"


def per_date(t):
    return feeds.newest_per_key(earnings(t), ["entity_id", "report_date"], [F.col("o_orderkey").desc()], 1)


@query("latest_event_per_date", "WIN-12 FN-04", "select entity_id, report_date::varchar report_date, o_orderkey, surprise from earnings", "earnings")
def _(t):
    return per_date(t).select("entity_id", "report_date", "o_orderkey", F.col("surprise") + 0.0).withColumnRenamed("(surprise + 0.0)", "surprise")


view("outlook", f"""select entity_id, min(report_date) filter (up) next_date, arg_min(hour_label, report_date) filter (up) hour_label, arg_min(eps_estimate, report_date) filter (up) eps_estimate, count(surprise) reports_seen, count(*) filter (surprise > 0) beats, count(*) filter (surprise < 0) misses,
 (round(avg(surprise), 6) + 0.0) average_surprise, arg_max(surprise, report_date) filter (surprise is not null) last_surprise from (select *, not reported and report_date >= date '{TODAY}' up from earnings) group by 1""", "earnings")


@query("earnings_outlook", "RUL-05", f"select entity_id, next_date::varchar next_date, (next_date - date '{TODAY}')::int days_until, hour_label, eps_estimate, reports_seen, beats, misses, average_surprise, last_surprise, coalesce(next_date - date '{TODAY}' <= 7, false) is_imminent from outlook", "outlook")
def _(t):
    return rules.earnings_outlook(per_date(t), TODAY)


@query("earnings_tape", "TOP-04 FN-24", f"""select entity_id, case next_date - date '{TODAY}' when 0 then 'TODAY' when 1 then 'TOMORROW' else (next_date - date '{TODAY}') || 'D' end label, concat_ws(' · ', 'Reports ' || next_date || ', ' || hour_label, case when reports_seen >= 3 then 'ahead of consensus ' || beats || ' of the last ' || reports_seen end) detail
 from outlook where next_date - date '{TODAY}' <= 21""", "outlook")
def _(t):
    d = rules.earnings_outlook(per_date(t), TODAY).filter("days_until <= 21")
    return d.selectExpr("entity_id", "CASE days_until WHEN 0 THEN 'TODAY' WHEN 1 THEN 'TOMORROW' ELSE concat(days_until, 'D') END AS label",
                        "concat_ws(' · ', concat('Reports ', next_date, ', ', hour_label), CASE WHEN reports_seen >= 3 THEN concat('ahead of consensus ', beats, ' of the last ', reports_seen) END) AS detail")


@query("earnings_upcoming", "RUL-07", f"select entity_id, (next_date - date '{TODAY}')::int days_until from outlook join holders using (entity_id) where tier='MACHINERY'", "outlook holders")
def _(t):
    watch = t.holders.filter("tier = 'MACHINERY'").select("entity_id")
    d = rules.earnings_outlook(per_date(t), TODAY).join(watch, "entity_id")
    return d.select("entity_id", "days_until")


@query("last_report_move", "WIN-22", f"""select entity_id, report_date::varchar report_date, {R('(x.adjusted_close / i.adjusted_close - 1) * 100', 4)} change_percent from (select entity_id, max(report_date) report_date, 'Brand#' || (entity_id % 25 + 1) brand from earnings where reported group by 1) e
 join indexed i on i.brand=e.brand and i.session_date=(select min(session_date) from bars b where b.brand=e.brand and b.session_date >= e.report_date) join indexed x on x.brand=e.brand and x.idx=i.idx+2""", "earnings indexed bars")
def _(t):
    last = per_date(t).filter("reported").groupBy("entity_id").agg(F.max("report_date").alias("report_date")).selectExpr(
        "entity_id", "report_date", "concat('Brand#', entity_id % 25 + 1) AS brand", "date_sub(report_date, 1) AS eve")
    d = prices.forward_return(last, t.bars, "eve", 2, "change_percent").filter("change_percent IS NOT NULL")
    return d.select("entity_id", "report_date", "change_percent")


# ---- briefs --------------------------------------------------------------------
def read_findings(t):
    """Findings of the reading window with norms, parity, restatement and priority attached."""
    s = signed(t).withColumns({"dismissed": F.expr(fx.DISMISSED), "priority": F.expr(_PRIORITY),
                               "source": F.expr("CASE WHEN finding_type = 'insider_activity' THEN 'insider' ELSE genre END")})
    live = s.filter("NOT dismissed")
    again = norms.restated(live, asked=f"datediff(date'2024-01-31', day) <= {FALLBACK}").distinct().withColumn("is_restated", F.lit(True))
    d = norms.with_expected(br.reading_window(s, "2024-01-31", WINDOW, FALLBACK), measured(t))
    return norms.parity_weights(d).join(again, "finding_id", "left").withColumn("is_restated", F.coalesce("is_restated", F.lit(False))).withColumn(
        "unusual", F.expr("value >= 200"))


def residual(read, t):
    genre, sector = norms.measure_incidence(norms.document_counts(signed(t)))
    return norms.incidence_excess(norms.expected_counts(norms.document_counts(read), genre, sector)).select("entity_id", "residual")


view("read", f"""select e.*, priority, case when e.finding_type='insider_activity' then 'insider' else e.genre end source, e.value >= 200 unusual, 1 / sqrt(count(*) over (partition by e.document_id)) parity, e.finding_id in (select finding_id from restated_live) is_restated, not near fell_back
 from expected e join ranked_findings r using (finding_id) join (select entity_id, max(day) >= date '2024-01-31' - {WINDOW} near from ranked_findings where not dismissed and day >= date '2024-01-31' - {FALLBACK} group by 1) n on n.entity_id=e.entity_id
 where not r.dismissed and e.day >= date '2024-01-31' - case when near then {WINDOW} else {FALLBACK} end""", "expected ranked_findings restated_live")
view("restated_live", """select finding_id from stated a where not (k >= 92) and finding_type not in ('guidance_change','qoq_anomaly') and len(toks) > 0 and exists (select 1 from stated b where not (b.k >= 92)
 and b.entity_id=a.entity_id and b.finding_type=a.finding_type and b.occurred_at < a.occurred_at and b.document_id <> a.document_id
 and len(list_intersect(a.toks, b.toks)) >= 0.3 * len(list_distinct(list_concat(a.toks, b.toks))) and len(list_intersect(a.figs, b.figs)) = len(a.figs))""", "stated")
view("read_residual", """select entity_id, avg(v) residual from (select entity_id, greatest(-1.0, least(1.0, ((positive - ep) - (negative - eq)) / greatest(ep + eq, 1.0))) v from (
 select d.*, case when s.n >= 4 then s.p when g.n >= 4 then g.p else r.p end ep, case when s.n >= 4 then s.q when g.n >= 4 then g.q else r.q end eq, case when s.n >= 4 then s.n when g.n >= 4 then g.n else r.n end peers
 from (select document_id, entity_id, sector, genre, count(*) filter (sign > 0) positive, count(*) filter (sign < 0) negative from read group by 1,2,3,4) d left join inc_sector s using (sector, genre) left join inc_genre g on g.genre=d.genre, inc_root r)
 where peers >= 4 and positive + negative > 0) group by 1""", "read inc_sector inc_genre inc_root")
_cnt = "sign is not null and sign <> 0 and abs(excess) >= 0.1"
view("folded", f"""select *, coalesce(residual, weighted, 0.0) mean from (select entity_id, count(*) findings, count(*) filter (sign > 0) positive, count(*) filter (sign < 0) negative, count(sign) informative_n, count(*) filter (finding_type <> 'notable_quote') capable, count(distinct source) sources,
 sum(w * coalesce(excess, 0)) / nullif(sum(w), 0) weighted, sum(eff) informative, avg(confidence) mean_confidence, any_value(fell_back) fell_back from (select *, case when {_cnt} then parity * case when is_restated then 0.25 else 1.0 end else 0.0 end eff,
 case when {_cnt} then (case magnitude when 'minor' then 0.5 when 'moderate' then 1.0 else 2.0 end) * greatest(priority, 0.05) * parity * case when is_restated then 0.25 else 1.0 end * case when 2024 - (1995 + k % 30) >= 2 then 0.4 else 1.0 end else 0.0 end w from read) group by 1) left join read_residual using (entity_id)""", "read read_residual")
_thin = "informative < 3 or sources < 2"
view("briefed", f"""select *, case when stance='insufficient' then 0.0 else least(1.0, greatest(0.0, 0.4 * least(sources / 3.0, 1.0) + 0.25 * coalesce(greatest(positive, negative) / nullif(positive + negative, 0)::double, 0) + 0.15 * least(informative / 3, 1.0) + 0.2 * mean_confidence)) end confidence from (
 select *, case when coalesce((positive + negative) / nullif(capable, 0)::double, 0) < 0.4 then 'insufficient' when (positive + negative) / findings::double < 0.25 then 'quiet' when informative_n < 2 then 'insufficient'
 when mean <= -0.55 then case when {_thin} then 'negative' else 'strong_negative' end when mean <= -0.15 then 'negative' when mean >= 0.55 then case when {_thin} then 'positive' else 'strong_positive' end when mean >= 0.15 then 'positive' else 'mixed' end stance from folded)""", "folded")


def briefed(t):
    read = cut_lineage(read_findings(t))
    return read, br.fold(read, residual(read, t))


@query("build_briefs", "BRF-01 BRF-02", f"select entity_id, findings, positive, negative, sources, {R('informative', 6)} informative, {R('mean', 6)} mean, stance, {R('confidence', 6)} confidence, fell_back from briefed", "briefed")
def _(t):
    return briefed(t)[1].select("entity_id", "findings", "positive", "negative", "sources", *[F.round(c, 6).alias(c) for c in ("informative", "mean", "confidence")], "stance", "fell_back")


@query("brief_counterpoints", "TOP-16", "select entity_id, first(finding_id order by round(coalesce(abs(excess), 0), 9) desc, priority desc, finding_id) finding_id from read join briefed using (entity_id) where (stance like '%positive' and sign < 0) or (stance like '%negative' and sign > 0) group by 1", "read briefed")
def _(t):
    read, b = briefed(t)
    return br.counterpoint(read.withColumn("excess", F.round("excess", 9)), b.select("entity_id", "stance"))


@query("brief_drivers", "TOP-15 BRF-11")
def _(t):
    read = cut_lineage(read_findings(t))
    d = br.driver_support(br.pick_distinct(read), read)
    return d.select("entity_id", "finding_id", "place", "supporting", F.array_join("sources", ",").alias("sources"))


@query("brief_changes_since", "BRF-03", """select entity_id, count(*) fresh, count(*) filter (direction='negative') negative, count(*) filter (direction='positive') positive, first(finding_id order by priority desc, finding_id) lead_id from ranked_findings where occurred_at > timestamp '2024-01-28' and not dismissed group by 1""", "ranked_findings")
def _(t):
    d = ranked(t).filter("occurred_at > timestamp'2024-01-28' AND NOT dismissed")
    return d.groupBy("entity_id").agg(F.count(F.lit(1)).alias("fresh"), F.count_if(F.col("direction") == "negative").alias("negative"), F.count_if(F.col("direction") == "positive").alias("positive"),
                                      F.max_by("finding_id", F.struct("priority", -F.col("finding_id"))).alias("lead_id"))


_age = "greatest(floor((epoch_us(timestamp '2024-01-31') - epoch_us(occurred_at)) / 86400000000.0)::bigint, date_diff('day', make_date(1995 + k % 30, 12, 31), date '2024-01-31'))"


@query("side_ages", "BRF-04", f"""select *, abs(positive_days - negative_days) gap_days, coalesce(abs(positive_days - negative_days) >= 180, false) is_imbalanced from (select entity_id, case when count(*) filter (direction='positive') >= 2 then floor(median({_age}) filter (direction='positive'))::int end positive_days,
 case when count(*) filter (direction='negative') >= 2 then floor(median({_age}) filter (direction='negative'))::int end negative_days from findings where direction is not null group by 1)""", "findings")
def _(t):
    return br.side_ages(t.findings, fx.effective_age_days("occurred_at", "quote", NOW))


# ---- contradictions, cases ---------------------------------------------------------
view("wide", """select h.entity_id, tone, insider, stance, f.score composite, p.* exclude (entity_id), m.abnormal_percent move_percent, coalesce(abs(m.sigma) >= 1.5, false) move_material from (select distinct entity_id from findings) h
 left join (select entity_id, avg(sentiment) tone from findings where sentiment is not null group by 1) using (entity_id) left join (select entity_id, case arg_max(k % 3, occurred_at) when 0 then 'negative' when 1 then 'positive' end insider from findings where finding_type='insider_activity' group by 1) using (entity_id)
 left join (select entity_id, stance from briefed) using (entity_id) left join (select entity_id, score from one_cond) f using (entity_id) left join (select entity_id, """ + ", ".join(f"max(percentile) filter (key='{k}') {k}" for k in ("accruals", "revenue_growth", "asset_growth", "return_on_assets", "momentum", "earnings_yield", "sales_yield", "book_to_price")) + """ from one_scored group by 1) p on p.entity_id=h.entity_id
 left join (select entity_id, arg_max(brand, day) brand, arg_max(price_day, day) at_date from findings where day <= date '2024-01-10' group by 1) d on d.entity_id=h.entity_id left join moves m on m.brand=d.brand and m.at_date=d.at_date""", "findings briefed one_cond one_scored moves")
PCT = ("accruals", "revenue_growth", "asset_growth", "return_on_assets", "momentum", "earnings_yield", "sales_yield", "book_to_price")


def wide(t, stances):
    f = t.findings
    tone = f.groupBy("entity_id").agg(F.avg("sentiment").alias("tone"), F.expr("max_by(CASE k % 3 WHEN 0 THEN 'negative' WHEN 1 THEN 'positive' END, CASE WHEN finding_type = 'insider_activity' THEN occurred_at END) AS insider"))
    s = cut_lineage(scored(t, [AS_OF]))
    pct = s.groupBy("entity_id").agg(*[F.max(F.when(F.col("key") == k, F.col("percentile"))).alias(k) for k in PCT])
    comp = composites.weighted_composite(s).select("entity_id", F.col("score").alias("composite"))
    last = f.filter("day <= date'2024-01-10'").groupBy("entity_id").agg(F.max_by("brand", "day").alias("brand"), F.max_by("price_day", "day").alias("price_day"))
    mv = prices.move_after(last, t.bars, t.benchmark_bars, "price_day").select("brand", F.col("at_date").alias("price_day"), F.col("abnormal_percent").alias("move_percent"), F.col("is_material").alias("move_material"))
    last = last.join(mv, ["brand", "price_day"], "left").drop("brand", "price_day")
    d = tone.join(stances.select("entity_id", "stance"), "entity_id", "left").join(comp, "entity_id", "left").join(pct, "entity_id", "left").join(last, "entity_id", "left")
    return d.withColumn("move_material", F.coalesce("move_material", F.lit(False)))


_cheap = " + ".join(f"coalesce({k} <= 0.2, false)::int" for k in ("earnings_yield", "sales_yield", "book_to_price"))
view("contradicted", f"""select entity_id, unnest(list_filter([case when tone >= 0.3 and accruals <= 0.2 then 'tone_vs_cash' end, case when tone >= 0.3 and insider='negative' then 'tone_vs_insiders' end, case when revenue_growth >= 0.8 and accruals <= 0.2 then 'growth_vs_quality' end,
 case when asset_growth <= 0.2 and return_on_assets >= 0.8 then 'expansion_vs_returns' end, case when momentum >= 0.8 and ({_cheap}) >= 2 then 'price_vs_value' end,
 case when stance in ('positive','strong_positive','negative','strong_negative') and ((stance like '%positive' and composite <= 0.2) or (stance not like '%positive' and composite >= 0.8)) then 'reading_vs_numbers' end,
 case when stance in ('positive','strong_positive','negative','strong_negative') and move_material and (stance like '%positive') <> (move_percent > 0) then 'reading_vs_tape' end], lambda x: x is not null)) contradiction from wide""", "wide")


@query("contradictions", "RUL-04", "select entity_id, contradiction from contradicted", "contradicted")
def _(t):
    return rules.contradictions(wide(t, briefed(t)[1]))


@query("positioning", "RUL-06", f"""select entity_id, {R('net', 2)} insider_net_usd, b.short shares_short, coalesce(b.short >= 250, false) short_crowded, {R('s.range_position', 3)} range_position from (select entity_id, sum(case when disposed then -usd else usd end) net, 'Brand#' || (entity_id % 25 + 1) brand from trades where open_market group by 1)
 left join (select brand, arg_max(volume, session_date) as short from bars group by 1) b using (brand) left join (select brand, case when count(*) >= 30 and max(adjusted_close) > min(adjusted_close) then (arg_max(adjusted_close, session_date) - min(adjusted_close)) / (max(adjusted_close) - min(adjusted_close)) end range_position
 from bars where session_date between date '2000-06-30' - 365 and date '2000-06-30' group by 1) s using (brand)""", "trades bars")
def _(t):
    net = trades(t).filter("open_market").groupBy("entity_id").agg(F.expr("round(sum(CASE WHEN disposed THEN -usd ELSE usd END), 2) AS insider_net_usd")).withColumn("brand", F.expr("concat('Brand#', entity_id % 25 + 1)"))
    short = t.bars.groupBy("brand").agg(F.max_by("volume", "session_date").alias("shares_short"))
    rng = t.bars.filter("session_date BETWEEN date_sub(date'2000-06-30', 365) AND date'2000-06-30'").groupBy("brand").agg(F.expr(
        "round(CASE WHEN count(1) >= 30 AND max(adjusted_close) > min(adjusted_close) THEN (max_by(adjusted_close, session_date) - min(adjusted_close)) / (max(adjusted_close) - min(adjusted_close)) END, 3) AS range_position"))
    return net.join(short, "brand", "left").join(rng, "brand", "left").selectExpr("entity_id", "insider_net_usd", "shares_short", "coalesce(shares_short >= 250, false) AS short_crowded", "range_position")


view("points", """select entity_id, 'contradiction:' || contradiction as key, contradiction headline, 'unclear' side, 100 weight from contradicted union all
 select entity_id, 'factor:' || key, key || case when percentile >= 0.9 then ' best' else ' worst' end, case when percentile >= 0.9 then 'for' else 'against' end, 70 from one_scored where (percentile <= 0.1 or percentile >= 0.9) and key not in ('earnings_yield','cash_flow_yield','sales_yield','book_to_price') union all
 select entity_id, 'finding:' || finding_id, summary, case direction when 'positive' then 'for' when 'negative' then 'against' else 'unclear' end, case when unusual then 85 when magnitude='major' then 60 else 40 end from read union all
 select entity_id, 'prior:watching', 'watching', 'unclear', 20 from holders where entity_id % 5 <> 0""", "contradicted one_scored read holders")


def points(t, read, stances):
    c = rules.contradictions(wide(t, stances)).selectExpr("entity_id", "concat('contradiction:', contradiction) AS key", "contradiction AS headline", "'unclear' AS side", "100 AS weight")
    f = scored(t, [AS_OF]).filter("(percentile <= 0.1 OR percentile >= 0.9) AND key NOT IN ('earnings_yield', 'cash_flow_yield', 'sales_yield', 'book_to_price')").selectExpr(
        "entity_id", "concat('factor:', key) AS key", "concat(key, CASE WHEN percentile >= 0.9 THEN ' best' ELSE ' worst' END) AS headline", "CASE WHEN percentile >= 0.9 THEN 'for' ELSE 'against' END AS side", "70 AS weight")
    r = read.selectExpr("entity_id", "concat('finding:', finding_id) AS key", "summary AS headline", "CASE direction WHEN 'positive' THEN 'for' WHEN 'negative' THEN 'against' ELSE 'unclear' END AS side",
                        "CASE WHEN unusual THEN 85 WHEN magnitude = 'major' THEN 60 ELSE 40 END AS weight")
    w = t.holders.filter("entity_id % 5 <> 0").selectExpr("entity_id", "'prior:watching' AS key", "'watching' AS headline", "'unclear' AS side", "20 AS weight")
    return c.unionByName(f).unionByName(r).unionByName(w)


view("case_file", """select *, row_number() over (partition by entity_id order by weight desc, side <> 'unclear' desc, key) place from (select entity_id, lower(trim(headline)) headline, weight, side, key from points qualify row_number() over (partition by entity_id, lower(trim(headline)) order by weight desc, side <> 'unclear' desc, key desc) = 1)""", "points")


@query("case_files", "BRF-05 TOP-17", "select entity_id, headline, weight, side, key, place::int place, place > 12 withheld from case_file", "case_file")
def _(t):
    read, b = briefed(t)
    return br.case_points(points(t, read, b))


@query("strongest_point_against", "BRF-12", "select entity_id, first(key order by weight desc, key desc) as key, max(weight) weight from case_file join briefed using (entity_id) where (stance like '%positive' and side='against') or (stance like '%negative' and side='for') group by 1", "case_file briefed")
def _(t):
    read, b = briefed(t)
    b = cut_lineage(b)
    return br.strongest_against(br.case_points(points(t, read, b)), b.select("entity_id", "stance"))


# ---- summaries ---------------------------------------------------------------------
view("tones", "select entity_id, sentiment, row_number() over (partition by entity_id order by occurred_at desc, finding_id desc) r from ranked_findings where sentiment is not null and not dismissed", "ranked_findings")
view("entity_summary", """select f.entity_id, count(*) findings, count(*) filter (finding_type='new_risk_factor') risks, count(*) filter (direction='negative') bearish, count(*) filter (direction='positive') bullish, count(*) filter (magnitude='major') major, avg(confidence) avg_confidence,
 first(finding_id order by priority desc, finding_id) top_finding, any_value(t.now) sentiment, any_value(t.now - t.was) trend, any_value(t.spark) sparkline from ranked_findings f left join (select entity_id, max(sentiment) filter (r=1) now, max(sentiment) filter (r=2) was, string_agg(round(sentiment, 3)::varchar, ' ' order by r desc) filter (r <= 8) spark from tones group by 1) t using (entity_id)
 where not dismissed group by 1""", "ranked_findings tones")


def entity_summary(t):
    live = ranked(t).filter("NOT dismissed")
    last = feeds.newest_per_key(live.filter("sentiment IS NOT NULL"), ["entity_id"], [F.col("occurred_at").desc(), F.col("finding_id").desc()], 8)
    w = Window.partitionBy("entity_id").orderBy(F.col("occurred_at").desc(), F.col("finding_id").desc())
    tones = last.withColumn("r", F.row_number().over(w)).groupBy("entity_id").agg(
        F.expr("max(CASE WHEN r = 1 THEN sentiment END) AS sentiment"), F.expr("max(CASE WHEN r = 1 THEN sentiment END) - max(CASE WHEN r = 2 THEN sentiment END) AS trend"),
        F.expr("array_join(transform(array_sort(collect_list(struct(-r AS o, round(sentiment, 3) AS s))), x -> string(x.s)), ' ') AS sparkline"))
    g = live.groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("findings"), F.expr("count_if(finding_type = 'new_risk_factor') AS risks"), F.expr("count_if(direction = 'negative') AS bearish"), F.expr("count_if(direction = 'positive') AS bullish"),
        F.expr("count_if(magnitude = 'major') AS major"), F.avg("confidence").alias("avg_confidence"), F.max_by("finding_id", F.struct("priority", -F.col("finding_id"))).alias("top_finding"))
    return g.join(tones, "entity_id", "left")


@query("entity_summaries", "BRF-06 WIN-19", f"select entity_id, findings, risks, bearish, bullish, major, {R('avg_confidence + 1e-12', 9)} avg_confidence, top_finding, {R('sentiment', 6)} sentiment, {R('trend', 6)} trend, length(sparkline) - length(replace(sparkline, ' ', '')) + 1 as readings from entity_summary", "entity_summary")
def _(t):
    return entity_summary(t).selectExpr("entity_id", "findings", "risks", "bearish", "bullish", "major", "round(avg_confidence + 1e-12, 9) AS avg_confidence", "top_finding", "round(sentiment, 6) AS sentiment", "round(trend, 6) AS trend",
                                        "bigint(size(split(sparkline, ' '))) AS readings").withColumn("readings", F.when(F.col("sentiment").isNotNull(), F.col("readings")))


@query("portfolio_summary", "AGG-33", f"select count(*) entities, sum(risks)::bigint risks, {R('avg(sentiment)', 6)} avg_sentiment, count(*) filter (trend > 0) trend_up, count(*) filter (trend < 0) trend_down, first(entity_id order by findings desc, entity_id) most_active from entity_summary", "entity_summary")
def _(t):
    return entity_summary(t).agg(F.count(F.lit(1)).alias("entities"), F.sum("risks").alias("risks"), F.round(F.avg("sentiment"), 6).alias("avg_sentiment"), F.expr("count_if(trend > 0) AS trend_up"),
                                 F.expr("count_if(trend < 0) AS trend_down"), F.max_by("entity_id", F.struct("findings", -F.col("entity_id"))).alias("most_active"))


@query("evidence_packets", "BRF-07", """select c.entity_id, c.findings, c.documents, coalesce(x.n, 0) contradictions, coalesce(p.n, 0) ranks, v.observed_negative from (select entity_id, count(*) findings, count(distinct document_id) documents from findings where day <= date '2024-01-20' group by 1) c
 left join (select entity_id, count(*) n from contradicted group by 1) x using (entity_id) left join (select entity_id, count(*) n from one_scored group by 1) p using (entity_id) left join (select entity_id, sum(negative)::bigint observed_negative from inc_expected group by 1) v using (entity_id)""", "findings contradicted one_scored inc_expected")
def _(t):
    from pitlens.operators.aggregates import coverage
    from pitlens.plans.finding_queries import incidence
    c = coverage(t.findings, "2024-01-20").select("entity_id", "findings", "documents")
    x = rules.contradictions(wide(t, briefed(t)[1])).groupBy("entity_id").agg(F.count(F.lit(1)).alias("contradictions"))
    p = scored(t, [AS_OF]).groupBy("entity_id").agg(F.count(F.lit(1)).alias("ranks"))
    v = incidence(t).groupBy("entity_id").agg(F.sum("negative").alias("observed_negative"))
    d = c.join(x, "entity_id", "left").join(p, "entity_id", "left").join(v, "entity_id", "left")
    return d.fillna(0, ["contradictions", "ranks"])


@query("user_digests", "BRF-08", """select user_id, f.brand, held, count(*) changes from (select user_id, brand, true held from positions where shares >= 150 union all select c_custkey, 'Brand#' || (c_custkey % 25 + 1), false from customer where c_mktsegment='MACHINERY'
 and (c_custkey, 'Brand#' || (c_custkey % 25 + 1)) not in (select user_id, brand from positions where shares >= 150)) u join findings f on f.brand=u.brand where value >= 250 and f.day > date '2024-01-31' - case when user_id % 3 = 0 then 14 else 7 end group by 1,2,3""", "positions findings")
def _(t):
    held = t.positions.filter("shares >= 150").selectExpr("user_id", "brand", "true AS held")
    watch = t.customer.filter("c_mktsegment = 'MACHINERY'").selectExpr("c_custkey AS user_id", "concat('Brand#', c_custkey % 25 + 1) AS brand", "false AS held").join(held.select("user_id", "brand"), ["user_id", "brand"], "left_anti")
    # changes fold to one row per brand and day before they meet the users
    daily = t.findings.filter("value >= 250").groupBy("brand", "day").agg(F.count(F.lit(1)).alias("n"))
    d = held.unionByName(watch).join(daily, "brand").filter("day > date_sub(date'2024-01-31', CASE WHEN user_id % 3 = 0 THEN 14 ELSE 7 END)")
    return d.groupBy("user_id", "brand", "held").agg(F.sum("n").alias("changes"))


@query("finding_rows", "BRF-09", f"""select finding_id, 'Unfocused: ' || summary summary, {R('least(greatest(confidence, 0.0), 1.0) * 0.85', 8)} confidence from findings where k % 4 = 3 union all select finding_id, summary, {R('least(greatest(confidence, 0.0), 1.0)', 8)} from findings where k % 4 <> 3""", "findings")
def _(t):
    return t.findings.selectExpr("finding_id", "CASE WHEN k % 4 = 3 THEN concat('Unfocused: ', summary) ELSE summary END AS summary",
                                 "round(least(greatest(confidence, 0D), 1D) * CASE WHEN k % 4 = 3 THEN 0.85D ELSE 1D END, 8) AS confidence")


@query("aligned_replies", "BRF-10", """select conv_id, turn, k::int reply_index from (select conv_id, turn, (turn % 5) k, row_number() over (partition by conv_id, turn % 5 order by turn) r, count(*) over (partition by conv_id) n from conversations) where k between 1 and n and r = 1""")
def _(t):
    d = t.conversations.selectExpr("conv_id", "turn", "int(turn % 5) AS reply_index")
    n = d.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    first = d.groupBy("conv_id", "reply_index").agg(F.min("turn").alias("turn"))
    return first.join(n, "conv_id").filter("reply_index BETWEEN 1 AND n").select("conv_id", "turn", "reply_index")
