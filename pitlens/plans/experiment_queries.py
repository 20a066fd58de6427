"""Decision books, audits and integrity checks."""

from pyspark.sql import functions as F

from pitlens.operators import backtest as bt
from pitlens.operators import experiments as ex
from pitlens.plans.aggregate_queries import decisions
from pitlens.plans.backtest_queries import HORIZON, METRICS, _PATH, _book_sql, monthly
from pitlens.plans.feed_queries import briefs, ranked
from pitlens.plans.finding_queries import expected, signed
from pitlens.plans.registry import query
from pitlens.plans.scoring import AS_OF, scored
from pitlens.plans.views import R, view
from pitlens.session import cut_lineage

CONTROL = "1-URGENT"
view("book_lines", "select o_custkey cust, year(o_orderdate)::int y, o_orderpriority arm, p_brand brand, case when l_returnflag='R' then -l_extendedprice else l_extendedprice end v from lineitem join orders on l_orderkey=o_orderkey join part on l_partkey=p_partkey")
view("books", "select cust, y, arm, brand, v / sum(abs(v)) over (partition by cust, y, arm) w from (select cust, y, arm, brand, sum(v) v from book_lines group by 1,2,3,4)", "book_lines")
view("year_win", "select y, c.idx entry, x.mp / c.mp - 1 bench from (select distinct y from books) join month_cal c on c.session_date = make_date(y, 6, 30) join month_cal x on x.idx = c.idx + 3", "books month_cal")
view("year_ret", "select w.y, a.brand, b.price / a.price - 1 total, w.bench from year_win w join month_idx a on a.idx=w.entry join month_idx b on b.brand=a.brand and b.idx=w.entry+3", "year_win month_idx")


def books(t):
    """Signed share of each customer-year's order value by brand and priority arm; returned lines are shorts."""
    price = F.col("l_extendedprice")
    lines = t.lineitem.select("l_orderkey", "l_partkey", F.when(F.col("l_returnflag") == "R", -price).otherwise(price).alias("v"))
    orders = t.orders.select("o_orderkey", F.col("o_custkey").alias("cust"), F.year("o_orderdate").alias("y"), F.col("o_orderpriority").alias("arm"))
    li = lines.join(t.part.select("p_partkey", F.col("p_brand").alias("brand")), F.col("l_partkey") == F.col("p_partkey")).join(
        orders, F.col("l_orderkey") == F.col("o_orderkey")).select("cust", "y", "arm", "brand", "v")
    # nearly every line is a brand of its own in its book, so lines are dealt by book once, and brands and books are summed where they lie;
    # even a customer with many orders is dealt over its years and arms
    g = li.repartition("cust", "y", "arm").groupBy("cust", "y", "arm", "brand").agg(F.sum("v").alias("v"))
    # a book holds a row a brand at most
    return g.selectExpr("cust", "y", "arm", "brand", "v / sum(abs(v)) OVER (PARTITION BY cust, y, arm) AS w")


def windows(t):
    cal = bt.calendar(monthly(t.benchmark_bars))
    years = t.orders.select(F.year("o_orderdate").alias("y")).distinct().withColumn("as_of", F.make_date("y", F.lit(6), F.lit(30)))
    return cal, bt.on_calendar(years, cal, "as_of", HORIZON).drop("as_of")


def year_returns(t):
    cal, win = windows(t)
    idx = bt.indexed_returns(monthly(t.bars, "brand"), cal)
    pairs = idx.select("brand", F.col("idx").alias("entry")).join(win, "entry")
    return bt.window_totals(pairs, idx, HORIZON).select("y", "brand", "total", "bench")


def measured_books(t):
    cal, win = windows(t)
    return bt.measure_books(books(t).join(F.broadcast(win), "y"), bt.indexed_returns(monthly(t.bars, "brand"), cal), HORIZON, ["cust", "y", "arm"], 12, win)


def scored_books(t):
    """Measured books written once, for those that read them several times."""
    return cut_lineage(measured_books(t))


view("book_names", "select b.*, entry, bench from books b join year_win using (y)", "books year_win")
view("book_held", _PATH.format(src="book_names"), "book_names month_idx")
view("book_scores", _book_sql("book_names", "book_held", "cust, y, arm"), "book_names book_held")
_M = ("ret", "excess", "volatility", "max_drawdown", "hhi", "cash", "hit_rate")


@query("score_books", "EXP-12 BT-08 AGG-23", "select cust, y, arm, names, " + ", ".join(f"{R(c, 7)} {c}" for c in _M) + " from book_scores", "book_scores")
def _(t):
    return measured_books(t).select("cust", "y", "arm", "names", *[F.round(F.col(c) + 0.0, 7).alias(c) for c in _M])


view("pairs", f"select t.*, c.ret control_ret, c.excess control_excess, c.volatility control_volatility, c.max_drawdown control_max_drawdown, c.hhi control_hhi, c.cash control_cash, c.hit_rate control_hit_rate from book_scores t join book_scores c on c.cust=t.cust and c.y=t.y and c.arm='{CONTROL}' where t.arm <> '{CONTROL}'", "book_scores")


@query("paired_arms", "JON-17 EXP-10", "select arm, count(*) pairs, " + ", ".join(f"{R(f'avg({m} - control_{m})', 7)} {m}" for m in _M[:6]) + " from pairs group by 1", "pairs")
def _(t):
    p = ex.paired_arms(scored_books(t), CONTROL, _M)
    return p.groupBy("arm").agg(F.count(F.lit(1)).alias("pairs"), *[F.round(F.avg(F.col(m) - F.col(f"control_{m}")) + 0.0, 7).alias(m) for m in _M[:6]])


@query("arm_report", "EXP-04", " union all ".join(
    f"select arm, '{m}' metric, count(*) n, {R(f'avg({m} - control_{m})', 7)} estimate, {R(f'avg({m} - control_{m}) / (stddev_samp({m} - control_{m}) / sqrt(count(*)))', 4)} t, count(*) filter ({m} - control_{m} > 0) positive from pairs group by 1" for m in ("excess", "volatility", "hhi")), "pairs")
def _(t):
    p = ex.paired_arms(scored_books(t), CONTROL, _M)
    return ex.arm_report(p, ("excess", "volatility", "hhi")).select("arm", "metric", "n", F.round("estimate", 7).alias("estimate"), F.round("t", 4).alias("t"), "positive")


@query("amplification", "EXP-05", f"select arm, count(*) n, {R('regr_slope(excess, control_excess)', 6)} slope, {R('corr(excess, control_excess)', 6)} corr from pairs group by 1 having count(*) >= 4", "pairs")
def _(t):
    d = ex.amplification(ex.paired_arms(scored_books(t), CONTROL, _M), "excess")
    return d.select("arm", "n", F.round("slope", 6).alias("slope"), F.round("corr", 6).alias("corr"))


@query("arm_metrics", "EXP-06", f"select arm, count(*) books, {R('avg(excess)', 7)} excess, {R('avg(hit_rate)', 7)} hit_rate, {R('avg(names)', 6)} as names, {R('avg(gross)', 7)} gross from book_scores group by 1", "book_scores")
def _(t):
    return measured_books(t).groupBy("arm").agg(F.count(F.lit(1)).alias("books"), F.round(F.avg("excess"), 7).alias("excess"), F.round(F.avg("hit_rate"), 7).alias("hit_rate"),
                                              F.round(F.avg("names"), 6).alias("names"), F.round(F.avg("gross"), 7).alias("gross"))


@query("paired_effects", "EXP-01", f"""select arm, kind, count(*) n, {R('sum(contribution)', 6)} total from (select *, case when abs(delta) < 1e-9 then 'unchanged' when contribution < 0 then case when r > 0 then 'missed_upside' else 'added_loss' end else case when r < 0 then 'avoided_loss' else 'captured_upside' end end kind
 from (select b.arm, b.w - coalesce(c.w, 0) delta, coalesce(total, 0) r, (b.w - coalesce(c.w, 0)) * coalesce(total, 0) contribution from books b left join books c on c.cust=b.cust and c.y=b.y and c.brand=b.brand and c.arm='{CONTROL}' left join year_ret r on r.y=b.y and r.brand=b.brand
 where b.arm <> '{CONTROL}' and (b.cust, b.y) in (select cust, y from books where arm='{CONTROL}'))) group by 1,2""", "books year_ret")
def _(t):
    d = ex.paired_effects(cut_lineage(books(t)), CONTROL, year_returns(t).drop("bench"))
    return d.groupBy("arm", "kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("contribution") + 0.0, 6).alias("total"))


@query("decomposed_effects", "EXP-02", f"""select arm, effect, change, count(*) n, {R('sum(delta * excess)', 6)} total from (select *, case when delta > 0 then case when excess > 0 then 'captured_upside' else 'added_loss' end else case when excess > 0 then 'missed_upside' else 'avoided_loss' end end effect,
 case when wc = 0 then 'added' when wt = 0 then 'removed' when sign(wt) <> sign(wc) then 'flipped' else 'resized' end change from (select arm, coalesce(b.w, 0) wt, coalesce(c.w, 0) wc, coalesce(b.w, 0) - coalesce(c.w, 0) delta, total - bench excess from
 (select n.cust, n.y, n.arm, x.brand from (select distinct cust, y, arm from books where arm <> '{CONTROL}' and (cust, y) in (select cust, y from books where arm='{CONTROL}')) n join (select distinct b.cust, b.y, b.brand, b.arm from books b) x on x.cust=n.cust and x.y=n.y and x.arm in (n.arm, '{CONTROL}') group by all) u
 left join books b using (cust, y, arm, brand) left join (select cust, y, brand, w from books where arm='{CONTROL}') c using (cust, y, brand) join year_ret using (y, brand)) where abs(delta) >= 1e-9) group by 1,2,3""", "books year_ret")
def _(t):
    d = ex.decompose(cut_lineage(books(t)), CONTROL, year_returns(t))
    return d.groupBy("arm", "effect", "change").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("contribution") + 0.0, 6).alias("total"))


view("meta", "select y, brand, (n + y) % 3 - 1 verdict, (n * 7 + y) % 3 - 1 evidence from (select distinct y, brand, cast(replace(brand, 'Brand#', '') as int) n from books)", "books")


@query("anchoring", "EXP-03", f"""select arm, count(*) books, {R('avg(av / stated::double)', 6)} with_verdict, {R('avg(ae / leaning::double)', 6)} with_evidence, {R('sum(se)', 6)} silent_exposure, sum(sh)::bigint silent_held from (select cust, y, arm, count(*) filter (verdict <> 0 and sign(w) = verdict) av, count(*) filter (evidence <> 0 and sign(w) = evidence) ae,
 sum(case when verdict = 0 and evidence <> 0 then abs(w) else 0 end) se, count(*) filter (verdict = 0 and evidence <> 0) sh from books join meta using (y, brand) group by 1,2,3) join (select y, count(*) filter (verdict <> 0) stated, count(*) filter (evidence <> 0) leaning from meta group by 1) using (y) group by 1""", "books meta")
def _(t):
    b = cut_lineage(books(t))
    meta = b.select("y", "brand").distinct().withColumn("n", F.expr("int(replace(brand, 'Brand#', ''))")).selectExpr("y", "brand", "(n + y) % 3 - 1 AS verdict", "(n * 7 + y) % 3 - 1 AS evidence")
    d = ex.anchoring(b, meta)
    return d.groupBy("arm").agg(F.count(F.lit(1)).alias("books"), F.round(F.avg("with_verdict"), 6).alias("with_verdict"), F.round(F.avg("with_evidence"), 6).alias("with_evidence"),
                                F.round(F.sum("silent_exposure"), 6).alias("silent_exposure"), F.sum("silent_held").alias("silent_held"))


@query("degraded_arm", "EXP-07", """select finding_id from (select finding_id, routine, bool_or(routine) over (partition by entity_id) has_routine, row_number() over (partition by entity_id order by priority, finding_id) r, count(*) over (partition by entity_id) n
 from (select finding_id, r.entity_id, r.priority, coalesce(abs(excess) < 0.1, false) routine from ranked_findings r join expected e using (finding_id) where r.day >= date '2024-01-25')) where case when has_routine then routine else r <= n / 2 end""", "ranked_findings expected")
def _(t):
    from pyspark.sql import Window
    d = expected(t).filter("day >= date'2024-01-25'").select("finding_id", "entity_id", F.coalesce(F.abs("excess") < 0.1, F.lit(False)).alias("routine"))
    d = cut_lineage(d.join(ranked(t).select("finding_id", "priority"), "finding_id"))
    any_routine = d.groupBy("entity_id").agg(F.bool_or("routine").alias("some"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("entity_id").orderBy("priority", "finding_id")
    return d.join(any_routine, "entity_id").withColumn("r", F.row_number().over(w)).filter("CASE WHEN some THEN routine ELSE r <= n / 2 END").select("finding_id")


@query("evidence_lines", "EXP-08", """select entity_id, string_agg(key || ' ' || printf('%.4f', percentile), '; ' order by r) factors from (select *, row_number() over (partition by entity_id order by round(abs(percentile - 0.5), 6) desc, key) r from one_scored qualify r <= 8) group by 1""", "one_scored")
def _(t):
    from pitlens.operators.feeds import newest_per_key
    order = [F.round(F.abs(F.col("percentile") - 0.5), 6).desc(), F.col("key")]
    d = newest_per_key(scored(t, [AS_OF]), ["entity_id"], order, 8)
    return d.groupBy("entity_id").agg(F.expr("array_join(transform(array_sort(collect_list(struct(-round(abs(percentile - 0.5), 6) AS o, key, percentile AS p))), x -> concat(x.key, ' ', format_string('%.4f', x.p))), '; ') AS factors"))


@query("stance_panel", "EXP-09", f"""select generated_on::varchar generated_on, count(*) entities, count(*) filter (v * e < 0) disagreements, count(*) filter (v = 0 and e <> 0) silent_but_leaning, {R('avg(s)', 8)} mean_sign from (select b.entity_id, b.generated_on, case when stance like '%negative' then -1 when stance like '%positive' then 1 else 0 end v, coalesce(sign(sum(s.sign)), 0)::int e, avg(s.sign) s
 from briefs b left join signed s on s.entity_id=b.entity_id and s.day > b.generated_on - 7 and s.day <= b.generated_on and s.magnitude <> 'minor' group by 1,2,3) group by 1""", "briefs signed")
def _(t):
    week = F.expr("date_add(date'2024-01-07', 7 * int(datediff(day, date'2024-01-01') DIV 7))").alias("generated_on")
    e = signed(t).filter("magnitude <> 'minor'").groupBy("entity_id", week).agg(F.sum("sign").alias("e"), F.avg("sign").alias("s"))
    d = briefs(t).join(e, ["entity_id", "generated_on"], "left").selectExpr("generated_on", "CASE WHEN stance LIKE '%negative' THEN -1 WHEN stance LIKE '%positive' THEN 1 ELSE 0 END AS v", "int(signum(coalesce(e, 0D))) AS e", "s")
    return d.groupBy("generated_on").agg(F.count(F.lit(1)).alias("entities"), F.expr("count_if(v * e < 0) AS disagreements"), F.expr("count_if(v = 0 AND e <> 0) AS silent_but_leaning"), F.round(F.avg("s"), 8).alias("mean_sign"))


@query("experiment_grid", "EXP-11", f"""select arm, y, tier, row_number() over (order by y, tier, arm <> '{CONTROL}', arm) place from (select distinct o_orderpriority arm from orders), (select distinct year(o_orderdate)::int y from orders), (select distinct c_mktsegment tier from customer)""")
def _(t):
    """Arms, periods and tiers are label sets; each is folded to one array and exploded, controls first."""
    from pyspark.sql import Window
    o = t.orders.agg(F.collect_set("o_orderpriority").alias("arms"), F.collect_set(F.year("o_orderdate")).alias("years"))
    c = t.customer.agg(F.collect_set("c_mktsegment").alias("tiers"))
    d = o.withColumn("j", F.lit(1)).join(c.withColumn("j", F.lit(1)), "j").select(F.explode("arms").alias("arm"), "years", "tiers").select("arm", F.explode("years").alias("y"), "tiers").select("arm", "y", F.explode("tiers").alias("tier"))
    w = Window.orderBy("y", "tier", F.col("arm") != CONTROL, "arm")
    return d.withColumn("place", F.row_number().over(w).cast("long"))


@query("parsed_decisions", "FN-32", f"""select user_id, ticker, {R("case when action='buy' then weight else -weight end / greatest(1.0, sum(weight) over (partition by user_id))", 10)} w from (select user_id, brand ticker, case when shares % 3 = 0 then 'short' when shares % 7 = 0 then 'pass' else 'buy' end action, (round(shares / 500, 4) + 0.0) weight from positions) where action in ('buy','short') and weight > 0""", "positions")
def _(t):
    p = t.positions.selectExpr("user_id", "brand AS ticker", "CASE WHEN shares % 3 = 0 THEN 'short' WHEN shares % 7 = 0 THEN 'pass' ELSE 'buy' END AS action", "round(shares / 500, 4) AS weight")
    # a book is at most one position per brand
    texts = p.groupBy("user_id").agg(F.expr("concat('Here is the book: ', to_json(struct(collect_list(struct(ticker, action, weight)) AS positions)), ' Thank you.') AS reply"))
    d = ex.normalise_decisions(ex.parse_decisions(texts, ["user_id"], "reply"), ["user_id"])
    return d.select("user_id", "ticker", F.round("w", 10).alias("w"))


# ---- audits ------------------------------------------------------------------
@query("lookahead_audit", "DQ-01", """select kind, newest::varchar newest, newest <= date '2000-06-30' passes from (select 'fact' kind, max(filed_on) newest from facts where filed_on <= date '2000-06-30' union all select 'bar', max(session_date) from bars where session_date <= date '2000-06-30' union all select 'finding', max(price_day) from findings)""", "facts bars findings")
def _(t):
    cut = "<= date'2000-06-30'"
    return ex.lookahead_audit({"fact": (t.facts.filter(f"filed_on {cut}"), "filed_on"), "bar": (t.bars.filter(f"session_date {cut}"), "session_date"), "finding": (t.findings, "price_day")}, "2000-06-30")


@query("integrity_violations", "DQ-05", "select cohort, count(*) violations from decisions join (select l_orderkey id, max(l_shipdate)::date newest from lineitem group by 1) using (id) where newest > decisions.day + 60 group by 1", "decisions")
def _(t):
    prov = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.to_date(F.max("l_shipdate")).alias("newest"))
    return decisions(t).join(prov, "id").filter("newest > date_add(day, 60)").groupBy("cohort").agg(F.count(F.lit(1)).alias("violations"))


@query("validated_books", "DQ-07", """select count(*) books, count(*) filter (extra > 0) with_extra, sum(missing)::bigint missing, count(*) filter (oversized) oversized from (select cust, y, arm, count(*) filter (brand not in (select p_brand from part where p_type='PROMO')) extra,
 (select count(distinct p_brand) from part where p_type='PROMO') - count(*) filter (brand in (select p_brand from part where p_type='PROMO')) missing, sum(abs(w)) > 1.001 oversized from books group by 1,2,3)""", "books")
def _(t):
    universe = t.part.filter("p_type = 'PROMO'").select(F.col("p_brand").alias("brand")).distinct()
    d = ex.validate_books(books(t), universe, ["cust", "y", "arm"])
    return d.agg(F.count(F.lit(1)).alias("books"), F.expr("count_if(extra > 0) AS with_extra"), F.sum("missing").alias("missing"), F.expr("count_if(oversized) AS oversized"))


@query("decision_constraints", "DQ-08", """select id, problem from (select id, unnest(list_filter([case when cohort = '4-NOT SPECIFIED' then 'unknown cohort' end, case when length(repeat('because ', (id % 12)::int)) < 40 then 'short rationale' end,
 case when cohort = '1-URGENT' and conviction >= 0.8 then 'control cites points' end], lambda x: x is not null)) problem from decisions)""", "decisions")
def _(t):
    found = ("array(CASE WHEN cohort = '4-NOT SPECIFIED' THEN 'unknown cohort' END, CASE WHEN length(repeat('because ', int(id % 12))) < 40 THEN 'short rationale' END,"
             " CASE WHEN cohort = '1-URGENT' AND conviction >= 0.8 THEN 'control cites points' END)")
    return decisions(t).selectExpr("id", f"explode(filter({found}, x -> x IS NOT NULL)) AS problem")
