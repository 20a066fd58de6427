"""Feeds, context joins, selections and set operations."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from pitlens.functions import findings as fx
from pitlens.operators import feeds, ranks
from pitlens.plans.aggregate_queries import trades  # noqa: F401
from pitlens.plans.finding_queries import NOW, signed
from pitlens.plans.registry import query
from pitlens.plans.views import R, view

_PRIORITY = "round(" + fx.priority_score("finding_type", "confidence", "occurred_at", "magnitude", NOW) + ", 6)"
view("ranked_findings", """select *, k >= 92 dismissed, k between 83 and 91 reviewed, (round(least(greatest(confidence, 0.0), 1.0) * case finding_type when 'new_risk_factor' then 1.0
 when 'guidance_change' then 0.9 when 'insider_activity' then 0.85 when 'sentiment_shift' then 0.7 when 'notable_quote' then 0.6 else 0.5 end * case magnitude when 'major' then 1.35 when 'minor' then 0.75 else 1.0 end
 * exp(-(epoch_us(timestamp '2024-01-31') - epoch_us(occurred_at)) / 86400000000.0 / 90.0), 6) + 0.0) priority from findings""", "findings")


def ranked(t):
    return t.findings.selectExpr("*", f"{fx.DISMISSED} AS dismissed", f"{fx.REVIEWED} AS reviewed", f"{_PRIORITY} AS priority")


@query("findings_feed", "FLT-02", """select finding_id, entity_id, priority from ranked_findings where event_type='error' and occurred_at >= timestamp '2024-01-10' and confidence >= 0.1
 and not dismissed and not reviewed order by priority desc, occurred_at desc, finding_id limit 100""", "ranked_findings")
def _(t):
    return feeds.findings_feed(ranked(t), kind="error", since="2024-01-10", min_confidence=0.1, unreviewed=True).select("finding_id", "entity_id", "priority")


view("held_documents", "select document_id, genre, day published, count(*) findings from findings group by 1,2,3", "findings")


@query("findings_page", "FLT-03 JON-08", """select finding_id, name, d.published::varchar published from ranked_findings f left join holders using (entity_id) left join held_documents d using (document_id)
 order by d.published desc nulls last, finding_id limit 50 offset 100""", "ranked_findings holders held_documents")
def _(t):
    docs = t.findings.groupBy("document_id").agg(F.max("day").alias("published"))
    d = t.findings.select("finding_id", "entity_id", "document_id").join(t.holders.select("entity_id", "name"), "entity_id", "left").join(docs, "document_id", "left")
    return feeds.page(d, "findings", [F.col("published").desc_nulls_last(), F.col("finding_id")], 50, 100).select("finding_id", "name", "published")


@query("document_timeline", "FLT-04", """select entity, doc_id, published::varchar published, row_number() over (partition by entity order by published desc, doc_id desc) pos
 from filings where subtype='en' qualify pos <= 20""", "filings")
def _(t):
    w = Window.partitionBy("entity").orderBy(F.col("published").desc_nulls_last(), F.col("doc_id").desc())
    return t.filings.filter("subtype = 'en'").select("entity", "doc_id", "published").withColumn("pos", F.row_number().over(w).cast("long")).filter("pos <= 20")


@query("entity_search", "FLT-05", "select entity_id, name from holders where name ilike '%r#00000001%' or tier ilike 'mach%'", "holders")
def _(t):
    return t.holders.filter(F.col("name").ilike("%r#00000001%") | F.col("tier").ilike("mach%")).select("entity_id", "name")


@query("facts_for_entity", "FLT-06", f"""select entity_id, period_end::varchar period_end, {R('value', 5)} as value from facts where metric='revenue' and period='quarter' and filed_on >= date '1997-01-01'
 qualify row_number() over (partition by entity_id order by period_end desc) <= 5""", "facts")
def _(t):
    d = t.facts.filter("metric = 'revenue' AND period = 'quarter' AND filed_on >= date'1997-01-01'")
    return feeds.newest_per_key(d, ["entity_id"], [F.col("period_end").desc()], 5).select("entity_id", "period_end", F.round("value", 5).alias("value"))


@query("sentiment_series", "FLT-07", f"select entity_id, finding_id, {R('sentiment', 6)} sentiment from findings where sentiment is not null", "findings")
def _(t):
    return t.findings.filter("sentiment IS NOT NULL").select("entity_id", "finding_id", F.round("sentiment", 6).alias("sentiment"))


view("now_date", "select max(published) at from filings", "filings")


@query("recent_documents", "FLT-08", """select entity, subtype, doc_id from filings where published <= date '2022-06-30' and (subtype <> 'de' or published >= date '2022-06-30' - 90)
 qualify subtype='de' or row_number() over (partition by entity, subtype order by published desc, doc_id desc) <= case when subtype='es' then 2 else 1 end""", "filings")
def _(t):
    return feeds.recent_documents(t.filings, "2022-06-30", "en", "fr", "de", "es").select("entity", "subtype", "doc_id")


@query("recent_news", "FLT-09", """select entity_id, finding_id from findings where genre='news' and day between date '2024-01-31' - 14 and date '2024-01-31'
 qualify row_number() over (partition by entity_id order by occurred_at desc, finding_id) <= 15""", "findings")
def _(t):
    d = t.findings.filter("genre = 'news' AND day BETWEEN date_sub(date'2024-01-31', 14) AND date'2024-01-31'")
    return feeds.newest_per_key(d, ["entity_id"], [F.col("occurred_at").desc(), F.col("finding_id")], 15).select("entity_id", "finding_id")


@query("provenance", "FLT-11", """select finding_id, case when genre='news' and k % 2 = 0 then 'full text' else case genre when '10-K' then 'full filing' when '10-Q' then 'full filing' when '8-K' then 'full filing' when 'news' then 'summary' end end held,
 case genre when 'news' then 'link' else 'text' end offered from findings""", "findings")
def _(t):
    table = {"10-K": ("full filing", "text"), "10-Q": ("full filing", "text"), "8-K": ("full filing", "text"), "news": ("summary", "link")}
    m = F.create_map(*[F.lit(x) if isinstance(x, str) else F.struct(F.lit(x[0]).alias("held"), F.lit(x[1]).alias("offered")) for kv in table.items() for x in kv])
    d = t.findings.withColumn("p", m[F.col("genre")])
    return d.select("finding_id", F.when((F.col("genre") == "news") & (F.col("k") % 2 == 0), "full text").otherwise(F.col("p.held")).alias("held"), "p.offered")


@query("findings_since_with_dismissed", "FLT-14", "select entity_id, count(*) findings, count(*) filter (dismissed) dismissed from ranked_findings where occurred_at >= timestamp '2024-01-20' group by 1", "ranked_findings")
def _(t):
    return ranked(t).filter("occurred_at >= timestamp'2024-01-20'").groupBy("entity_id").agg(F.count(F.lit(1)).alias("findings"), F.count_if("dismissed").alias("dismissed"))


# ---- briefs as a weekly table ----------------------------------------------
_ST = "case when m <= -0.55 then 'strong_negative' when m <= -0.15 then 'negative' when m >= 0.55 then 'strong_positive' when m >= 0.15 then 'positive' else 'mixed' end"
view("briefs", f"select entity_id, generated_on, {_ST} stance, least(n / 10.0, 1.0)::double confidence, n from (select entity_id, (date '2024-01-07' + 7 * ((day - date '2024-01-01') // 7)::int)::date generated_on, avg(sign) m, count(*) n from signed where sign is not null group by 1,2)", "signed")
STANCE_RANK = {"strong_negative": -2, "negative": -1, "mixed": 0, "positive": 1, "strong_positive": 2}


def briefs(t):
    g = signed(t).filter("sign IS NOT NULL").groupBy(
        "entity_id", F.expr("date_add(date'2024-01-07', 7 * int(datediff(day, date'2024-01-01') DIV 7))").alias("generated_on")).agg(
        F.avg("sign").alias("m"), F.count(F.lit(1)).alias("n"))
    return g.selectExpr("entity_id", "generated_on", f"{_ST} AS stance", "least(n / 10D, 1D) AS confidence", "n")


@query("brief_history", "FLT-15 JON-19", """select entity_id, generated_on::varchar generated_on, stance, row_number() over (partition by entity_id order by generated_on desc) pos from briefs qualify pos <= 3""", "briefs")
def _(t):
    w = Window.partitionBy("entity_id").orderBy(F.col("generated_on").desc())
    return briefs(t).withColumn("pos", F.row_number().over(w).cast("long")).filter("pos <= 3").select("entity_id", "generated_on", "stance", "pos")


@query("latest_brief_per_entity", "JON-19", "select entity_id, max(generated_on)::varchar generated_on, arg_max(stance, generated_on) stance from briefs group by 1", "briefs")
def _(t):
    return feeds.latest(briefs(t), ["entity_id"], "generated_on", ["stance"])


_RANK = "case {} " + " ".join(f"when '{k}' then {v}" for k, v in STANCE_RANK.items()) + " else 0 end"
view("verdict_changes", f"""select c.entity_id, c.generated_on, p.stance was, c.stance now from (select * from briefs qualify row_number() over (partition by entity_id order by generated_on desc) = 1) c
 join lateral (select stance from briefs b where b.entity_id=c.entity_id and b.generated_on < c.generated_on and b.stance <> c.stance order by generated_on desc limit 1) p on true
 where c.generated_on >= date '2024-01-25' and sign({_RANK.format('p.stance')}) <> sign({_RANK.format('c.stance')})""", "briefs")


def verdict_changes(t):
    b = briefs(t)
    cur = feeds.latest(b, ["entity_id"], "generated_on", ["stance"]).filter("generated_on >= date'2024-01-25'").selectExpr("entity_id", "generated_on", "stance AS now")
    was = b.selectExpr("entity_id", "generated_on AS at", "stance").join(cur, "entity_id").filter("at < generated_on AND stance <> now")
    prev = was.groupBy("entity_id", "generated_on", "now").agg(F.max_by("stance", "at").alias("was"))
    rank = lambda c: _RANK.format(c)
    return prev.filter(f"signum({rank('was')}) <> signum({rank('now')})").select("entity_id", "generated_on", "was", "now")


@query("verdict_changes", "WIN-13", "select entity_id, generated_on::varchar generated_on, was, now from verdict_changes", "verdict_changes")
def _(t):
    return verdict_changes(t)


@query("watchlist_findings", "FLT-16", "select entity_id, count(*) findings from findings where entity_id in (select entity_id from holders where tier='MACHINERY') group by 1", "findings holders")
def _(t):
    watch = t.holders.filter("tier = 'MACHINERY'").select("entity_id")
    return t.findings.join(watch, "entity_id").groupBy("entity_id").agg(F.count(F.lit(1)).alias("findings"))


@query("documents_analysed", "FLT-17", "select doc_id, exists (select 1 from labels l where l.doc_id=d.doc_id) is_analysed from documents d")
def _(t):
    done = t.labels.select("doc_id").distinct().withColumn("done", F.lit(True))
    return t.documents.select("doc_id").join(done, "doc_id", "left").select("doc_id", F.coalesce("done", F.lit(False)).alias("is_analysed"))


# ---- joins -----------------------------------------------------------------
@query("prior_filing", "JON-07", "select doc_id, lag(doc_id) over (partition by entity, subtype order by published) prior_id from filings", "filings")
def _(t):
    d = feeds.previous_in_order(t.filings.select("doc_id", "entity", "subtype", "published"), ["entity", "subtype"], "published", ["doc_id"], "unix_date(published) DIV 90")
    return d.select("doc_id", F.col("prior.doc_id").alias("prior_id"))


view("priors_meta", "select entity_id, (date '2024-01-05' - 40 * (entity_id % 7)::int)::date generated_on from holders where entity_id % 5 <> 0", "holders")


@query("needs_prior", "JON-09", """select entity_id, case when generated_on is null then 1 else 2 end::int urgency from holders left join priors_meta using (entity_id)
 where tier in ('MACHINERY','BUILDING') and (generated_on is null or generated_on < date '2024-01-31' - 120)""", "holders priors_meta")
def _(t):
    pri = t.holders.filter("entity_id % 5 <> 0").selectExpr("entity_id", "date_sub(date'2024-01-05', int(40 * (entity_id % 7))) AS generated_on")
    newest = pri.groupBy("entity_id").agg(F.max("generated_on").alias("generated_on"))
    d = t.holders.filter(F.col("tier").isin("MACHINERY", "BUILDING")).join(newest, "entity_id", "left")
    d = d.withColumn("urgency", F.expr("CASE WHEN generated_on IS NULL THEN 1 WHEN generated_on < date_sub(date'2024-01-31', 120) THEN 2 END"))
    return d.filter("urgency IS NOT NULL").select("entity_id", "urgency")


@query("never_read_in_read_order", "JON-10 TOP-05", """select h.entity_id, coalesce(r.n, 0) sector_reads, row_number() over (order by coalesce(r.n, 0), size desc, h.entity_id) pos from holders h
 left join (select sector, count(distinct entity_id) n from findings join holders using (entity_id) group by 1) r using (sector)
 where tier='MACHINERY' and entity_id not in (select entity_id from findings) order by pos""", "holders findings")
def _(t):
    read = t.findings.select("entity_id").distinct()
    counts = t.holders.join(read, "entity_id", "left_semi").groupBy("sector").agg(F.count(F.lit(1)).alias("n"))
    d = t.holders.filter("tier = 'MACHINERY'").join(read, "entity_id", "left_anti").join(counts, "sector", "left").withColumn("sector_reads", F.coalesce("n", F.lit(0)))
    return ranks.position_in_order(d, "size", ["entity_id"], "pos", "sector_reads", descending=True).select("entity_id", "sector_reads", "pos")


@query("unanalysed_filing", "JON-11", """select entity, arg_max(doc_id, published) doc_id from filings where subtype in ('en','fr') and doc_id not in (select doc_id from labels) group by 1""", "filings")
def _(t):
    d = t.filings.filter(F.col("subtype").isin("en", "fr")).join(t.labels.select("doc_id"), "doc_id", "left_anti")
    return d.groupBy("entity").agg(F.max_by("doc_id", "published").alias("doc_id"))


@query("panel_with_bars_and_facts", "JON-12", """select entity_id from entities where brand in (select brand from bars where session_date >= date '2001-01-01') and entity_id in (select entity_id from facts where metric='equity')""", "entities bars facts")
def _(t):
    return t.entities.join(t.bars.filter("session_date >= date'2001-01-01'").select("brand"), "brand", "left_semi").join(
        t.facts.filter("metric = 'equity'").select("entity_id"), "entity_id", "left_semi").select("entity_id")


@query("events_after_prior", "JON-13", "select finding_id from findings join priors_meta using (entity_id) where day > generated_on", "findings priors_meta")
def _(t):
    pri = t.holders.filter("entity_id % 5 <> 0").selectExpr("entity_id", "date_sub(date'2024-01-05', int(40 * (entity_id % 7))) AS generated_on")
    return t.findings.join(pri, "entity_id").filter("day > generated_on").select("finding_id")


@query("later_findings_per_verdict", "JON-18", """select b.entity_id, generated_on::varchar generated_on, count(s.finding_id) later, coalesce(sum(s.sign), 0)::double later_sign from briefs b left join signed s
 on s.entity_id=b.entity_id and s.day > generated_on and s.day <= generated_on + 9 group by 1, b.generated_on""", "briefs signed")
def _(t):
    daily = signed(t).groupBy("entity_id", "day").agg(F.count(F.lit(1)).alias("later"), F.sum("sign").alias("later_sign"))
    d = feeds.daily_window_sum(briefs(t).select("entity_id", "generated_on"), daily, ["entity_id"], "generated_on", 9, ["later", "later_sign"])
    return d.withColumn("later_sign", F.col("later_sign").cast("double"))


@query("placebo_rotation", "JON-20", """select entity_id, lead(entity_id, 1, (select min(entity_id) from findings)) over (order by entity_id) receives_from from (select distinct entity_id from findings)""", "findings")
def _(t):
    covered = ranks.position_in_order(t.findings.select("entity_id").distinct(), "entity_id", [], "pos")
    n = covered.agg(F.count(F.lit(1)).alias("n"))
    nxt = covered.select(F.col("entity_id").alias("receives_from"), F.col("pos").alias("_p"))
    d = covered.join(F.broadcast(n)).withColumn("_p", F.col("pos") % F.col("n") + 1)
    return d.join(nxt, "_p").select("entity_id", "receives_from")


@query("peers_by_size", "JON-21", """select a.entity_id, b.entity_id peer, row_number() over (partition by a.entity_id order by b.size desc nulls last, b.entity_id) pos
 from holders a join holders b on a.sector=b.sector and a.entity_id <> b.entity_id qualify pos <= 25""", "holders")
def _(t):
    d = feeds.top_others(t.holders.select("entity_id", "sector", "size"), "sector", "entity_id", [F.col("size").desc_nulls_last(), F.col("entity_id")], 25)
    return d.selectExpr("entity_id", "peer", "bigint(pos) AS pos")


# ---- selections ------------------------------------------------------------
@query("tape_news", "TOP-03", """select entity, doc_id from (select * from filings where subtype='en' and published > (select max(published) from filings) - 60
 qualify row_number() over (partition by entity order by published desc, doc_id desc) <= 3) order by published desc, doc_id desc limit 24""", "filings")
def _(t):
    newest = t.filings.agg(F.max("published").alias("at"))
    d = t.filings.select("entity", "subtype", "doc_id", "published").join(F.broadcast(newest)).filter("subtype = 'en' AND published > date_sub(at, 60)")
    few = feeds.newest_per_key(d, ["entity"], [F.col("published").desc(), F.col("doc_id").desc()], 3)
    return few.orderBy(F.col("published").desc(), F.col("doc_id").desc()).limit(24).select("entity", "doc_id")


view("doc_counts", "select entity_id, count(distinct document_id) docs from findings group by 1", "findings")


def doc_counts(t):
    return t.findings.groupBy("entity_id").agg(F.countDistinct("document_id").alias("docs"))


@query("round_robin_needs", "TOP-06", """select brand, min_by_turn.turn, min_by_turn.user_id from (select brand, min(struct_pack(turn := turn, user_id := user_id)) min_by_turn from (
 select user_id, brand, row_number() over (partition by user_id order by shares, brand) turn from positions where shares < 60) group by 1)""", "positions")
def _(t):
    d = feeds.round_robin(t.positions.filter("shares < 60"), "user_id", "brand", [F.col("shares"), F.col("brand")])
    return d.selectExpr("brand", "bigint(turn) AS turn", "user_id")


@query("by_reach", "TOP-07", """select hub, count(*) dependents, sum(mention_count)::bigint mentions, row_number() over (order by count(*) desc, sum(mention_count), hub) pos from exposures where mention_count >= 8 group by 1""", "exposures")
def _(t):
    g = t.exposures.filter("mention_count >= 8").groupBy("hub").agg(F.count(F.lit(1)).alias("dependents"), F.sum("mention_count").alias("mentions"))
    # one row per nation: the order is over a table of proven size
    return g.withColumn("pos", F.row_number().over(Window.orderBy(F.col("dependents").desc(), "mentions", "hub")).cast("long"))


@query("needs_depth", "TOP-08 TOP-18", "select entity_id, coalesce(docs, 0) docs from holders left join doc_counts using (entity_id) where coalesce(docs, 0) < 30 order by docs is null, coalesce(docs, 0), size desc, entity_id limit 60", "holders doc_counts")
def _(t):
    d = t.holders.join(doc_counts(t), "entity_id", "left").withColumn("seen", F.col("docs").isNull()).withColumn("docs", F.coalesce("docs", F.lit(0)))
    return d.filter("docs < 30").orderBy("seen", "docs", F.col("size").desc_nulls_last(), "entity_id").limit(60).select("entity_id", "docs")


@query("filings_to_refresh", "TOP-19", "select entity_id, max(day)::varchar newest, count(distinct document_id) docs from findings group by 1 having count(distinct document_id) >= 4 order by max(day), entity_id limit 50", "findings")
def _(t):
    g = t.findings.groupBy("entity_id").agg(F.max("day").alias("newest"), F.countDistinct("document_id").alias("docs"))
    return g.filter("docs >= 4").orderBy("newest", "entity_id").limit(50)


QUOTA = 40
view("q_held", "select entity_id, row_number() over (order by size desc, entity_id) pos from holders where tier='BUILDING'", "holders")
view("q_reach", "select entity_id, row_number() over (order by docs desc, entity_id) pos from doc_counts", "doc_counts")
view("q_breadth", "select entity_id, row_number() over (order by entity_id) pos from holders where tier='MACHINERY'", "holders")
view("q_a", "select entity_id, 0 claim, row_number() over (order by pos) turn from q_held qualify turn <= 20", "q_held")
view("q_b", "select entity_id, 1 claim, row_number() over (order by pos) turn from q_reach where entity_id not in (select entity_id from q_a) qualify turn <= least(10, 40 - (select count(*) from q_a))", "q_reach q_a")
view("q_c", """select entity_id, 2 claim, row_number() over (order by pos) turn from q_breadth where entity_id not in (select entity_id from q_a union all select entity_id from q_b)
 qualify turn <= 40 - (select count(*) from q_a) - (select count(*) from q_b)""", "q_breadth q_a q_b")


@query("share_quota", "TOP-09", "select * from q_a union all select * from q_b union all select * from q_c", "q_a q_b q_c")
def _(t):
    # a claim is filled within its own share and what the claims before it already name, so 4 times the quota is never short
    place = lambda d, *order: d.orderBy(*order).limit(4 * QUOTA).withColumn("pos", F.row_number().over(Window.orderBy(*order)))
    held = place(t.holders.filter("tier = 'BUILDING'"), F.col("size").desc(), F.col("entity_id"))
    reach = place(doc_counts(t), F.col("docs").desc(), F.col("entity_id"))
    breadth = place(t.holders.filter("tier = 'MACHINERY'"), F.col("entity_id"))
    return feeds.share_quota([(held, 20), (reach, 10), (breadth, QUOTA)], "entity_id", QUOTA).selectExpr("entity_id", "claim", "bigint(turn) AS turn")


@query("rotate_stalest", "TOP-10", "select entity_id, max(day)::varchar analysed from holders left join findings using (entity_id) group by 1 order by max(day) nulls first, entity_id limit 8", "holders findings")
def _(t):
    last = t.findings.groupBy("entity_id").agg(F.max("day").alias("analysed"))
    return t.holders.select("entity_id").join(last, "entity_id", "left").orderBy(F.col("analysed").asc_nulls_first(), "entity_id").limit(8)


@query("pick_universe", "TOP-11", "select entity_id, count(*) n from findings join holders using (entity_id) where day <= date '2024-01-20' group by entity_id, size having count(*) >= 5 order by n desc, size desc, entity_id limit 60", "findings holders")
def _(t):
    g = t.findings.filter("day <= date'2024-01-20'").groupBy("entity_id").agg(F.count(F.lit(1)).alias("n")).filter("n >= 5")
    return g.join(t.holders.select("entity_id", "size"), "entity_id").orderBy(F.col("n").desc(), F.col("size").desc(), "entity_id").limit(60).select("entity_id", "n")


@query("stratified_sample", "TOP-12")
def _(t):
    d = ranks.position_in_order(t.holders, "size", ["entity_id"], "rank", descending=True)
    d = d.withColumn("stratum", F.expr("CASE WHEN rank <= 150 THEN 'mega' WHEN rank <= 450 THEN 'mid' ELSE 'small' END"))
    return feeds.newest_per_key(d, ["stratum"], [F.xxhash64("entity_id", F.lit(17)), F.col("entity_id")], 20).select("stratum", "entity_id")


@query("size_positions", "TOP-12", "select entity_id, row_number() over (order by size desc, entity_id) as rank from holders", "holders")
def _(t):
    return ranks.position_in_order(t.holders, "size", ["entity_id"], "rank", descending=True).select("entity_id", "rank")


@query("covered_and_uncovered", "TOP-13", """(select 'covered' side, entity_id from findings join holders using (entity_id) group by entity_id, size having count(*) >= 3 order by count(*) desc, size desc, entity_id limit 28)
 union all (select 'uncovered', entity_id from holders where entity_id not in (select entity_id from findings) order by size desc, entity_id limit 12)""", "findings holders")
def _(t):
    n = t.findings.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n")).filter("n >= 3").join(t.holders.select("entity_id", "size"), "entity_id")
    a = n.orderBy(F.col("n").desc(), F.col("size").desc(), "entity_id").limit(28).selectExpr("'covered' AS side", "entity_id")
    b = t.holders.join(t.findings.select("entity_id"), "entity_id", "left_anti").orderBy(F.col("size").desc(), "entity_id").limit(12).selectExpr("'uncovered' AS side", "entity_id")
    return a.unionByName(b)


@query("brief_order", "TOP-14", """select entity_id, stance, row_number() over (order by case stance when 'strong_negative' then 0 when 'strong_positive' then 1 when 'negative' then 2 when 'positive' then 3 else 4 end, confidence desc, entity_id) pos
 from (select * from briefs qualify row_number() over (partition by entity_id order by generated_on desc) = 1) order by pos""", "briefs")
def _(t):
    d = feeds.latest(briefs(t), ["entity_id"], "generated_on", ["stance", "confidence"])
    d = d.withColumn("urgency", F.expr("CASE stance WHEN 'strong_negative' THEN 0 WHEN 'strong_positive' THEN 1 WHEN 'negative' THEN 2 WHEN 'positive' THEN 3 ELSE 4 END"))
    return ranks.position_in_order(d, "confidence", ["entity_id"], "pos", "urgency", descending=True).select("entity_id", "stance", "pos")


@query("derived_tiers", "TOP-20", "select entity_id, case when entity_id in (select user_id from positions where shares > 100) then 'focus' else tier end tier from holders", "holders positions")
def _(t):
    held = t.positions.filter("shares > 100").select(F.col("user_id").alias("entity_id")).distinct().withColumn("held", F.lit(True))
    return t.holders.join(held, "entity_id", "left").selectExpr("entity_id", "CASE WHEN held THEN 'focus' ELSE tier END AS tier")


# ---- sets ------------------------------------------------------------------
@query("new_notices", "SET-02", """select finding_id from findings where day = date '2024-01-30' and entity_id in (select entity_id from holders where tier <> 'FURNITURE')
 and (entity_id, event_type) not in (select entity_id, event_type from findings where day = date '2024-01-29')""", "findings holders")
def _(t):
    seen = t.findings.filter("day = date'2024-01-29'").select("entity_id", "event_type")
    tracked = t.holders.filter("tier <> 'FURNITURE'").select("entity_id")
    return t.findings.filter("day = date'2024-01-30'").join(seen, ["entity_id", "event_type"], "left_anti").join(tracked, "entity_id", "left_semi").select("finding_id")


_words = lambda c: f"list_filter(string_split_regex(lower({c}), '\\s+'), lambda w: length(w) > 3)"
view("word_counts", f"select entity, subtype, w, count(*) n from (select entity, subtype, unnest({_words('text')}) w from filings) group by 1,2,3", "filings")


@query("multiset_divergence", "SET-05", f"""select a.entity, a.subtype one, b.subtype other, {R('1 - coalesce(c.n, 0) / (a.n + b.n - coalesce(c.n, 0))::double', 6)} divergence
 from (select entity, subtype, sum(n) n from word_counts group by 1,2) a join (select entity, subtype, sum(n) n from word_counts group by 1,2) b on a.entity=b.entity and a.subtype < b.subtype
 left join (select x.entity, x.subtype one, y.subtype other, sum(least(x.n, y.n)) n from word_counts x join word_counts y on x.entity=y.entity and x.w=y.w and x.subtype < y.subtype group by 1,2,3) c on c.entity=a.entity and c.one=a.subtype and c.other=b.subtype""", "word_counts")
def _(t):
    return feeds.multiset_divergence(t.filing_texts.selectExpr("entity", "subtype", r"explode(filter(split(lower(text), '\\s+'), w -> length(w) > 3)) AS item"), "entity", "subtype", "item")


@query("event_grouping", "SET-06", """select entity_id, topics, count(*) items, max(value) lead_score, max(day)::varchar newest from (select f.*, coalesce(x.topics, '') topics from findings f
 left join (select finding_id, array_to_string(list_sort(list(topic)), ',') topics from topic_hits group by 1) x using (finding_id)) group by 1,2""", "findings topic_hits")
def _(t):
    from pitlens.functions import text as tx
    d = t.findings.selectExpr("entity_id", "value", "day", f"array_join(array_sort({tx.topics_of('summary')}), ',') AS topics")
    return d.groupBy("entity_id", "topics").agg(F.count(F.lit(1)).alias("items"), F.max("value").alias("lead_score"), F.max("day").alias("newest"))


@query("recent_changes", "SET-01", f"""select * from (select 'verdict' kind, 3 severity, entity_id, generated_on::varchar occurred, was || '>' || now what from verdict_changes
 union all select 'factor', 2, entity_id, '2024-01-30', key || ':' || crossing from factor_changes
 union all select 'event', 1, entity_id, max(day)::varchar, event_type from findings where value >= 300 and day >= date '2024-01-24' group by entity_id, event_type)
 order by severity desc, occurred desc, entity_id, what limit 60""", "verdict_changes factor_changes findings")
def _(t):
    from pitlens.plans.scoring import factor_changes
    v = verdict_changes(t).selectExpr("'verdict' AS kind", "3 AS severity", "entity_id", "string(generated_on) AS occurred", "concat(was, '>', now) AS what")
    f = factor_changes(t).selectExpr("'factor' AS kind", "2 AS severity", "entity_id", "'2024-01-30' AS occurred", "concat(key, ':', crossing) AS what")
    e = t.findings.filter("value >= 300 AND day >= date'2024-01-24'").groupBy("entity_id", "event_type").agg(F.max("day").alias("d")).selectExpr(
        "'event' AS kind", "1 AS severity", "entity_id", "string(d) AS occurred", "event_type AS what")
    return v.unionByName(f).unionByName(e).orderBy(F.col("severity").desc(), F.col("occurred").desc(), "entity_id", "what").limit(60)
