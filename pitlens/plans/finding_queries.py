"""Base rates, norms, incidence, parity and restatement over findings."""

from pyspark.sql import functions as F

from pitlens.functions import findings as fx
from pitlens.functions import text as tx
from pitlens.operators import baselines, norms
from pitlens.plans.registry import query
from pitlens.plans.views import R, view

WINDOW_DAYS = 10
NORM_CUT = "2024-01-20"
NOW = "timestamp'2024-01-31 00:00:00'"


def signed(t):
    """Findings with the sign their document states, and the entity's sector."""
    def pick(options, i):
        return f"element_at(array({', '.join(repr(o) for o in options)}), int({i}) + 1)"
    f = t.findings.withColumns({
        "rule": F.expr("CASE WHEN finding_type = 'insider_activity' THEN element_at(array('insider_sell_cluster', 'insider_buy_cluster', 'other'), k % 3 + 1) END"),
        "metric": F.expr(pick(fx.METRICS, "k % 8")), "movement": F.expr(pick(fx.MOVEMENTS, "(k DIV 8) % 4"))})
    f = f.withColumn("sign", F.expr(fx.documentary_sign("finding_type", "sentiment", "rule", "movement", "metric")))
    return f.join(t.holders.select("entity_id", "sector"), "entity_id", "left")


_SIGN = """case finding_type when 'new_risk_factor' then -1.0 when 'insider_activity' then case k % 3 when 0 then -1.0 when 1 then 1.0 end
 when 'sentiment_shift' then case when sentiment > 0 then 1.0 when sentiment < 0 then -1.0 end
 when 'guidance_change' then case when (k // 8) % 4 = 2 then -1.0 when (k // 8) % 4 = 3 then null
  else (case when (k // 8) % 4 = 0 then 1.0 else -1.0 end) * case k % 8 when 0 then 1.0 when 1 then 1.0 when 3 then -1.0 when 5 then 1.0 when 6 then -1.0 end end end"""
view("signed", f"select f.*, h.sector, ({_SIGN})::double sign from findings f left join holders h using (entity_id)", "findings holders")


@query("documentary_sign", "FN-14 FN-15 FN-16", """select finding_id, finding_type, sign, case when sign is null then 'unassessed' when sign > 0 then 'positive' else 'negative' end label,
 finding_type <> 'notable_quote' can_be_directional from signed""", "signed")
def _(t):
    return signed(t).selectExpr("finding_id", "finding_type", "sign", f"{fx.direction_label('sign')} AS label",
                                f"finding_type IN ({', '.join(repr(x) for x in fx.DIRECTION_BEARING)}) AS can_be_directional")


_W = f"range between interval {WINDOW_DAYS} days preceding and interval 1 microsecond preceding"
view("baseline", f"""select finding_id, entity_id, event_type, magnitude, n sample_size, case when n >= 10 then (h + 10 * p) / (n + 10) end rate,
 case when n >= 10 and p > 0 and (h + 10 * p) <> 0 then (h + 10 * p) / (n + 10) / p end lift from (
 select *, case when alln = 0 then 1/3.0 else allh / alln end p from (select *, case magnitude when 'minor' then a when 'moderate' then b else c end h,
  case magnitude when 'minor' then pa when 'moderate' then pb else pc end allh from (select *,
  count(*) over e n, count(*) filter (magnitude='minor') over e a, count(*) filter (magnitude='moderate') over e b, count(*) filter (magnitude='major') over e c,
  count(*) over g alln, count(*) filter (magnitude='minor') over g pa, count(*) filter (magnitude='moderate') over g pb, count(*) filter (magnitude='major') over g pc
  from findings window e as (partition by entity_id, event_type order by occurred_at {_W}), g as (partition by event_type order by occurred_at {_W}))))""", "findings")


@query("evidence_baseline", "WIN-09 WIN-10 FN-36 UDF-02", f"""select finding_id, entity_id, event_type, magnitude, sample_size, {R('rate', 8)} rate, {R('lift', 8)} lift,
 coalesce(rate < 0.1, false) is_anomalous from baseline""", "baseline")
def _(t):
    d = baselines.evidence_scores(t.findings, WINDOW_DAYS)
    return d.withColumns({"rate": F.round("rate", 8), "lift": F.round("lift", 8), "sample_size": F.col("sample_size").cast("long")})


@query("parity_weight", "WIN-11", f"select finding_id, {R('1 / sqrt(count(*) over (partition by document_id))', 8)} parity from findings", "findings")
def _(t):
    return norms.parity_weights(t.findings).select("finding_id", F.round("parity", 8).alias("parity"))


# ---- norms ---------------------------------------------------------------
_past = f"(select * from signed where sign <> 0 and day <= date '{NORM_CUT}')"
view("norm_type", f"select finding_type, count(*) n, sum(sign) / (count(*) + 8.0) e from {_past} group by 1", "signed")
view("norm_genre", f"select genre, finding_type, count(*) n, (sum(sign) + 8 * any_value(p.e)) / (count(*) + 8.0) e from {_past} join norm_type p using (finding_type) group by 1,2", "signed norm_type")
view("norm_sector", f"select sector, genre, finding_type, count(*) n, (sum(sign) + 8 * any_value(p.e)) / (count(*) + 8.0) e from {_past} join norm_genre p using (genre, finding_type) where sector is not null group by 1,2,3 having count(*) >= 10", "signed norm_genre")
view("norm_company", f"""select s.entity_id, s.genre, s.finding_type, count(*) n, (sum(sign) + 8 * any_value(coalesce(x.e, g.e))) / (count(*) + 8.0) e from {_past} s
 join norm_genre g on g.genre=s.genre and g.finding_type=s.finding_type left join norm_sector x on x.sector=s.sector and x.genre=s.genre and x.finding_type=s.finding_type group by 1,2,3""", "signed norm_genre norm_sector")
view("expected", """select s.*, coalesce(c.e, x.e, g.e, p.e, 0.0) expected, case when c.e is not null then 'company' when x.e is not null then 'sector' when g.e is not null then 'genre'
 when p.e is not null then 'type' else 'root' end as level, greatest(-1.0, least(1.0, sign - coalesce(c.e, x.e, g.e, p.e, 0.0))) excess from signed s
 left join norm_company c on c.entity_id=s.entity_id and c.genre=s.genre and c.finding_type=s.finding_type left join norm_sector x on x.sector=s.sector and x.genre=s.genre and x.finding_type=s.finding_type
 left join norm_genre g on g.genre=s.genre and g.finding_type=s.finding_type left join norm_type p on p.finding_type=s.finding_type""", "signed norm_company norm_sector norm_genre norm_type")


def measured(t):
    return norms.measure_norms(signed(t).filter(F.col("day") <= F.lit(NORM_CUT).cast("date")))


def expected(t):
    return norms.with_expected(signed(t), measured(t))


@query("norms_by_hierarchy", "NRM-01", " union all ".join([
    f"select 'type' as level, null entity_id, null sector, null genre, finding_type, n, {R('e', 8)} expected from norm_type",
    f"select 'genre', null, null, genre, finding_type, n, {R('e', 8)} from norm_genre",
    f"select 'sector', null, sector, genre, finding_type, n, {R('e', 8)} from norm_sector",
    f"select 'company', entity_id, null, genre, finding_type, n, {R('e', 8)} from norm_company"]), "norm_type norm_genre norm_sector norm_company")
def _(t):
    m = measured(t)
    rows = lambda l: m[l].selectExpr(
        f"'{l}' AS level", "entity_id" if l == "company" else "bigint(null) AS entity_id", "sector" if l == "sector" else "string(null) AS sector",
        "string(null) AS genre" if l == "type" else "genre", "finding_type", f"{l}_n AS n", f"round({l}_e, 8) AS expected")
    return rows("type").unionByName(rows("genre")).unionByName(rows("sector")).unionByName(rows("company"))


@query("excess_over_norm", "NRM-02 WIN-21", f"select finding_id, level, {R('expected', 8)} expected, {R('excess', 8)} excess from expected", "expected")
def _(t):
    return expected(t).select("finding_id", "level", F.round("expected", 8).alias("expected"), F.round("excess", 8).alias("excess"))


@query("routine_findings", "FLT-13", "select finding_id, entity_id from expected where abs(excess) < 0.10", "expected")
def _(t):
    return expected(t).filter(F.abs("excess") < 0.10).select("finding_id", "entity_id")


view("docs", "select document_id, entity_id, sector, genre, count(*) filter (sign > 0) positive, count(*) filter (sign < 0) negative from signed group by 1,2,3,4", "signed")
view("inc_root", "select avg(positive) p, avg(negative) q, count(*) n from docs", "docs")
view("inc_genre", "select genre, count(*) n, (sum(positive) + 2 * any_value(r.p)) / (count(*) + 2.0) p, (sum(negative) + 2 * any_value(r.q)) / (count(*) + 2.0) q from docs, inc_root r group by 1", "docs inc_root")
view("inc_sector", """select sector, genre, count(*) n, (sum(positive) + 2 * any_value(g.p)) / (count(*) + 2.0) p, (sum(negative) + 2 * any_value(g.q)) / (count(*) + 2.0) q
 from docs join inc_genre g using (genre) where sector is not null group by 1,2""", "docs inc_genre")
view("inc_expected", """select d.*, case when s.n >= 4 then s.p when g.n >= 4 then g.p else r.p end ep, case when s.n >= 4 then s.q when g.n >= 4 then g.q else r.q end eq,
 case when s.n >= 4 then s.n when g.n >= 4 then g.n else r.n end peers from docs d left join inc_sector s using (sector, genre) left join inc_genre g on g.genre=d.genre, inc_root r""", "docs inc_sector inc_genre inc_root")
view("residual", """select entity_id, avg(v) residual, count(*) measurable from (select entity_id, greatest(-1.0, least(1.0, ((positive - ep) - (negative - eq)) / greatest(ep + eq, 1.0))) v
 from inc_expected where peers >= 4 and positive + negative > 0) group by 1""", "inc_expected")


def incidence(t):
    docs = norms.document_counts(signed(t))
    return norms.expected_counts(docs, *norms.measure_incidence(docs))


@query("incidence_norms", "NRM-03", f"""select genre, null sector, n docs, {R('p', 8)} positive, {R('q', 8)} negative from inc_genre union all
 select genre, sector, n, {R('p', 8)}, {R('q', 8)} from inc_sector""", "inc_genre inc_sector")
def _(t):
    genre, sector = norms.measure_incidence(norms.document_counts(signed(t)))
    a = genre.selectExpr("genre", "string(null) AS sector", "genre_docs AS docs", "round(genre_p, 8) AS positive", "round(genre_q, 8) AS negative")
    return a.unionByName(sector.selectExpr("genre", "sector", "sector_docs AS docs", "round(sector_p, 8) AS positive", "round(sector_q, 8) AS negative"))


@query("incidence_excess", "NRM-04", f"select entity_id, {R('residual', 8)} residual, measurable from residual", "residual")
def _(t):
    return norms.incidence_excess(incidence(t)).withColumn("residual", F.round("residual", 8))


@query("disclosure_volume", "NRM-06", f"""select document_id, entity_id, genre, positive observed_positive, negative observed_negative, case when peers >= 4 then {R('ep', 3)} end expected_positive,
 case when peers >= 4 then {R('eq', 3)} end expected_negative, peers peer_documents from inc_expected""", "inc_expected")
def _(t):
    ok = lambda c: F.when(F.col("peer_documents") >= norms.MIN_DOCUMENTS, F.round(c, 3))
    return incidence(t).select("document_id", "entity_id", "genre", F.col("positive").alias("observed_positive"), F.col("negative").alias("observed_negative"),
                               ok("expected_p").alias("expected_positive"), ok("expected_q").alias("expected_negative"), "peer_documents")


_tok = lambda c: f"list_filter(list_distinct(regexp_extract_all(lower({c}), '[a-z]{{4,}}')), lambda w: not list_contains({list(tx.STOPWORDS)!r}, w))"
view("stated", f"select *, {_tok('summary')} toks, list_distinct(regexp_extract_all(summary, '[0-9]+(?:[.,][0-9]+)*')) figs from findings", "findings")
view("restated", """select finding_id from stated a where finding_type not in ('guidance_change','qoq_anomaly') and len(toks) > 0 and exists (select 1 from stated b
 where b.entity_id=a.entity_id and b.finding_type=a.finding_type and b.occurred_at < a.occurred_at and b.document_id <> a.document_id
 and len(list_intersect(a.toks, b.toks)) >= 0.3 * len(list_distinct(list_concat(a.toks, b.toks))) and len(list_intersect(a.figs, b.figs)) = len(a.figs))""", "stated")


@query("restated_findings", "JON-15 SET-04 FN-08 FN-09", "select finding_id from restated", "restated")
def _(t):
    return norms.restated(t.findings).distinct()


view("weighed", """select e.*, count(*) over (partition by document_id) docn, case when sign is not null and sign <> 0 and abs(excess) >= 0.1
 then (1 / sqrt(count(*) over (partition by document_id))) * case when finding_id in (select finding_id from restated) then 0.25 else 1.0 end else 0.0 end weight from expected e""", "expected restated")


@query("effective_findings", "NRM-05", f"""select entity_id, {R('sum(weight)', 6)} effective, count(sign) informative, {R('greatest(0, least(1, 1 - abs(any_value(residual))))', 6)} routine_share
 from weighed left join residual using (entity_id) group by 1""", "weighed residual")
def _(t):
    d = norms.finding_weight(norms.parity_weights(expected(t)), norms.restated(t.findings))
    g = d.groupBy("entity_id").agg(F.round(F.sum("weight"), 6).alias("effective"), F.count("sign").alias("informative"))
    r = norms.incidence_excess(incidence(t)).selectExpr("entity_id", "round(greatest(0D, least(1D, 1 - abs(residual))), 6) AS routine_share")
    return g.join(r, "entity_id", "left")


# ---- scalars ---------------------------------------------------------------
@query("priority_score", "FN-18 FN-19 FN-20 FN-17", f"""select finding_id, {R("exp(-(epoch_us(timestamp '2024-01-31') - epoch_us(occurred_at)) / 86400000000.0 / 90.0)")} recency,
 {R("least(greatest(confidence, 0.0), 1.0) * case finding_type when 'new_risk_factor' then 1.0 when 'guidance_change' then 0.9 when 'insider_activity' then 0.85 when 'sentiment_shift' then 0.7 when 'notable_quote' then 0.6 else 0.5 end * case magnitude when 'major' then 1.35 when 'minor' then 0.75 else 1.0 end * exp(-(epoch_us(timestamp '2024-01-31') - epoch_us(occurred_at)) / 86400000000.0 / 90.0)")} priority,
 (case magnitude when 'minor' then 0.5 when 'moderate' then 1.0 else 2.0 end)::double weight, (case horizon when 'near_term' then 0.35 when 'multi_quarter' then 1.0 when 'structural' then 0.85 else 0.7 end)::double horizon_weight from findings""", "findings")
def _(t):
    score = fx.priority_score("finding_type", "confidence", "occurred_at", "magnitude", NOW)
    return t.findings.selectExpr("finding_id", f"round({fx.recency_factor('occurred_at', NOW)}, 6) AS recency", f"round({score}, 6) AS priority",
                                 f"{fx.lookup('magnitude', fx.MAGNITUDE_WEIGHT, 'NULL')} AS weight",
                                 f"{fx.lookup('''coalesce(horizon, 'unset')''', fx.READING_HORIZONS['1y'][2], '0.7D')} AS horizon_weight")


@query("stale_evidence", "FN-10 FN-11 FN-12", """select finding_id, 1995 + k % 30 newest_quoted_year, 2024 - (1995 + k % 30) >= 2 is_stale,
 greatest(floor((epoch_us(timestamp '2024-01-31') - epoch_us(occurred_at)) / 86400000000.0)::bigint, date_diff('day', make_date(1995 + k % 30, 12, 31), date '2024-01-31')) effective_age_days from findings""", "findings")
def _(t):
    return t.findings.selectExpr("finding_id", f"{fx.newest_quoted_year('quote')} AS newest_quoted_year", f"{fx.is_stale('occurred_at', 'quote')} AS is_stale",
                                 f"bigint({fx.effective_age_days('occurred_at', 'quote', NOW)}) AS effective_age_days")


_has = lambda ws: " + ".join(f"contains(low, '{w}')::int" for w in ws)
view("topic_hits", "select finding_id, topic, ord, hits from (" + " union all ".join(
    f"select finding_id, '{t}' topic, {i} ord, {_has(ws)} hits from (select finding_id, lower(summary) low from findings)" for i, (t, ws) in enumerate(tx.TOPICS.items())) + ") where hits > 0", "findings")


@query("finding_topics", "FN-13 SET-03", "select finding_id, array_to_string(list(topic order by ord), ',') topics, first(topic order by hits desc, ord) primary_topic from topic_hits group by 1", "topic_hits")
def _(t):
    return t.findings.selectExpr("finding_id", tx.told_topics("summary")).withColumn("topics", F.array_join("topics", ","))


@query("finding_titles_and_sources", "FN-25 FN-26 FN-34 FN-35", """select finding_id, trim(split_part(summary, ':', 1)) title, regexp_replace(lower(summary), '[^a-z0-9]+', ' ', 'g') normalised,
 case when finding_type='insider_activity' then 'insider' else genre end source, substring(sha256(summary), 1, 16) fingerprint from findings""", "findings")
def _(t):
    return t.findings.selectExpr("finding_id", f"{tx.title_of('summary')} AS title", f"{tx.normalise('summary')} AS normalised",
                                 "CASE WHEN finding_type IN ('insider_activity', 'short_interest_spike') THEN 'insider' ELSE coalesce(genre, 'filing') END AS source",
                                 "substring(sha2(summary, 256), 1, 16) AS fingerprint")


@query("plausible_figures", "FN-28", r"""select o_orderkey, case when o_totalprice / 2000 - 60 between -100 and 100 then (round(o_totalprice / 2000 - 60, 6) + 0.0) end eps, case when o_totalprice * 4 >= 1000000 then (round(o_totalprice * 4, 2) + 0.0) end revenue,
 o_orderkey % 3 = 0 or o_orderkey % 3 = 1 looks from orders""")
def _(t):
    words = "element_at(array('Diluted EPS of one', 'NET REVENUE grew', 'Steps taken'), int(o_orderkey % 3) + 1)"
    return t.orders.selectExpr("o_orderkey", f"round({fx.plausible_eps('(o_totalprice / 2000 - 60)')}, 6) AS eps", f"round({fx.plausible_revenue('(o_totalprice * 4)')}, 2) AS revenue",
                               f"{fx.looks_like_earnings(words)} AS looks")
