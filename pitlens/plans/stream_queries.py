"""Live scoring, its replay, exposures."""

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from pitlens.operators import graph
from pitlens.plans.registry import query
from pitlens.plans.views import R, view
from pitlens.session import checkpoint_dir, cut_lineage
from pitlens.sources.bindings import pick, WORDS_A, WORDS_B
from pitlens.streaming import notices, scoring


def priors(t):
    """Standing expectations by entity, from the watch profiles; a fifth of entities have none."""
    p = t.holders.filter("entity_id % 5 <> 0").selectExpr(
        "entity_id", "entity_id % 4 AS profile", "date_sub(date'2024-01-05', int(40 * (entity_id % 7))) AS generated_on",
        "CASE WHEN entity_id % 4 <> 1 THEN 5D END AS eps_estimate", "50D AS revenue_estimate", "entity_id % 2 = 0 AS short_crowded")
    return scoring.latest_priors(p.join(F.broadcast(scoring.watch_profiles(t.spark)), "profile").drop("profile"))


def events(findings):
    return findings.selectExpr("finding_id AS external_id", "entity_id", "day", "event_type AS form", "summary AS text",
                               "CASE WHEN event_type = 'purchase' THEN value / 10 END AS eps_actual", "CASE WHEN event_type = 'signup' THEN value END AS revenue_actual")


_rows = ", ".join(f"({p}, {i}, '{t}', {list(k)!r}, {scoring.SEVERITY[s] * (0.5 if pr else 1)}, '{d}')" for i, (p, t, k, s, d, pr) in enumerate(scoring.WATCH))
view("watch", f"select * from (values {_rows}) w(profile, ord, topic, keywords, weight, dir)")
view("matched", """select finding_id, topic, dir, weight from findings f join watch w on w.profile = f.entity_id % 4 where f.entity_id % 5 <> 0 and len(list_filter(w.keywords, lambda k: regexp_matches(lower(summary), '\\b' || k || '\\b'))) > 0""", "findings watch")
view("surprises", """select finding_id, entity_id, day, case when event_type='purchase' and entity_id % 4 <> 1 and abs(value / 10 - 5) <= 1.25 then (round((value / 10 - 5) / 5.0 * 100, 2) + 0.0) end es, case when event_type='signup' then (round((value - 50) / 50.0 * 100, 2) + 0.0) end rs from findings""", "findings")
view("assessed", """select external_id, entity_id, day, es eps_surprise, rs revenue_surprise, topics, amplified, case when entity_id % 5 = 0 then 0.0 else (round(raw * f, 2) + 0.0) end score, case when entity_id % 5 = 0 then 'neutral' when lean * f > 0.25 then 'positive' when lean * f < -0.25 then 'negative' else 'neutral' end direction from (
 select *, entity_id % 5 <> 0 and entity_id % 2 = 0 and lean > 0 amplified, case when entity_id % 5 <> 0 and entity_id % 2 = 0 and lean > 0 then 1.35 else 1.0 end f from (select s.finding_id external_id, s.entity_id, s.day, es, rs, coalesce(m.topics, '') topics,
 coalesce(m.w, 0) + case when abs(es) >= 2 then least(abs(es) / 10, 2.0) else 0 end + case when abs(rs) >= 2 then least(abs(rs) / 10, 2.0) else 0 end raw,
 coalesce(m.d, 0) + case when abs(es) >= 2 then sign(es) * least(abs(es) / 10, 2.0) else 0 end + case when abs(rs) >= 2 then sign(rs) * least(abs(rs) / 10, 2.0) else 0 end lean
 from (select * replace (case when entity_id % 5 <> 0 then es end as es, case when entity_id % 5 <> 0 then rs end as rs) from surprises) s left join (select finding_id, sum(weight)::double w, sum(case dir when 'positive' then weight when 'negative' then -weight else 0 end)::double d, string_agg(topic, ',' order by topic) topics from matched group by 1) m using (finding_id)))""", "surprises matched")


def assessed(t):
    return scoring.score_events(events(t.findings), priors(t))


@query("score_events", "STR-04 STR-10 JON-14 FN-33", f"select external_id, entity_id, {R('eps_surprise', 2)} eps_surprise, {R('revenue_surprise', 2)} revenue_surprise, topics, amplified, score, direction, score >= 1 is_notable from assessed", "assessed")
def _(t):
    return assessed(t).select("external_id", "entity_id", "eps_surprise", "revenue_surprise", "topics", "amplified", "score", "direction", "is_notable")


@query("replayed_assessments", "STR-08 JON-13", "select 'replay:' || external_id external_id, a.entity_id, score, direction from assessed a join priors_meta p on p.entity_id=a.entity_id and a.day > p.generated_on", "assessed priors_meta")
def _(t):
    d = assessed(t).filter("day > generated_on")
    return d.selectExpr("concat('replay:', external_id) AS external_id", "entity_id", "score", "direction")


@query("notable_assessments", "FLT-10", "select external_id, entity_id, score from assessed where score >= 1.5 order by day desc, external_id desc limit 200", "assessed")
def _(t):
    return assessed(t).filter("score >= 1.5").orderBy(F.col("day").desc(), F.col("external_id").desc()).limit(200).select("external_id", "entity_id", "score")


@query("prior_coverage", "AGG-36", """select h.entity_id, h.entity_id % 5 <> 0 armed, case when h.entity_id % 5 <> 0 then (select count(*) from watch w where w.profile = h.entity_id % 4) else 0 end::int watch_items, count(*) filter (a.topics <> '') matched, count(*) filter (a.score >= 1) notable
 from holders h left join assessed a using (entity_id) group by 1""", "holders watch assessed")
def _(t):
    a = assessed(t).groupBy("entity_id").agg(F.expr("count_if(topics <> '') AS matched"), F.expr("count_if(score >= 1) AS notable"))
    p = priors(t).selectExpr("entity_id", "size(watch_items) AS watch_items")
    d = t.holders.select("entity_id").join(p, "entity_id", "left").join(a, "entity_id", "left")
    return d.selectExpr("entity_id", "watch_items IS NOT NULL AS armed", "coalesce(watch_items, 0) AS watch_items", "coalesce(matched, 0L) AS matched", "coalesce(notable, 0L) AS notable")


def _live_events(batch):
    k = F.get_json_object("props", "$.k").cast("int")
    d = batch.withColumn("text", F.concat("form", F.lit(": "), pick(WORDS_A, F.floor(k / 10)), F.lit(" "), pick(WORDS_B, k % 10)))
    return d.selectExpr("external_id", "entity_id", "accession", "form", "accepted_at", "text", "CASE WHEN form = 'purchase' THEN value / 10 END AS eps_actual", "CASE WHEN form = 'signup' THEN value END AS revenue_actual")


def _watch(t, folder, pattern, root=None):
    # the graph is written once and read by every batch
    edges = f"{checkpoint_dir(t.spark)}/dependents-{uuid.uuid4().hex}"
    graph.dependents_array(t.exposures).write.parquet(edges)
    return notices.run_notices(t.spark, folder, pattern, lambda: t.holders.filter("tier <> 'FURNITURE'"), lambda: priors(t), _live_events,
                               lambda: t.spark.read.parquet(edges), F.col("entity_id") % 25, root)


@query("notice_stream_state", "STR-01 STR-02 STR-03 STR-05 STR-06 STR-07 STR-09", """select entity_id, count(distinct event_type || strftime(occurred_at, '%Y%m%d%H')) assessments, true timed from findings where entity_id in (select entity_id from holders where tier <> 'FURNITURE') group by 1""", "findings holders")
def _(t):
    d = t.spark.read.parquet(_watch(t, t.sf_dir, "events.parquet"))
    return d.groupBy("entity_id").agg(F.count(F.lit(1)).alias("assessments"), F.bool_and(F.col("latency_seconds") > 0).alias("timed"))


# Notices land in slices of ten days. Of the last hours of a slice every fourth comes a slice late, within the day that is waited for;
# of its middle a few come two slices late, and are too late.
view("landed_notices", """select *, accession_slice from (select *, min(slice) over (partition by entity_id, event_type, strftime(occurred_at, '%Y%m%d%H')) accession_slice from (
 select f.*, (day - date '2024-01-01')::int // 10 + case when hour(occurred_at) >= 14 and (day - date '2024-01-01')::int % 10 = 9 and k % 4 = 0 then 1 else 0 end slice
 from findings f where not (hour(occurred_at) between 10 and 11 and (day - date '2024-01-01')::int % 10 = 4 and k % 9 = 0)))
 where entity_id in (select entity_id from holders where tier <> 'FURNITURE')""", "findings holders")


def _landed_in_slices(t, days=10):
    """Runs the path once for each slice that lands, and then from the beginning again with its state lost; the folder of its store and ledger."""
    root, folder = (f"{checkpoint_dir(t.spark)}/{k}-{uuid.uuid4().hex}" for k in ("notices", "landing"))
    k = "cast(get_json_object(props, '$.k') AS int)"
    day = "datediff(to_date(ts), date'2024-01-01')"
    late = f"CASE WHEN hour(ts) >= 14 AND {day} % 10 = 9 AND {k} % 4 = 0 THEN 1 WHEN hour(ts) BETWEEN 10 AND 11 AND {day} % 10 = 4 AND {k} % 9 = 0 THEN 2 ELSE 0 END"
    landing = cut_lineage(t.events.withColumn("slice", F.expr(f"{day} DIV {days} + {late}")))
    slices = [r.slice for r in landing.select("slice").distinct().orderBy("slice").collect()]
    for n in slices:
        landing.filter(F.col("slice") == n).drop("slice").write.mode("append").parquet(folder)
        _watch(t, folder, "*.parquet", root)
    return root, folder


@query("notice_stream_in_slices", "STR-01 STR-02 STR-05 STR-08", """select entity_id, count(distinct event_type || strftime(occurred_at, '%Y%m%d%H')) assessments from findings where entity_id in (select entity_id from holders where tier <> 'FURNITURE') group by 1""", "findings holders")
def _(t):
    # begun anew without its state the path meets every notice again: what is stored stays as it is, and what came too late is taken in
    root, folder = _landed_in_slices(t, 16)
    state = t.spark._jvm.org.apache.hadoop.fs.Path(f"{root}/state")
    state.getFileSystem(t.spark._jsc.hadoopConfiguration()).delete(state, True)
    return t.spark.read.parquet(_watch(t, folder, "*.parquet", root)).groupBy("entity_id").agg(F.count(F.lit(1)).alias("assessments"))


@query("notice_stream_heartbeat", "STR-09", """select row_number() over (order by accession_slice) as cycle, count(distinct entity_id || event_type || strftime(occurred_at, '%Y%m%d%H')) notices,
 count(distinct entity_id || event_type || strftime(occurred_at, '%Y%m%d%H')) written, min(day)::varchar first_day, true ended from landed_notices group by accession_slice""", "landed_notices")
def _(t):
    d = notices.heartbeat(t.spark, _landed_in_slices(t)[0]).filter("notices > 0")
    return d.select(F.row_number().over(Window.orderBy("epoch")).cast("long").alias("cycle"), "notices", "written", "first_day", F.col("failure").isNull().alias("ended"))


# ---- graph -------------------------------------------------------------------
view("edges", "select hub, dependent, mention_count from exposures where mention_count >= 8 and hub <> dependent qualify row_number() over (partition by hub order by mention_count desc, dependent) <= 12", "exposures")


@query("exposure_edges", "GRF-01", "select * from edges", "edges")
def _(t):
    return graph.build_exposures(t.exposures).select("hub", "dependent", "mention_count")


@query("dependents_of_hub", "GRF-02", "select dependent, mention_count from edges where hub = 7", "edges")
def _(t):
    return graph.dependents_of(graph.build_exposures(t.exposures), 7).select("dependent", "mention_count")


@query("exposure_nodes", "GRF-03", "select node, sum(r)::bigint reach, sum(u)::bigint upstream from (select hub node, 1 r, 0 u from edges union all select dependent, 0, 1 from edges) group by 1", "edges")
def _(t):
    return graph.nodes(graph.build_exposures(t.exposures))
