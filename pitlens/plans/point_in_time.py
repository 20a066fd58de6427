"""Filed figures as they were known on a date."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from pitlens.operators import pit
from pitlens.plans.registry import query
from pitlens.plans.views import R, view

AS_OF = "2000-06-30"

view("visible", f"select * from facts where filed_on <= date '{AS_OF}'", "facts")
view("resolved", f"""select entity_id, metric, period, period_end, max(filed_on) filed_on, arg_max(value, filed_on) as value
 from facts_restated where filed_on <= date '{AS_OF}' group by 1,2,3,4""", "facts_restated")
view("placed", """select *, row_number() over (partition by entity_id, metric, period order by period_end desc) - 1 as back
 from resolved""", "resolved")


def resolved(t):
    return pit.resolve_restatements(pit.as_of(t.facts_restated, AS_OF))


@query("facts_as_of", "FLT-01 FLT-12", f"select entity_id, metric, period, period_end::varchar period_end,"
       f" filed_on::varchar filed_on, {R('value', 5)} as value from visible", "visible")
def _(t):
    return pit.as_of(t.facts, AS_OF).withColumn("value", F.round("value", 5))


@query("restatements_resolved", "WIN-01", f"""select entity_id, metric, period, period_end::varchar period_end,
 filed_on::varchar filed_on, {R('value', 5)} as value from resolved""", "resolved")
def _(t):
    return resolved(t).withColumn("value", F.round("value", 5))


@query("same_day_restatements", "WIN-01", f"""select entity_id, metric, period, period_end::varchar period_end, filed_on::varchar filed_on, {R('case when day(period_end) % 2 = 0 then value - 5 else value end', 5)} as value
 from resolved""", "resolved")
def _(t):
    # each figure is filed twice on its day; what arrives later is lower by five, or comes first and is higher
    late = "CASE WHEN day(period_end) % 2 = 0 THEN 2L ELSE 0L END"
    facts = pit.as_of(t.facts_restated, AS_OF).withColumn("arrival", F.lit(1).cast("long"))
    again = facts.withColumn("arrival", F.expr(late)).withColumn("value", F.expr("CASE WHEN arrival = 2 THEN value - 5 ELSE value + 7 END"))
    return pit.resolve_restatements(facts.unionByName(again)).withColumn("value", F.round("value", 5))


@query("latest_value_by_metric", "WIN-02", f"""select entity_id, metric, period, max(period_end)::varchar period_end,
 {R('arg_max(value, period_end)', 5)} as value from resolved group by 1,2,3""", "resolved")
def _(t):
    return resolved(t).groupBy("entity_id", "metric", "period").agg(
        F.max("period_end").alias("period_end"), F.round(F.max_by("value", "period_end"), 5).alias("value"))


@query("prior_by_position", "WIN-03", f"""select a.entity_id, a.metric, a.period, a.period_end::varchar period_end,
 b.period_end::varchar prior_end, {R('a.value', 5)} as value, {R('b.value', 5)} prior_value
 from placed a join placed b using (entity_id, metric, period) where a.back = 0 and b.back = 1""", "placed")
def _(t):
    w = Window.partitionBy("entity_id", "metric", "period").orderBy("period_end")
    d = pit.by_position(resolved(t)).withColumn("prior_end", F.lag("period_end").over(w)).withColumn(
        "prior_value", F.round(F.lag("value").over(w), 5))
    return d.filter((F.col("back") == 0) & F.col("prior_end").isNotNull()).select(
        "entity_id", "metric", "period", "period_end", "prior_end", F.round("value", 5).alias("value"), "prior_value")


@query("stale_periods", "WIN-04", """select entity_id, metric, period, period_end::varchar period_end,
 max(filed_on) over (partition by entity_id)::varchar newest_filing, filed_on - period_end age_days,
 max(filed_on) over (partition by entity_id) - period_end > 500 is_stale from resolved""", "resolved")
def _(t):
    newest = F.max("filed_on").over(Window.partitionBy("entity_id"))
    return resolved(t).select(
        "entity_id", "metric", "period", "period_end", newest.alias("newest_filing"),
        F.datediff("filed_on", "period_end").cast("long").alias("age_days"),
        (F.datediff(newest, F.col("period_end")) > 500).alias("is_stale"))


view("instants", "select entity_id, metric, period_end, value from resolved where period='instant'", "resolved")


def instants(t, metric=None):
    d = resolved(t).filter(F.col("period") == "instant").select("entity_id", "metric", "period_end", "value")
    return d.filter(F.col("metric") == metric).drop("metric") if metric else d


@query("instant_on_nearest", "JON-03", f"""select entity_id, anchor::varchar anchor, found::varchar found, {R('value', 5)} as value from (
 select p.entity_id, p.anchor, i.period_end found, i.value,
  row_number() over (partition by p.entity_id, p.anchor order by abs(i.period_end - p.anchor), i.period_end) rn
 from (select distinct entity_id, (period_end + (entity_id % 40)::int)::date anchor from resolved where period='year') p
 left join (select * from instants where metric='assets') i on i.entity_id=p.entity_id and abs(i.period_end - p.anchor) <= 14)
 where rn=1""", "instants")
def _(t):
    probes = resolved(t).filter(F.col("period") == "year").select(
        "entity_id", F.date_add("period_end", (F.col("entity_id") % 40).cast("int")).alias("anchor")).distinct()
    d = pit.nearest(probes, instants(t, "assets"), ["entity_id"], "anchor", "period_end", ["value"], 14, "hit")
    return d.select("entity_id", "anchor", F.col("hit.at").alias("found"), F.round("hit.value", 5).alias("value"))


@query("year_apart_instants", "JON-04", f"""select entity_id, metric, period_end::varchar period_end, prior_end::varchar prior_end,
 {R('value', 5)} as value, {R('prior_value', 5)} prior_value from (
 select a.entity_id, a.metric, a.period_end, a.value, b.period_end prior_end, b.value prior_value,
  row_number() over (partition by a.entity_id, a.metric, a.period_end order by abs(b.period_end - (a.period_end - 365)), b.period_end) rn
 from instants a join instants b on a.entity_id=b.entity_id and a.metric=b.metric and b.period_end < a.period_end
  and abs(b.period_end - (a.period_end - 365)) <= 60) where rn=1""", "instants")
def _(t):
    inst = instants(t)
    d = pit.year_apart(inst, inst, ["entity_id", "metric"], "period_end", "period_end", ["value"], "prior")
    return d.filter(F.col("prior").isNotNull()).select(
        "entity_id", "metric", "period_end", F.col("prior.at").alias("prior_end"),
        F.round("value", 5).alias("value"), F.round("prior.value", 5).alias("prior_value"))


@query("aligned_periods", "JON-05", f"""select entity_id, period_end::varchar period_end, {R('revenue', 5)} revenue,
 {R('net_income', 5)} net_income, {R('operating_cash_flow', 5)} operating_cash_flow from (
 select *, row_number() over (partition by entity_id order by period_end desc) rn from (
 select entity_id, period_end, max(value) filter (metric='revenue') revenue, max(value) filter (metric='net_income') net_income,
 max(value) filter (metric='operating_cash_flow') operating_cash_flow from resolved where period='year' group by 1,2)
 where revenue is not null and net_income is not null and operating_cash_flow is not null) where rn=2""", "resolved")
def _(t):
    metrics = ["revenue", "net_income", "operating_cash_flow"]
    d = pit.aligned(resolved(t).filter(F.col("period") == "year"), metrics, back=1)
    return d.select("entity_id", "period_end", *[F.round(m, 5).alias(m) for m in metrics])
