"""Scoring one event against the standing expectations of its entity.

The score is a row-wise expression over the event joined to its entity's latest
prior, so the same function serves a micro-batch and a replay over history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Severity weights and scoring constants.
SEVERITY = {"minor": 0.5, "moderate": 1.0, "major": 2.0}
PRICED_DISCOUNT, CROWDED_AMPLIFIER, MEANINGFUL_SURPRISE, NOTABLE = 0.5, 1.35, 2.0, 1.0
CREDIBLE_SURPRISE = 0.25

# Standing watch lists by profile, as (profile, topic, keywords, severity, direction if confirmed, priced in).
WATCH = (
    (0, "supply", ("supplier", "tariff"), "major", "negative", False), (0, "demand", ("demand", "backlog"), "moderate", "positive", True),
    (1, "legal", ("lawsuit", "court"), "major", "negative", False), (1, "pricing", ("pricing", "margin"), "minor", "positive", False),
    (2, "leadership", ("resignation",), "moderate", "negative", False), (2, "spend", ("capex", "debt"), "minor", "negative", True),
    (2, "outlook", ("guidance", "outlook"), "major", "positive", False), (3, "cyber", ("breach",), "major", "negative", True),
    (3, "labour", ("workforce",), "minor", "neutral", False),
)


def watch_profiles(spark: SparkSession) -> DataFrame:
    rows = [(p, t, list(k), SEVERITY[s], d, priced) for p, t, k, s, d, priced in WATCH]
    d = spark.createDataFrame(rows, "profile long, topic string, keywords array<string>, severity double, direction string, priced boolean")
    item = "struct(topic, keywords, severity, direction, priced)"
    return d.groupBy("profile").agg(F.expr(f"array_sort(collect_list({item})) AS watch_items"))


def latest_priors(priors: DataFrame) -> DataFrame:
    """One prior per entity: the newest one generated."""
    cols = [c for c in priors.columns if c not in ("entity_id", "generated_on")]
    return priors.groupBy("entity_id").agg(*[F.max_by(c, "generated_on").alias(c) for c in cols], F.max("generated_on").alias("generated_on"))


def credible(actual: str, estimate: str) -> str:
    """An actual more than a quarter away from consensus is on another basis and is set aside."""
    return f"CASE WHEN {estimate} IS NULL OR {estimate} = 0 OR abs({actual} - {estimate}) <= {CREDIBLE_SURPRISE} * abs({estimate}) THEN {actual} END"


def surprise_percent(actual: str, estimate: str) -> str:
    return f"CASE WHEN {estimate} <> 0 THEN round(({actual} - {estimate}) / abs({estimate}) * 100, 2) END"


def score_events(events: DataFrame, priors: DataFrame) -> DataFrame:
    """Events joined to their entity's prior, with score, direction, matches and surprises.

    `events`: entity_id, text, eps_actual, revenue_actual and whatever else should
    travel along; an entity without a prior scores zero.
    """
    d = events.join(priors, "entity_id", "left")
    word = "regexp_like(lower(text), concat('(?<![a-z0-9_])\\\\Q', k, '\\\\E(?![a-z0-9_])'))"
    d = d.withColumn("matches", F.expr(
        f"filter(transform(watch_items, w -> struct(w.topic AS topic, w.direction AS direction, filter(w.keywords, k -> {word}) AS hits,"
        f" w.severity * CASE WHEN w.priced THEN {PRICED_DISCOUNT} ELSE 1 END AS weight)), m -> size(m.hits) > 0)"))
    d = d.withColumns({"eps_surprise": F.expr(surprise_percent(credible("eps_actual", "eps_estimate"), "eps_estimate")),
                       "revenue_surprise": F.expr(surprise_percent("revenue_actual", "revenue_estimate"))})
    push = lambda s: f"CASE WHEN abs({s}) >= {MEANINGFUL_SURPRISE} THEN least(abs({s}) / 10, 2D) ELSE 0D END"
    signed = lambda s: f"CASE WHEN abs({s}) >= {MEANINGFUL_SURPRISE} THEN signum({s}) * least(abs({s}) / 10, 2D) ELSE 0D END"
    d = d.withColumn("raw_score", F.expr(f"coalesce(aggregate(matches, 0D, (a, m) -> a + m.weight), 0D) + {push('eps_surprise')} + {push('revenue_surprise')}"))
    d = d.withColumn("lean", F.expr("coalesce(aggregate(matches, 0D, (a, m) -> a + CASE m.direction WHEN 'positive' THEN m.weight WHEN 'negative' THEN -m.weight ELSE 0D END), 0D)"
                                    f" + {signed('eps_surprise')} + {signed('revenue_surprise')}"))
    d = d.withColumn("amplified", F.expr("coalesce(short_crowded, false) AND lean > 0"))
    factor = f"CASE WHEN amplified THEN {CROWDED_AMPLIFIER} ELSE 1D END"
    d = d.withColumn("score", F.expr(f"CASE WHEN watch_items IS NULL THEN 0D ELSE round(raw_score * {factor}, 2) END")).withColumn(
        "direction", F.expr(f"CASE WHEN watch_items IS NULL THEN 'neutral' WHEN lean * {factor} > 0.25 THEN 'positive' WHEN lean * {factor} < -0.25 THEN 'negative' ELSE 'neutral' END"))
    d = d.withColumn("topics", F.expr("coalesce(array_join(transform(matches, m -> m.topic), ','), '')")).withColumn("is_notable", F.col("score") >= NOTABLE)
    return d.drop("watch_items", "matches", "raw_score", "lean")
