"""Ranks of pools of one range, the counts of ranks, and back-tested keys from one row a name."""

import random
from datetime import date

from pyspark.sql import functions as F

from pitlens.operators import backtest as bt
from pitlens.operators import composites, factors, ranks

SCORED = "as_of date, entity_id long, sector string, key string, percentile double"


def test_a_pool_of_one_range_is_ranked_in_one_exchange(spark):
    d = spark.range(500).selectExpr("id", "IF(id % 9 = 0, NULL, id % 3) AS k", "nullif(pmod(xxhash64(id), 20), 7) AS v").repartition(3)
    one = ranks.position(d, ["k"], "v", ["id"], "pos", "n", slices=1)
    one = ranks.average_rank(one, ["k"], "v", "r", None, slices=1)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(k") == 1 and "ExistingRDD" not in plan
    many = ranks.average_rank(ranks.position(d, ["k"], "v", ["id"], "pos", "n", slices=5), ["k"], "v", "r", None, slices=5)
    got = lambda x: sorted(tuple(r) for r in x.select("id", "pos", "n", "r").collect())
    assert got(one) == got(many) and len(got(one)) == d.filter("k IS NOT NULL").count()


def test_counts_of_ranks_are_those_of_the_ranks(spark):
    rng = random.Random(5)
    rows = [(date(2000, 1, 1 + day), e, rng.choice(["A", "B", "Utilities", None]), 1.0,
             [(k, True, rng.random()) for k in "pqrs" if rng.random() < (0.15 if k == "s" else 0.7)]) for day in range(3) for e in range(40)]
    d = spark.createDataFrame(rows, "as_of date, entity_id long, sector string, size double, vals array<struct<key string, higher_is_better boolean, value double>>").filter("size(vals) > 0")
    s = factors.score(d)
    want = {r.key: r["count"] for r in s.groupBy("key").count().collect()}
    got = factors.ranked_counts(d).collect()
    assert {r.key: r.seen for r in got} == want and {r.total for r in got} == {s.select("as_of", "entity_id").distinct().count()}


def test_keys_of_one_row_are_those_of_the_composites(spark):
    rng = random.Random(9)
    rows = [(date(2000, 1, 31), e, ("Financials", "Utilities", "ASIA")[e % 3], k, round(rng.random(), 4)) for e in range(60) for k in bt.FACTOR_KEYS if rng.random() < e / 60]
    d = spark.createDataFrame(rows, SCORED)
    got = {(r.entity_id, r.key): r.score for r in bt.each_key(bt.ranking_keys(d), ["as_of", "entity_id"]).collect()}
    want = {(r[1], r[3]): r[4] for r in rows}
    want |= {(r.entity_id, "composite"): r.score for r in composites.flat_composite(d).collect()}
    cond = {r.entity_id: r.score for r in composites.weighted_composite(d).collect()}
    want |= {(e, "composite_conditional"): v for e, v in cond.items()}
    want |= {(r.entity_id, f"theme:{r.theme}"): round(r.theme_score, 8) for r in composites.theme_scores(d).collect() if r.entity_id in cond}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_last_version_known_on_each_date(spark):
    filed = [(1, "assets", "instant", date(2020, 3, 31), date(2020, 5, d), v) for d, v in ((1, 1.0), (9, 2.0), (20, 3.0))]
    filed += [(1, "assets", "instant", date(2020, 6, 30), date(2020, 5, 15), 9.0)]
    facts = spark.createDataFrame(filed, "entity_id long, metric string, period string, period_end date, filed_on date, value double")
    days = ["2020-04-30", "2020-05-01", "2020-05-10", "2020-05-16", "2020-05-20"]
    view = factors.company_view(facts, days)
    got = {str(r.as_of): [x.value for x in r.i_assets] for r in view.select("as_of", "i_assets").collect()}
    assert got == {"2020-05-01": [1.0], "2020-05-10": [2.0], "2020-05-16": [2.0, 9.0], "2020-05-20": [3.0, 9.0]}
    # metrics are told apart once an entity: below the dates, not above them
    plan = view._jdf.queryExecution().optimizedPlan().toString().split("Generate explode")
    assert "= assets)" not in plan[0] and "= assets)" in plan[-1]
