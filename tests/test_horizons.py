"""Outcomes at several horizons in one pass against one horizon at a time, and what the horizon queries return."""

from datetime import date, timedelta

from pyspark.sql import functions as F

from compare import check
from conftest import SF
from pitlens.operators import events, prices
from pitlens.plans import QUERIES
from pitlens.plans.registry import runner


def test_all_horizons_in_one_pass_are_each_by_itself(spark):
    start = date(2020, 1, 1)
    days = [start + timedelta(days=k + (k // 5) * 2) for k in range(40)]
    bars = spark.createDataFrame([(b, d, 10.0 + (k * m) % 7) for b, m in (("a", 3), ("b", 5)) for k, d in enumerate(days)], "brand string, session_date date, adjusted_close double")
    asked = spark.createDataFrame([(b, start + timedelta(days=k)) for b in ("a", "b", "none") for k in (-9, 0, 3, 20, 50, 300)], "brand string, at date")
    hs = (1, 5, 21)
    got = {(r.brand, r["at"], r.horizon): r.pct for r in prices.forward_returns(asked, bars, "at", hs, "pct").collect()}
    want = {(r.brand, r["at"], h): r.pct for h in hs for r in prices.forward_return(asked, bars, "at", h, "pct").collect()}
    assert got == want and len(got) == 54 and any(v is not None for v in got.values())


def test_scores_against_what_prices_did(spark):
    rows = [("d", 21, v, v * 2.0 + k % 3) for k, v in enumerate([-2.0, -1.0, 1.0, 2.0] * 5)] + [("d", 21, 0.0, 99.0), ("d", 21, 1.0, None), ("d", 63, 1.0, 1.0)]
    calls = spark.createDataFrame(rows, "depth string, horizon int, v double, abnormal_pct double")
    r, = events.agreement_with_prices(calls, ["depth", "horizon"], "v").collect()
    side = lambda s: [a for d, h, v, a in rows if h == 21 and a is not None and v * s > 0]
    assert (r.horizon, r.n) == (21, 20) and r.spearman > 0.8
    assert abs(r.spread - (sum(side(1)) / 10 - sum(side(-1)) / 10)) < 1e-3


def test_every_horizon_has_its_row(spark, con):
    for name, hs in (("verdicts_by_horizon", {1, 5, 21}), ("evaluate_assessments", {1, 5, 21})):
        rows = runner(QUERIES[name])(spark, SF).select("source", "horizon", *[F.col(c) for c in runner(QUERIES[name])(spark, SF).columns if c not in ("source", "horizon")])
        assert check(con, rows, QUERIES[name].sql) is None
        assert {r.horizon for r in rows.select("horizon").collect()} == hs
