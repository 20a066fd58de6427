"""Measures of books from arrays of sessions against those from rows."""

import random
import re

from pitlens.operators import aggregates as agg
from pitlens.operators import backtest as bt

KEYS = ["book"]


def test_ratios_of_arrays_are_those_of_rows(spark):
    rng = random.Random(3)
    paths = [(k, [rng.gauss(0, 0.1) for _ in range(n)]) for k, n in enumerate((1, 2, 3, 12, 60))] + [(9, [0.0, 0.0]), (10, [0.5, -0.5, 0.1])]
    d = spark.createDataFrame(paths, "book int, r array<double>")
    rows = d.selectExpr("book", "posexplode(r) AS (k, r)")
    want = {r.book: r for r in agg.risk_ratios(rows, KEYS, "r", 12).join(agg.max_drawdown(rows, KEYS, "k", "r"), KEYS).collect()}
    for got in d.selectExpr("book", *agg.path_ratios("r", 12)).collect():
        for c in ("annualised", "downside", "sharpe", "sortino", "compound", "max_drawdown"):
            a, b = got[c], want[got.book][c]
            assert (a is None) == (b is None) and (a is None or abs(a - b) < 1e-9), (got, c, b)


def test_a_book_meets_its_sessions_in_one_exchange(spark):
    weights = spark.createDataFrame([("a", "x", 0.6, 0, 0.1), ("a", "y", -0.4, 0, 0.1), ("b", "y", 1.0, 0, 0.1), ("b", "gone", 1.0, 0, 0.1), ("c", "gone", 1.0, 0, 0.1)],
                                    "book string, brand string, w double, entry int, bench double")
    indexed = spark.createDataFrame([(b, k, r) for b, rs in (("x", (None, 0.1, 0.2)), ("y", (None, 0.1, -0.3))) for k, r in enumerate(rs)] + [("gone", 1, 0.1)], "brand string, idx int, ret double")
    d = bt.measure_books(weights, indexed, 2, KEYS, 12)
    got = {r.book: r for r in d.collect()}
    assert set(got) == {"a", "b"} and (got["a"].names, got["b"].names) == (2, 1)
    assert abs(got["a"].ret - (1.02 * 1.24 - 1)) < 1e-12 and abs(got["b"].max_drawdown + 0.3) < 1e-12
    assert (got["a"].hit_rate, got["b"].hit_rate, got["b"].gross) == (1.0, 0.0, 2.0)
    plan = d._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange hashpartitioning(book") == 1


def test_weights_are_worked_out_once(spark):
    rows = [("a", "x", 0.6, 0, 0.1), ("a", "y", -0.4, 0, 0.1), ("b", "x", 1.0, 1, 0.2), ("c", "gone", 1.0, 0, 0.1)]
    schema = "book string, brand string, w double, entry int, bench double"
    met = spark.sparkContext.accumulator(0)

    def count(r):
        met.add(1)
        return r

    weights = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2).map(count), schema, verifySchema=False)
    indexed = spark.createDataFrame([(b, k, r) for b, rs in (("x", (None, 0.1, 0.2, 0.3)), ("y", (None, 0.1, -0.3, None))) for k, r in enumerate(rs)], "brand string, idx int, ret double")
    # one entry more than the books have
    entries = spark.createDataFrame([(0,), (1,), (2,), (1,)], "entry int")
    got = {r.book: r for r in bt.measure_books(weights, indexed, 2, KEYS, 12, entries).collect()}
    assert met.value == len(rows)
    want = {r.book: r for r in bt.measure_books(spark.createDataFrame(rows, schema), indexed, 2, KEYS, 12).collect()}
    assert got == want and set(got) == {"a", "b"} and abs(got["b"].ret - (1.2 * 1.3 - 1)) < 1e-12


def test_lines_are_dealt_by_book_once(tables):
    from pitlens.plans.experiment_queries import books, measured_books
    for d in (books(tables), measured_books(tables)):
        d.collect()
        plan = d._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert len(re.findall(r"Exchange hashpartitioning\(\w*cust", plan)) == 1
