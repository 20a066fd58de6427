"""Visibility, restatement and price rules on hand-built rows."""

from datetime import date, timedelta

from pyspark.sql import functions as F

from pitlens.operators import factors, pit, prices, ranks


def facts(spark, rows):
    return spark.createDataFrame(rows, "entity_id long, metric string, period string, period_end date, filed_on date, value double")


D = date


def test_invisible_before_filing_and_restatement_keeps_history(spark):
    f = facts(spark, [(1, "revenue", "year", D(2020, 12, 31), D(2021, 2, 1), 10.0), (1, "revenue", "year", D(2020, 12, 31), D(2021, 8, 1), 12.0)])
    value = lambda when: [r.value for r in pit.resolve_restatements(pit.as_of(f, when)).collect()]
    assert value("2021-01-15") == []
    assert value("2021-03-01") == [10.0]
    assert value("2021-09-01") == [12.0]


def test_prior_counts_periods_not_days(spark):
    f = facts(spark, [(1, "revenue", "year", D(2015, 12, 31), D(2016, 2, 1), 5.0), (1, "revenue", "year", D(2020, 12, 31), D(2021, 2, 1), 10.0)])
    got = {r.back: r.value for r in pit.by_position(f).collect()}
    assert got == {0: 10.0, 1: 5.0}


def bars(spark, rows):
    return spark.createDataFrame([("A", d, c, a) for d, c, a in rows], "brand string, session_date date, close double, adjusted_close double")


def ask(spark, b, *days):
    p = spark.createDataFrame([("A", d) for d in days], "brand string, day date")
    return {r.day: (r.p.close if r.p else None) for r in prices.price_on_or_before(p, b, "day", "p").collect()}


def test_weekend_reads_friday_and_holes_stay_holes(spark):
    b = bars(spark, [(D(2021, 1, 8), 10.0, 10.0), (D(2021, 1, 11), 11.0, 11.0)])
    got = ask(spark, b, D(2021, 1, 9), D(2021, 1, 11), D(2021, 1, 18), D(2021, 1, 19), D(2021, 1, 7))
    assert got == {D(2021, 1, 9): 10.0, D(2021, 1, 11): 11.0, D(2021, 1, 18): 11.0, D(2021, 1, 19): None, D(2021, 1, 7): None}


def test_split_is_not_a_crash(spark):
    b = bars(spark, [(D(2021, 1, 4), 100.0, 50.0), (D(2021, 1, 5), 51.0, 51.0)])
    p = spark.createDataFrame([("A", D(2021, 1, 4), D(2021, 1, 5))], "brand string, s date, e date")
    assert abs(prices.total_return(p, b, "s", "e", "r").first().r - 0.02) < 1e-12


def test_baseline_excludes_the_day_itself(spark):
    days = [D(2021, 1, 1) + timedelta(days=i) for i in range(60)]
    rows = [("A", d, days[i - 1], 0.01 if i % 2 else -0.01) for i, d in enumerate(days) if i]
    rows[-1] = (*rows[-1][:3], 9.0)
    ab = spark.createDataFrame(rows, "brand string, session_date date, prev_date date, abnormal double")
    p = spark.createDataFrame([("A", days[-1])], "brand string, day date")
    assert prices.typical_move(p, ab, "day", "t").first().t < 0.05


def test_entry_is_strictly_after_the_event_even_before_the_first_session(spark):
    b = bars(spark, [(D(2021, 1, 4 + i), 0.0, 10.0 + i) for i in range(5)])
    e = spark.createDataFrame([(1, "A", D(2021, 1, 4)), (2, "A", D(2020, 6, 1)), (3, "A", D(2021, 1, 8))], "id int, brand string, day date").withColumnRenamed("day", "at")
    got = {r.id: r.entry_date for r in prices.forward_return(e, b, "at", 1, "pct").collect()}
    assert got == {1: D(2021, 1, 5), 2: D(2021, 1, 4), 3: None}


def test_truncating_the_future_changes_nothing(spark, tables):
    f = tables.facts_restated
    cut = f.filter(F.col("filed_on") <= F.lit("1998-06-30").cast("date"))
    a, b = (pit.resolve_restatements(pit.as_of(x, "1998-06-30")) for x in (f, cut))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_average_ranks_tie_and_slices_agree(spark):
    d = spark.createDataFrame([("g", float(v), i) for i, v in enumerate([1, 2, 2, 3] + [5] * 40 + list(range(6, 60)))], "k string, v double, id int")
    one = {r.id: (r.r, r.n) for r in ranks.average_rank(d, ["k"], "v", "r", "n", slices=1).collect()}
    many = {r.id: (r.r, r.n) for r in ranks.average_rank(d, ["k"], "v", "_i", "_n", slices=8).withColumnsRenamed({"_i": "r", "_n": "n"}).collect()}
    assert one == many and one[1][0] == one[2][0] == 1.5


def test_thin_pool_has_no_rank_and_low_is_inverted(spark):
    d = spark.createDataFrame([("thin", float(i), True) for i in range(7)] + [("full", float(i), False) for i in range(8)], "k string, v double, up boolean")
    got = ranks.percentile_rank(d, ["k"], "v", F.col("up")).collect()
    assert {r.k for r in got} == {"full"}
    assert {r.v: r.percentile for r in got}[0.0] == 1.0


def test_global_position_without_one_big_sort(spark):
    d = spark.range(1000).selectExpr("id", "nullif(pmod(xxhash64(id), 50), 7) AS x", "id % 3 AS g")
    for slices in (1, 7, 40):
        got = ranks.position_in_order(d, "x", ["id"], "pos", slices=slices).orderBy(F.col("x").asc_nulls_first(), "id").collect()
        assert [r.pos for r in got] == list(range(1, 1001))
        got = ranks.position_in_order(d, "x", ["id"], "pos", "g", True, slices).orderBy("g", F.col("x").desc_nulls_last(), "id").collect()
        assert [r.pos for r in got] == list(range(1, 1001))


def test_of_versions_filed_on_one_day_the_later_arrival_counts(spark):
    rows = [(1, "assets", "instant", date(2020, 3, 31), date(2020, 5, 1), v, a) for v, a in ((9.0, 1), (7.0, 2), (8.0, 0))]
    filed = spark.createDataFrame(rows, "entity_id long, metric string, period string, period_end date, filed_on date, value double, arrival long")
    assert [r.value for r in pit.resolve_restatements(filed).collect()] == [7.0]
    assert [r.value for r in pit.resolve_restatements(filed.drop("arrival")).collect()] == [9.0]
    assert factors.packed_facts(filed).first().filed[-1].value == 7.0
