"""Earnings whose figures lie half-way between two cents, against the twins."""

import os

import pytest
from compare import TABLES, check, connect
from conftest import SF
from pitlens.plans import QUERIES
from pitlens.plans.registry import runner


@pytest.mark.parametrize("name", ["earnings_event_rows", "latest_event_per_date", "earnings_outlook"])
def test_half_cents_settle_as_in_the_twin(spark, tmp_path, name):
    for t in TABLES:
        os.symlink(f"{SF}/{t}.parquet", tmp_path / f"{t}.parquet")
    os.unlink(tmp_path / "orders.parquet")
    # every price of a half cent with every factor, a day each
    rows = spark.range(21 * 600).selectExpr(
        "id AS o_orderkey", "id % 97 AS o_custkey", "CASE WHEN id % 5 = 0 THEN 'P' ELSE 'F' END AS o_orderstatus", "(id DIV 21 + 1) * 500D AS o_totalprice",
        "timestamp_ntz'2000-01-01 00:00:00' + make_interval(0, 0, 0, int(id DIV 97)) AS o_orderdate", "'1-URGENT' AS o_orderpriority")
    rows.coalesce(1).write.parquet(str(tmp_path / "written"))
    os.symlink(next((tmp_path / "written").glob("part-*.parquet")), tmp_path / "orders.parquet")
    rows = runner(QUERIES[name])(spark, str(tmp_path))
    assert check(connect(str(tmp_path)), rows, QUERIES[name].sql) is None and rows.count() > 0


def test_half_way_percents_settle_on_the_product(spark, tmp_path):
    """(244.41 / 160 - 1) * 100 is 52.756249999999994 in doubles and 527562.5 in ten-thousandths: the twin says 52.7563."""
    import datetime as dt

    import duckdb
    rows = [(k, dt.datetime(2024, 1, 30, 10, k), 1, v, "view", '{"k": 1}') for k, v in enumerate((160.0, 244.41))]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, value double, event_type string, props string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    from compare import check
    from pitlens.plans import QUERIES
    from pitlens.plans.registry import runner
    assert check(con, runner(QUERIES["intraday_change"])(spark, str(tmp_path)), QUERIES["intraday_change"].sql) is None
