"""Leave-one-out order statistics of precedents, against plain lists."""

import random
from statistics import median

from pyspark.sql import functions as F

from pitlens.operators import events


def test_a_record_takes_rows_by_its_values_and_not_by_its_counts(spark):
    cells = spark.createDataFrame([("a", 1.5, 1_000_000), ("a", -2.0, 3), ("a", 0.0, 1), ("b", 7.0, 2)], "topic string, move double, c long")
    width, blocks = events.position_blocks(cells, ["topic"])
    assert blocks.count() <= 3 * 4
    at = spark.createDataFrame([("a", p) for p in (0, 2, 3, 4, 500_000, 1_000_003)] + [("b", 0), ("b", 1)], "topic string, pos long").join(width, "topic")
    got = at.withColumn("block", F.expr("pos DIV width")).join(blocks, ["topic", "block"]).filter("pos >= start AND pos < upto").orderBy("topic", "pos").collect()
    assert [r.at_move for r in got] == [-2.0, -2.0, 0.0, 1.5, 1.5, 1.5, 7.0, 7.0]


def test_lookup_matches_plain_lists(spark):
    rng = random.Random(3)
    rows = [("t", "s", k % 11, rng.choice([-1.24, 0.5, 0.5, 0.5, 2.0, round(rng.uniform(-9, 9), 2)])) for k in range(400)]
    got = events.precedent_lookup(spark.createDataFrame(rows, "topic string, sector string, ticker long, move double")).collect()
    assert len(got) == 11
    for r in got:
        v = sorted(m for _, _, t, m in rows if t != r.ticker)
        assert (r.cases, r.median_percent, r.low, r.high) == (len(v), round(median(v), 3), round(v[int(len(v) * 0.1)], 1), round(v[int(len(v) * 0.9)], 1))
