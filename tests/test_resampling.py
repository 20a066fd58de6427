"""How wide resampled intervals must be: returns of independent prices fall back, so errors for independent rows are far too wide."""

import math
import random

from pyspark.sql import functions as F

from pitlens.functions import stats


def test_the_mean_of_returns_that_fall_back_is_as_wide_as_its_blocks_say(spark):
    rng = random.Random(5)
    price = {b: [100 + rng.gauss(0, 3) for _ in range(80)] for b in "ab"}
    drift = {"c": [math.sin(k / 9) / 10 for k in range(80)]}
    rows = [(b, k, v[k] / v[k - 1] - 1) for b, v in price.items() for k in range(1, 80)] + [(b, k, v) for b, s in drift.items() for k, v in enumerate(s)]
    m = spark.createDataFrame(rows, "brand string, month int, ret double")
    d = stats.resample_statistics(m, ["brand"], "month", ["ret"], {"mean": stats.mean_of("ret")}, resamples=2000)
    got = d.join(stats.block_error(m, ["brand"], "month", "ret"), "brand").join(m.groupBy("brand").agg((F.stddev_samp("ret") / F.sqrt(F.count("ret"))).alias("plain")), "brand").collect()
    width = {r.brand: (r.high - r.low) / (2 * 1.96) for r in got}
    assert all(0.9 < width[r.brand] / r.se < 1.1 for r in got)
    assert any(not 0.5 <= width[r.brand] / r.plain <= 1.5 for r in got)
