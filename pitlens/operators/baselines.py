"""Leave-one-out base rates: how often a label was seen before this moment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitlens.functions.stats import shrunk_rate
from pitlens.session import cut_lineage

MIN_SAMPLES, PRIOR_WEIGHT, ANOMALY_RATE = 10, 10.0, 0.10
LABELS = ("minor", "moderate", "major")


def counts_before(df: DataFrame, keys: Sequence[str], row_id: str, ts: str, flags: Sequence[str],
                  window_days: int, prefix: str, unit_seconds: int = 3600) -> DataFrame:
    """Sum each 0/1 flag over rows of the same key in [t - window, t), the row itself left out.

    A range frame over (key) would put a whole hot key in one task.  Instead counts
    are pre-aggregated per (key, unit of time) and summed over units, and only the
    two edge units are ordered row by row: the unit holding t, and the unit one
    window earlier, whose rows visit this one as negative entries.
    """
    keys = list(keys)
    unit = unit_seconds * 1_000_000
    span = window_days * 86400 // unit_seconds
    d = df.withColumn("_us", F.unix_micros(ts)).withColumn("_u", F.floor(F.col("_us") / unit)).withColumn(
        "_off", F.col("_us") - F.col("_u") * unit).drop("_us")
    # every row enters at its unit and leaves again one window later
    both = F.explode(F.array(F.lit(0), F.lit(span)))
    signed = lambda f: F.when(F.col("_shift") == 0, F.col(f)).otherwise(-F.col(f))
    before = Window.unboundedPreceding

    def sums(rows: DataFrame, order: str, within: list[str], tag: str) -> DataFrame:
        w = Window.partitionBy(*within).orderBy(order).rangeBetween(before, -1)
        moved = rows.withColumn("_shift", both).withColumn("_u", F.col("_u") + F.col("_shift"))
        summed = moved.select("*", *[F.coalesce(F.sum(signed(f)).over(w), F.lit(0)).alias(f"{tag}{f}") for f in flags])
        return summed.filter("_shift = 0").drop("_shift")

    inside = sums(d, "_off", [*keys, "_u"], "_e_")
    units = sums(d.groupBy(*keys, "_u").agg(*[F.sum(f).alias(f) for f in flags]), "_u", keys, "_w_").drop(*flags)
    got = inside.join(units, [*keys, "_u"])
    return got.select(*df.columns, *[(F.col(f"_e_{f}") + F.col(f"_w_{f}")).alias(f"{prefix}{f}") for f in flags])


def evidence_scores(findings: DataFrame, window_days: int) -> DataFrame:
    """Rate and lift of each finding's own magnitude label against its entity's past.

    Under ten past findings nothing is computed; not computable is not the same as normal.
    """
    d = findings.select("finding_id", "entity_id", "event_type", "occurred_at", "magnitude",
                        *[F.when(F.col("magnitude") == l, 1).otherwise(0).alias(l) for l in LABELS])
    d = counts_before(d, ["entity_id", "event_type"], "finding_id", "occurred_at", LABELS, window_days, "own_")
    d = cut_lineage(d)
    d = counts_before(d, ["event_type"], "finding_id", "occurred_at", LABELS, window_days, "all_", unit_seconds=60)
    pick = lambda p: "CASE magnitude " + " ".join(f"WHEN '{l}' THEN {p}{l}" for l in LABELS) + " END"
    d = d.selectExpr("finding_id", "entity_id", "event_type", "magnitude",
                     "own_minor + own_moderate + own_major AS sample_size", f"{pick('own_')} AS hits",
                     f"CASE WHEN all_minor + all_moderate + all_major = 0 THEN 1 / 3D ELSE ({pick('all_')}) / (all_minor + all_moderate + all_major) END AS prior")
    d = d.selectExpr("*", f"CASE WHEN sample_size >= {MIN_SAMPLES} THEN {shrunk_rate('hits', 'sample_size', 'prior', PRIOR_WEIGHT)} END AS rate")
    return d.selectExpr("finding_id", "entity_id", "event_type", "magnitude", "sample_size", "rate",
                        "CASE WHEN rate <> 0 AND prior > 0 THEN rate / prior END AS lift",
                        f"coalesce(rate < {ANOMALY_RATE}, false) AS is_anomalous")
