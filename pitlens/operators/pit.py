"""Point-in-time operators: visibility, restatements, and bounded as-of lookups.

The lookups never sort a whole history.  History is packed into small arrays per
(key, block of days), each row reaching at most two blocks, and a probe reads one
block by equi-join.  An array therefore holds at most two blocks of calendar days
however hot its key is, and a hot probe key is an ordinary skewed equi-join that
adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of(df: DataFrame, when: str, column: str = "filed_on") -> DataFrame:
    """Rows knowable by the end of that day."""
    return df.filter(F.col(column) <= F.lit(when).cast("date"))


def resolve_restatements(facts: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """One row per period: the version filed last among those visible.

    Of versions filed on one day the one that arrived later counts, by the column `arrival` where facts
    have it; without it, or alike in it, the larger value, so that runs agree.
    """
    keys = [*extra, "entity_id", "metric", "period", "period_end"]
    last = F.max(F.struct("filed_on", *(["arrival"] if "arrival" in facts.columns else []), "value"))
    return facts.groupBy(*keys).agg(last.alias("v")).select(*keys, "v.filed_on", "v.value")


def by_position(history: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """`back` counts reported periods from the newest; histories are calendar-bounded."""
    w = Window.partitionBy(*extra, "entity_id", "metric", "period").orderBy(F.col("period_end").desc())
    return history.withColumn("back", F.row_number().over(w) - 1)


def newest_filing(facts: DataFrame) -> DataFrame:
    return facts.groupBy("entity_id").agg(F.max("filed_on").alias("newest_filing"))


def aligned(history: DataFrame, metrics: Sequence[str], back: int = 0) -> DataFrame:
    """Latest (or back-th) period end shared by every metric, with all their values."""
    wide = history.filter(F.col("metric").isin(*metrics)).groupBy("entity_id", "period_end").agg(
        *[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in metrics])
    w = Window.partitionBy("entity_id").orderBy(F.col("period_end").desc())
    return (wide.dropna(subset=list(metrics)).withColumn("rn", F.row_number().over(w))
            .filter(F.col("rn") == back + 1).drop("rn"))


def nearby(probes: DataFrame, history: DataFrame, keys: Sequence[str], probe_date: str,
           hist_date: str, back: int, ahead: int, payload: Sequence[str], out: str = "nearby") -> DataFrame:
    """Attach, oldest first, the history rows within [probe - back, probe + ahead] days."""
    width = back + ahead + 1
    first = f"ceil((unix_date({hist_date}) - {width - 1 + ahead}) / {width})"
    last = f"floor((unix_date({hist_date}) + {back}) / {width})"
    packed = history.selectExpr(
        *keys, f"explode(sequence({first}, {last})) AS _block", f"struct({hist_date} AS at, {', '.join(payload)}) AS _row",
    ).groupBy(*keys, "_block").agg(F.expr("sort_array(collect_list(_row)) AS _rows"))
    joined = probes.selectExpr("*", f"floor(unix_date({probe_date}) / {width}) AS _block").join(packed, [*keys, "_block"], "left")
    inside = (f"filter(_rows, r -> datediff({probe_date}, r.at) <= {back} AND datediff(r.at, {probe_date}) <= {ahead})")
    return joined.selectExpr(*[f"`{c}`" for c in probes.columns], f"{inside} AS {out}")


def on_or_before(probes: DataFrame, history: DataFrame, keys: Sequence[str], probe_date: str,
                 hist_date: str, payload: Sequence[str], max_back: int, out: str) -> DataFrame:
    """As-of backward: the last history row at or before the probe, null past `max_back` days."""
    got = nearby(probes, history, keys, probe_date, hist_date, max_back, 0, payload, "_near")
    return got.withColumn(out, F.expr("try_element_at(_near, -1)")).drop("_near")


def nearest(probes: DataFrame, history: DataFrame, keys: Sequence[str], probe_date: str,
            hist_date: str, payload: Sequence[str], tolerance: int, out: str) -> DataFrame:
    """Nearest history row within the tolerance; the older one wins a tie."""
    got = nearby(probes, history, keys, probe_date, hist_date, tolerance, tolerance, payload, "_near")
    fields = ", ".join(f"r.{p} AS {p}" for p in payload)
    ranked = f"transform(_near, r -> struct(abs(datediff(r.at, {probe_date})) AS gap, r.at AS at, {fields}))"
    return got.withColumn(out, F.expr(f"array_min({ranked})")).drop("_near")


def year_apart(anchors: DataFrame, history: DataFrame, keys: Sequence[str], anchor: str, hist_date: str,
               payload: Sequence[str], out: str, tolerance: int = 60) -> DataFrame:
    """The row nearest to a year before the anchor, strictly earlier, within the tolerance."""
    probes = anchors.withColumn("_target", F.date_sub(anchor, 365))
    return nearest(probes, history, keys, "_target", hist_date, payload, tolerance, out).drop("_target")
