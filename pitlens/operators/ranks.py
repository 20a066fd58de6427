"""Ranking inside comparable pools."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitlens.session import cut_lineage

MIN_UNIVERSE = 8
MIN_SECTOR_MEMBERS = 8
ROWS_PER_SLICE = 500_000
# Sectors whose statements cannot be compared with operating companies.
STRUCTURALLY_DIFFERENT = ("Financials", "Utilities")


def slices_for(largest: int) -> int:
    """Ranges for a pool of so many rows."""
    return max(1, -(-largest // ROWS_PER_SLICE))


def _counted(df: DataFrame, keys: Sequence[str], slices: int | None) -> tuple[DataFrame, int]:
    """The rows and the ranges their largest pool needs; who knows the ranges is spared writing and counting the rows."""
    if slices is not None:
        return df, slices
    base = cut_lineage(df)
    return base, slices_for(base.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0)


def _whole(df: DataFrame, keys: Sequence[str], size: str) -> DataFrame:
    """Pools of one range: their rows with their number, in the one exchange that also orders them."""
    return df.dropna(subset=list(keys)).withColumn(size, F.count(F.lit(1)).over(Window.partitionBy(*keys)))


def _sliced(df: DataFrame, keys: Sequence[str], value: str, size: str, descending: bool, slices: int) -> DataFrame:
    """Rows with the value range of their pool that they fall in and the rows of the ranges before it.

    A pool is cut into ranges of about ROWS_PER_SLICE rows (approximate cut points, exact
    counts: equal values always share a range), so no task orders a whole pool. Nulls come
    first ascending and last descending.
    """
    base = cut_lineage(df)
    steps = F.array(*[F.lit(i / slices) for i in range(slices)])
    cuts = base.groupBy(*keys).agg(F.percentile_approx(value, steps, F.lit(1000)).alias("_cuts"))
    v = F.col(value)
    place = F.when(v.isNull(), F.lit(slices)).otherwise(F.size(F.filter("_cuts", lambda c: c > v))) if descending else F.size(F.filter("_cuts", lambda c: c < v))
    cut = base.join(cuts, list(keys)).withColumn("_slice", F.coalesce(place, F.lit(0))).drop("_cuts")
    counts = cut.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_held"))
    counts = counts.withColumn("_before", F.sum("_held").over(Window.partitionBy(*keys).orderBy("_slice")) - F.col("_held")).withColumn(
        size, F.sum("_held").over(Window.partitionBy(*keys))).drop("_held")
    return cut.join(counts, [*keys, "_slice"])


def average_rank(df: DataFrame, keys: Sequence[str], value: str, rank: str, size: str | None, slices: int | None = None) -> DataFrame:
    """Positions 0..n-1 inside each key group, ties sharing the mean of their span; `size`, if named, holds the group's rows.

    In pools of several ranges equal values are counted before anything is ordered, so a popular value costs a row.
    """
    keys = list(keys)
    df, slices = _counted(df, keys, slices)
    if slices == 1:
        ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, value))
        return (_whole(df, keys, size) if size else df.dropna(subset=keys)).withColumn(rank, F.rank().over(Window.partitionBy(*keys).orderBy(value)) - 1 + (ties - 1) / 2)
    d = _sliced(df, keys, value, size or "_size", False, slices)
    spans = d.groupBy(*keys, "_slice", "_before", value).agg(F.count(F.lit(1)).alias("_ties"))
    below = F.sum("_ties").over(Window.partitionBy(*keys, "_slice").orderBy(value)) - F.col("_ties")
    spans = spans.withColumn(rank, F.col("_before") + below + (F.col("_ties") - 1) / 2).select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(value).alias("_v"), rank)
    same = F.col(value).eqNullSafe(F.col("_v"))
    for i, k in enumerate(keys):
        same = same & (F.col(k) == F.col(f"_k{i}"))
    return d.drop("_slice", "_before").join(spans, same).drop("_v", *([] if size else ["_size"]), *[f"_k{i}" for i in range(len(keys))])


def position(df: DataFrame, keys: Sequence[str], value: str, tie: Sequence[str], out: str, size: str = "_size",
             descending: bool = False, slices: int | None = None) -> DataFrame:
    """1-based position inside each key group by `value`, then by the tie columns; `size` holds the group's rows."""
    order = [F.col(value).desc() if descending else F.col(value), *tie]
    df, slices = _counted(df, keys, slices)
    if slices == 1:
        d = _whole(df, keys, size).withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
        return d.drop(*(["_size"] if size == "_size" else []))
    d = _sliced(df, keys, value, size, descending, slices)
    w = Window.partitionBy(*keys, "_slice").orderBy(*order)
    return d.withColumn(out, (F.row_number().over(w) + F.col("_before")).cast("long")).drop("_slice", "_before", *(["_size"] if size == "_size" else []))


def percentile_rank(df: DataFrame, keys: Sequence[str], value: str, higher_is_better: Column,
                    out: str = "percentile", size: str = "universe_size", slices: int | None = None) -> DataFrame:
    """0 worst to 1 best inside the pool; pools under eight members get no rows."""
    d = average_rank(df, keys, value, "_rank", size, slices).filter(F.col(size) >= MIN_UNIVERSE)
    raw = F.col("_rank") / F.greatest(F.col(size) - 1, F.lit(1))
    return d.withColumn(out, F.round(F.when(higher_is_better, raw).otherwise(1 - raw), 4)).drop("_rank")


def comparable_pool(sector: Column, members: Column) -> Column:
    """The sector when populous enough, else the universe, else nothing at all."""
    enough = F.coalesce(members >= MIN_SECTOR_MEMBERS, F.lit(False))
    return (F.when(sector.isNull(), "universe").when(enough, sector)
            .when(sector.isin(*STRUCTURALLY_DIFFERENT), F.lit(None)).otherwise("universe"))


def position_in_order(df: DataFrame, value: str, tie: Sequence[str], out: str, lead: str | None = None,
                      descending: bool = False, slices: int | None = None) -> DataFrame:
    """1-based position in one global order: `lead` (a column of few values) ascending, `value`, then the tie columns."""
    d = df.withColumn("_lead", F.col(lead) if lead else F.lit(0))
    d = position(d, ["_lead"], value, tie, "_in", "_of", descending, slices)
    groups = d.select("_lead", "_of").distinct()
    before = groups.select("_lead", (F.sum("_of").over(Window.orderBy("_lead")) - F.col("_of")).alias("_earlier"))
    return d.join(before, "_lead").withColumn(out, F.col("_in") + F.col("_earlier")).drop("_lead", "_in", "_of", "_earlier")
