"""Exposure edges between dependents and the hubs they name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitlens.operators.feeds import newest_per_key

MIN_MENTIONS, MAX_DEPENDENTS = 8, 12


def build_exposures(counts: DataFrame) -> DataFrame:
    """Twelve strongest dependents of each hub, itself left out, with enough mentions to matter."""
    d = counts.filter((F.col("mention_count") >= MIN_MENTIONS) & (F.col("dependent") != F.col("hub")))
    return newest_per_key(d, ["hub"], [F.col("mention_count").desc(), F.col("dependent")], MAX_DEPENDENTS)


def dependents_of(edges: DataFrame, hub: int) -> DataFrame:
    return edges.filter(F.col("hub") == hub).orderBy(F.col("mention_count").desc(), "dependent")


def nodes(edges: DataFrame) -> DataFrame:
    """How many each node reaches as a hub and how many hubs it leans on, in one pass over both ends."""
    ends = edges.selectExpr("inline(array(struct(hub AS node, 1 AS reach, 0 AS upstream), struct(dependent AS node, 0 AS reach, 1 AS upstream)))")
    return ends.groupBy("node").agg(F.sum("reach").alias("reach"), F.sum("upstream").alias("upstream"))


def dependents_array(edges: DataFrame) -> DataFrame:
    """One row per hub with its (at most twelve) dependents, for attaching to events."""
    return build_exposures(edges).groupBy("hub").agg(F.expr("transform(array_sort(collect_list(struct(-mention_count AS m, dependent AS d))), x -> x.d) AS dependents"))
