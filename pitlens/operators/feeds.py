"""Feeds, pages, joins and selections.

Top-k per key is `row_number` with a limit, which Spark trims on the map side, so
a hot key ships k rows per task.  Newest-per-key is `max_by`, which pre-aggregates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE_KINDS = {"findings": "priority", "documents": "published"}
MAX_PAGE = 200


def findings_feed(findings: DataFrame, *, entity: int | None = None, kind: str | None = None, since: str | None = None,
                  min_confidence: float | None = None, include_dismissed: bool = False, unreviewed: bool = False,
                  limit: int = 100) -> DataFrame:
    d = findings
    if entity is not None:
        d = d.filter(F.col("entity_id") == entity)
    if kind is not None:
        d = d.filter(F.col("event_type") == kind)
    if since is not None:
        d = d.filter(F.col("occurred_at") >= F.lit(since).cast("timestamp"))
    if min_confidence is not None:
        d = d.filter(F.col("confidence") >= min_confidence)
    if not include_dismissed:
        d = d.filter(~F.col("dismissed"))
    if unreviewed:
        d = d.filter(~F.col("reviewed"))
    return d.orderBy(F.col("priority").desc(), F.col("occurred_at").desc(), "finding_id").limit(limit)


def page(df: DataFrame, kind: str, order: Sequence[Column], limit: int, offset: int) -> DataFrame:
    """One page of a known kind; an unknown kind is an error, not an empty page."""
    if kind not in PAGE_KINDS:
        raise ValueError(f"unknown kind {kind!r}; known: {', '.join(sorted(PAGE_KINDS))}")
    return df.orderBy(*order).offset(offset).limit(min(limit, MAX_PAGE))


def newest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def latest(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.max_by(c, order).alias(c) for c in columns], F.max(order).alias(order))


def recent_documents(filings: DataFrame, now: str, annual: str, quarterly: str, event: str, call: str) -> DataFrame:
    """Newest annual and quarterly, every event filing of 90 days, at most two calls per entity."""
    at = F.lit(now).cast("date")
    seen = filings.filter(F.col("published") <= at)
    allowed = F.expr(f"CASE subtype WHEN '{annual}' THEN 1 WHEN '{quarterly}' THEN 1 WHEN '{call}' THEN 2 ELSE 0 END")
    few = newest_per_key(seen.filter(F.col("subtype").isin(annual, quarterly, call)), ["entity", "subtype"],
                         [F.col("published").desc(), F.col("doc_id").desc()], 2)
    w = Window.partitionBy("entity", "subtype").orderBy(F.col("published").desc(), F.col("doc_id").desc())
    few = few.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= allowed).drop("_r")
    events = seen.filter((F.col("subtype") == event) & (F.col("published") >= F.date_sub(at, 90)))
    return few.unionByName(events)


def previous_in_order(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str], bucket: str) -> DataFrame:
    """The row before each row in its key's order, strictly earlier, without sorting a whole key.

    Rows are ordered inside a bucket of the order column; a bucket's first row takes
    the last row of the previous non-empty bucket, found on one row per bucket.
    Ties in `order` skip to the strictly earlier group.
    """
    d = df.withColumn("_b", F.expr(bucket))
    packed = F.struct(order, *columns)
    last = d.groupBy(*keys, "_b").agg(F.max(packed).alias("_last"))
    before = last.select(*keys, "_b", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_b")).alias("_before"))
    w = Window.partitionBy(*keys, "_b").orderBy(F.unix_date(order)).rangeBetween(Window.unboundedPreceding, -1)
    inside = d.withColumn("_inside", F.max(packed).over(w))
    return inside.join(before, [*keys, "_b"]).withColumn("prior", F.coalesce("_inside", "_before")).drop("_b", "_inside", "_before")


def top_others(df: DataFrame, group: str, key: str, order: Sequence[Column], n: int) -> DataFrame:
    """For every row the n best other members of its group: always among the group's best n + 1."""
    w = Window.partitionBy(group).orderBy(*order)
    best = df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n + 1).select(
        group, F.col(key).alias("peer"), F.col("_r").alias("_pos"))
    pairs = df.select(group, key).join(best, group).filter(F.col(key) != F.col("peer"))
    own = best.select(F.col("peer").alias(key), F.col("_pos").alias("_own"))
    return pairs.join(own, key, "left").withColumn(
        "pos", F.col("_pos") - F.when(F.col("_own") < F.col("_pos"), 1).otherwise(0)).filter(F.col("pos") <= n).drop("_pos", "_own")


def daily_window_sum(anchors: DataFrame, daily: DataFrame, keys: Sequence[str], at: str, days: int, columns: Sequence[str]) -> DataFrame:
    """Sum pre-aggregated daily rows over (at, at + days] by spreading each anchor over its days."""
    spread = anchors.withColumn("day", F.explode(F.sequence(F.date_add(at, 1), F.date_add(at, days))))
    sums = spread.join(daily, [*keys, "day"], "left").groupBy(*keys, at).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in columns])
    return sums


def round_robin(needs: DataFrame, account: str, key: str, order: Sequence[Column]) -> DataFrame:
    """The i-th need of every account before the (i+1)-th of any; a repeated need keeps its first turn."""
    w = Window.partitionBy(account).orderBy(*order)
    turns = needs.withColumn("turn", F.row_number().over(w))
    first = turns.groupBy(key).agg(F.min(F.struct("turn", account)).alias("_f"))
    return first.select(key, "_f.turn", F.col(f"_f.{account}").alias(account))


def share_quota(ranked: Sequence[tuple[DataFrame, int]], key: str, limit: int) -> DataFrame:
    """Claims in order, each up to its share, a key claimed once, unused room passed on.

    Each source contributes at most `limit` + what earlier ones took, so the union is a
    few hundred rows however long the sources are.
    """
    taken: DataFrame | None = None
    for i, (df, share) in enumerate(ranked):
        best = df.orderBy("pos").limit(limit * (i + 1)).select(key, "pos")
        if taken is not None:
            best = best.join(taken.select(key), key, "left_anti")
            room = taken.agg((F.lit(limit) - F.count(F.lit(1))).alias("room"))
        else:
            room = df.sparkSession.range(1).select(F.lit(limit).alias("room"))
        best = best.withColumn("_n", F.row_number().over(Window.orderBy("pos")))
        got = best.join(F.broadcast(room)).filter(F.col("_n") <= F.least(F.lit(share), F.col("room"))).select(
            key, F.lit(i).alias("claim"), F.col("_n").alias("turn"))
        taken = got if taken is None else taken.unionByName(got)
    return taken


def multiset_divergence(items: DataFrame, key: str, side: str, item: str) -> DataFrame:
    """(key, one, other, divergence) of any two sides of a key: 1 less the share that their multisets of items have in common.

    What two multisets have in common is counted where both hold an item; what they hold together is
    their sizes less that, so items of one side alone meet nothing. A side holds few kinds, never items, in one row.
    """
    counts = items.groupBy(key, side, item).agg(F.count(F.lit(1)).alias("n"))
    kinds = counts.groupBy(key, item).agg(F.sort_array(F.collect_list(F.struct(F.col(side).alias("side"), "n"))).alias("sides")).filter("size(sides) > 1")
    pairs = kinds.select(key, F.explode(F.flatten(F.transform("sides", lambda a: F.transform(F.filter("sides", lambda b: b["side"] > a["side"]), lambda b: F.struct(
        a["side"].alias("one"), b["side"].alias("other"), F.least(a["n"], b["n"]).alias("n")))))).alias("p"))
    common = pairs.groupBy(key, "p.one", "p.other").agg(F.sum("p.n").alias("common"))
    sizes = items.groupBy(key, side).agg(F.count(F.lit(1)).alias("n"))
    both = sizes.select(key, F.col(side).alias("one"), F.col("n").alias("one_n")).join(sizes.select(key, F.col(side).alias("other"), F.col("n").alias("other_n")), key).filter("one < other")
    shared = F.coalesce(F.col("common"), F.lit(0))
    return both.join(common, [key, "one", "other"], "left").select(key, "one", "other", F.round(1 - shared / (F.col("one_n") + F.col("other_n") - shared), 6).alias("divergence"))
