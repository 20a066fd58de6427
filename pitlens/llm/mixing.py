"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents are shuffled and laid end to end, and the stream is cut into blocks of
equal words. Slot k of the mix falls at the fractional part of k times the golden ratio; the
sources' shares of the slots, laid end to end, say whose slot that is. The n-th slot of a
source takes its n-th block, starting over after the last, so every stretch of the mix
holds the sources in nearly their target proportions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pitlens.llm.chunking import unused
from pitlens.session import cut_lineage

WEIGHTS, SHARE, CAP, BLOCK_WORDS = (3.0, 1.0, 2.0), 1.5, 2.0, 512
WORD = r"[^\x20\x09-\x0D]+"
_BITS, _HALF, _CELLS, _CHUNK, _BUCKET_ROWS = 40, 20, 1_024, 65_536, 2_000
_GOLDEN = 679_535_556_991  # 2**40 times the golden ratio's fractional part, made odd


def golden(k: Column) -> Column:
    """The fractional part of k times the golden ratio, in units of 2**-40, without overflow below 2**43."""
    high = F.shiftleft(F.pmod(F.shiftright(k, _HALF) * F.lit(_GOLDEN), F.lit(1 << _HALF)), _HALF)
    return F.pmod(high + k.bitwiseAND(F.lit((1 << _HALF) - 1)) * F.lit(_GOLDEN), F.lit(1 << _BITS))


def numbered(df: DataFrame, order: Column, name: str) -> DataFrame:
    """Rows numbered from 0 in a global order: sorted ranges, each counted on from those before it."""
    ranged = cut_lineage(df.orderBy(order).withColumn("_range", F.spark_partition_id()))
    within = Window.partitionBy("_range").orderBy(order)
    sizes = ranged.groupBy("_range").count().withColumn(
        "_before", F.sum("count").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)))
    return ranged.withColumn("_at", F.row_number().over(within)).join(sizes.select("_range", "_before"), "_range").withColumn(
        name, F.col("_at") - 1 + F.coalesce("_before", F.lit(0))).drop("_range", "_at", "_before")


def targets(totals: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, source_size -> also sid, target: words each source should give.

    Sources by code point, null last, weigh `weights` in turn; targets share `share` times all
    words by weight, stop at `cap` times their source's size, and the excess is shared again.
    """
    known = numbered(totals, F.col("source").asc_nulls_last(), "sid").withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("sid"), F.lit(len(weights))) + 1).cast("int")))
    known = cut_lineage(known)
    level = 0.0
    while True:
        over = F.col("source_size") * cap <= F.col("weight") * level
        row = known.agg(F.sum("source_size").alias("all"), F.sum(F.when(over, F.col("source_size") * cap)).alias("full"),
                        F.sum(F.when(~over, F.col("weight"))).alias("open")).first()
        if not row["open"]:
            break
        now = (share * row["all"] - (row["full"] or 0.0)) / row["open"]
        if now <= level:
            break
        level = now
    return known.withColumn("target", F.least(F.col("source_size") * cap, F.col("weight") * level)).drop("weight")


def schedule(sources: DataFrame, block: int) -> DataFrame:
    """sid, rank, position: the slots of the mix, from sources with sid and slots (how many each has).

    A source that the points leave short of its slots gets the rest after the last point; points
    beyond its slots go unused. Both are a few blocks.
    """
    spark = sources.sparkSession
    n = sources.agg(F.sum("slots")).first()[0] or 0
    ends = F.sum("slots").over(Window.orderBy("sid"))
    spans = sources.where("slots > 0").withColumn("hi", F.floor(ends / F.lit(float(max(n, 1))) * float(1 << _BITS))).withColumn(
        "lo", F.floor((ends - F.col("slots")) / F.lit(float(max(n, 1))) * float(1 << _BITS)))
    shift = _BITS - (_CELLS.bit_length() - 1)
    cells = spans.select("sid", "lo", "hi", "slots", F.explode(F.sequence(
        F.shiftright("lo", shift), F.shiftright(F.greatest(F.col("hi") - 1, F.col("lo")), shift))).alias("cell"))
    points = spark.range(n).select(F.col("id").alias("position"), golden(F.col("id")).alias("u")).withColumn("cell", F.shiftright("u", shift))
    owned = points.join(cells, "cell").where("u >= lo AND u < hi").select(
        "sid", "slots", "position", F.floor(F.col("position") / _CHUNK).alias("chunk"))
    counts = owned.groupBy("sid", "chunk").count().withColumn(
        "before", F.sum("count").over(Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = owned.withColumn("at", F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("position"))).join(
        counts.select("sid", "chunk", F.coalesce("before", F.lit(0)).alias("before")), ["sid", "chunk"]).select(
        "sid", (F.col("before") + F.col("at") - 1).alias("rank"), "position", "slots").where("rank < slots").select("sid", "rank", "position")
    met = counts.groupBy("sid").agg(F.sum("count").alias("met"))
    short = sources.where("slots > 0").join(met, "sid", "left").withColumn("met", F.coalesce("met", F.lit(0))).where("met < slots").select(
        "sid", F.explode(F.sequence(F.col("met"), F.col("slots") - 1)).alias("rank")).select("sid", "rank", (F.col("rank") + n).alias("position"))
    return ranked.unionByName(short)


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP,
        block: int = BLOCK_WORDS, seed: int = 7) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, first_position: a row per row of `docs`.

    `size` counts words, 0 for a null text; `taken` is how many of them the mix holds, repeats
    counted, at most `cap` times the size; `first_position` is the first slot that holds some (null:
    none). The shuffle depends on ids, sizes and the seed alone, so runs agree; rows alike in
    both stand side by side. A null source is a source; extra columns are not read, and no rows give none.
    """
    sized = docs.select("doc_id", "source", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"))
    sized = cut_lineage(sized.withColumn("_h", F.xxhash64(F.lit(seed), "doc_id", "size")))
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    aims = targets(totals, weights, share, cap)
    want, size = F.round("target").cast("long"), F.col("source_size")
    per_pass = F.ceil(size / block)
    aims = cut_lineage(aims.withColumn("want", want).withColumn("blocks", per_pass).withColumn("slots", F.when(
        size > 0, F.floor(F.col("want") / F.greatest(size, F.lit(1))) * F.col("blocks") + F.ceil((F.col("want") % F.greatest(size, F.lit(1))) / block)).otherwise(0)))
    buckets = max(1, -(-(aims.agg(F.sum("n")).first()[0] or 0) // _BUCKET_ROWS))
    placed = sized.withColumn("bucket", F.pmod("_h", F.lit(buckets)))
    base = placed.groupBy("source", "bucket").agg(F.sum("size").alias("words")).withColumn("base", F.coalesce(F.sum("words").over(
        Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("b")
    base = base.join(aims.alias("a"), F.col("b.source").eqNullSafe(F.col("a.source"))).select(
        F.col("b.source").alias("_source"), F.col("b.bucket").alias("_bucket"), "base", "sid", "source_size", "target", "want", "blocks")
    rows = Window.partitionBy("source", "bucket").orderBy("_h", "doc_id", "size")
    laid = placed.withColumn("row", F.row_number().over(rows)).withColumn(
        "inner", F.coalesce(F.sum("size").over(rows.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).join(
        base, F.col("source").eqNullSafe(F.col("_source")) & (F.col("bucket") == F.col("_bucket"))).withColumn("start", F.col("base") + F.col("inner"))
    last = F.col("start") + F.col("size") - 1
    pieces = laid.withColumn("blk", F.explode_outer(F.when(F.col("size") > 0, F.sequence(
        F.floor(F.col("start") / block), F.floor(last / block))))).withColumn("from", F.greatest(F.col("start") - F.col("blk") * block, F.lit(0))).withColumn(
        "to", F.least(last + 1 - F.col("blk") * block, F.lit(block)))
    turn = F.floor(F.col("rank") / F.col("blocks"))
    slots = schedule(aims.select("sid", "slots"), block).join(aims.select("sid", "source_size", "want", "blocks"), "sid").withColumn(
        "blk", F.col("rank") % F.col("blocks")).withColumn("take", F.col("want") - turn * F.col("source_size") - F.col("blk") * block).select(
        F.col("sid").alias("_sid"), F.col("blk").alias("_blk"), "take", "position")
    got = F.when(F.col("take").isNotNull(), F.greatest(F.least("to", "take") - F.col("from"), F.lit(0)))
    held = pieces.join(slots, (F.col("sid") == F.col("_sid")) & (F.col("blk") == F.col("_blk")), "left")
    return held.groupBy("sid", "bucket", "row").agg(
        *[F.first(c).alias(c) for c in ("doc_id", "source", "size", "source_size", "target")],
        F.coalesce(F.sum(got), F.lit(0)).cast("long").alias("taken"), F.min(F.when(got > 0, F.col("position"))).alias("first_position")).drop("sid", "bucket", "row")


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The documents of the mix, each as often as it is taken, to the nearest whole number; columns as given.

    Rows alike in every column are taken alike.
    """
    key, doc, mixed, times, copy = (unused(docs.columns, c) for c in ("_key", "_doc", "_mixed", "_times", "_copy"))
    names = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.withColumn(key, F.xxhash64(*names))
    given = keyed.select("text", F.struct("doc_id", F.col(key).alias("key")).alias("doc_id"), "source")
    taken = mix(given, **how).groupBy(F.col("doc_id.doc_id").alias(doc), F.col("doc_id.key").alias(mixed)).agg(
        F.round(F.sum("taken") / F.greatest(F.sum("size"), F.lit(1))).cast("int").alias(times))
    return keyed.join(taken.where(F.col(times) > 0), (F.col(key) == F.col(mixed)) & F.col("doc_id").eqNullSafe(F.col(doc))).withColumn(
        copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*names)
