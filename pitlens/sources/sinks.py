"""Writes that can be repeated: append what is absent, replace what is derived."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitlens.session import cut_lineage


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def content_hash(columns: Sequence[str]) -> str:
    """Hash of the row's columns in name order."""
    fields = ", ".join(sorted(columns))
    return f"sha2(to_json(struct({fields})), 256)"


def append_if_absent(df: DataFrame, path: str, columns: Sequence[str], partition_by: Sequence[str] = ()) -> None:
    """Content-addressed append: a row already stored is dropped without a word."""
    fresh = df.withColumn("content_hash", F.expr(content_hash(columns))).dropDuplicates(["content_hash"])
    if exists(df.sparkSession, path):
        fresh = fresh.join(df.sparkSession.read.parquet(path).select("content_hash"), "content_hash", "left_anti")
    fresh.write.mode("append").partitionBy(*partition_by).parquet(path)


def first_come(df: DataFrame, key_sets: Sequence[Sequence[str]], arrival: Sequence[str]) -> DataFrame:
    """Rows that no earlier accepted row matches on any of the key sets, as if they had been offered one by one.

    In a round, the row that is the earliest left on each of its keys is accepted, and whatever shares a key
    with it is turned away; a row turned away blocks nobody. Rounds go on over what is left undecided; an
    arrival order unrelated to the keys leaves a few rounds, whatever the number of rows, and a hot key is settled in one.
    A key set with a null in it matches nothing. Rows alike are one row; rows alike in `arrival` go by their other columns.
    """
    names = df.columns
    order = [*arrival, *(c for c in names if c not in arrival)]
    if len(key_sets) == 1:  # the earliest of each key, and nothing to turn away twice
        keyed = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key_sets[0]])
        first = df.filter(keyed).groupBy(*key_sets[0]).agg(F.min(F.struct(*order)).alias("_first")).select("_first.*")
        return first.select(*names).unionByName(df.filter(~keyed).dropDuplicates())
    left = cut_lineage(df.dropDuplicates().withColumn("_turn", F.struct(*order)))
    accepted = []
    while True:
        first = F.lit(True)
        tried = left
        for k, keys in enumerate(key_sets):
            least = left.groupBy(*keys).agg(F.min("_turn").alias(f"_least{k}"))
            tried = tried.join(least, list(keys), "left")
            first = first & F.coalesce(F.col(f"_least{k}") == F.col("_turn"), F.lit(True))
        taken = cut_lineage(tried.filter(first).select(*names, "_turn"))
        accepted.append(taken.select(*names))
        for keys in key_sets:
            left = left.join(taken.select(*keys).distinct(), list(keys), "left_anti")
        left = cut_lineage(left.join(taken.select("_turn"), "_turn", "left_anti").select(*names, "_turn"))
        if left.isEmpty():
            return reduce(DataFrame.unionByName, accepted)


def append_absent_keys(df: DataFrame, path: str, key_sets: Sequence[Sequence[str]], arrival: Sequence[str]) -> None:
    """Append rows matching no stored row on any of the key sets, and no earlier accepted row of the batch; see first_come."""
    spark, fresh = df.sparkSession, df
    if exists(spark, path):
        stored = spark.read.parquet(path)
        for keys in key_sets:
            fresh = fresh.join(stored.select(*keys).distinct(), list(keys), "left_anti")
    first_come(fresh, key_sets, arrival).select(*df.columns).write.mode("append").parquet(path)


def replace_as_of(df: DataFrame, path: str, partition: str = "as_of") -> None:
    """Rewrite only the dates present in `df`; every other date stays as stored."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path))


def replace_untouched(stored: DataFrame, derived: DataFrame, key: str, touched: str, path: str) -> None:
    """Rebuild derived rows but keep those a person acted on; written beside the old table."""
    kept = stored.filter(touched)
    derived.join(kept.select(key), key, "left_anti").unionByName(kept).write.mode("overwrite").parquet(path)


def incremental_since(incoming: DataFrame, stored: DataFrame, key: str, at: str, overlap_days: int = 7) -> DataFrame:
    """Rows newer than what is stored for their key, less a week of overlap."""
    newest = stored.groupBy(key).agg(F.max(at).alias("_newest"))
    return incoming.join(newest, key, "left").filter(f"_newest IS NULL OR {at} >= date_sub(_newest, {overlap_days})").drop("_newest")


def upsert(stored: DataFrame, changes: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Update by key, insert otherwise; the later version wins."""
    both = stored.unionByName(changes)
    rest = [c for c in both.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max(F.struct(version, *[c for c in rest if c != version])).alias("_v")).select(*keys, "_v.*")


def export_tables(tables: dict[str, DataFrame], root: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").option("compression", "gzip").json(f"{root}/{name}")


def import_tables(spark: SparkSession, root: str, target: str, schemas: dict[str, str], replace: bool = False) -> None:
    """Tables in the given order; one that already holds data is skipped unless replaced."""
    for name, schema in schemas.items():
        spark.read.schema(schema).json(f"{root}/{name}").write.mode("overwrite" if replace else "ignore").parquet(f"{target}/{name}")


def record_assessments(df: DataFrame, path: str) -> None:
    """Accepted and rejected judgements alike, once per (document, kind, quote)."""
    from pitlens.functions.text import fold_quotes
    hashed = df.withColumn("quote_hash", F.expr(f"sha2({fold_quotes('quote')}, 256)"))
    append_absent_keys(hashed, path, [("doc_id", "kind", "quote_hash")], ("quote",))


def latest_version(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
