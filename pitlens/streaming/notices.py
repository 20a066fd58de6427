"""The live path: landed notice files, deduplicated, tracked, scored, written once.

State is the dedupe keys of one day; priors and dependents are read afresh for each
micro-batch, so a new prior counts from the next batch on. What a cycle writes lies by day and
epoch, and a ledger of epochs, one small file each, is the path's heartbeat.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitlens.session import checkpoint_dir
from pitlens.sources.sinks import exists
from pitlens.streaming.scoring import score_events

NOTICE_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
LEDGER_SCHEMA = "notices long, written long, first_day date, last_day date, seconds double, failure string"


def notice_stream(spark: SparkSession, folder: str, pattern: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(NOTICE_SCHEMA).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def as_notices(raw: DataFrame) -> DataFrame:
    """Notices in event time; several items of one hour share an accession."""
    return raw.selectExpr("event_id AS external_id", "user_id AS entity_id", "event_type AS form", "cast(ts AS timestamp) AS accepted_at", "value", "props",
                          "concat_ws('-', user_id, event_type, date_format(ts, 'yyyyMMddHH')) AS accession")


def dedupe_seen(notices: DataFrame) -> DataFrame:
    return notices.withWatermark("accepted_at", "24 hours").dropDuplicatesWithinWatermark(["accession"])


def track(notices: DataFrame, tracked: DataFrame) -> DataFrame:
    return notices.join(tracked.select("entity_id"), "entity_id", "left_semi")


def store_epoch(batch: DataFrame, root: str, query: str, epoch: int, keys: list[str], at: str) -> int | None:
    """Adds a micro-batch to the store under `root` once, and enters it in the ledger; None if it was there already.

    A row lies in the folder of its day (of `at`), of the query that met it and of its epoch; an epoch that died on
    the way is written over, an epoch in the ledger is left alone. Keys are looked for in the days of the batch only, so
    a cycle reads what those days hold and not the store. A query begun anew over the same notices has another name: it
    finds their keys stored and adds nothing.
    """
    spark = batch.sparkSession
    entry, store = f"{root}/ledger/query={query}/epoch={epoch}", f"{root}/assessments"
    if exists(spark, f"{entry}/_SUCCESS"):
        return None
    began = time.time()
    fresh = batch.dropDuplicates(keys).withColumn("day", F.to_date(at)).persist()
    try:
        notices, first, last = fresh.agg(F.count(F.lit(1)), F.min("day"), F.max("day")).first()
        written = 0
        if notices:
            new = fresh.withColumns({"query": F.lit(query), "epoch": F.lit(epoch).cast("long")})
            if exists(spark, store):
                days = [r.day for r in fresh.select("day").distinct().collect()]
                known = spark.read.parquet(store).filter(F.col("day").isin(days) & ~((F.col("query") == query) & (F.col("epoch") == epoch)))
                new = new.join(known.select(*keys), keys, "left_anti")
            new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "query", "epoch").parquet(store)
            written = spark.read.parquet(store).filter((F.col("day") >= F.lit(first)) & (F.col("day") <= F.lit(last)) & (F.col("query") == query) & (F.col("epoch") == epoch)).count()
        _enter(spark, entry, (notices, written, first, last, time.time() - began, None))
        return written
    finally:
        fresh.unpersist()


def _enter(spark: SparkSession, entry: str, row: tuple) -> None:
    spark.createDataFrame([row], LEDGER_SCHEMA).withColumn("entered_at", F.current_timestamp()).write.mode("overwrite").parquet(entry)


def heartbeat(spark: SparkSession, root: str) -> DataFrame:
    """A row per cycle of the queries that wrote under `root`: query, epoch, notices, written, first_day, last_day, seconds,
    failure (null of a cycle that ended well), entered_at."""
    return spark.read.schema(f"{LEDGER_SCHEMA}, entered_at timestamp, query string, epoch long").parquet(f"{root}/ledger")


def run_notices(spark: SparkSession, folder: str, pattern: str, tracked: Callable[[], DataFrame], priors: Callable[[], DataFrame],
                to_events: Callable[[DataFrame], DataFrame], dependents: Callable[[], DataFrame] | None = None, hub: Column | None = None,
                root: str | None = None) -> str:
    """Drain what has landed through the live path and return the folder of assessments, beside which the ledger lies.

    `dependents` (hub, and what depends on it) joins where `hub`, an expression over the
    assessments, names one. Called again with the same `root` it goes on behind what it has seen. A cycle that fails
    is entered in the ledger as a failure before the error leaves, and is tried again by the next call.
    """
    root = root or f"{checkpoint_dir(spark)}/notices-{uuid.uuid4().hex}"

    def sink(batch: DataFrame, epoch: int) -> None:
        name = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "batch"
        try:
            scored = score_events(to_events(batch), priors())
            scored = scored.withColumn("latency_seconds", F.expr("(unix_micros(current_timestamp()) - unix_micros(accepted_at)) / 1000000D"))
            if dependents is not None:
                scored = scored.withColumn("_hub", hub).join(dependents().withColumnRenamed("hub", "_of"), F.col("_hub") == F.col("_of"), "left").drop("_hub", "_of")
            store_epoch(scored, root, name, epoch, ["entity_id", "accession"], "accepted_at")
        except Exception as error:
            _enter(spark, f"{root}/ledger/query={name}/epoch={epoch}/failed-{uuid.uuid4().hex}", (0, 0, None, None, 0.0, str(error)[:1000]))
            raise

    live = track(dedupe_seen(as_notices(notice_stream(spark, folder, pattern))), tracked())
    live.writeStream.foreachBatch(sink).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return f"{root}/assessments"
