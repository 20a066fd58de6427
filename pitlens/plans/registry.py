"""Query registry: a Spark builder and, where SQL can say it, a twin for checking."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitlens.plans.views import with_views
from pitlens.sources.bindings import Tables


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    body: str | None
    views: tuple[str, ...]
    covers: tuple[str, ...]

    @property
    def sql(self) -> str | None:
        return with_views(list(self.views), self.body) if self.body else None


QUERIES: dict[str, Query] = {}


def _plain(df: DataFrame) -> DataFrame:
    """Dates leave as ISO text so both engines hash the same value."""
    return df.select(*[F.col(f"`{n}`").cast("string").alias(n) if t == "date" else F.col(f"`{n}`")
                       for n, t in df.dtypes])


def query(name: str, covers: str, sql: str | None = None, views: str = ""):
    """Register a plan under `name`; `covers` lists inventory ids, `views` the CTEs the twin needs."""
    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Query(name, fn, sql, tuple(views.split()), tuple(covers.split()))
        return fn
    return register


def runner(q: Query) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return _plain(q.build(Tables(spark, sf_dir)))
    return run
