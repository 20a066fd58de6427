"""Domain views over the landed star-schema tables.

Every view is a DataFrame; only the daily bars are materialised.  Each aggregation that
builds a view has a map-side partial step, so a hot entity, brand or day costs
one row per map task in the shuffle, and what is left per entity afterwards is
bounded by the calendar (quarters of filings, sessions of prices).
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitlens.session import cut_lineage, spread

# The invented vocabulary the finding summaries are built from.
WORDS_A = ["supplier", "regulation", "lawsuit", "deficiency", "backlog",
           "inflation", "capex", "refinancing", "resignation", "competition"]
WORDS_B = ["breach", "workforce", "tariff", "guidance", "demand",
           "margin", "debt", "court", "pricing", "outlook"]
FINDING_TYPE = {"error": "new_risk_factor", "purchase": "guidance_change",
                "signup": "insider_activity", "view": "sentiment_shift",
                "click": "notable_quote"}
SUBTYPES = ["10-K", "10-Q", "8-K", "news"]
HORIZONS = ["near_term", "multi_quarter", "structural"]
# Events happen in 2024, prices end in 2001: findings are read 24 years earlier.
PRICE_SHIFT_DAYS = 8766
NOW = "2024-01-31 00:00:00"
FILING_LAG_DAYS, FILING_SPREAD, RESTATEMENT_LAG_DAYS = 30, 45, 180


def pick(options: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(o) for o in options]), (index + 1).cast("int"))


class Tables:
    """Lazily bound tables of one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.read(name)

    # -- dimensions -------------------------------------------------------
    @cached_property
    def regions(self) -> DataFrame:
        return self.nation.join(self.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
            F.col("n_nationkey").alias("nation_key"), F.col("n_name").alias("nation"),
            F.col("r_name").alias("sector"))

    @cached_property
    def entities(self) -> DataFrame:
        """Filers: supplier with its region as sector and a brand as its share price."""
        return self.supplier.join(self.regions, F.col("s_nationkey") == F.col("nation_key")).select(
            F.col("s_suppkey").alias("entity_id"), F.col("s_name").alias("name"), "sector", "nation",
            F.col("s_acctbal").alias("size"),
            F.concat(F.lit("Brand#"), (F.col("s_suppkey") % 25 + 1).cast("string")).alias("brand"))

    @cached_property
    def holders(self) -> DataFrame:
        """Entities findings are about: customers, with their region as sector."""
        return self.customer.join(self.regions, F.col("c_nationkey") == F.col("nation_key")).select(
            F.col("c_custkey").alias("entity_id"), F.col("c_name").alias("name"), "sector",
            F.col("c_acctbal").alias("size"), F.col("c_mktsegment").alias("tier"))

    # -- filed figures ----------------------------------------------------
    FLOWS = ["revenue", "gross_profit", "net_income", "operating_income",
             "operating_cash_flow", "shares_diluted", "rnd_expense"]

    def _quarters(self, versions: list[str]) -> DataFrame:
        """Quarterly sums per filer; `_o` columns leave returned lines out. One scan serves every version."""
        ext, disc, tax = "l_extendedprice", "l_discount", "l_tax"
        amounts = {"revenue": f"{ext} * (1 - {disc})", "gross_profit": f"{ext} * (1 - {disc} - {tax})", "net_income": f"{ext} * ({disc} - {tax})",
                   "operating_income": f"{ext} * ({disc} - {tax} / 2)",
                   "operating_cash_flow": f"CASE WHEN l_linestatus = 'F' THEN {ext} * ({disc} - {tax}) ELSE 0D END",
                   "shares_diluted": "l_quantity", "rnd_expense": f"{ext} * {tax} * 2.4D",
                   "ext": ext, "ext_tax": f"{ext} * {tax}", "ext_disc": f"{ext} * {disc}"}
        keep = {"": "true", "_o": "l_returnflag <> 'R'"}
        aggs = [F.expr(f"sum(CASE WHEN {keep[v]} THEN {a} END) AS {n}{v}") for v in versions for n, a in amounts.items()]
        return self.lineitem.groupBy(F.col("l_suppkey").alias("entity_id"), F.year("l_shipdate").alias("y"),
                                     F.quarter("l_shipdate").alias("q")).agg(*aggs)

    def _long(self, versions: dict[str, int]) -> DataFrame:
        """Filed figures from the quarters: per version its columns' suffix and extra filing lag in days."""
        run = "OVER (PARTITION BY entity_id ORDER BY y, q ROWS UNBOUNDED PRECEDING)"
        year = "OVER (PARTITION BY entity_id, y)"
        stock = {"assets": "ext", "liabilities": "ext_tax", "cash": "ext_disc", "shares_outstanding": "shares_diluted"}
        columns = ["entity_id", "y", "q"]
        for v in versions:
            columns += [f"{m}{v}" for m in self.FLOWS]
            columns += [f"sum({src}{v}) {run} AS {m}{v}" for m, src in stock.items()]
            columns += [f"sum({m}{v}) {year} AS {m}_y{v}" for m in self.FLOWS]
            columns += [f"ext{v} IS NOT NULL AS filed{v}", f"q = max(CASE WHEN ext{v} IS NOT NULL THEN q END) {year} AS closes_year{v}"]
        wide = self._quarters(list(versions)).selectExpr(*columns)
        q_end, y_end = "last_day(make_date(y, q * 3, 1))", "make_date(y, 12, 31)"
        parts = []
        for v, extra in versions.items():
            entry = lambda metric, period, end, value: (f"struct('{metric}' AS metric, '{period}' AS period, {end} AS period_end,"
                                                        f" {value} AS value, {extra} AS extra)")
            instants = {m: f"{m}{v}" for m in ("assets", "liabilities", "cash")}
            instants |= {"equity": f"assets{v} - liabilities{v}", "shares_outstanding": f"shares_outstanding{v}"}
            rows = [entry(m, "quarter", q_end, f"{m}{v}") for m in ("revenue", "shares_diluted")]
            rows += [entry(m, "instant", q_end, e) for m, e in instants.items()]
            annual = [entry(m, "year", y_end, f"{m}_y{v}") for m in self.FLOWS]
            parts.append(f"CASE WHEN closes_year{v} THEN array({', '.join(rows + annual)}) WHEN filed{v} THEN array({', '.join(rows)}) END")
        packed = parts[0] if len(parts) == 1 else f"flatten(filter(array({', '.join(parts)}), a -> a IS NOT NULL))"
        lag = f"int({FILING_LAG_DAYS} + extra + entity_id % {FILING_SPREAD})"
        return wide.selectExpr("entity_id", f"inline({packed})").selectExpr(
            "entity_id", "metric", "period", "period_end", f"date_add(period_end, {lag}) AS filed_on", "value")

    @cached_property
    def facts(self) -> DataFrame:
        return self._long({"": 0})

    @cached_property
    def facts_restated(self) -> DataFrame:
        """Each period filed twice: without returned lines, then in full 180 days later."""
        return self._long({"_o": 0, "": RESTATEMENT_LAG_DAYS})

    # -- prices -----------------------------------------------------------
    @cached_property
    def bars(self) -> DataFrame:
        """Daily bars, at most one row per series and day; written once because every price
        operator reads them several times and the trades behind them are the largest table."""
        price = F.col("l_extendedprice") / F.col("l_quantity")
        lines = self.lineitem.join(self.part.select("p_partkey", "p_brand"),
                                   F.col("l_partkey") == F.col("p_partkey"))
        return cut_lineage(lines.groupBy(F.col("p_brand").alias("brand"), F.to_date("l_shipdate").alias("session_date")).agg(
            F.avg(price).alias("close"), F.avg(price * (1 - F.col("l_discount"))).alias("adjusted_close"),
            F.sum("l_quantity").alias("volume")))

    @cached_property
    def benchmark_bars(self) -> DataFrame:
        price = F.col("l_extendedprice") / F.col("l_quantity")
        return cut_lineage(self.lineitem.groupBy(F.to_date("l_shipdate").alias("session_date")).agg(
            F.avg(price).alias("close"), F.avg(price * (1 - F.col("l_discount"))).alias("adjusted_close")))

    # -- findings ---------------------------------------------------------
    @cached_property
    def findings(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("int")
        occurred = F.col("ts").cast("timestamp")
        day = F.to_date("ts")
        kind = F.col("event_type")
        ftype = F.create_map(*[F.lit(x) for kv in FINDING_TYPE.items() for x in kv])[kind]
        value = F.col("value")
        return self.events.select(
            F.col("event_id").alias("finding_id"), F.col("user_id").alias("entity_id"),
            kind.alias("event_type"), ftype.alias("finding_type"), occurred.alias("occurred_at"),
            day.alias("day"), value, k.alias("k"),
            F.when(kind.isin("purchase", "signup"), "positive").when(kind == "error", "negative").alias("direction"),
            F.when(value < 20, "minor").when(value < 80, "moderate").otherwise("major").alias("magnitude"),
            F.least(value / 400, F.lit(1.0)).alias("confidence"),
            F.when(kind == "view", F.greatest(F.least(value / 50 - 1, F.lit(1.0)), F.lit(-1.0))).alias("sentiment"),
            F.when(k % 4 < 3, pick(HORIZONS, k % 4)).alias("horizon"),
            F.concat_ws("@", F.col("user_id").cast("string"), day.cast("string")).alias("document_id"),
            pick(SUBTYPES, (F.col("user_id") + F.dayofmonth("ts")) % 4).alias("genre"),
            F.concat(kind, F.lit(": "), pick(WORDS_A, F.floor(k / 10)), F.lit(" "),
                     pick(WORDS_B, k % 10), F.lit(" "), F.floor(value).cast("string")).alias("summary"),
            F.concat(F.lit("as of "), (F.lit(1995) + k % 30).cast("string")).alias("quote"),
            F.date_sub(day, PRICE_SHIFT_DAYS).alias("price_day"),
            F.concat(F.lit("Brand#"), (F.col("user_id") % 25 + 1).cast("string")).alias("brand"))

    # -- filings ----------------------------------------------------------
    @cached_property
    def filings(self) -> DataFrame:
        return self.documents.select(
            F.col("doc_id"), F.col("source").alias("entity"), F.col("lang").alias("subtype"),
            F.date_add(F.lit("2020-01-01").cast("date"), F.col("doc_id").cast("int")).alias("published"), "text")

    @cached_property
    def filing_texts(self) -> DataFrame:
        """Filings spread over the cluster for per-text work; texts differ a thousandfold in length."""
        return spread(self.filings)

    @cached_property
    def positions(self) -> DataFrame:
        """What a customer holds: units and average unit cost by brand."""
        li = self.lineitem.join(self.part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
        return li.join(self.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy(
            F.col("o_custkey").alias("user_id"), F.col("p_brand").alias("brand")).agg(
            F.sum("l_quantity").alias("shares"),
            (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("cost_basis"))

    @cached_property
    def exposures(self) -> DataFrame:
        """Supplier nation names customer nation: one mention per line item."""
        sn = self.supplier.select("s_suppkey", F.col("s_nationkey").alias("dependent"))
        cn = self.customer.select("c_custkey", F.col("c_nationkey").alias("hub"))
        return (self.lineitem.select("l_orderkey", "l_suppkey")
                .join(self.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
                .join(sn, F.col("l_suppkey") == F.col("s_suppkey"))
                .join(cn, F.col("o_custkey") == F.col("c_custkey"))
                .groupBy("dependent", "hub").agg(F.count("*").alias("mention_count")))
