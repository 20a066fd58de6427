"""Landed payloads to rows: one document in, many rows out, all as column expressions.

Every function takes a DataFrame with the raw text in a column and keeps the other
columns; what cannot be read becomes no row, never a default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Reported concepts by metric, best first.
CONCEPTS = {
    "revenue": ("RevenueFromContractWithCustomerExcludingAssessedTax", "Revenues", "SalesRevenueNet"),
    "gross_profit": ("GrossProfit",),
    "operating_income": ("OperatingIncomeLoss",),
    "net_income": ("NetIncomeLoss", "ProfitLoss"),
    "rnd_expense": ("ResearchAndDevelopmentExpense",),
    "assets": ("Assets",),
    "liabilities": ("Liabilities",),
    "equity": ("StockholdersEquity",),
    "cash": ("CashAndCashEquivalentsAtCarryingValue", "CashCashEquivalentsRestrictedCashAndRestrictedCashEquivalents"),
    "operating_cash_flow": ("NetCashProvidedByUsedInOperatingActivities",),
    "eps_diluted": ("EarningsPerShareDiluted",),
    "shares_diluted": ("WeightedAverageNumberOfDilutedSharesOutstanding",),
}
SHARES_CONCEPT = "EntityCommonStockSharesOutstanding"
FORMS = ("10-K", "10-Q", "20-F", "40-F")
# Industry code ranges and their sectors.
SIC_RANGES = (
    (100, 999, "Agriculture"), (1000, 1499, "Energy and Materials"), (1500, 1799, "Industrials"), (2000, 2199, "Consumer Staples"),
    (2200, 2399, "Consumer Discretionary"), (2400, 2599, "Industrials"), (2600, 2699, "Energy and Materials"), (2700, 2799, "Communication Services"),
    (2800, 2899, "Health Care"), (2900, 2999, "Energy and Materials"), (3000, 3299, "Industrials"), (3300, 3499, "Energy and Materials"),
    (3500, 3579, "Technology"), (3580, 3599, "Industrials"), (3600, 3699, "Technology"), (3700, 3799, "Industrials"), (3800, 3851, "Health Care"),
    (3852, 3999, "Industrials"), (4000, 4499, "Industrials"), (4500, 4599, "Industrials"), (4600, 4799, "Energy and Materials"),
    (4800, 4899, "Communication Services"), (4900, 4999, "Utilities"), (5000, 5199, "Industrials"), (5200, 5999, "Consumer Discretionary"),
    (6000, 6799, "Financials"), (7000, 7299, "Consumer Discretionary"), (7300, 7399, "Technology"), (7400, 7999, "Consumer Discretionary"),
    (8000, 8099, "Health Care"), (8100, 8999, "Industrials"),
)
# Report-hour labels, skipped ticker suffixes, intraday ranges in days, open-market codes.
HOUR_LABELS = {"bmo": "before market open", "amc": "after market close", "dmh": "during market hours"}
SKIPPED_SUFFIXES = ("-W", "-WS", "-U", "-R", "-RT", "-P")
RANGE_DAYS = {"1H": 1, "24H": 1, "1W": 5, "1M": 31, "6M": 183, "1Y": 366}
TAIL_POINTS = {"1H": 30}
OPEN_MARKET_CODES = ("S", "P")

_OBS = "array<struct<start: string, end: string, val: double, filed: string, form: string, accn: string>>"
_FACTS = f"struct<facts: map<string, map<string, struct<units: map<string, {_OBS}>>>>>"


def classify_period(start: str, end: str) -> str:
    """instant without a start; otherwise by the length of the span in days."""
    days = f"datediff({end}, {start})"
    return (f"CASE WHEN {end} IS NULL THEN NULL WHEN {start} IS NULL THEN 'instant' WHEN {days} BETWEEN 80 AND 100 THEN 'quarter'"
            f" WHEN {days} BETWEEN 170 AND 190 THEN 'half_year' WHEN {days} BETWEEN 260 AND 285 THEN 'nine_months' WHEN {days} BETWEEN 350 AND 380 THEN 'year' ELSE 'other' END")


def flatten_companyfacts(df: DataFrame, key: str, payload: str, this_year: int, years: int = 16) -> DataFrame:
    """Reported figures: per metric the first concept present, accepted forms, recent filings."""
    d = df.select(key, F.from_json(payload, _FACTS[7:-1].replace("facts: ", "facts ", 1)).alias("p"))
    first = lambda names: "coalesce(" + ", ".join(f"p.facts['us-gaap']['{n}']" for n in names) + ")"
    entries = [f"struct('{m}' AS metric, {first(names)} AS c)" for m, names in CONCEPTS.items()]
    entries.append(f"struct('shares_outstanding' AS metric, p.facts['dei']['{SHARES_CONCEPT}'] AS c)")
    d = d.selectExpr(key, f"inline(array({', '.join(entries)}))").filter("c IS NOT NULL")
    d = d.selectExpr(key, "metric", "explode(c.units) AS (unit, obs)").selectExpr(key, "metric", "unit", "inline(obs)")
    forms = ", ".join(f"'{f}'" for f in FORMS)
    d = d.selectExpr(key, "metric", "unit", "try_to_date(start) AS start", "try_to_date(end) AS period_end", "try_to_date(filed) AS filed_on", "val AS value", "form", "accn AS accession")
    d = d.filter(f"form IN ({forms}) AND value IS NOT NULL AND period_end IS NOT NULL AND year(filed_on) >= {this_year - years}")
    return d.selectExpr(key, "metric", f"{classify_period('start', 'period_end')} AS period", "period_end", "filed_on", "value", "accession")


def insider_transactions(df: DataFrame, key: str, xml: str) -> DataFrame:
    """One row per open or coded transaction of an ownership form."""
    v = lambda n: f"{n}: struct<value: string>"
    txn = (f"struct<{v('transactionDate')}, transactionCoding: struct<transactionCode: string>, transactionAmounts: struct<{v('transactionShares')},"
           f" {v('transactionPricePerShare')}, {v('transactionAcquiredDisposedCode')}>>")
    schema = (f"reportingOwner struct<reportingOwnerId: struct<rptOwnerName: string>, reportingOwnerRelationship: struct<isOfficer: string, isDirector: string>>,"
              f" nonDerivativeTable struct<nonDerivativeTransaction: array<{txn}>>")
    d = df.select(key, F.from_xml(xml, schema).alias("f"))
    flag = lambda n: f"coalesce(lower(f.reportingOwner.reportingOwnerRelationship.{n}) IN ('1', 'true'), false)"
    d = d.selectExpr(key, "f.reportingOwner.reportingOwnerId.rptOwnerName AS owner", f"{flag('isOfficer')} AS is_officer", f"{flag('isDirector')} AS is_director",
                     "posexplode(f.nonDerivativeTable.nonDerivativeTransaction) AS (seq, t)")
    d = d.selectExpr(key, "owner", "is_officer", "is_director", "seq", "try_to_date(t.transactionDate.value) AS day", "try_cast(t.transactionAmounts.transactionShares.value AS double) AS n",
                     "try_cast(t.transactionAmounts.transactionPricePerShare.value AS double) AS price", "coalesce(t.transactionCoding.transactionCode, '?') AS code",
                     "coalesce(upper(t.transactionAmounts.transactionAcquiredDisposedCode.value) = 'D', false) AS disposed").filter("day IS NOT NULL AND n IS NOT NULL")
    codes = ", ".join(f"'{c}'" for c in OPEN_MARKET_CODES)
    return d.selectExpr(key, "seq", "owner", "is_officer", "is_director", "day", "code", "disposed", "CASE WHEN disposed THEN -n ELSE n END AS shares",
                        f"code IN ({codes}) AS is_open_market", "round(n * nullif(price, 0), 2) AS value_usd")


def short_interest(df: DataFrame, key: str, line: str) -> DataFrame:
    """Settlement rows of a short-interest file; rows without a date or position are dropped."""
    schema = "settlementDate string, currentShortPositionQuantity string, previousShortPositionQuantity string, daysToCoverQuantity string, changePercent string"
    d = df.select(key, F.from_csv(line, schema).alias("r")).select(key, "r.*")
    num = lambda c: f"try_cast({c} AS double)"
    return d.selectExpr(key, "try_to_date(settlementDate) AS settled", f"{num('currentShortPositionQuantity')} AS position", f"{num('previousShortPositionQuantity')} AS previous",
                        f"{num('daysToCoverQuantity')} AS days_to_cover", f"{num('changePercent')} AS change_percent").filter("settled IS NOT NULL AND position IS NOT NULL")


def earnings_events(df: DataFrame, key: str, payload: str) -> DataFrame:
    schema = "date string, epsEstimate double, epsActual double, revenueEstimate double, revenueActual double, hour string"
    d = df.select(key, F.from_json(payload, schema).alias("e")).select(key, "e.*")
    labels = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in HOUR_LABELS.items())
    reported = "(epsActual IS NOT NULL OR revenueActual IS NOT NULL)"
    return d.selectExpr(key, "try_to_date(date) AS report_date", "epsEstimate AS eps_estimate", "epsActual AS eps_actual", f"{reported} AS reported",
                        f"CASE WHEN {reported} AND epsEstimate <> 0 THEN round((epsActual - epsEstimate) / abs(epsEstimate) * 100, 2) END AS surprise_percent",
                        f"CASE lower(hour) {labels} END AS hour_label").filter("report_date IS NOT NULL")


def bars_from_chart(df: DataFrame, key: str, payload: str) -> DataFrame:
    """Parallel arrays zipped by index; a null close drops the session, adjusted falls back to close."""
    schema = "timestamp array<bigint>, close array<double>, adjclose array<double>, volume array<double>"
    d = df.select(key, F.from_json(payload, schema).alias("c"))
    d = d.selectExpr(key, "inline(arrays_zip(c.timestamp, c.close, c.adjclose, c.volume))")
    return d.filter("close IS NOT NULL AND timestamp IS NOT NULL").selectExpr(
        key, "to_date(timestamp_seconds(timestamp)) AS session_date", "close", "coalesce(adjclose, close) AS adjusted_close", "volume")


def intraday_change(points: DataFrame, key: str, at: str, value: str, range_key: str) -> DataFrame:
    """First-to-last change over the named range, the shortest one cut to its last points."""
    days = RANGE_DAYS[range_key]
    newest = points.groupBy(key).agg(F.max(at).alias("_newest"))
    d = points.filter(F.col(value).isNotNull()).join(newest, key).filter(f"{at} > _newest - interval {days} days")
    if range_key in TAIL_POINTS:
        from pyspark.sql import Window
        w = Window.partitionBy(key).orderBy(F.col(at).desc())
        d = d.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= TAIL_POINTS[range_key])
    g = d.groupBy(key).agg(F.count(F.lit(1)).alias("points"), F.min_by(value, at).alias("_first"), F.max_by(value, at).alias("last"))
    return g.selectExpr(key, "points", "last", "CASE WHEN points >= 2 THEN last - _first END AS change",
                        "CASE WHEN points >= 2 AND _first <> 0 THEN (last / _first - 1) * 100 END AS change_percent")


def filing_index_rows(df: DataFrame, key: str, payload: str, annual: str, quarterly: str, limit: int, held: DataFrame | None = None) -> DataFrame:
    """Periodic filings with a primary document, newest first, annual before quarterly on one date."""
    from pitlens.operators.feeds import newest_per_key
    schema = "form array<string>, filingDate array<string>, accessionNumber array<string>, primaryDocument array<string>"
    d = df.select(key, F.from_json(payload, schema).alias("s")).selectExpr(key, "inline(arrays_zip(s.form, s.filingDate, s.accessionNumber, s.primaryDocument))")
    d = d.filter(F.col("form").isin(annual, quarterly) & (F.coalesce("primaryDocument", F.lit("")) != "")).selectExpr(
        key, "form", "try_to_date(filingDate) AS filed", "concat_ws('/', accessionNumber, primaryDocument) AS url")
    if held is not None:
        d = d.join(held.select("url"), "url", "left_anti")
    return newest_per_key(d, [key], [F.col("filed").desc(), (F.col("form") != annual), F.col("url")], limit)


def exhibit_entries(header: str) -> str:
    """(type, sequence, filename) of each document of a submission header."""
    rx = r"<TYPE>([^\\r\\n<]+)\\s*<SEQUENCE>([^\\r\\n<]+)\\s*<FILENAME>([^\\r\\n<]+)"
    part = lambda i: f"regexp_extract_all({header}, '{rx}', {i})"
    return f"transform(arrays_zip({part(1)}, {part(2)}, {part(3)}), x -> struct(trim(x['0']) AS type, int(trim(x['1'])) AS seq, trim(x['2']) AS filename))"


EXHIBIT_CHARS = 150_000


def assemble_exhibits(exhibits: DataFrame, key: str, budget: int = EXHIBIT_CHARS) -> DataFrame:
    """Exhibit texts in order up to `budget` characters, the last one cut where the budget ends."""
    from pyspark.sql import Window
    d = exhibits.filter("type RLIKE '(?i)^EX-99(\\\\.\\\\d+)?$'")
    w = Window.partitionBy(key).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_room", budget - F.sum(F.length("text")).over(w) + F.length("text")).filter("_room > 0").withColumn("text", F.expr("substring(text, 1, int(_room))"))
    return d.groupBy(key).agg(F.expr("array_join(transform(array_sort(collect_list(struct(seq, text))), x -> x.text), '\\n\\n') AS body"), F.count(F.lit(1)).alias("exhibits"))


def filing_items(header: str) -> str:
    return f"regexp_extract_all({header}, '(?m)^<ITEMS>([0-9.]+)', 1)"


def acceptance_notices(df: DataFrame, title: str, link: str, updated: str, at: str) -> DataFrame:
    """Form, company, cik and accession of feed entries; one per accession, the entry listed first (least `at`) wins."""
    rx = r"^\\s*(.+?)\\s+-\\s+(.*?)\\s+\\((\\d{10})\\)"
    d = df.selectExpr(f"regexp_extract({title}, '{rx}', 1) AS form", f"regexp_extract({title}, '{rx}', 2) AS company", f"regexp_extract({title}, '{rx}', 3) AS cik",
                      f"regexp_replace(substring_index({link}, '/', -1), '(-index.htm|.txt)$', '') AS accession", f"try_to_timestamp({updated}) AS accepted_at", f"{at} AS _at")
    d = d.filter("form <> '' AND accession <> ''").withColumn("is_amendment", F.expr("upper(form) LIKE '%/A'"))
    return d.groupBy("accession").agg(F.min_by(F.struct("form", "company", "cik", "accepted_at", "is_amendment"), "_at").alias("_e")).select("accession", "_e.*")


def news_items(df: DataFrame, key: str, payload: str, name: Column, ticker: Column, minimum: int = 120) -> DataFrame:
    """Items with a headline and a real summary that are about the entity; the body follows when present."""
    from pitlens.functions.text import is_about
    schema = "headline string, summary string, body string, datetime bigint, url string"
    plain = lambda c: f"replace(replace(replace(replace({c}, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&#39;', '\\'')"
    d = df.withColumn("n", F.from_json(payload, schema)).withColumn("headline", F.expr(plain("n.headline"))).withColumn("summary", F.expr(plain("n.summary")))
    d = d.filter(f"headline <> '' AND length(summary) >= {minimum}").filter(is_about(F.col("headline"), F.lower(name), ticker))
    return d.selectExpr(key, "headline", "timestamp_seconds(n.datetime) AS published_at", "n.url AS url", "concat_ws('\\n\\n', summary, n.body) AS text")


def peer_frame(facts: DataFrame, metrics: list[str], period: str, period_end: str) -> DataFrame:
    d = facts.filter(F.col("metric").isin(*metrics) & (F.col("period") == period) & (F.col("period_end") == F.lit(period_end).cast("date")))
    return d.groupBy(F.lpad(F.col("entity_id").cast("string"), 10, "0").alias("cik")).agg(*[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in metrics])


def search_hits(df: DataFrame, payload: str) -> DataFrame:
    schema = "_id string, _source struct<ciks: array<string>, display_names: array<string>, root_forms: array<string>, file_date: string>"
    d = df.select(F.from_json(payload, schema).alias("h")).filter("contains(h._id, ':') AND size(h._source.ciks) > 0")
    d = d.selectExpr("split_part(h._id, ':', 1) AS accession", "split_part(h._id, ':', 2) AS document", "lpad(h._source.ciks[0], 10, '0') AS cik",
                     "coalesce(get(h._source.root_forms, 0), 'unknown') AS form", "try_to_date(h._source.file_date) AS filed")
    return d.withColumn("path", F.expr("concat_ws('/', string(bigint(cik)), replace(accession, '-', ''), document)"))


def seed_universe(df: DataFrame, page: str, payload: str, exchanges: tuple[str, ...]) -> DataFrame:
    """Directory rows of two exchanges with short tickers, no warrants or units; (page, pos) is their order.

    A ticker listed twice keeps its first row.
    """
    d = df.selectExpr(page, f"from_json({payload}, 'fields array<string>, data array<array<string>>') AS d").selectExpr(page, "d.fields AS f", "posexplode(d.data) AS (pos, r)")
    col = lambda n: f"get(r, int(array_position(f, '{n}')) - 1)"
    d = d.selectExpr(page, "pos", f"{col('cik')} AS cik", f"{col('name')} AS name", f"{col('ticker')} AS ticker", f"{col('exchange')} AS exchange")
    bad = " OR ".join(f"endswith(ticker, '{s}')" for s in SKIPPED_SUFFIXES)
    d = d.filter(F.col("exchange").isin(*exchanges)).filter(f"length(ticker) <= 6 AND NOT ({bad})")
    first = d.groupBy("ticker").agg(F.min_by(F.struct(*[c for c in d.columns if c != "ticker"]), F.struct(page, "pos")).alias("_r"))
    return first.select("ticker", "_r.*")


def sector_for_sic(sic: str) -> str:
    code = f"try_cast({sic} AS int)"
    return "CASE " + " ".join(f"WHEN {code} BETWEEN {a} AND {b} THEN '{s}'" for a, b, s in SIC_RANGES) + " END"


def transcript_index(df: DataFrame, url: str, months: int, now: str) -> DataFrame:
    """Call transcripts from a site map: ticker, date and quarter out of the address, one row per address."""
    rx = r"/call-transcripts/(\\d{4})/(\\d{2})/(\\d{2})/[a-z0-9-]+?-([a-z]{1,5})-q(\\d)-(\\d{4})-earnings-call-transcript"
    part = lambda i: f"regexp_extract({url}, '{rx}', {i})"
    d = df.selectExpr(f"{url} AS url", f"upper({part(4)}) AS ticker", f"try_to_date(concat_ws('-', {part(1)}, {part(2)}, {part(3)})) AS held_on", f"concat('Q', {part(5)}, ' ', {part(6)}) AS quarter")
    return d.filter(f"ticker <> '' AND held_on >= add_months(date'{now}', -{months})").dropDuplicates(["url"])
