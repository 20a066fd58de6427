"""The factor library: a registry of column builders over one wide row per (date, entity).

Every entity's filed figures are packed once and dealt to their metrics once; a scoring date only
filters these short arrays, so many dates cost no extra shuffle and no join between dates and history.
An entity's pack is bounded by its calendar of filings (metrics x periods x versions).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitlens.operators import prices, ranks
from pitlens.operators.pit import nearby
from pitlens.session import cut_lineage

MIN_DENOMINATOR = 1.0
MAX_PERIOD_AGE_DAYS = 500
MAX_STALENESS_DAYS = 400
MAX_SHARE_COUNT_AGE_DAYS = 200
MIN_VOLATILITY_SESSIONS = 120
INSTANT_TOLERANCE_DAYS, YEAR_TOLERANCE_DAYS = 14, 60
YEARLY = ("revenue", "gross_profit", "net_income", "operating_income",
          "operating_cash_flow", "shares_diluted", "rnd_expense")
INSTANTS = ("assets", "liabilities", "cash", "equity", "shares_outstanding")


@dataclass(frozen=True)
class Factor:
    """One entry makes a factor: its key, the good direction, an SQL expression over the wide row."""
    key: str
    higher_is_better: bool
    value: str
    inputs: dict[str, str]


def safe_ratio(top: str, bottom: str) -> str:
    return f"(CASE WHEN abs({bottom}) >= {MIN_DENOMINATOR} THEN ({top}) / ({bottom}) END)"


def packed_facts(facts: DataFrame) -> DataFrame:
    """One row per entity; `collect_set` removes duplicate rows before the shuffle. Of versions filed on one day the later
    arrival comes last, by the column `arrival` where facts have it."""
    order = ["arrival"] if "arrival" in facts.columns else []
    return facts.groupBy("entity_id").agg(F.array_sort(F.collect_set(
        F.struct("period_end", "filed_on", *order, "metric", "period", "value"))).alias("filed"))


def _versions(h: str) -> str:
    """Figures of a (period_end, filed_on) sorted array, each with the day from which a later version of its period counts."""
    after = f"get({h}, i + 1)"
    return (f"transform({h}, (x, i) -> struct(x.period_end AS at, x.value AS value, x.filed_on AS filed_on,"
            f" CASE WHEN {after}.period_end = x.period_end THEN {after}.filed_on END AS until))")


def _known(h: str) -> str:
    """Of `_versions`, the last one of each period filed by the date."""
    return f"filter({h}, x -> x.filed_on <= as_of AND (x.until IS NULL OR x.until > as_of))"


def _nearest(h: str, target: str, tolerance: int) -> str:
    """Closest entry within the tolerance; the older one wins a tie."""
    near = f"filter({h}, r -> abs(datediff(r.at, {target})) <= {tolerance})"
    return f"array_min(transform({near}, r -> struct(abs(datediff(r.at, {target})) AS gap, r.at AS at, r.value AS value)))"


def _year_before(h: str, current: str) -> str:
    return _nearest(f"filter({h}, e -> e.at < {current})", f"date_sub({current}, 365)", YEAR_TOLERANCE_DAYS)


def _paired(a: str, b: str) -> str:
    """Periods both metrics report, with both values, oldest first."""
    match = f"get(filter({b}, y -> y.at = x.at), 0).value"
    return f"filter(transform({a}, x -> struct(x.at AS at, x.value AS a, {match} AS b)), x -> x.b IS NOT NULL)"


def _with(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.selectExpr("*", *[f"{e} AS {n}" for n, e in columns.items()])


def company_view(facts: DataFrame, dates: Sequence[str]) -> DataFrame:
    """(as_of, entity) rows with resolved histories and the period picks the factors read."""
    days = ", ".join(f"DATE'{d}'" for d in dates)
    only = lambda m, p: f"filter(filed, x -> x.metric = '{m}' AND x.period = '{p}')"
    packs = {**{f"y_{m}": only(m, "year") for m in YEARLY}, **{f"i_{m}": only(m, "instant") for m in INSTANTS},
             "q_shares": only("shares_diluted", "quarter")}
    # metrics are told apart and versions ordered before the dates multiply the rows
    d = packed_facts(facts).selectExpr("entity_id", "array_distinct(transform(filed, x -> x.filed_on)) AS _days", *[f"{e} AS _{n}" for n, e in packs.items()])
    d = d.selectExpr("entity_id", "_days", *[f"{_versions('_' + n)} AS _{n}" for n in packs])
    d = d.selectExpr("*", f"explode(array({days})) AS as_of")
    d = d.selectExpr("*", "array_max(filter(_days, x -> x <= as_of)) AS newest_filing").filter("newest_filing IS NOT NULL")
    d = d.selectExpr("entity_id", "as_of", "newest_filing", *[f"{_known('_' + n)} AS {n}" for n in packs])
    d = _with(d, {"ni_ocf": _paired("y_net_income", "y_operating_cash_flow"),
                  "rev_op": _paired("y_revenue", "y_operating_income")})

    def annual(h: str, back: int = 0) -> str:
        x = f"try_element_at({h}, {-1 - back})"
        return f"CASE WHEN datediff(newest_filing, {x}.at) <= {MAX_PERIOD_AGE_DAYS} THEN {x} END"

    picks = {f"{h}_{b}": annual(h, b) for h, b in (
        ("ni_ocf", 0), ("rev_op", 0), ("rev_op", 1), ("y_revenue", 0), ("y_revenue", 1), ("y_net_income", 0),
        ("y_gross_profit", 0), ("y_operating_cash_flow", 0), ("y_shares_diluted", 0), ("y_shares_diluted", 1),
        ("y_rnd_expense", 0))}
    picks.update({f"{m}_now": annual(f"i_{m}") for m in ("assets", "liabilities", "cash", "equity")})
    picks["shares"] = ("coalesce(try_element_at(i_shares_outstanding, -1), try_element_at(q_shares, -1),"
                       " try_element_at(y_shares_diluted, -1))")
    d = _with(d, picks)
    anchors = ("ni_ocf_0", "y_gross_profit_0", "y_net_income_0", "y_revenue_0", "y_revenue_1", "liabilities_now", "cash_now")
    d = _with(d, {"assets_prior": _year_before("i_assets", "assets_now.at"),
                  "liabilities_prior": _year_before("i_liabilities", "liabilities_now.at"),
                  **{f"assets_at_{p}": _nearest("i_assets", f"{p}.at", INSTANT_TOLERANCE_DAYS) for p in anchors}})
    profits = ("ni_ocf_0", "y_gross_profit_0", "y_net_income_0")
    d = _with(d, {"assets_at_liabilities_prior": _nearest("i_assets", "liabilities_prior.at", INSTANT_TOLERANCE_DAYS),
                  **{f"before_{p}": _year_before("i_assets", f"assets_at_{p}.at") for p in profits}})
    return _with(d, {f"avg_assets_{p}": f"coalesce((assets_at_{p}.value + before_{p}.value) / 2, assets_at_{p}.value)"
                     for p in profits})


def price_panel(bars: DataFrame, dates: Sequence[str]) -> DataFrame:
    """(brand, as_of): raw close, skip-month momentum and one-year volatility."""
    days = ", ".join(f"DATE'{d}'" for d in dates)
    p = bars.select("brand").distinct().selectExpr("brand", f"explode(array({days})) AS as_of")
    p = prices.price_on_or_before(p, bars, "as_of", "last")
    p = _with(p, {"_from": "date_sub(as_of, 395)", "_to": "date_sub(as_of, 30)"})
    p = prices.total_return(p, bars, "_from", "_to", "momentum")
    p = nearby(p, prices.session_returns(bars), ["brand"], "as_of", "session_date", 365, 0, ["prev_date", "ret"], "_near")
    p = _with(p, {"_r": "transform(filter(_near, r -> datediff(as_of, r.prev_date) <= 365), r -> r.ret)"})
    p = _with(p, {"_mean": "aggregate(_r, 0D, (a, x) -> a + x) / size(_r)"})
    vol = ("CASE WHEN size(_r) >= %d THEN sqrt(aggregate(_r, 0D, (a, x) -> a + (x - _mean) * (x - _mean))"
           " / (size(_r) - 1)) * sqrt(252D) END" % MIN_VOLATILITY_SESSIONS)
    return p.selectExpr("brand", "as_of", "last.close AS price", "momentum", f"{vol} AS volatility")


def factor_registry() -> list[Factor]:
    v = lambda pick: f"{pick}.value"
    growth = lambda now, before: safe_ratio(f"{now} - {before}", f"abs({before})")
    margin = lambda p: safe_ratio(f"{p}.b", f"{p}.a")
    ni_ocf = {"net_income": "ni_ocf_0.a", "operating_cash_flow": "ni_ocf_0.b"}
    on_assets = lambda p: safe_ratio(v(p), f"avg_assets_{p}")
    paid = lambda top: safe_ratio(top, "market_cap")
    cap = {"market_cap": "market_cap"}
    turned = lambda p, a: safe_ratio(v(p), v(a))
    return [Factor(*row) for row in (
        ("accruals", False, safe_ratio("ni_ocf_0.a - ni_ocf_0.b", "avg_assets_ni_ocf_0"),
         {**ni_ocf, "avg_assets": "avg_assets_ni_ocf_0"}),
        ("cash_conversion", True, f"CASE WHEN ni_ocf_0.a > 0 THEN {safe_ratio('ni_ocf_0.b', 'ni_ocf_0.a')} END", ni_ocf),
        ("asset_growth", False, growth(v("assets_now"), v("assets_prior")),
         {"assets": v("assets_now"), "assets_prior": v("assets_prior")}),
        ("net_share_issuance", False, growth(v("y_shares_diluted_0"), v("y_shares_diluted_1")),
         {"shares_diluted": v("y_shares_diluted_0"), "shares_diluted_prior": v("y_shares_diluted_1")}),
        ("gross_profitability", True, on_assets("y_gross_profit_0"), {"gross_profit": v("y_gross_profit_0")}),
        ("return_on_assets", True, on_assets("y_net_income_0"), {"net_income": v("y_net_income_0")}),
        ("operating_margin_change", True, f"{margin('rev_op_0')} - {margin('rev_op_1')}",
         {"margin": margin("rev_op_0"), "margin_prior": margin("rev_op_1")}),
        ("revenue_growth", True, growth(v("y_revenue_0"), v("y_revenue_1")),
         {"revenue": v("y_revenue_0"), "revenue_prior": v("y_revenue_1")}),
        ("asset_turnover_change", True, f"{turned('y_revenue_0', 'assets_at_y_revenue_0')} - "
         f"{turned('y_revenue_1', 'assets_at_y_revenue_1')}", {"revenue": v("y_revenue_0")}),
        ("leverage_change", False, f"{turned('liabilities_now', 'assets_at_liabilities_now')} - "
         f"{turned('liabilities_prior', 'assets_at_liabilities_prior')}", {"liabilities": v("liabilities_now")}),
        ("earnings_yield", True, paid(v("y_net_income_0")), cap),
        ("cash_flow_yield", True, paid(v("y_operating_cash_flow_0")), cap),
        ("sales_yield", True, paid(v("y_revenue_0")), cap),
        ("book_to_price", True, f"CASE WHEN equity_now.value > 0 THEN {paid(v('equity_now'))} END", cap),
        ("momentum", True, "momentum", {}),
        ("volatility", False, "volatility", {}),
        ("cash_to_assets", True, turned("cash_now", "assets_at_cash_now"), {"cash": v("cash_now")}))]


def wide_panel(facts: DataFrame, bars: DataFrame, entities: DataFrame, dates: Sequence[str]) -> DataFrame:
    """The row every factor expression reads: filings, prices, market cap and the entity's sector."""
    d = company_view(facts, dates)
    d = d.join(entities.select("entity_id", "sector", "brand", "size"), "entity_id")
    d = d.join(price_panel(bars, dates), ["brand", "as_of"], "left")
    usable = f"shares.value > 0 AND price > 0 AND datediff(as_of, shares.at) <= {MAX_SHARE_COUNT_AGE_DAYS}"
    return _with(d, {"market_cap": f"CASE WHEN {usable} THEN price * shares.value END"})


def factor_rows(panel: DataFrame, registry: Sequence[Factor] | None = None) -> DataFrame:
    """One row per (as_of, entity) holding the factors that could be computed; others are absent."""
    registry = registry or factor_registry()
    live = panel.filter(F.datediff("as_of", "newest_filing") <= MAX_STALENESS_DAYS)

    entry = lambda f: f"struct('{f.key}' AS key, {str(f.higher_is_better).lower()} AS higher_is_better, {f.value} AS value)"
    rows = live.selectExpr("as_of", "entity_id", "sector", "size",
                           f"array({', '.join(map(entry, registry))}) AS vals")
    return rows.withColumn("vals", F.expr("filter(vals, x -> x.value IS NOT NULL)")).filter("size(vals) > 0")


def factor_values(panel: DataFrame, registry: Sequence[Factor] | None = None) -> DataFrame:
    """Long (as_of, entity, key, value)."""
    return factor_rows(panel, registry).select("as_of", "entity_id", "sector", "size", F.inline("vals"))


def factor_inputs(panel: DataFrame, registry: Sequence[Factor] | None = None) -> DataFrame:
    """The filed figures behind each computed factor, one row per (as_of, entity, key, input)."""
    registry = registry or factor_registry()
    live = panel.filter(F.datediff("as_of", "newest_filing") <= MAX_STALENESS_DAYS)
    entries = ", ".join(f"struct('{f.key}' AS key, '{k}' AS input, double({c}) AS amount, ({f.value}) IS NOT NULL AS kept)"
                        for f in registry for k, c in f.inputs.items())
    return live.selectExpr("as_of", "entity_id", f"inline(array({entries}))").filter("kept").drop("kept")


def score(rows: DataFrame, slices: int | None = None) -> DataFrame:
    """Percentile of every factor inside the entity's pool; unpooled or thin stays unranked.

    `rows` is `factor_rows` output: pools are counted and joined before the factors
    are unpacked, so the join carries one row per entity.
    """
    long, largest = pooled(rows)
    slices = ranks.slices_for(largest) if slices is None else slices
    return ranks.percentile_rank(long, ["as_of", "key", "pool"], "value", F.col("higher_is_better"), slices=slices)


def pooled(rows: DataFrame) -> tuple[DataFrame, int]:
    """Every factor with its entity's pool, a row each, and the members of the largest pool."""
    # counted and joined below: compute the panel once, and survive a lost executor cheaply
    rows = cut_lineage(rows)
    members = rows.filter(F.col("sector").isNotNull()).groupBy("as_of", "sector").agg(F.count(F.lit(1)).alias("members"))
    named = rows.join(members, ["as_of", "sector"], "left").withColumn(
        "pool", ranks.comparable_pool(F.col("sector"), F.col("members"))).filter(F.col("pool").isNotNull())
    largest = named.groupBy("as_of", "pool").count().agg(F.max("count")).first()[0] or 0
    return named.select("as_of", "entity_id", "sector", "size", "pool", F.inline("vals")), largest


def ranked_counts(rows: DataFrame) -> DataFrame:
    """How many ranks `score` gives each key (seen), and to how many dates and entities it gives any (total): nothing is ordered."""
    rows = pooled(rows)[0].select("as_of", "entity_id", "pool", "key")
    held = rows.groupBy("as_of", "pool", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= ranks.MIN_UNIVERSE)
    seen = held.groupBy("key").agg(F.sum("n").alias("seen"))
    total = rows.join(held.select("as_of", "pool", "key"), ["as_of", "pool", "key"], "left_semi").select("as_of", "entity_id").distinct().agg(F.count(F.lit(1)).alias("total"))
    return seen.join(F.broadcast(total))


def score_universe(facts: DataFrame, bars: DataFrame, entities: DataFrame, dates: Sequence[str]) -> DataFrame:
    return score(factor_rows(wide_panel(facts, bars, entities, dates)))
