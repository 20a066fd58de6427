"""The domain views of `sources.bindings`, said once more in SQL for the twins."""

from __future__ import annotations

from pitlens.sources.bindings import FINDING_TYPE, HORIZONS, SUBTYPES, WORDS_A, WORDS_B


def R(expr: str, digits: int = 6) -> str:
    """Rounded output column without a negative zero."""
    return f"(round({expr}, {digits}) + 0.0)"


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_FLOWS = ["revenue", "gross_profit", "net_income", "operating_income",
          "operating_cash_flow", "shares_diluted", "rnd_expense"]


def _quarters(where: str) -> str:
    e, d, t = "l_extendedprice", "l_discount", "l_tax"
    return f"""select l_suppkey entity_id, year(l_shipdate) y, quarter(l_shipdate) q,
 sum({e}*(1-{d})) revenue, sum({e}*(1-{d}-{t})) gross_profit, sum({e}*({d}-{t})) net_income,
 sum({e}*({d}-{t}/2)) operating_income,
 sum(case when l_linestatus='F' then {e}*({d}-{t}) else 0 end) operating_cash_flow,
 sum(l_quantity) shares_diluted, sum({e}*{t}*2.4) rnd_expense,
 sum({e}) ext, sum({e}*{t}) ext_tax, sum({e}*{d}) ext_disc
 from lineitem {where} group by all"""


def _long(src: str, lag: int) -> str:
    run = "over (partition by entity_id order by y, q rows unbounded preceding)"
    qe = "last_day(make_date(y, q*3, 1))"
    parts = [f"select entity_id, '{m}' metric, 'quarter' period, {qe} period_end, {m} as value from {src}"
             for m in ("revenue", "shares_diluted")]
    inst = {"assets": f"sum(ext) {run}", "liabilities": f"sum(ext_tax) {run}", "cash": f"sum(ext_disc) {run}",
            "equity": f"sum(ext) {run} - sum(ext_tax) {run}", "shares_outstanding": f"sum(shares_diluted) {run}"}
    parts += [f"select entity_id, '{m}' metric, 'instant' period, {qe} period_end, {x} as value from {src}"
              for m, x in inst.items()]
    parts += [f"select entity_id, '{m}' metric, 'year' period, make_date(y,12,31) period_end, sum({m}) as value"
              f" from {src} group by entity_id, y" for m in _FLOWS]
    return (f"select entity_id, metric, period, period_end::date period_end,"
            f" (period_end::date + ({30 + lag} + entity_id % 45)::int)::date filed_on, value from ("
            + " union all ".join(parts) + ")")


_FTYPE = "case event_type " + " ".join(f"when '{a}' then '{b}'" for a, b in FINDING_TYPE.items()) + " end"
_K = "cast(json_extract_string(props,'$.k') as int)"

VIEWS: dict[str, tuple[str, str]] = {
    "regions": ("", "select n_nationkey nation_key, n_name nation, r_name sector from nation join region on n_regionkey=r_regionkey"),
    "entities": ("regions", "select s_suppkey entity_id, s_name as name, sector, nation, s_acctbal as size,"
                 " 'Brand#' || (s_suppkey % 25 + 1) brand from supplier join regions on s_nationkey=nation_key"),
    "holders": ("regions", "select c_custkey entity_id, c_name as name, sector, c_acctbal as size, c_mktsegment tier"
                " from customer join regions on c_nationkey=nation_key"),
    "quarters": ("", _quarters("")),
    "quarters_original": ("", _quarters("where l_returnflag <> 'R'")),
    "facts": ("quarters", _long("quarters", 0)),
    "facts_restated": ("quarters quarters_original",
                       _long("quarters_original", 0) + " union all " + _long("quarters", 180)),
    "bars": ("", "select p_brand brand, l_shipdate::date session_date, avg(l_extendedprice/l_quantity) as close,"
             " avg(l_extendedprice/l_quantity*(1-l_discount)) adjusted_close, sum(l_quantity) volume"
             " from lineitem join part on l_partkey=p_partkey group by 1,2"),
    "benchmark_bars": ("", "select l_shipdate::date session_date, avg(l_extendedprice/l_quantity) as close,"
                       " avg(l_extendedprice/l_quantity*(1-l_discount)) adjusted_close from lineitem group by 1"),
    "findings": ("", f"""select event_id finding_id, user_id entity_id, event_type, {_FTYPE} finding_type,
 ts occurred_at, ts::date as day, value, {_K} k,
 case when event_type in ('purchase','signup') then 'positive' when event_type='error' then 'negative' end direction,
 case when value<20 then 'minor' when value<80 then 'moderate' else 'major' end magnitude,
 least(value/400, 1.0) confidence,
 case when event_type='view' then greatest(least(value/50-1, 1.0), -1.0) end sentiment,
 case when {_K} % 4 < 3 then {_list(HORIZONS)}[{_K} % 4 + 1] end horizon,
 user_id || '@' || ts::date document_id, {_list(SUBTYPES)}[(user_id + day(ts)) % 4 + 1] genre,
 event_type || ': ' || {_list(WORDS_A)}[{_K} // 10 + 1] || ' ' || {_list(WORDS_B)}[{_K} % 10 + 1] || ' ' || floor(value)::int summary,
 'as of ' || (1995 + {_K} % 30) quote, (ts::date - 8766)::date price_day, 'Brand#' || (user_id % 25 + 1) brand
 from events"""),
    "filings": ("", "select doc_id, source entity, lang subtype, (date '2020-01-01' + doc_id::int)::date published, text from documents"),
    "positions": ("", "select o_custkey user_id, p_brand brand, sum(l_quantity) shares,"
                  " sum(l_extendedprice)/sum(l_quantity) cost_basis from lineitem join part on l_partkey=p_partkey"
                  " join orders on l_orderkey=o_orderkey group by 1,2"),
    "exposures": ("", "select s_nationkey dependent, c_nationkey hub, count(*) mention_count from lineitem"
                  " join orders on l_orderkey=o_orderkey join supplier on l_suppkey=s_suppkey"
                  " join customer on o_custkey=c_custkey group by 1,2"),
}


def view(name: str, sql: str, needs: str = "") -> None:
    """Register a CTE that several twins share."""
    VIEWS[name] = (needs, sql)


def with_views(names: list[str], body: str) -> str:
    done: list[str] = []

    def add(n: str) -> None:
        if n in done:
            return
        for d in VIEWS[n][0].split():
            add(d)
        done.append(n)

    for n in names:
        add(n)
    if not done:
        return body
    return "with " + ",\n".join(f"{n} as ({VIEWS[n][1]})" for n in done) + "\n" + body
