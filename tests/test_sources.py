"""Payload flatteners on small documents, and writes repeated on purpose."""

import json
import random
from datetime import date, datetime

from pyspark.sql import functions as F

from pitlens.operators import briefs, sections
from pitlens.sources import html, landed, sinks


def doc(spark, payload):
    return spark.createDataFrame([(1, payload if isinstance(payload, str) else json.dumps(payload))], "id long, p string")


def obs(val, **kw):
    return {**{"start": "2020-01-01", "end": "2020-12-31", "val": val, "filed": "2021-02-01", "form": "10-K", "accn": "a"}, **kw}


def test_first_concept_present_wins_and_forms_are_kept(spark):
    gaap = {"Revenues": {"units": {"USD": [obs(1.0)]}}, "RevenueFromContractWithCustomerExcludingAssessedTax": {"units": {"USD": [obs(2.0), obs(3.0, form="8-K"), obs(None)]}},
            "Assets": {"units": {"USD": [obs(9.0, start=None), obs(8.0, start=None, filed="1999-01-01")]}}, "GrossProfit": {"units": {"USD": [obs(4.0, start="2020-10-01")]}}}
    got = landed.flatten_companyfacts(doc(spark, {"facts": {"us-gaap": gaap}}), "id", "p", 2024).collect()
    assert {(r.metric, r.period, r.value) for r in got} == {("revenue", "year", 2.0), ("assets", "instant", 9.0), ("gross_profit", "quarter", 4.0)}


def test_bad_short_interest_rows_are_dropped(spark):
    rows = [(1, "2024-01-15,100,90,5.5,11.1"), (2, "soon,100,90,1,1"), (3, "2024-01-15,null,90,1,1"), (4, "2024-01-31,50,,null,x")]
    got = landed.short_interest(spark.createDataFrame(rows, "id long, line string"), "id", "line").collect()
    assert {(r.id, r.position, r.days_to_cover) for r in got} == {(1, 100.0, 5.5), (4, 50.0, None)}


def test_surprise_needs_a_report_and_a_nonzero_estimate(spark):
    rows = [(1, {"date": "2024-01-02", "epsEstimate": -2.0, "epsActual": -1.0, "hour": "BMO"}), (2, {"date": "2024-01-02", "epsEstimate": 0.0, "epsActual": 1.0}), (3, {"date": "2024-01-02", "epsEstimate": 1.0})]
    d = spark.createDataFrame([(i, json.dumps(p)) for i, p in rows], "id long, p string")
    got = {r.id: (r.reported, r.surprise_percent, r.hour_label) for r in landed.earnings_events(d, "id", "p").collect()}
    assert got == {1: (True, 50.0, "before market open"), 2: (True, None, None), 3: (False, None, None)}


def test_chart_drops_null_close_and_falls_back(spark):
    p = {"timestamp": [0, 86400, 172800], "close": [1.0, None, 3.0], "adjclose": [0.5, 0.6, None], "volume": [1, 2, 3]}
    got = landed.bars_from_chart(doc(spark, p), "id", "p").orderBy("session_date").collect()
    assert [(r.session_date, r.close, r.adjusted_close) for r in got] == [(date(1970, 1, 1), 1.0, 0.5), (date(1970, 1, 3), 3.0, 3.0)]


def test_annual_before_quarterly_on_one_day_and_held_skipped(spark):
    p = {"form": ["10-Q", "10-K", "8-K", "10-K"], "filingDate": ["2024-02-01"] * 3 + ["2023-02-01"], "accessionNumber": ["q", "k", "e", "old"], "primaryDocument": ["q.htm", "k.htm", "e.htm", "o.htm"]}
    got = landed.filing_index_rows(doc(spark, p), "id", "p", "10-K", "10-Q", 1).collect()
    assert [r.url for r in got] == ["k/k.htm"]
    held = spark.createDataFrame([("k/k.htm",), ("q/q.htm",)], "url string")
    assert [r.url for r in landed.filing_index_rows(doc(spark, p), "id", "p", "10-K", "10-Q", 5, held).collect()] == ["old/o.htm"]


def test_notice_titles_and_one_row_per_accession(spark):
    rows = [("8-K - ACME CORP (0000000123) (Filer)", "/x/acc1-index.htm", "2024-01-01T10:00:00+00:00"), ("10-K/A - ACME CORP (0000000123) (Filer)", "/x/acc1-index.htm", "2024-01-01T10:00:00+00:00"), ("no form here", "/x/acc2-index.htm", None)]
    d = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "t string, l string, u string, k int")
    got = landed.acceptance_notices(d, "t", "l", "u", "k").collect()
    assert [(r.accession, r.cik, r.form, r.is_amendment) for r in got] == [("acc1", "0000000123", "8-K", False)]


def test_sic_ranges_are_closed(spark):
    d = spark.createDataFrame([("3579",), ("3580",), ("x",), (None,)], "s string")
    assert [r.x for r in d.selectExpr(f"{landed.sector_for_sic('s')} AS x").collect()] == ["Technology", "Industrials", None, None]


def test_exhibits_stop_at_the_budget_and_skip_plumbing(spark):
    rows = [(1, 1, "EX-99.1", "a" * 10), (1, 2, "EX-101.INS", "b"), (1, 3, "EX-99", "c" * 10), (1, 4, "EX-99.2", "d" * 10)]
    got = landed.assemble_exhibits(spark.createDataFrame(rows, "k long, seq int, type string, text string"), "k", 25).first()
    assert got.exhibits == 3 and got.body == "a" * 10 + "\n\n" + "c" * 10 + "\n\n" + "d" * 5


def test_page_text_and_article_outcomes(spark):
    long = "Word " * 200
    pages = [f"<html><head><title>T</title></head><body><script>x()</script><p>Hello <b>there</b></p><div style='display:none'>gone</div></body></html>",
             f"<body><nav>menu</nav><article><p>{long}</p></article></body>", f"<body><article><p>Subscribe to continue. {long}</p></article></body>", "<body><p>short</p></body>"]
    d = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "id int, html string")
    assert d.select(html.html_to_text("html").alias("t")).first().t == "Hello\nthere"
    got = {r.id: r.o for r in d.select("id", html.article_body("html").outcome.alias("o")).collect()}
    assert [got[i] for i in (1, 2, 3)] == ["fetched", "paywalled", "too_short"]


def test_append_if_absent_is_silent_about_repeats(spark, tmp_path):
    d = spark.range(4).selectExpr("id", "id * 2 AS v")
    path = str(tmp_path / "facts")
    for part in (d, d.union(d), d.union(spark.range(9, 10).selectExpr("id", "id * 2"))):
        sinks.append_if_absent(part, path, ["id", "v"])
    assert spark.read.parquet(path).count() == 5


def accepted_one_by_one(rows):
    urls, hashes, out = set(), set(), []
    for at, url, content in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or "", r[2])):
        if (url is None or url not in urls) and content not in hashes:
            out.append((at, url, content))
            urls.add(url)
            hashes.add(content)
    return sorted(out, key=str)


def test_a_row_turned_away_blocks_nobody(spark, tmp_path):
    kind, keys = "at int, url string, hash string", [("url",), ("hash",)]
    rows = [(1, "u1", "h1"), (2, "u2", "h1"), (3, "u2", "h3")]
    path = str(tmp_path / "documents")
    sinks.append_absent_keys(spark.createDataFrame(rows, kind), path, keys, ("at",))
    assert {tuple(r) for r in spark.read.parquet(path).collect()} == {rows[0], rows[2]}
    sinks.append_absent_keys(spark.createDataFrame([(4, "u9", "h3"), (5, "u9", "h9"), (6, None, "h1"), (7, None, "h7"), (8, None, "h8"), (8, None, "h8")], kind), path, keys, ("at",))
    assert {r.at for r in spark.read.parquet(path).collect()} == {1, 3, 5, 7, 8}
    rng = random.Random(7)
    many = [(rng.randrange(500), rng.choice([None, *(f"u{k}" for k in range(60))]), f"h{rng.randrange(80)}") for _ in range(600)]
    chain = [(k, f"u{(k + 1) // 2}", f"h{k // 2}") for k in range(24)]
    for case in (many, chain, []):
        got = sinks.first_come(spark.createDataFrame(case, kind), keys, ("at",)).collect()
        assert sorted(map(tuple, got), key=str) == accepted_one_by_one(set(case))


def test_upsert_takes_the_later_version(spark):
    old = spark.createDataFrame([(1, 5, 1), (2, 6, 1)], "k int, v int, version int")
    new = spark.createDataFrame([(2, 7, 2), (3, 8, 2)], "k int, v int, version int")
    assert {(r.k, r.v) for r in sinks.upsert(old, new, ["k"], "version").collect()} == {(1, 5), (2, 7), (3, 8)}


def test_greedy_drivers_match_a_plain_loop(spark):
    words = "supplier demand margin debt court tariff breach outlook".split()
    rows = [(1, i, f"{words[i % 8]} {words[(i * 3) % 8]}", (i % 5) / 5, i % 7 / 7) for i in range(40)]
    d = spark.createDataFrame([(e, i, s, x, p, False) for e, i, s, x, p in rows], "entity_id long, finding_id long, summary string, excess double, priority double, unusual boolean")
    got = [r.finding_id for r in briefs.pick_distinct(d).orderBy("place").collect()]
    chosen, seen = [], []
    for _, i, s, x, p in sorted(rows, key=lambda r: (r[3] >= 0.1, r[3], r[4], -r[1]), reverse=True):
        t = set(s.split())
        if any(len(t & o) / len(t | o) >= 0.4 for o in seen):
            continue
        chosen.append(i)
        seen.append(t)
        if len(chosen) == 3:
            break
    assert got == chosen


def test_diff_reports_both_directions(spark):
    p = lambda d, i, s: (d, i, s)
    same, changed, new, gone = "The plant burned down in May. " * 5, "Rates rose and demand fell in the north. " * 5, "Cyber attack at the subsidiary " * 6, "Old litigation was settled quietly " * 6
    rows = [p(1, 0, same), p(1, 1, gone), p(1, 2, changed), p(2, 0, same), p(2, 1, changed.replace("north", "south")), p(2, 2, new)]
    paras = spark.createDataFrame(rows, "doc_id long, pos int, paragraph string")
    pairs = spark.createDataFrame([("e", "s", 2, 1)], "entity string, subtype string, current_id long, prior_id long")
    got = sections.changed_paragraphs(sections.diff_filings(paras, pairs)).collect()
    assert {(r.side, r.doc_id, r.pos) for r in got} == {("added", 2, 2), ("removed", 1, 1)}


def test_intraday_tail_of_the_shortest_range(spark):
    rows = [(1, datetime(2024, 1, 1, 10, i), float(i + 1)) for i in range(50)]
    d = spark.createDataFrame(rows, "id long, at timestamp, v double")
    got = landed.intraday_change(d, "id", "at", "v", "1H").first()
    assert (got.points, got.change) == (30, 29.0)
