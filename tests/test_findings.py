"""Statistics, text, norms and scoring on small inputs, against plain Python where it matters."""

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitlens.functions import stats
from pitlens.functions import text as tx
from pitlens.operators import baselines, experiments, norms, search, sections
from pitlens.streaming import notices, scoring


def one(spark, expr, **cols):
    return spark.range(1).selectExpr(*[f"{v} AS {k}" for k, v in cols.items()]).selectExpr(f"{expr} AS x").first().x


def test_student_p_known_values(spark):
    for t, df, p in ((2.0, 10, 0.073388), (1.0, 1, 0.5), (2.5, 4, 0.066766), (3.0, 29, 0.005498)):
        assert abs(one(spark, stats.student_p("t", "d"), t=f"double({t})", d=str(df)) - p) < 1e-5
    assert one(spark, stats.student_p("t", "d"), t="double(null)", d="3") is None


def test_binomial_p_is_exact(spark):
    for k, n in ((8, 10), (5, 10), (0, 6), (400, 900)):
        seen = math.comb(n, k)
        want = sum(math.comb(n, j) for j in range(n + 1) if math.comb(n, j) <= seen) / 2 ** n
        assert abs(one(spark, stats.binomial_p("k", "n"), k=str(k), n=str(n)) - want) < 1e-9


def test_threshold_grows_with_trials():
    assert stats.multiple_testing_threshold(1) == 1.96
    assert stats.multiple_testing_threshold(10) > stats.multiple_testing_threshold(5)


def test_shrinkage_and_refusals(spark):
    assert one(spark, stats.shrunk_rate("0", "0", "0.3D", 0)) == 0.3
    assert one(spark, stats.shrunk_rate("5", "3", "0.3D", 10)) is None
    assert abs(one(spark, stats.shrunk_rate("3", "10", "0.5D", 10)) - 0.4) < 1e-12


def test_figures_cut_only_fractional_zeros(spark):
    got = one(spark, tx.figures("s"), s="'1,200.50 and 100 and 1 and 7.00'")
    assert got == ["1200.5", "100", "1", "7"]


def test_titles_topics_and_years(spark):
    assert one(spark, tx.title_of("s"), s="'Supply risk: one supplier'") == "Supply risk"
    assert one(spark, tx.primary_topic("s"), s="'a tariff and an export control'") == "trade"
    assert one(spark, tx.quoted_years("s"), s="'in 1998, 2120 and 2019'") == [1998, 2019]


def test_topics_are_told_once_a_text(spark):
    d = spark.createDataFrame([(1, "A TARIFF and an export control on a supplier"), (2, "nothing here"), (3, None), (4, "supplier, tariff")], "id int, s string")
    got = {r.id: (r.topics, r.primary_topic) for r in d.selectExpr("id", tx.told_topics("s")).collect()}
    assert got == {1: (["supply_concentration", "trade"], "trade"), 4: (["supply_concentration", "trade"], "supply_concentration")}
    assert tx.topic_hits("said").count("said") == 1 and tx.told_topics("said").count("said") == 1


def test_whole_word_ticker(spark):
    d = spark.createDataFrame([("Shares of F fall", "F"), ("For all", "F"), ("(AB) rises", "AB")], "h string, t string")
    assert [r.x for r in d.select(tx.contains_word(F.col("h"), F.col("t")).alias("x")).collect()] == [True, False, True]


def test_counts_before_are_half_open(spark):
    t0 = datetime(2024, 1, 1)
    at = [t0 + timedelta(hours=7 * i, microseconds=i % 3) for i in range(80)] + [t0 + timedelta(hours=70)] * 3 + [t0 + timedelta(days=12), t0 + timedelta(days=2)]
    d = spark.createDataFrame([(i, "k" if i % 5 else "j", a, 1) for i, a in enumerate(at)], "id long, key string, t timestamp, one int")
    got = {r.id: r.n_one for r in baselines.counts_before(d, ["key"], "id", "t", ["one"], 10, "n_").collect()}
    keys = ["k" if i % 5 else "j" for i in range(len(at))]
    want = {i: sum(1 for j, b in enumerate(at) if keys[j] == keys[i] and a - timedelta(days=10) <= b < a) for i, a in enumerate(at)}
    assert got == want


def brute_restated(rows):
    stop = set(tx.STOPWORDS)
    import re
    shape = lambda s: ({w for w in re.findall("[a-z]{4,}", s.lower())} - stop, set(re.findall(r"\d+", s)))
    out = set()
    for i, (a_id, a_t, a_doc, a_kind, a_s) in enumerate(rows):
        ta, fa = shape(a_s)
        for b_id, b_t, b_doc, b_kind, b_s in rows:
            tb, fb = shape(b_s)
            if b_t < a_t and b_doc != a_doc and b_kind == a_kind and ta and tb and len(ta & tb) / len(ta | tb) >= 0.3 and not fa - fb:
                out.add(a_id)
    return out


def test_restated_matches_brute_force(spark):
    words = "supplier demand margin debt court tariff breach outlook pricing backlog".split()
    rows = []
    for i in range(160):
        s = " ".join(words[(i * k) % 10] for k in (1, 3, 7)) + (f" {i % 4}" if i % 3 else "")
        rows.append((i, datetime(2024, 1, 1) + timedelta(hours=i % 50), f"d{i % 9}", ["new_risk_factor", "notable_quote"][i % 2], s))
    d = spark.createDataFrame([(i, 1, t, doc, kind, s) for i, t, doc, kind, s in rows], "finding_id long, entity_id long, occurred_at timestamp, document_id string, finding_type string, summary string")
    assert {r.finding_id for r in norms.restated(d).collect()} == brute_restated(rows)


def test_figure_update_is_not_a_repeat(spark):
    rows = [(1, 1, datetime(2024, 1, 1), "a", "notable_quote", "supplier demand grew 5"), (2, 1, datetime(2024, 1, 2), "b", "notable_quote", "supplier demand grew 6"),
            (3, 1, datetime(2024, 1, 3), "c", "guidance_change", "supplier demand grew 5")]
    d = spark.createDataFrame(rows, "finding_id long, entity_id long, occurred_at timestamp, document_id string, finding_type string, summary string")
    assert norms.restated(d).count() == 0


def test_contents_entry_is_not_a_section(spark):
    body = "\n".join(f"Line {i} of the risks." for i in range(30))
    text = f"Item 1A. Risk Factors 12\nItem 2. Properties 30\nItem 1A. Risk Factors\n{body}\n12\nItem 2. Properties\nnone"
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = sections.extract_section(d, "1A").first().section
    assert got.splitlines()[0] == "Line 0 of the risks." and len(got.splitlines()) == 30


def test_paragraph_ratio_matches_difflib(spark):
    from difflib import SequenceMatcher
    a, b = "the supplier of parts closed one plant", "the supplier of parts opened one new plant"
    d = spark.createDataFrame([(a, b), (a, "")], "p string, c string")
    got = [r.x for r in d.select(sections.matching_ratio("p", "c").alias("x")).collect()]
    assert got == [SequenceMatcher(None, b, a).ratio(), 0.0]


def test_quotes_found_at_any_offset_and_in_copies(spark):
    docs = spark.createDataFrame([(1, "xalpha beta gamma delta epsilon zetay"), (2, "alpha beta"), (3, "xalpha beta gamma delta epsilon zetay"), (4, "gamma alpha")], "doc_id long, text string")
    quotes = spark.createDataFrame([(10, "alpha beta gamma delta epsilon zeta"), (11, "pha beta ga"), (12, "absent words are here now ok")], "quote_id long, quote string")
    got = {(r.quote_id, r.doc_id) for r in search.quotes_in_source(quotes, docs).collect()}
    assert got == {(10, 1), (10, 3), (11, 1), (11, 3)}


def test_snippet_prefers_the_phrase(spark):
    text = "a " * 400 + "special words here " + "b " * 400
    got = search.snippets(spark.createDataFrame([(1, text)], "doc_id long, text string"), '"special words" here').first().snippet
    assert "special words here" in got and got[0] == got[-1] == "…" and 316 <= len(got) <= 322


def prior(**kw):
    return {**{"entity_id": 1, "eps_estimate": None, "revenue_estimate": None, "short_crowded": False, "watch": []}, **kw}


def score(spark, text, p, eps=None):
    item = "array<struct<topic: string, keywords: array<string>, severity: double, direction: string, priced: boolean>>"
    pri = spark.createDataFrame([(p["entity_id"], p["watch"], p["eps_estimate"], p["revenue_estimate"], p["short_crowded"])],
                                f"entity_id long, watch_items {item}, eps_estimate double, revenue_estimate double, short_crowded boolean")
    ev = spark.createDataFrame([(1, text, eps, None)], "entity_id long, text string, eps_actual double, revenue_actual double")
    return scoring.score_events(ev, pri).first()


def test_keyword_is_a_whole_word_and_priced_is_halved(spark):
    w = [("demand", ["ai"], 2.0, "positive", True)]
    assert score(spark, "said plainly", prior(watch=w)).score == 0
    assert score(spark, "AI demand", prior(watch=w)).score == 1.0


def test_crowded_short_amplifies_only_upside(spark):
    up = score(spark, "x", prior(eps_estimate=1.0, short_crowded=True), eps=1.1)
    down = score(spark, "x", prior(eps_estimate=1.0, short_crowded=True), eps=0.9)
    assert (up.score, down.score) == (1.35, 1.0) and (up.direction, down.direction) == ("positive", "negative")


def test_basis_mismatch_is_set_aside_and_no_prior_scores_zero(spark):
    assert score(spark, "x", prior(eps_estimate=1.0), eps=2.0).score == 0
    assert score(spark, "x", prior(entity_id=2, eps_estimate=1.0), eps=1.1).score == 0


def test_a_batch_replayed_changes_nothing(spark, tmp_path):
    root = str(tmp_path)
    batch = spark.range(12).selectExpr("id % 3 AS entity_id", "string(id % 6) AS accession", "timestamp'2024-01-01 20:00:00' + make_interval(0, 0, 0, 0, int(id)) AS accepted_at", "id AS mark")
    keys = ["entity_id", "accession"]
    stored = lambda: sorted(map(tuple, spark.read.parquet(f"{root}/assessments").select("entity_id", "accession", "mark", "epoch").collect()))
    assert notices.store_epoch(batch, root, "q", 0, keys, "accepted_at") == 6
    first = stored()
    assert notices.store_epoch(batch, root, "q", 0, keys, "accepted_at") is None and stored() == first
    assert notices.store_epoch(batch, root, "other", 0, keys, "accepted_at") == 0 and stored() == first
    more = batch.unionByName(spark.range(100, 102).selectExpr("9L AS entity_id", "string(id) AS accession", "timestamp'2024-01-02 00:00:00' AS accepted_at", "id AS mark"))
    assert notices.store_epoch(more, root, "q", 1, keys, "accepted_at") == 2 and len(stored()) == 8
    assert notices.store_epoch(more.filter("false"), root, "q", 2, keys, "accepted_at") == 0
    beat = notices.heartbeat(spark, root).orderBy("query", "epoch").collect()
    assert [(r.query, r.epoch, r.notices, r.written) for r in beat] == [("other", 0, 6, 0), ("q", 0, 6, 6), ("q", 1, 8, 2), ("q", 2, 0, 0)]
    # an epoch that died between its rows and its entry is written over, not doubled
    fs = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/ledger/query=q/epoch=1")
    fs.getFileSystem(spark._jsc.hadoopConfiguration()).delete(fs, True)
    assert notices.store_epoch(more, root, "q", 1, keys, "accepted_at") == 2 and len(stored()) == 8


def test_a_failed_cycle_is_in_the_heartbeat(spark, tmp_path):
    spark.createDataFrame([(1, 1, "purchase", 1.0, "{}")], "event_id long, user_id long, event_type string, value double, props string").selectExpr(
        "event_id", "timestamp_ntz'2024-01-01 10:00:00' AS ts", "user_id", "event_type", "value", "props").write.parquet(str(tmp_path / "in"))

    def fail(batch):
        raise ValueError("no priors today")

    with pytest.raises(Exception):
        notices.run_notices(spark, str(tmp_path / "in"), "*.parquet", lambda: spark.range(5).withColumnRenamed("id", "entity_id"), lambda: None, fail, root=str(tmp_path / "out"))
    beat = notices.heartbeat(spark, str(tmp_path / "out")).collect()
    assert len(beat) == 1 and "no priors today" in beat[0].failure


def test_word_forms_meet(spark):
    same = [("price", "prices"), ("price", "pricing"), ("price", "priced"), ("loss", "losses"), ("company", "companies"), ("box", "boxes"), ("report", "reported"),
            ("report", "reporting"), ("supply", "supplies"), ("rate", "rates"), ("use", "used")]
    apart = [("king", "k"), ("ring", "r"), ("need", "ne"), ("bus", "bu"), ("thing", "th"), ("loss", "los")]
    d = spark.createDataFrame(same + apart, "a string, b string").selectExpr("a", "b", f"{search.stem('a')} = {search.stem('b')} AS same")
    assert [r.same for r in d.collect()] == [True] * len(same) + [False] * len(apart)


def test_query_words_without_stop_words():
    assert search.parse_query('price of "the loss" the and tax or duty -the -old "of the"') == ([["price"], ["tax", "duty"]], ["the loss"], ["old"])


def test_short_quotes_are_found(spark):
    quotes = spark.createDataFrame([(1, "net loss"), (2, "x"), (3, "loss"), (4, "absent"), (5, ""), (6, "a net loss of ten")], "quote_id int, quote string")
    docs = spark.createDataFrame([(10, "a net loss of ten"), (11, "glossy x"), (12, ""), (13, "a net loss of ten")], "doc_id int, text string")
    got = {(r.quote_id, r.doc_id) for r in search.quotes_in_source(quotes, docs).collect()}
    assert got == {(1, 10), (1, 13), (2, 11), (3, 10), (3, 11), (3, 13), (6, 10), (6, 13)}


def test_diff_keeps_every_changed_paragraph_and_its_best_match(spark):
    from difflib import SequenceMatcher
    from pitlens.operators import sections
    rng = np.random.default_rng(4)
    say = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 400, n))
    old = [say(30) for _ in range(60)]
    new = [p if k % 3 == 0 else p + " " + say(6) if k % 3 == 1 else say(30) for k, p in enumerate(old)]
    rows = [(1, k, p) for k, p in enumerate(old)] + [(2, k, p) for k, p in enumerate(new)]
    paragraphs = spark.createDataFrame(rows, "doc_id long, pos int, paragraph string")
    pairs = spark.createDataFrame([("e", "10-K", 2, 1), ("e", "10-K", 9, 2)], "entity string, subtype string, current_id long, prior_id long")
    got = sections.diff_filings(paragraphs, pairs).filter("side = 'added' AND current_id = 2").collect()
    assert {r.pos for r in got} == {k for k in range(60) if k % 3}
    for r in got:
        best = max(SequenceMatcher(None, o, r.paragraph).ratio() for o in old)
        assert (r.similarity >= 0.75) == (best >= 0.75) and (best < 0.75 or abs(r.similarity - best) < 1e-12)
    changed = sections.changed_paragraphs(sections.diff_filings(paragraphs, pairs)).filter("current_id = 2").groupBy("side").agg(F.count("*").alias("n"), F.max("place").alias("p"))
    assert {r.side: (r.n, r.p) for r in changed.collect()} == {"added": (20, 20), "removed": (20, 20)}


def test_a_failing_rule_fails_alone(spark):
    from pitlens.operators import rules
    failed = []
    got = rules.evaluate_rules([lambda d: d.select("nothing"), lambda d: d.select("id")], spark.range(2), failed=failed)
    assert len(got) == 1 and got[0].count() == 2 and len(failed) == 1


def test_sign_flips_come_near_the_exact_share(spark):
    from itertools import product
    from pitlens.functions import stats
    x = [0.5, -0.2, 0.9, 0.4, -0.1, 0.7, 0.3, 0.2]
    d = spark.createDataFrame([("k", i, v) for i, v in enumerate(x)], "k string, i int, v double")
    r = stats.sign_flip(d, ["k"], "i", "v", 10_000).first()
    exact = np.mean([abs(np.dot(s, x)) >= abs(sum(x)) - 1e-12 for s in product((1, -1), repeat=len(x))])
    assert r.n == 8 and abs(r.p - exact) < 0.01


def test_resamples_of_any_statistic(spark):
    from pitlens.functions import stats
    rng = np.random.default_rng(5)
    x = rng.normal(0.3, 1, 60)
    rows = [("a", i, float(v), 2.0) for i, v in enumerate(x)] + [("same", i, 1.5, 3.0) for i in range(9)] + [("few", 0, 1.0, 1.0), ("few", 1, 2.0, 1.0)]
    d = spark.createDataFrame(rows, "k string, i int, x double, y double")
    told = {"mean": stats.mean_of("x"), "median": stats.median_of("x"), "ratio": stats.ratio_of("x", "y"), "spread": lambda r: f"array_max(transform({r}, v -> v.x)) - array_min(transform({r}, v -> v.x))"}
    got = {(r.k, r.statistic): r for r in stats.resample_statistics(d, ["k"], "i", ["x", "y"], told, 4_000).collect()}
    assert len(got) == 12 and np.isclose(got["a", "mean"].point, x.mean()) and np.isclose(got["a", "median"].point, np.median(x)) and np.isclose(got["a", "spread"].point, np.ptp(x))
    assert got["same", "median"].low == got["same", "median"].high == 1.5 and got["same", "ratio"].low == 0.5 and got["few", "mean"].low is None and got["few", "mean"].draws == 0
    draws = {"mean": [], "median": []}
    for _ in range(4_000):  # a stationary bootstrap walked step by step
        at, sample = rng.integers(60), []
        for _ in range(60):
            sample.append(x[at])
            at = rng.integers(60) if rng.random() <= 0.2 else (at + 1) % 60
        draws["mean"].append(np.mean(sample))
        draws["median"].append(np.median(sample))
    for name, values in draws.items():
        low, high = np.quantile(values, [0.025, 0.975])
        assert abs(got["a", name].low - low) < 0.08 and abs(got["a", name].high - high) < 0.08
    assert np.isclose(got["a", "ratio"].low, got["a", "mean"].low / 2)


def test_the_last_bit_of_a_sum_is_no_gain(spark):
    rows = [("c", k, "a", 0.5 + d, 0.5) for k, d in enumerate((1.7763568394002505e-15, 2.220446049250313e-16, -1e-16, 0.0, 0.01, -0.01))]
    pairs = spark.createDataFrame(rows, "cust string, y int, arm string, volatility double, control_volatility double")
    r = experiments.arm_report(pairs, ["volatility"]).first()
    assert (r.n, r.positive) == (6, 1)
