"""Search on positions: phrases without texts, snippets against a plain scan, the query's twin where the tables are larger."""

import random
import re

from pyspark.sql import functions as F

from compare import check, connect
from pitlens.operators import search
from pitlens.plans import QUERIES
from pitlens.plans.registry import runner

TEXTS = {1: "Margin pressure\nThe pressures on margins grew. Pressure of margins.", 2: "Report\nMargin. Pressure came later; margin under pressure.", 3: "Margin\nPressure alone",
         4: "Margin pressure again, but withdrawn", 5: "margins of pressure", 6: ""}


def found(spark, query, **how):
    docs = spark.createDataFrame([(k, f"e{k % 2}", "10-K", "2020-01-01", v) for k, v in TEXTS.items()], "doc_id long, entity string, subtype string, published string, text string")
    index = search.postings(docs.selectExpr("*", r"substring_index(text, '\n', 1) AS title"), "title", "text")
    return {r.doc_id for r in search.search(index, docs, query, None, **how).collect()}


def test_phrases_stand_in_order_and_keep_the_places_of_stop_words(spark):
    assert found(spark, '"margin pressure"') == {1, 2, 3, 4}
    assert found(spark, '"margin of pressure"') == {1, 2, 5}
    assert found(spark, '"margin pressure" -withdrawn') == {1, 2, 3}
    assert found(spark, '"margin pressure" "pressure on margin"') == {1}
    assert found(spark, '"the margin"') == {1, 2, 3, 4, 5}
    assert found(spark, '"margin pressure"', entity="e1") == {1, 3}
    assert found(spark, "pressure or report") == {1, 2, 3, 4, 5}


def test_a_word_without_a_vowel_is_no_stem_of_a_participle(spark):
    got = spark.createDataFrame([(w,) for w in ("thwhing", "thwhed", "thwhs", "walking", "walked", "walks")], "w string").selectExpr(f"{search.stem('w')} AS s").collect()
    assert [r.s for r in got] == ["thwhing", "thwhed", "thwh", "walk", "walk", "walk"]


def plain_snippet(text, query, radius=160):
    low = text.lower()
    spot = next((low.find(p.strip().lower()) for p in re.findall(r'"([^"]+)"', query) if low.find(p.strip().lower()) >= 0), None)
    if spot is None:
        terms = {t for t in re.findall(r"\w+", query.lower()) if len(t) > 2}
        at = sorted((m.start(), t) for t in terms for m in re.finditer(re.escape(t), low))
        if not at:
            return None
        spot = max(at, key=lambda p: (len({t for q, t in at if p[0] <= q <= p[0] + radius}), -p[0]))[0]
    a, b = max(0, spot - radius), min(len(text), spot + radius)
    return ("…" if a else "") + " ".join(text[a:b].split()) + ("…" if b < len(text) else "")


def test_snippets_match_a_plain_scan(spark):
    rng = random.Random(1)
    words = ["margin", "cost", "demand", "the", "fell.", "pressure", "ed", "costs\n", "tariff"]
    texts = [" ".join(rng.choice(words[:n] + ["xx"] * 30) for _ in range(rng.randint(0, 900))) for n in (1, 3, 9) for _ in range(12)] + ["", "nothing here", "costcostcost"]
    query = 'cost or margin demand -tariff "pressure fell."'
    got = search.snippets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), query).collect()
    assert {r.doc_id: r.snippet for r in got} == {k: plain_snippet(t, query) for k, t in enumerate(texts)}


def test_search_queries_match_their_twins_on_more_documents(spark):
    con = connect("/root/testdata/sf0.01")
    for name in ("text_search", "phrase_search", "search_snippets"):
        rows = runner(QUERIES[name])(spark, "/root/testdata/sf0.01")
        assert check(con, rows, QUERIES[name].sql) is None and rows.count() > 0


def test_equal_scores_go_to_the_newer_document_in_whatever_order_postings_come(spark):
    words = ["cost", "margin", "demand", "price", "tariff"]
    body = lambda n: " ".join(w for w, k in zip(words, (1, 2, 4, 6, n)) for _ in range(k))
    docs = spark.createDataFrame([(k, "e", "s", f"2020-01-{k + 1:02d}", f"{words[k % 5]}\n" + body(9)) for k in range(0, 30, 5)], "doc_id long, entity string, subtype string, published string, text string")
    index = search.postings(docs.selectExpr("*", r"substring_index(text, '\n', 1) AS title"), "title", "text")
    for seed in range(4):
        dealt = index.withColumn("_r", F.rand(seed)).repartitionByRange(7, "_r").sortWithinPartitions("_r").drop("_r")
        got = search.search(dealt, docs, " or ".join(words), None).collect()
        assert [r.doc_id for r in got] == [25, 20, 15, 10, 5, 0] and len({r.score for r in got}) == 1


def test_scores_that_differ_in_their_last_bits_alone_are_a_tie(spark):
    index = spark.createDataFrame([("aa", 1, "A", 1), ("bb", 1, "A", 4), ("aa", 2, "A", 9), ("aa", 3, "A", 4), ("bb", 3, "A", 1)], "term string, doc_id long, field string, tf long")
    docs = spark.createDataFrame([(1, "2020-01-01"), (2, "2020-01-02"), (3, "2020-01-03")], "doc_id long, published string")
    assert [r.doc_id for r in search.search(index, docs, "aa or bb", None).collect()] == [3, 2, 1]


def test_forms_of_words_are_those_of_the_expression_and_places_stand_in_order(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("aesidngxzhtyé9") for _ in range(rng.randint(1, 7))) + rng.choice(["", "s", "es", "ies", "ed", "ing", "e", "sses", "zzes"]) for _ in range(3000)]
    got = spark.createDataFrame([(w,) for w in words], "w string").selectExpr("w", f"{search.stem('w')} AS s").collect()
    assert all(search.form(r.w) == r.s for r in got)
    docs = spark.createDataFrame([(7, "e", "s", None, " ".join(words)), (8, "e", "s", "", None)], "doc_id long, entity string, subtype string, title string, text string")
    rows = search.postings(docs, "title", "text").collect()
    assert sorted((p, r.term) for r in rows for p in r.positions) == [(k, search.form(w)) for k, w in enumerate(words) if search.form(w)]
    assert all(r.tf == len(r.positions) and r.positions == sorted(r.positions) and (r.doc_id, r.field) == (7, "B") for r in rows)
