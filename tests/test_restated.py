"""Restated findings against a plain loop, and a hot entity dealt over a grid."""

import random
import re

from pyspark.sql import functions as F

from pitlens.functions.findings import ALWAYS_NEW
from pitlens.functions.text import STOPWORDS
from pitlens.operators import norms

SCHEMA = "finding_id long, entity_id long, finding_type string, document_id string, occurred_at long, summary string"
WORDS = ["margin", "tariff", "demand", "supplier", "court", "recall", "launch", "outlook", "merger", "strike", "permit", "lease"]


def plain(rows):
    toks = lambda s: {w for w in re.findall("[a-z]{4,}", s.lower()) if w not in STOPWORDS}
    figs = lambda s: set(re.findall(r"[0-9]+(?:[.,][0-9]+)*", s))
    out = set()
    for i, e, k, d, t, s in rows:
        a = toks(s)
        if k in ALWAYS_NEW or not a:
            continue
        if any(e == e2 and k == k2 and t2 < t and d2 != d and 10 * len(a & toks(s2)) >= 3 * len(a | toks(s2)) and figs(s) <= figs(s2) for _, e2, k2, d2, t2, s2 in rows):
            out.add(i)
    return out


def test_same_as_a_plain_loop(spark, monkeypatch):
    rng = random.Random(3)
    rows = []
    for i in range(500):
        said = " ".join(rng.sample(WORDS, rng.randint(0, 5)) + [str(rng.randrange(4)) for _ in range(rng.choice([0, 0, 1, 1, 2, 3]))])
        rows.append((i, rng.randrange(3), rng.choice(["new_risk_factor", "guidance_change", "notable_quote"]), f"d{rng.randrange(40)}", rng.randrange(300), said))
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for cell in (norms.CELL_ROWS, 3):
        monkeypatch.setattr(norms.similar_sets, "__defaults__", (cell,))
        assert {r.finding_id for r in norms.restated(df).collect()} == plain(rows)


def test_a_hot_entity_meets_in_cells(spark, monkeypatch):
    """All sets of one entity share a word; no row and column of the grid holds more than a cell of them."""
    monkeypatch.setattr(norms.similar_sets, "__defaults__", (50,))
    sets = spark.range(600).select(F.lit(1).alias("k"), F.col("id").alias("this"), F.array(F.lit("margin"), F.concat(F.lit("own"), "id")).alias("rare"))
    index = sets.select("k", F.col("this").alias("other"), "rare", F.lit("x").alias("seen"))
    met = norms.similar_sets(sets, index, ["k"])
    cells = met.groupBy("tok", "row", "column").agg(F.countDistinct("this").alias("p"), F.countDistinct("other").alias("i")).agg(F.max("p"), F.max("i"), F.count("*")).first()
    assert met.count() == 600 * 600 and max(cells[0], cells[1]) < 100 and cells[2] >= 100
