"""Where quotes stand and whether their paragraph is new, on hand-built filings."""

from pyspark.sql import functions as F

from pitlens.operators import events, sections

OLD, KEPT, NEAR = "The plant burned down in May. " * 5, "Rates rose and demand fell in the north. " * 5, "Cyber attack at the big subsidiary was stopped. " * 4


def test_placement_and_revalidation(spark):
    rows = [(1, 0, OLD), (1, 1, KEPT), (1, 2, NEAR), (2, 0, KEPT), (2, 1, NEAR.replace("big", "small")), (2, 2, "Quite another matter entirely, said nowhere before. " * 4), (3, 0, OLD)]
    p = spark.createDataFrame(rows, "doc_id long, pos int, paragraph string")
    pairs = spark.createDataFrame([("e", "s", 2, 1), ("e", "s", 4, 3)], "entity string, subtype string, current_id long, prior_id long")
    similar = sections.similarity_to_prior(p, pairs, sections.diff_filings(p, pairs))
    quotes = spark.createDataFrame([(2, "rates rose, and DEMAND fell"), (2, "at the small subsidiary"), (2, "another matter entirely"), (2, "nowhere to be found"), (3, "the plant burned")], "doc_id long, quote string")
    got = {(r.doc_id, r.pos): r.placed for r in sections.quote_placements(quotes, p, similar).collect()}
    assert got == {(2, 0): False, (2, 1): False, (2, 2): True, (2, None): None, (3, 0): None}
    verdicts = {(r.doc_id, r.pos): r.verdict for r in sections.revalidated(p.select("doc_id", "pos", F.lit("f").alias("id")), similar).collect()}
    assert verdicts == {(1, 0): "unreconstructible", (1, 1): "unreconstructible", (1, 2): "unreconstructible", (3, 0): "unreconstructible", (2, 0): "stale", (2, 1): "stale", (2, 2): "sound"}


def test_agreement_against_a_coin(spark):
    d = spark.createDataFrame([("k", 1.0, 0.5)] * 9 + [("k", -1.0, 0.2)] + [("one", 1.0, 1.0)], "k string, v double, later double")
    got = {r.k: (r.n, r.agree, round(r.p_vs_coinflip, 9)) for r in events.agreement(d, ["k"], "v", "later").collect()}
    assert got == {"k": (10, 9, round(2 * 11 / 1024, 9)), "one": (1, 1, 1.0)}
