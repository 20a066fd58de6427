"""Filings compared with the ones before: best ratios as by brute force, and what is dealt grows with the text."""

import random
from difflib import SequenceMatcher

from pitlens.operators import sections


def filings(seed, docs, paragraphs):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(400)]
    rows = [(1, k, " ".join(rng.choices(words, k=rng.randint(5, 60)))) for k in range(paragraphs)]
    for doc in range(2, docs + 1):
        for k, (_, _, text) in enumerate(rows[-paragraphs:]):
            said = text.split(" ")
            for _ in range(rng.randint(0, 6)):
                said[rng.randrange(len(said))] = rng.choice(words)
            rows.append((doc, k, "!!" if k == 3 else " ".join(said)))
    return rows


def diffed(spark, rows):
    pairs = [("e", "s", k, k - 1) for k in range(2, max(r[0] for r in rows) + 2)]
    p = spark.createDataFrame(rows, "doc_id long, pos int, paragraph string").repartition(8)
    return sections.diff_filings(p, spark.createDataFrame(pairs, "entity string, subtype string, current_id long, prior_id long"))


def test_best_ratios_as_by_brute_force(spark):
    rows = filings(7, 4, 12)
    norm = lambda text: text.strip("!").lower()
    grams = lambda text: set(zip(text.split(" "), text.split(" ")[1:]))
    want = {}
    for doc, against, side in [(k, k - 1, "added") for k in (2, 3, 4)] + [(k, k + 1, "removed") for k in (1, 2, 3)]:
        theirs = [norm(t) for d, _, t in rows if d == against]
        for _, pos, text in (r for r in rows if r[0] == doc and norm(r[2]) not in theirs):
            n = norm(text)
            near = [t for t in theirs if grams(t) & grams(n) and min(len(t), len(n)) >= sections.MIN_LENGTH_RATIO * max(len(t), len(n))]
            want[side, doc, pos, text] = 1.0 if n == "" else max((SequenceMatcher(None, t, n).ratio() for t in near), default=0.0)
    got = diffed(spark, rows).collect()
    assert {(r.side, r.doc_id, r.pos, r.paragraph): r.similarity for r in got} == want and len(got) == len(want) > 40
    assert {(r.entity, r.subtype, r.doc_id) for r in got if r.side == "added"} == {("e", "s", 2), ("e", "s", 3), ("e", "s", 4)}


def test_texts_are_dealt_not_their_words(spark):
    rows = filings(8, 6, 300)
    sc = spark.sparkContext
    none = sc._gateway.new_array(sc._jvm.double, 0)

    def written():
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, none, None)
        return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))

    begun, small = written(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        diffed(spark, rows).count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)
    assert written() - begun < 3.5 * sum(len(r[2]) for r in rows)


def test_rarities_are_the_same_wherever_terms_are_looked_up(spark):
    """Terms that most entities use do not leave their paragraph; the result does not depend on how many these are."""
    rng = random.Random(9)
    words = [f"word{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(300)]
    rows = [(f"e{k % 25}", k, " ".join(words[min(299, int(rng.expovariate(1 / 40)))] for _ in range(30))) for k in range(200)]
    p = spark.createDataFrame(rows, "entity string, key long, paragraph string")
    got = [sorted(map(tuple, sections.term_rarity(p, sections.build_vocabulary(p), "key", common).collect())) for common in (0, 10, 20_000)]
    used = {w: len({e for e, _, text in rows if w in text.split(" ")}) for w in words}
    assert got[0] == got[1] == got[2] and len(got[0]) == sum(len(set(text.split(" "))) for _, _, text in rows)
    assert all((r == 1.0) == (used[w] < 2) and (r == 0.0) == (used[w] == 25) for _, w, r in got[0])
