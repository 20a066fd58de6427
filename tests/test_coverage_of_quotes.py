"""Runs of words that quotes have in common with texts: against all pairs of positions, and on one word repeated."""

import random
import time

from pitlens.operators import search


def plain(q, t, least=4):
    runs = [[0] * (len(t) + 1) for _ in range(len(q) + 1)]
    inside, longest = set(), 0
    for i, a in enumerate(q, 1):
        for j, b in enumerate(t, 1):
            n = runs[i][j] = runs[i - 1][j - 1] + 1 if a == b else 0
            longest = max(longest, n)
            if n >= least:
                inside |= set(range(i - n, i))
    return len(inside), longest


def test_runs_match_all_pairs_of_positions(spark):
    rng = random.Random(5)
    rows = [(k, " ".join(rng.choice("abcd"[:n]) for _ in range(rng.randint(0, 30))), "\n ".join(rng.choice("abcd"[:n]) for _ in range(rng.randint(0, 60)))) for n in (1, 2, 3, 4) for k in range(n * 100, n * 100 + 40)]
    got = {r.id: (r.quote_words, round(r.covered * max(r.quote_words, 1)), r.longest) for r in search.quote_coverage(spark.createDataFrame(rows, "id int, q string, t string"), "id", "q", "t").collect()}
    assert got == {k: (len(q.split()), *plain(q.split(), t.split())) for k, q, t in rows}


def test_one_word_repeated_costs_its_length(spark):
    rows = [(1, "w " * 30_000 + "end", "w " * 29_000)]
    begun = time.time()
    r = search.quote_coverage(spark.createDataFrame(rows, "id int, q string, t string"), "id", "q", "t").first()
    assert (r.quote_words, r.longest, round(r.covered * r.quote_words)) == (30_001, 29_000, 30_000) and time.time() - begun < 20
