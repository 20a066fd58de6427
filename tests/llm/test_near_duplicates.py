"""Near-duplicate groups against all pairs by brute force."""

import random
import re

import pytest

from pitlens.llm.near_duplicates import components, halves, near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LAST = 2**63 - 1


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def sets(text, width):
    w = WORD.findall(lower(text or ""))
    return {tuple(w)} if 0 < len(w) < width else {tuple(w[k:k + width]) for k in range(len(w) - width + 1)}


def plain(rows, width, inner, outer):
    own = [sets(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            common = len(own[a] & own[b])
            if own[a] and own[b] and outer * common >= inner * len(own[a] | own[b]):
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        i = LAST if i is None else i
        least[root(k)] = min(least.get(root(k), LAST), i)
    out = []
    for k, (i, _) in enumerate(rows):
        c = least[root(k)]
        out.append((i, len(own[k]), None if c == LAST else c, c == (LAST if i is None else i)))
    return sorted(out, key=str)


def corpus(seed, families, size):
    rnd = random.Random(seed)
    rows = []
    for _ in range(families):
        base = [f"w{rnd.randrange(3000)}" for _ in range(rnd.choice([1, 2, 4, 8, 30, 120, 300]))]
        for _ in range(rnd.randrange(1, size)):
            w = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 4, len(w) // 20])):
                w[rnd.randrange(len(w))] = f"W{rnd.randrange(3000)}"
            rows.append(" ".join(x.upper() if rnd.random() < 0.05 else x for x in w))
    rnd.shuffle(rows)
    rows = list(enumerate(rows))
    long = " ".join(f"w{rnd.randrange(3000)}" for _ in range(40_000))
    return rows + [(None, None), (None, ""), (9000, None), (9001, " \n"), (3, "a tie"), (3, "a tie"), (3, "another tie"), (9002, "a tie"),
                   (9003, long), (9004, long + " x"), (None, "only null ids"), (None, "only null ids"), (9005, "É"), (9006, "é")]


@pytest.mark.parametrize("width,inner,block", [(3, 85, 2_000_000), (5, 80, 2_000_000), (3, 85, 600)])
def test_same_as_all_pairs(spark, width, inner, block):
    rows = corpus(width + block, 40, 12)
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n long, kept string").repartition(5)
    got = near_duplicates(df, width, (inner, 100), block=block).collect()
    assert sorted((tuple(r)[:4] for r in got), key=str) == plain(rows, width, inner, 100)
    words = [r for r in got if r.n_shingles]
    for c in {r.component_id for r in words}:
        firsts = [r for r in words if r.component_id == c and r.first]
        assert firsts and all(r.kept for r in firsts) and (len(firsts) == 1 or c == 3)


def test_no_rows(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_halves_meet_the_miss_rate():
    assert all((1 - t**3) ** halves(t) <= 1e-5 < (1 - t**3) ** (halves(t) - 1) for t in (0.8, 0.85))


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(200, 260)] + [(500, 500)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {k: 100 for k in range(100, 161)} | {k: 7 for k in [7, *range(200, 260)]}
