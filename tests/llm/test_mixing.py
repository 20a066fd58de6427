"""Mixing: targets against a plain loop, takes near targets, order low in discrepancy."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pitlens.llm import mixing


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, cap=2):
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: weights[k % 3] for k, s in enumerate(order)}
    full, total = set(), share * sum(sizes.values())
    while True:
        rest = [s for s in order if s not in full]
        left = total - sum(cap * sizes[s] for s in full)
        own = {s: left * w[s] / sum(w[x] for x in rest) for s in rest}
        above = {s for s in rest if own[s] > cap * sizes[s]}
        if not above:
            return own | {s: cap * sizes[s] for s in full}
        full |= above


def docs(n, seed=1):
    rnd = random.Random(seed)
    names = ["a", "B", "é", "b", None, "zz", "src10", "src9", "🙂"]
    say = lambda: " ".join("w" * rnd.randrange(1, 5) for _ in range(rnd.choice([0, 1, 3, 40, 200])))
    out = [(k // 2, say(), rnd.choice(names) if k % 3 else "hot") for k in range(n)]
    return out + [(None, None, "a"), (5, "x y", "only"), (5, "x y", "only"), (6, None, "none"), (7, "long " * 30_000, "hot")]


@pytest.mark.parametrize("n,block", [(0, 512), (300, 512), (300, 7), (1500, 1)])
def test_takes_meet_targets(spark, n, block):
    rows = docs(n)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, size int, target string")
    got = mixing.mix(df, block=block).collect()
    size = lambda t: len((t or "").split())
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"]) for r in got) == sorted((i is None, i or 0, size(t)) for i, t, _ in rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for _, t, s in rows:
        sizes[s] += size(t)
    want = plain_targets(sizes)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 * (1 + want[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"] and (r["first_position"] is None) == (r["taken"] == 0)
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 0.51 for s in sizes)
    again = mixing.mix(df.repartition(3), block=block).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_schedule_keeps_the_shares_everywhere(spark):
    slots = {0: 500, 1: 30, 2: 1, 3: 0, 4: 1200}
    got = mixing.schedule(spark.createDataFrame(list(slots.items()), "sid long, slots long"), 1).orderBy("position", "sid").collect()
    total, seen = sum(slots.values()), defaultdict(int)
    assert len(got) == total and {(r.sid, r.rank) for r in got} == {(s, k) for s, n in slots.items() for k in range(n)}
    for k, r in enumerate(got, 1):
        seen[r.sid] += 1
        assert abs(seen[r.sid] - k * slots[r.sid] / total) < 4


def test_golden_points(spark):
    ks = [0, 1, 2, 3, 10**6, 2**30 + 7, 2**42]
    got = spark.createDataFrame([(k,) for k in ks], "k long").select(mixing.golden(F.col("k"))).collect()
    assert [r[0] for r in got] == [k * mixing._GOLDEN % 2**40 for k in ks] and mixing._GOLDEN / 2**40 == pytest.approx((5**0.5 - 1) / 2)


def test_mixed_documents_keep_columns(spark):
    df = spark.createDataFrame([(i, t, s, "en") for i, t, s in docs(200)], "doc_id long, text string, source string, lang string")
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns and out.exceptAll(df.union(df)).count() == 0 and out.count() > 100
    assert mixing.mixed_documents(df.limit(0)).count() == 0
