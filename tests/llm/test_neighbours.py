"""Nearest neighbours: recall against brute force, exact scores, odd vectors."""

import numpy as np
from pyspark.sql import functions as F

from pitlens.llm import neighbours

SHAPE = "vec_id long, embedding array<float>, score string"


def exact(ids, x, queries, k=10):
    out = {}
    for q in queries:
        d = np.sqrt(((x.astype(float) - x[list(ids).index(q)].astype(float)) ** 2).sum(axis=1))
        out[q] = [(int(ids[j]), d[j]) for j in np.lexsort((ids, d)) if ids[j] != q][:k]
    return out


def found(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(out.setdefault(r["query_id"], [])) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


def test_recall_over_shards_and_blocks(spark):
    x = np.random.default_rng(1).normal(size=(3000, 64)).astype(np.float32)
    ids = np.random.default_rng(2).permutation(9000)[:3000]
    df = spark.createDataFrame([(int(i), v.tolist(), "x") for i, v in zip(ids, x)], SHAPE)
    rows = neighbours.usable(df, "embedding")
    index, fitted = neighbours.build(rows, shard_rows=700)
    got = found(neighbours.search(index, fitted, rows.where("vec_id % 20 = 0"), block=40).collect())
    want = exact(ids, x, [int(i) for i in ids if i % 20 == 0])
    assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
    assert np.mean([len({a for a, _ in got[q]} & {a for a, _ in want[q]}) / 10 for q in want]) >= 0.9
    place = {int(i): v.astype(float) for i, v in zip(ids, x)}
    assert all(s == np.sqrt(((place[q] - place[v]) ** 2).sum()) for q, near in got.items() for v, s in near)


def test_ties_copies_and_odd_vectors(spark):
    rng = np.random.default_rng(3)
    one = rng.normal(size=8).astype(np.float32).tolist()
    rows = [(i, one, "x") for i in range(900)] + [(1000 + i, rng.normal(size=8).astype(np.float32).tolist(), "x") for i in range(60)]
    odd = [(2000, None, "x"), (2020, [0.0] * 8, "x"), (2040, [float("nan")] * 8, "x"), (2060, [float("inf")] + [1.0] * 7, "x"), (2080, [None] + [1.0] * 7, "x"),
           (2100, [1.0] * 3, "x"), (None, one, "x"), (2120, [], "x"), (0, one, "x")]
    df = spark.createDataFrame(rows + odd, SHAPE)
    got = found(neighbours.nearest(df, "embedding", F.col("vec_id") % 100 == 0, shard_rows=200).collect())
    assert set(got) == {*range(0, 900, 100), 1000}
    for q in range(0, 900, 100):
        assert got[q] == [(i, 0.0) for i in range(12) if i != q][:10]
    few = spark.createDataFrame([(0, [1.0, 0.0], "x"), (100, [0.0, 1.0], "x"), (7, [1.0, 1.0], "x")], SHAPE)
    assert found(neighbours.nearest(few, "embedding", F.col("vec_id") % 100 == 0).collect())[0] == [(7, 1.0), (100, 2**0.5)]
    assert neighbours.nearest(few.limit(0), "embedding", F.lit(True)).count() == 0
    assert neighbours.nearest(few.where("vec_id = 7"), "embedding", F.lit(True)).count() == 0


def test_small_groups_of_copies(spark):
    for n in (100, 500, 1200, 2500):
        rng = np.random.default_rng(n)
        x = rng.normal(size=(n, 64)).astype(np.float32)
        ids, first, at = np.arange(n), [], 0
        for g in range(2, 11):
            x[at:at + g] = x[at]
            first.append(at)
            at += g
        df = spark.createDataFrame([(int(i), v.tolist(), "x") for i, v in zip(ids, x)], SHAPE)
        got, want = found(neighbours.nearest(df, "embedding", F.col("vec_id").isin(first)).collect()), exact(ids, x, first)
        assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
        for g, q in enumerate(first, 2):
            assert got[q][:g - 1] == [(q + i, 0.0) for i in range(1, g)]
        assert np.mean([len({a for a, _ in got[q]} & {a for a, _ in want[q]}) / 10 for q in want]) >= 0.9


def test_many_neighbours_beside_copies(spark):
    x = np.random.default_rng(5).normal(size=(8000, 16)).astype(np.float32)
    x[:34] = x[0]
    df = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(x)], SHAPE)
    got = found(neighbours.nearest(df, "embedding", F.col("vec_id") == 0, k=40).collect())
    assert len(got[0]) == 40 and got[0][:33] == [(i, 0.0) for i in range(1, 34)]


def test_blocks_and_shards_meet_without_the_driver(spark):
    # every block goes to every shard: a few queries on many shards are large, however small they are before that
    x = np.random.default_rng(6).normal(size=(900, 16)).astype(np.float32)
    rows = neighbours.usable(spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(x)], SHAPE), "embedding")
    index, fitted = neighbours.build(rows, shard_rows=30)
    near = neighbours.search(index, fitted, rows.where("vec_id % 10 = 0"), block=20)
    got, want = found(near.collect()), exact(np.arange(900), x, range(0, 900, 10))
    assert set(got) == set(want) and np.mean([len({a for a, _ in got[q]} & {a for a, _ in want[q]}) / 10 for q in want]) >= 0.9
    assert "Broadcast" not in near._jdf.queryExecution().executedPlan().toString()
