"""Approximate nearest neighbours by a forest of hash prefixes.

A vector's hash string in a tree is the signs of its projections on random directions, and a
tree is the sorted array of the strings. A query descends each tree to the strings with the
longest common prefix, then ascends all trees together, a bit at a time, until the prefixes
of that length hold enough vectors between them; those are measured exactly. The few vectors
met in the most trees do not count towards enough, so a query's own copies never end the ascent
before its k are found. Prefixes are taken whole, so vectors alike in their strings are all
measured, however many they are.

The index is split by vec_id into shards of bounded size, each a forest of its own. Queries come
in blocks of bounded size; every block visits every shard, and a query keeps its nearest of all the shards of a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pitlens.session import cut_lineage

TREES, STRING_BITS, SHARD_ROWS, BLOCK_QUERIES, TASK_BLOCKS = 128, 32, 8_192, 1_024, 32
#: How many vectors, repeats over trees counted, the ascent gathers beside the k + 1 it meets most: this share of the shard and at least this many a neighbour.
SHARE, LEAST = 0.5, 50


def usable(vectors: DataFrame, column: str) -> DataFrame:
    """vec_id, vector (doubles) of the rows that take part, one for each vec_id (the least, of repeats).

    Null ids, and vectors null, zero or with null or non-finite components are left out; where
    lengths differ, the commonest length takes part, the longer of equals.
    """
    v = F.col("vector")
    rows = vectors.select("vec_id", F.col(column).cast("array<double>").alias("vector")).where("vec_id IS NOT NULL AND vector IS NOT NULL").where(
        F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0))
    length = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("vector") == (length["n"] if length else 0)).groupBy("vec_id").agg(F.min("vector").alias("vector"))


def directions(dim: int, n: int, seed: int = 5) -> np.ndarray:
    """n random directions, orthogonal by dozens."""
    rng = np.random.default_rng(seed)
    return np.concatenate([np.linalg.qr(rng.normal(size=(dim, dim)))[0] for _ in range(-(-n // dim))], axis=1)[:, :n]


def strings(x: np.ndarray, centre: np.ndarray, turns: np.ndarray, trees: int) -> np.ndarray:
    """Hash strings, a row per tree."""
    bits = ((x - centre) @ turns > 0).reshape(len(x), trees, -1)
    packed = np.packbits(bits, axis=2)
    return np.ascontiguousarray(packed.view(">u4")[:, :, 0].T.astype(np.uint32))


def gather(keys: np.ndarray, order: np.ndarray, asked: np.ndarray, least: int, k: int) -> list[np.ndarray]:
    """Candidates of each query: rows of the sorted arrays under the longest prefixes that hold `least` between all trees.

    The k + 1 rows met most often are not counted, so there are more than k + 1 candidates, or every row.
    """
    trees, n = keys.shape
    queries = asked.shape[1]
    low = np.zeros((STRING_BITS + 1, trees, queries), np.int32)
    high = np.full((STRING_BITS + 1, trees, queries), n, np.int32)
    for depth in range(1, STRING_BITS + 1):
        mask = np.uint32((0xFFFFFFFF << (STRING_BITS - depth)) & 0xFFFFFFFF)
        for t in range(trees):
            low[depth, t] = np.searchsorted(keys[t], asked[t] & mask, "left")
            high[depth, t] = np.searchsorted(keys[t], asked[t] | ~mask, "right")
    enough = (high - low).sum(axis=1, dtype=np.int64) >= least
    depth = STRING_BITS - np.argmax(enough[::-1], axis=0)
    depth = np.where(enough.any(axis=0), depth, 0)
    out = []
    for q in range(queries):
        for d in range(depth[q], -1, -1):
            times = np.bincount(np.concatenate([order[t, low[d, t, q]:high[d, t, q]] for t in range(trees)]), minlength=n)
            if n > k + 1 and np.partition(times, n - k - 1)[:n - k - 1].sum() >= least:
                break
        out.append(np.flatnonzero(times))
    return out


def build(rows: DataFrame, trees: int = TREES, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, tuple[np.ndarray, np.ndarray]]:
    """(shard, ids, vectors, keys, order) of every row, written once, and (centre, directions); the centre is every row's mean."""
    means = rows.select(F.posexplode("vector").alias("at", "x")).groupBy("at").agg(F.avg("x").alias("x")).collect()
    centre = np.array([x for _, x in sorted(map(tuple, means))] or [0.0])
    turns = directions(len(centre), trees * STRING_BITS)
    shards = max(1, -(-rows.count() // shard_rows))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id")
        x = table.column("vector").combine_chunks().flatten().to_numpy().reshape(len(table), -1)
        keys = strings(x, centre, turns, trees)
        order = np.argsort(keys, axis=1, kind="stable").astype(np.int32)
        return pa.table({"shard": pa.array([table.column("shard")[0].as_py()], pa.int32()), "ids": pa.array([table.column("vec_id").to_numpy()], pa.list_(pa.int64())),
                         "vectors": pa.array([x.tobytes()], pa.binary()), "keys": pa.array([np.take_along_axis(keys, order, axis=1).tobytes()], pa.binary()),
                         "order": pa.array([order.tobytes()], pa.binary())})

    placed = rows.select(F.pmod(F.xxhash64(F.lit(3), "vec_id"), F.lit(shards)).cast("int").alias("shard"), F.col("vec_id").cast("long").alias("vec_id"), "vector")
    return cut_lineage(placed.groupBy("shard").applyInArrow(run, "shard int, ids array<long>, vectors binary, keys binary, order binary")), (centre, turns)


def search(index: DataFrame, fitted: tuple[np.ndarray, np.ndarray], queries: DataFrame, k: int = 10, trees: int = TREES,
           share: float = SHARE, least: int = LEAST, block: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest found, itself left out, nearest first, ties to the smaller vec_id.

    `queries` has vec_id and vector as `usable` gives them. score is the Euclidean distance of the
    vectors as given, in double precision. No rows on either side give none.
    """
    centre, turns = fitted
    dim = len(centre)
    blocks = max(1, -(-queries.count() // block))
    # tasks are parts of the index by parts of the blocks: as many of these as give every core two tasks, and none of more than TASK_BLOCKS
    parts = max(-(-blocks // TASK_BLOCKS), min(blocks, -(-2 * queries.sparkSession.sparkContext.defaultParallelism // max(1, index.rdd.getNumPartitions()))))
    asked = queries.groupBy(F.pmod(F.xxhash64(F.lit(4), "vec_id"), F.lit(blocks)).alias("block")).agg(
        F.collect_list(F.struct(F.col("vec_id").cast("long").alias("vec_id"), "vector")).alias("asked")).select("asked").coalesce(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {}  # of each query the nearest of the shards met so far in this task
        for batch in batches:
            for row in range(batch.num_rows):
                ids, data, keys, order = (batch.column(c)[row] for c in range(4))
                ids = ids.values.to_numpy()
                x = np.frombuffer(data.as_buffer(), np.float64).reshape(len(ids), dim)
                keys = np.frombuffer(keys.as_buffer(), np.uint32).reshape(trees, -1)
                order = np.frombuffer(order.as_buffer(), np.int32).reshape(trees, -1)
                own = batch.column(4)[row].values
                who = own.field("vec_id").to_numpy()
                q = own.field("vector").flatten().to_numpy().reshape(len(who), dim)
                for a in range(0, len(who), 64):
                    found = gather(keys, order, strings(q[a:a + 64], centre, turns, trees), max(least * k, int(share * len(ids))), k)
                    for i, rows in enumerate(found, a):
                        rows = rows[ids[rows] != who[i]]
                        near, score = ids[rows], np.sqrt(((x[rows] - q[i]) ** 2).sum(axis=1))
                        if who[i] in best:
                            near, score = np.concatenate([best[who[i]][0], near]), np.concatenate([best[who[i]][1], score])
                        first = np.lexsort((near, score))[:k]
                        best[who[i]] = near[first], score[first]
        for some in batched(best.items(), block):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat([w for w, _ in some], [len(near) for _, (near, _) in some])),
                                              *(pa.array(np.concatenate([found[c] for _, found in some])) for c in (0, 1))], ["query_id", "vec_id", "score"])

    # every pair of a shard and a block, from where the two lie: no copies of either are dealt out, and neither is sent through the driver
    near = index.select("ids", "vectors", "keys", "order").hint("shuffle_replicate_nl").crossJoin(asked).mapInArrow(run, "query_id long, vec_id long, score double")
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).where(
        F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, column: str, is_query, k: int = 10, **how) -> DataFrame:
    """The k nearest of every usable row for the usable rows for which `is_query` holds."""
    rows = cut_lineage(usable(vectors, column))
    index, fitted = build(rows, how.get("trees", TREES), how.get("shard_rows", SHARD_ROWS))
    return search(index, fitted, rows.where(is_query), k, how.get("trees", TREES))
