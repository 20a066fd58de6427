"""Near-duplicate groups by MinHash with tensored banding.

Two small collections of half-keys (a few minimum hashes each) are computed per text, and every
pair of a left and a right half-key is the key of one table: m half-keys a side make m * m
tables for 2 * m half-keys' worth of hashing. A half-key that no other text has can be in no
shared table, so pairs are formed of shared half-keys alone. Texts that meet in a table are
compared on their full shingle sets, and the links so found are closed into components.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pitlens.llm.chunking import bound_batches, unused
from pitlens.llm.words import mix, slices, words
from pitlens.session import cut_lineage

HALF_ROWS = 3
#: A linked pair at the threshold itself shares no table with less than twice this probability.
MISS = 1e-5
#: Shingles of one side of a comparison; larger groups are compared block by block.
BLOCK_SHINGLES = 2_000_000
_LAST = 2**63 - 1


def halves(threshold: float, rows: int = HALF_ROWS) -> int:
    """Half-keys a side, so that each side has one in common but for MISS."""
    return ceil(log(MISS) / log(1 - threshold**rows))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingles, A-Z as a-z, and where they begin."""
    hashed, first = words(data, offsets, lower=True).shingles(width)
    for a, b in zip(first, first[1:]):
        hashed[a:b].sort()
    fresh = np.ones(len(hashed), bool)
    fresh[1:] = hashed[1:] != hashed[:-1]
    fresh[first[:-1][first[:-1] < len(hashed)]] = True
    return hashed[fresh], np.concatenate([[0], np.cumsum(fresh)])[first]


def half_keys(sets: np.ndarray, first: np.ndarray, m: int, rows: int) -> np.ndarray:
    """2 * m half-keys of each text that has shingles; zero rows for the others."""
    n = np.diff(first)
    has, begin = np.flatnonzero(n), first[:-1][n > 0]
    out = np.zeros((len(n), 2 * m), np.uint64)
    if len(has):
        factors = np.random.default_rng(1_009).integers(0, 2**63, (2 * m, rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for k in range(2 * m):
            key = np.full(len(has), k, np.uint64)
            for factor in factors[k]:
                key = mix(key ^ np.minimum.reduceat(sets * factor, begin))
            out[has, k] = key
    return out


def signatures(docs: DataFrame, width: int, m: int, rows: int) -> DataFrame:
    """doc_id, id, mark, n, s1, s2, keys: two sums stand for the set, half-keys for its tables."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, data, offsets in slices(batch.column(3)):
                sets, first = shingle_sets(data, offsets, width)
                sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(sets * np.uint64(a)), dtype=np.uint64)])[first] for a in (3, 5)]
                keys = half_keys(sets, first, m, rows)
                part = batch.slice(at, to - at)
                yield pa.RecordBatch.from_arrays([
                    *part.columns[:3], pa.array(np.diff(first)), *(pa.array(np.diff(s).view(np.int64)) for s in sums),
                    pa.FixedSizeListArray.from_arrays(pa.array(keys.view(np.int64).reshape(-1)), 2 * m).cast(pa.list_(pa.int64()))],
                    ["doc_id", "id", "mark", "n", "s1", "s2", "keys"])

    return bound_batches(docs).select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("id"), F.xxhash64("text").alias("mark"), "text").mapInArrow(
        run, f"doc_id {kind}, id long, mark long, n long, s1 long, s2 long, keys array<long>")


def meetings(classes: DataFrame, m: int) -> DataFrame:
    """hub, cid: every class with the least class of each table that it shares; two that share a table share a hub."""
    half = classes.select("cid", F.posexplode("keys").alias("slot", "key"))
    shared = half.groupBy("key").agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    own = half.join(shared, "key").groupBy("cid").agg(
        F.collect_list(F.when(F.col("slot") < m, F.col("key"))).alias("left"), F.collect_list(F.when(F.col("slot") >= m, F.col("key"))).alias("right"))
    tables = own.select("cid", "right", F.explode("left").alias("l")).select("cid", "l", F.explode("right").alias("r")).select(
        "cid", F.xxhash64("l", "r").alias("table"))
    hubs = tables.groupBy("table").agg(F.min("cid").alias("hub"), F.max("cid").alias("_most")).where("hub < _most").drop("_most")
    return tables.join(hubs, "table").groupBy("hub", "cid").agg(F.lit(1).alias("_one")).select("hub", "cid")


def links_in(width: int, inner: int, outer: int):
    """Links of one cell: texts of a hub's group, or of two blocks of it. Joins the hub first, then searches what it left out."""
    def run(table: pa.Table) -> pa.Table:
        cid = table.column("cid").to_numpy()
        lead = np.flatnonzero(table.column("hub").to_numpy() == cid)
        sets = []
        for _, _, data, offsets in slices(table.column("text")):
            found, first = shingle_sets(data, offsets, width)
            sets += [found[a:b] for a, b in zip(first, first[1:])]
        size = np.array([len(s) for s in sets])
        whole, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
        order = np.argsort(whole, kind="stable")
        whole, owner = whole[order], owner[order]
        parent = np.arange(len(sets))

        def root(k: int) -> int:
            while parent[k] != k:
                parent[k] = parent[parent[k]]
                k = parent[k]
            return k

        out: list[tuple[int, int]] = []
        for u in [*lead, *(k for k in range(len(sets)) if k not in set(lead))]:
            if out and root(u) == root(int(lead[0])) and u not in lead:
                continue
            a, b = np.searchsorted(whole, sets[u], "left"), np.searchsorted(whole, sets[u], "right")
            n = b - a
            at = np.arange(n.sum()) + np.repeat(a - (np.cumsum(n) - n), n)
            common = np.bincount(owner[at], minlength=len(sets))
            for v in np.flatnonzero(outer * common >= inner * (size + size[u] - common)):
                x, y = root(u), root(int(v))
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    out.append((int(cid[u]), int(cid[v])))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return run


def components(edges: DataFrame) -> DataFrame:
    """node, label: the least node of each component, by large and small stars in turn until nothing moves.

    A node with very many neighbours is reduced before the shuffle and joined as a skewed key.
    """
    def star(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else pairs.select(
            F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
        moved = both.join(least, "a")
        far = moved.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")) if large else moved.select(
            F.col("b").alias("a"), F.col("least").alias("b")).unionByName(least.select("a", F.col("least").alias("b")))
        return far.where("a <> b").distinct()

    now, before = cut_lineage(edges.where("a <> b").distinct()), None
    while True:
        now = cut_lineage(star(star(now, True), False))
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
        before = state


def grouped(docs: DataFrame, width: int, threshold: tuple[int, int], rows: int = HALF_ROWS, block: int = BLOCK_SHINGLES) -> DataFrame:
    """What near_duplicates says, with id (a null doc_id as the last) and mark (a hash of the text)."""
    inner, outer = threshold
    m = halves(inner / outer, rows)
    signed = cut_lineage(signatures(docs, width, m, rows))
    classes = cut_lineage(signed.where("n > 0").groupBy("s1", "s2").agg(
        F.min(F.struct("id", "mark")).alias("_root"), F.first("n").alias("n"), F.first("keys").alias("keys"))).select(
        F.monotonically_increasing_id().alias("cid"), "s1", "s2", "n", "keys", F.col("_root.id").alias("root"), F.col("_root.mark").alias("mark"))
    met = cut_lineage(meetings(classes, m))
    sized = met.join(classes.select("cid", "n"), "cid")
    blocks = sized.groupBy("hub").agg(F.ceil(F.sum("n") / block).cast("int").alias("blocks"))
    placed = sized.join(blocks, "hub").withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    with_hub = F.when(F.col("hub") == F.col("cid"), F.expr(
        "flatten(transform(sequence(0, blocks - 1), i -> transform(sequence(i, blocks - 1), j -> struct(i, j))))")).otherwise(
        F.expr("transform(sequence(0, blocks - 1), k -> struct(least(own, k) as i, greatest(own, k) as j))"))
    cells = placed.select("hub", "cid", F.explode(with_hub).alias("cell")).select("hub", "cid", F.col("cell.i").alias("i"), F.col("cell.j").alias("j"))
    wanted = met.select("cid").distinct().join(classes.select("cid", "root", "mark"), "cid")
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("root"), F.xxhash64("text").alias("mark"), "text").join(
        wanted.hint("shuffle_hash"), ["root", "mark"]).groupBy("cid").agg(F.min("text").alias("text"))
    edges = cells.join(texts, "cid").groupBy("hub", "i", "j").applyInArrow(links_in(width, inner, outer), "a long, b long")
    labels = components(edges)
    named = classes.join(labels, F.col("cid") == F.col("node"), "left").select("s1", "s2", "root", F.coalesce("label", "cid").alias("label"))
    least = named.groupBy("label").agg(F.min("root").alias("component"))
    whose = named.join(least, "label").select("s1", "s2", "component")
    out = signed.select("doc_id", "id", "mark", "n", "s1", "s2").join(whose, ["s1", "s2"], "left").withColumn(
        "component", F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")))
    alike = Window.partitionBy("s1", "s2", "id").orderBy("mark")
    return out.withColumn("kept", F.col("id") == F.col("component")).withColumn(
        "first", F.col("kept") & ((F.col("n") == 0) | (F.row_number().over(alike) == 1))).select(
        "doc_id", "id", "mark", F.col("n").alias("n_shingles"), F.when(F.col("component") < _LAST, F.col("component")).alias("component_id"), "kept", "first")


def near_duplicates(docs: DataFrame, width: int = 5, threshold: tuple[int, int] = (80, 100), rows: int = HALF_ROWS,
                    block: int = BLOCK_SHINGLES) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, first: a row per row of `docs`.

    Linked: texts whose shingle sets (of `width` words, A-Z as a-z) meet `threshold`, as a fraction
    of their union. component_id is the least doc_id reachable, kept whether that is the row's own,
    and `first` marks one row of each component (of rows alike in doc_id and set). Texts without
    words, null included, are linked with nothing. Null ids come last; a component of nothing
    else has a null id. Equal sets are one class from the start, and only classes are compared, so a
    group of copies costs its size. Columns other than doc_id and text are not read; no rows give none.
    """
    return grouped(docs, width, threshold, rows, block).drop("id", "mark")


def deduplicate(docs: DataFrame, width: int = 5, threshold: tuple[int, int] = (80, 100)) -> DataFrame:
    """The first document of each near-duplicate group, columns as given.

    Rows alike in doc_id and text are one document; of those the least in its other columns stays.
    Different ids without words all stay.
    """
    id_, mark, at = (unused(docs.columns, c) for c in ("_stay_id", "_stay_mark", "_stay_at"))
    names = [F.col(f"`{c}`") for c in docs.columns]
    stay = grouped(docs, width, threshold).where("first").select(F.col("id").alias(id_), F.col("mark").alias(mark)).distinct()
    keyed = docs.withColumn(id_, F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))).withColumn(mark, F.xxhash64("text"))
    own = Window.partitionBy(id_, mark).orderBy(F.xxhash64(*names))
    return keyed.join(stay, [id_, mark], "left_semi").withColumn(at, F.row_number().over(own)).where(F.col(at) == 1).select(*names)
