"""Document fingerprints by one-permutation MinHash.

Every shingle is hashed once; the top bits name its bin and the bin keeps its least hash.
An empty bin takes the value of the first filled one in a fixed random order of its own
(optimal densification), so every bin agrees with the probability of the Jaccard
similarity. Of each value a few low bits are stored; the matches that chance gives are
taken off again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitlens.llm.chunking import bound_batches
from pitlens.llm.words import slices, words

SHINGLE_WORDS, BINS, BITS = 5, 256, 8
_EMPTY = np.uint64(2**64 - 1)


@lru_cache(maxsize=4)
def _probes(bins: int) -> np.ndarray:
    rng = np.random.default_rng(bins)
    return np.stack([rng.permutation(bins) for _ in range(bins)])


def densify(table: np.ndarray) -> np.ndarray:
    """Fills the empty bins of every row that has a filled one."""
    bins, filled = table.shape[1], table != _EMPTY
    row, at = np.nonzero(~filled & filled.any(axis=1)[:, None])
    out, probes = table.copy(), _probes(bins)
    for attempt in range(bins):
        if not len(row):
            break
        other = probes[at, attempt]
        hit = filled[row, other]
        out[row[hit], at[hit]] = table[row[hit], other[hit]]
        row, at = row[~hit], at[~hit]
    return out


def signatures(texts: pa.Array, width: int = SHINGLE_WORDS, bins: int = BINS, bits: int = BITS) -> list[bytes]:
    """Packed fingerprint of each text; empty bytes for a text without words."""
    out: list[bytes] = []
    shift = np.uint64(64 - int(bins).bit_length() + 1)
    for _, _, data, offsets in slices(texts):
        hashed, first = words(data, offsets).shingles(width)
        n = np.diff(first)
        table = np.full(len(n) * bins, _EMPTY)
        np.minimum.at(table, np.repeat(np.arange(len(n)), n) * bins + (hashed >> shift).astype(np.int64), hashed)
        table = densify(table.reshape(len(n), bins))
        if bits == 8:
            packed = table.astype(np.uint8)
        else:
            low = (table[:, :, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
            packed = np.packbits(low.astype(np.uint8).reshape(len(n), -1), axis=1)
        out += [p.tobytes() if k else b"" for p, k in zip(packed, n)]
    return out


def likeness(a: bytes, b: bytes, bins: int = BINS, bits: int = BITS) -> float:
    """Estimated Jaccard similarity, 0 to 1; two texts without words are alike, one alone is not."""
    if not a or not b:
        return float(a == b)
    x, y = (np.frombuffer(v, np.uint8) for v in (a, b))
    if bits != 8:
        x, y = (np.packbits(np.unpackbits(v)[:bins * bits].reshape(bins, bits), axis=1) for v in (x, y))
    same = (x == y).reshape(bins, -1).all(axis=1).mean()
    chance = 0.5**bits
    return float(min(1.0, max(0.0, (same - chance) / (1 - chance))))


def fingerprint(docs: DataFrame, width: int = SHINGLE_WORDS, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """doc_id, fingerprint (hexadecimal): a row per row of `docs`; null text counts as empty, whose fingerprint is ''."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.hex() for s in signatures(batch.column(1), width, bins, bits)], pa.string())],
                                             ["doc_id", "fingerprint"])

    return bound_batches(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fingerprint string")


def beside_next(docs: DataFrame, shape: str, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """`run` over sorted partitions of rows (range, doc_id, text, extra) in which every row is followed by the next.

    Order: doc_id descending, null ids last, then text; after the last row comes the first. Rows are
    dealt into ranges of doc_id, as many as there are shuffle partitions; each range ends with a copy
    (`extra`) of the rows that can follow its last. Texts move once; the driver sees two ids a range.
    """
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = bound_batches(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-2**63)).alias("id"))
    cuts = keyed.select(F.percentile_approx("id", [k / ranges for k in range(1, ranges)] or [0.0], 10_000)).first()[0] or []
    cuts = np.unique(np.array(cuts, np.int64))

    @F.pandas_udf("int")
    def place(ids: pd.Series) -> pd.Series:
        return pd.Series((len(cuts) - np.searchsorted(cuts, ids.to_numpy(), side="left")).astype(np.int32))

    own = keyed.withColumn("range", place("id"))
    tops = sorted((r[0], r[1]) for r in own.groupBy("range").agg(F.max("id")).collect())
    heads = {top: tops[k - 1][0] for k, (_, top) in enumerate(tops)}

    @F.pandas_udf("int")
    def follows(ids: pd.Series) -> pd.Series:
        return ids.map(heads).astype("Int32")

    dealt = own.withColumn("copy", follows("id")).select("doc_id", "text", "id", F.explode(F.filter(F.array(
        F.struct(F.col("range"), F.lit(False).alias("extra")), F.struct(F.col("copy").alias("range"), F.lit(True).alias("extra"))),
        lambda c: c["range"].isNotNull())).alias("to")).select("to.range", "doc_id", "text", "to.extra", "id")
    return dealt.repartitionById(len(cuts) + 1, F.col("range")).sortWithinPartitions(
        "range", "extra", F.desc("id"), "text").drop("id").mapInArrow(run, shape)


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edit, and their likeness to each other and to the next text.

    The edit replaces the last floor(n_chars / 2) code points by the first as many (or all) of the
    next document's, by descending doc_id, nulls last, ties by text; after the last comes the first, and
    a lone document follows itself. doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next: a row per row of `docs`; null text counts as empty; other columns are not read.
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kind = docs.schema["doc_id"].dataType.simpleString()

    def finish(ids: list, texts: list[str], marks: list[bytes], arrow: pa.DataType) -> pa.RecordBatch:
        """Rows for all but the last text, which only follows."""
        edited = [t[:len(t) - len(t) // 2] + n[:len(t) // 2] for t, n in zip(texts, texts[1:])]
        after = signatures(pa.array(edited, pa.string()))
        return pa.RecordBatch.from_arrays([
            pa.array(ids[:len(edited)], arrow), pa.array([len(t) for t in texts[:-1]], pa.int64()),
            pa.array([sha256(e.encode()).hexdigest() for e in edited], pa.string()), pa.array([m.hex() for m in marks[:-1]], pa.string()),
            pa.array([m.hex() for m in after], pa.string()), pa.array([likeness(a, b) for a, b in zip(marks, after)], pa.float64()),
            pa.array([likeness(a, b) for a, b in zip(marks, marks[1:])], pa.float64())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (range, doc_id, text, fingerprint) of the row whose next has not come
        done = None  # the range whose copy has been used; further copies are ties
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ranges, ids, extra = (part.column(k).to_pylist() for k in (0, 1, 3))
                texts, marks = part.column(2).to_pylist(), signatures(part.column(2))
                run_ids, run_texts, run_marks = [], [], []
                if held:
                    run_ids, run_texts, run_marks = [[x] for x in held[1:]]
                    now = held[0]
                else:
                    now = None
                for k, r in enumerate(ranges):
                    if r == done:
                        continue
                    if now != r:
                        now, run_ids, run_texts, run_marks = r, [], [], []
                    run_ids.append(ids[k])
                    run_texts.append(texts[k])
                    run_marks.append(marks[k])
                    if extra[k]:
                        yield finish(run_ids, run_texts, run_marks, part.schema.field(1).type)
                        done, now, run_ids, run_texts, run_marks = r, None, [], [], []
                if len(run_texts) > 1:
                    yield finish(run_ids, run_texts, run_marks, part.schema.field(1).type)
                held = (now, run_ids[-1], run_texts[-1], run_marks[-1]) if run_texts else None

    return beside_next(docs, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
                             "near_edited double, near_next double", run)
