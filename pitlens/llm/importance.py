"""Importance resampling towards a target by bit-sliced aggregation.

A text's features are its runs of one to three words, hashed into BUCKETS. A bucket's gain is the
log ratio of its smoothed shares in the target and in the corpus, in whole thousandths. A
document's bucket counts become bit planes: plane j holds bit j of all counts, BUCKETS bits side by
side. The gains become bit planes too, in two's complement. The bits set in both of a count plane and a
gain plane, counted and scaled by the planes' powers of two, add up to the document's weight; a
Gumbel term of its id turns weights into a draw without replacement, the same in every run.

Texts are lower-cased in A-Z; a word is a run of bytes that are 0-9, a-z or above 127. Null and
empty texts have no features and weigh nothing. A null doc_id is hashed as an empty string. Rows
alike are drawn each by itself. Without documents there are no rows; without a target its counts
are all nought.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitlens.llm.chunking import bound_batches
from pitlens.llm.mixing import numbered
from pitlens.llm.words import LOWER, slices
from pitlens.session import cut_lineage

BUCKETS, LONGEST, SCALE = 10_000, 3, 1_000.0
LEAST_WORDS, PERCENT, SEED = 20, 5, 42
#: Documents whose counts are held at once, BUCKETS numbers each, and first words whose runs are.
GROUP_ROWS, BLOCK_WORDS = 128, 500_000
_LANES = -(-BUCKETS // 64)
_INSIDE = np.zeros(256, bool)
_INSIDE[np.r_[48:58, 97:123, 128:256]] = True


def _crc_table() -> np.ndarray:
    """The remainders of single bytes under the reflected polynomial of CRC-32."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> np.uint32(1)) ^ (np.uint32(0xEDB88320) * (table & np.uint32(1)))
    return table


_CRC = _crc_table()


def extend(state: np.ndarray, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC states after the bytes `start:start + length` of `data`, all rows a byte at a time."""
    order = np.argsort(-length, kind="stable")
    out, start, left = state[order], start[order], -length[order]
    for k in range(int(-left[0]) if len(left) else 0):
        m = int(np.searchsorted(left, -k))
        out[:m] = _CRC[(out[:m] ^ data[start[:m] + k]) & np.uint32(255)] ^ (out[:m] >> np.uint32(8))
    back = np.empty_like(out)
    back[order] = out
    return back


def runs_hashed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]:
    """How many words each text has, and (text, bucket) of its runs of words, a block of first words at a time."""
    data = LOWER[data]
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = _INSIDE[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside[:-1]
    before[offsets] = False
    start = np.flatnonzero(inside & ~before)
    after = np.r_[inside[1:], False]
    after[offsets[1:] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    first = np.searchsorted(start, offsets)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))

    def blocks() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for at in range(0, len(start), BLOCK_WORDS):
            head = np.arange(at, min(at + BLOCK_WORDS, len(start)))
            state = np.full(len(head), 0xFFFFFFFF, np.uint32)
            for k in range(LONGEST):
                if k:
                    stays = head + k < len(start)
                    stays[stays] = text[head[stays] + k] == text[head[stays]]
                    head, state = head[stays], state[stays]
                    state = _CRC[(state ^ np.uint32(32)) & np.uint32(255)] ^ (state >> np.uint32(8))
                state = extend(state, data, start[head + k], end[head + k] - start[head + k])
                yield text[head], ((state ^ np.uint32(0xFFFFFFFF)) % np.uint32(BUCKETS)).astype(np.int64)

    return np.diff(first), blocks()


def counted(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(words, counts) of a few texts at a time: counts has a row a text and a column a bucket."""
    for _, _, data, offsets in slices(texts, rows=GROUP_ROWS):
        n = len(offsets) - 1
        words, blocks = runs_hashed(data, offsets)
        counts = np.zeros(n * BUCKETS, np.int64)
        for text, bucket in blocks:
            counts += np.bincount(text * BUCKETS + bucket, minlength=n * BUCKETS)
        yield words, counts.reshape(n, BUCKETS)


def bucket_counts(docs: DataFrame) -> np.ndarray:
    """Features of all of `docs` in each bucket; tasks add theirs up before anything moves, BUCKETS numbers reach the driver."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, counts in counted(batch.column(0)):
                total += counts.sum(axis=0)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for bucket, n in bound_batches(docs).select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(target: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """Whole thousandths of the log ratio of each bucket's smoothed shares in target and corpus, rounded down."""
    t, s = target.astype(float), corpus.astype(float)
    ratio = ((t + 1) * (s.sum() + BUCKETS)) / ((s + 1) * (t.sum() + BUCKETS))
    return np.floor(SCALE * np.log(ratio)).astype(np.int64)


def planes(values: np.ndarray, bits: int) -> np.ndarray:
    """Bit j of every value of a row side by side, for j below `bits`: shape (bits, rows, lanes of 64)."""
    padded = np.zeros((bits, len(values), _LANES * 8), np.uint8)
    for j in range(bits):
        packed = np.packbits(((values >> j) & 1).astype(bool), axis=1)
        padded[j, :, :packed.shape[1]] = packed
    return padded.view(np.uint64)


def signed_planes(gain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two's complement planes of the gains, and what a bit of each is worth; the last is the sign's."""
    bits = int(np.abs(gain).max(initial=1)).bit_length()
    worth = np.array([1 << k for k in range(bits)] + [-(1 << bits)], np.int64)
    return planes((gain & ((1 << (bits + 1)) - 1))[None, :], bits + 1)[:, 0], worth


def weights(counts: np.ndarray, gain_planes: np.ndarray, worth: np.ndarray) -> np.ndarray:
    """Sum of count times gain of each row, from the bits that count planes and gain planes share."""
    out = np.zeros(len(counts), np.int64)
    for j, plane in enumerate(planes(counts, int(counts.max(initial=0)).bit_length())):
        rows = np.flatnonzero(plane.any(axis=1))
        shared = np.bitwise_count(plane[rows, None, :] & gain_planes[None, :, :]).sum(axis=2, dtype=np.int64)
        out[rows] += (shared @ worth) << j
    return out


def weigh(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight of every row of `docs`; nothing but doc_id and text is read."""
    gain_planes, worth = signed_planes(gain)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(words, counts.sum(axis=1), weights(counts, gain_planes, worth)) for words, counts in counted(batch.column(1))]
            columns = [np.concatenate([np.zeros(0, np.int64), *part]) for part in zip(*got)] if got else [np.zeros(0, np.int64)] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns)], ["doc_id", "n_words", "n_features", "weight"])

    return bound_batches(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every document, weighed towards the texts of `target`.

    Of the documents with at least `least_words` words, `percent` in a hundred (rounded down) are drawn: the
    highest scores, ties to smaller doc_ids; rank counts them from 1 and is null for all others.
    """
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-SCALE * F.log(-F.log((h + 0.5) / float(2**32))))
    scored = cut_lineage(weigh(docs, gains(bucket_counts(target), bucket_counts(docs))).withColumn("score", F.col("weight") + noise))
    long_enough = F.col("n_words") >= least_words
    drawn = scored.where(long_enough).count() * percent // 100
    placed = numbered(scored, F.struct((~long_enough).alias("short"), (-F.col("score")).alias("down"), F.col("doc_id").alias("id")), "_place")
    return placed.select(*scored.columns, F.when(F.col("_place") < drawn, F.col("_place") + 1).alias("rank"))
