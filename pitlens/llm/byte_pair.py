"""Byte-level BPE encoding and decoding over overlapping chunks.

Chunks of a long text are pre-tokenised apart, each running on into the next. A match of the
pattern depends only on the text from its start on, so where two neighbours both begin a
pre-token they agree from there; the stitch hands over at the first such place and keeps
each pre-token once. Pre-tokens are then merged by rank, each distinct one once per task.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from pitlens.llm.chunking import CHUNK_CHARS, long_chunks, short_texts

OVERLAP_CHARS = 1_024
#: No match of the pattern looks further ahead than its own end and this many characters.
LOOK_AHEAD = 3
KNOWN_PIECES = 500_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the lowest rank among neighbours merges first, the leftmost of equals."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, k, k + 2) for k in range(n - 1) if (r := ranks.get(piece[k:k + 2])) is not None]
    heapify(heap)
    while heap:
        _, k, to = heappop(heap)
        other = after[k]
        if end[k] < 0 or other >= n or end[other] != to or end[k] != other:
            continue
        end[k], end[other], after[k] = to, -1, after[other]
        if after[k] < n:
            before[after[k]] = k
            if (r := ranks.get(piece[k:end[after[k]]])) is not None:
                heappush(heap, (r, k, end[after[k]]))
        if (p := before[k]) >= 0 and (r := ranks.get(piece[p:to])) is not None:
            heappush(heap, (r, p, to))
    out, k = [], 0
    while k < n:
        out.append(ranks[piece[k:end[k]]])
        k = after[k]
    return out


class Encoder:
    """Pre-tokens to packed little-endian 32-bit ids; remembers a bounded number of pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split, self.known = ranks, regex.compile(pattern), {}
        self.token = {i: b for b, i in ranks.items()}

    def bytes(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def ids(self, piece: str) -> bytes:
        got = self.known.get(piece)
        if got is None:
            got = np.array(merge(piece.encode("utf-8", "replace"), self.ranks), "<u4").tobytes()
            if len(piece) <= 64 and len(self.known) < KNOWN_PIECES:
                self.known[piece] = got
        return got

    def text(self, text: str) -> bytes:
        known, ids = self.known, self.ids
        return b"".join([known.get(p) or ids(p) for p in self.split.findall(text)])

    def chunk(self, text: str, start: int, last: bool) -> list[int]:
        """Ends of the pre-tokens that what follows the chunk cannot change."""
        ends = [m.end() for m in self.split.finditer(text)]
        return [start + e for e in ends if last or e <= len(text) - LOOK_AHEAD]


@lru_cache(maxsize=2)
def encoder(packed: bytes, pattern: str) -> Encoder:
    lines = packed.split(b"\n")
    return Encoder({base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x)}, pattern)


def stitch(starts: list[int], slices: list[str], ends: list[list[int]], split: Callable[[str, int, bool], list[int]]) -> list[int]:
    """Ends of the whole text's pre-tokens from those of its overlapping chunks.

    Where a chunk never resynchronises with what is known (a pre-token longer than the
    overlap), the text from the last sure boundary on is split again, and no more than that.
    """
    out, at, size = [], 0, starts[1] - starts[0] if len(starts) > 1 else 0
    for c, (start, own) in enumerate(zip(starts, ends)):
        bounds = [start, *own]
        if c and at > start and at in set(bounds):
            sure = own[bounds.index(at):]
        elif c == 0 or at == start:
            sure = own
        else:
            first = max(0, at // size)
            text = "".join(s[:size] for s in slices[first:c]) + slices[c]
            sure = split(text[at - starts[first]:], at, c == len(starts) - 1)
        here = set(ends[c + 1]) | {starts[c + 1]} if c + 1 < len(starts) else set()
        for e in sure:
            out.append(e)
            at = e
            if here and e >= starts[c + 1] and e in here:
                break
    return out


def encode(docs: DataFrame, ranks_path: str, pattern: str, chunk_chars: int = CHUNK_CHARS,
           overlap_chars: int = OVERLAP_CHARS, decoded: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids: a row per row of `docs`; ids packed as little-endian unsigned 32-bit.

    With `decoded` also what the ids stand for, read back from them in the same task.

    Null and empty texts have no tokens; repeated rows and ids give a row each; columns other
    than doc_id and text are not read. The rank file, of fixed size, goes to the tasks with the code.
    """
    with open(ranks_path, "rb") as file:
        packed = file.read()
    kind = docs.schema["doc_id"].dataType.simpleString()
    shape = f"doc_id {kind}, n_tokens long, ids binary" + ", decoded binary" * decoded
    names = ["doc_id", "n_tokens", "ids", *["decoded"] * decoded]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(packed, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [own.text(t) for t in part.column(1).to_pylist()]
                back = [pa.array([own.bytes(i) for i in ids], pa.binary())] if decoded else []
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary()), *back], names)

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(packed, pattern)
        for batch in batches:
            ends = [own.chunk(t, s, p + 1 == n) for p, n, s, t in zip(*(batch.column(k).to_pylist() for k in range(2, 6)))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ends, pa.list_(pa.int64()))], [*batch.schema.names, "ends"])

    def join(group: pd.DataFrame) -> pd.DataFrame:
        own = encoder(packed, pattern)
        group = group.sort_values("part")
        starts, slices = group["start"].tolist(), group["text"].tolist()
        ends = stitch(starts, slices, [list(e) for e in group["ends"]], own.chunk)
        text = "".join(s[:starts[1]] for s in slices)
        ids = b"".join([own.ids(text[a:b]) for a, b in zip([0, *ends], ends)])
        return pd.DataFrame({"doc_id": group["doc_id"].iloc[:1], "n_tokens": [len(ids) // 4], "ids": [ids]} | ({"decoded": [own.bytes(ids)]} if decoded else {}))

    chunks = long_chunks(docs, chunk_chars, overlap_chars)
    cut = chunks.mapInArrow(bounds, f"row long, doc_id {kind}, part int, parts int, start long, text string, ends array<long>")
    return short_texts(docs, chunk_chars).mapInArrow(whole, shape).unionByName(cut.groupBy("row").applyInPandas(join, shape))


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """`encoded` with `decoded`, the raw bytes its ids stand for; null ids give null."""
    vocabulary = {i: b for b, i in read_ranks(ranks_path).items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = vocabulary.__getitem__
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [None if i is None else b"".join(map(get, np.frombuffer(i, "<u4").tolist()))
                         for i in part.column(part.schema.get_field_index("ids")).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary())], [*part.schema.names, "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(run, fields + ", decoded binary")


def encode_and_decode(docs: DataFrame, ranks_path: str, pattern: str, **sizes: int) -> DataFrame:
    """doc_id, n_tokens, ids, decoded: encoded and read back in one pass, so a task needs one Python worker."""
    return encode(docs, ranks_path, pattern, decoded=True, **sizes)
