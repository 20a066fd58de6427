"""Substring deduplication by windows of words, grouped by prefix.

A text's windows begin at its words. Two rounds keep the groups small. First only sparse
suffixes are looked at: each window of words has an anchor, its run of ANCHOR words with
the least hash, so equal windows have equal anchors. An anchor met once in the corpus holds
no repeat. Then the windows whose anchor is shared are split by prefix into groups of bounded
size: by the first word, or by a longer prefix where many windows begin with that word. A group
is sorted by the hashes of its windows, and equal ones are repeats; words are not compared
and no tree is built (see the README). Within a task, equal windows are reduced before
they move, so a passage found in very many documents sends a few rows a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitlens.llm.chunking import bound_batches, unused
from pitlens.llm.words import PLACE, Words, mix, slices, words

WINDOW, ANCHOR = 20, 8
#: Suffixes a task holds before it sends them on, and in a group.
FLUSH_SUFFIXES, GROUP_SUFFIXES = 1_000_000, 2_000_000
_CODE_BITS = 12
#: From a task's first group for what is known to the next task's; a prime, so that tasks take groups in turn.
_STRIDE = 2_654_435_761
_ROWS = "target int, kind int, hash array<long>, doc array<int>, pos array<int>, ids array<long>, marks array<long>"


def windows(w: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Text and first word (counted in the slice) of every window."""
    n = np.maximum(w.count - width + 1, 0)
    doc = np.repeat(np.arange(len(n)), n)
    return doc, np.arange(n.sum()) + np.repeat(w.first[:-1] - (np.cumsum(n) - n), n)


def runs(w: Words, at: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the `width` words from each of `at` on."""
    out = np.zeros(len(at), np.uint64)
    for k in range(width):
        out += w.hash[at + k] * PLACE[k]
    return mix(out)


def anchors(w: Words, at: np.ndarray, width: int, anchor: int) -> np.ndarray:
    """First word of the anchor of each window: the leftmost run of `anchor` words with the least hash."""
    if not len(at):
        return at
    run = runs(w, np.arange(len(w.hash) - anchor + 1), anchor)
    best, offset = run[at], np.zeros(len(at), np.int64)
    for k in range(1, width - anchor + 1):
        other = run[at + k]
        less = other < best
        best[less], offset[less] = other[less], k
    return at + offset


class Outbox:
    """Gathers (hash, row, position) of several texts and sends them by target, equal hashes reduced."""

    def __init__(self, groups: int, first_only: bool):
        task = TaskContext.get()
        self.groups, self.first_only, self.sent = groups, first_only, task.partitionId() * _STRIDE if task else 0
        self.clear()

    def clear(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.ids: list[np.ndarray] = []
        self.marks: list[np.ndarray] = []
        self.rows = self.held = 0

    def add(self, hashed: np.ndarray, row: np.ndarray, pos: np.ndarray, target: np.ndarray, ids: np.ndarray, marks: np.ndarray) -> None:
        self.parts.append((hashed, row + self.rows, pos, target))
        self.ids.append(ids)
        self.marks.append(marks)
        self.rows += len(ids)
        self.held += len(hashed)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            self.clear()
            return
        hashed, row, pos, target = (np.concatenate(p) for p in zip(*self.parts))
        ids, marks = np.concatenate(self.ids), np.concatenate(self.marks)
        order = np.lexsort((pos, ids[row], hashed))
        hashed, row, pos, target = hashed[order], row[order], pos[order], target[order]
        begins = np.r_[True, hashed[1:] != hashed[:-1]]
        head = np.flatnonzero(begins)[np.cumsum(begins) - 1]
        if self.first_only:  # what is not first here is not first at all
            known = (ids[row] != ids[row[head]]) | (pos != pos[head])
            kind = np.where(known, 1, 0)
        else:  # what is met twice here is shared
            known = np.diff(np.r_[np.flatnonzero(begins), len(hashed)])[np.cumsum(begins) - 1] > 1
            kind = np.where(begins & known, 2, np.where(known, 1, 0))
            again = np.flatnonzero(begins & known)
            hashed, row, pos, target = (np.r_[x, x[again]] for x in (hashed, row, pos, target))
            kind = np.r_[kind, np.ones(len(again), kind.dtype)]
        target = np.where(kind == 1, self.sent % self.groups, target)
        self.sent += 1
        key = target * 3 + kind
        order = np.argsort(key, kind="stable")
        cuts = np.flatnonzero(np.r_[True, np.diff(key[order]) > 0, True])
        for a, b in zip(cuts, cuts[1:]):
            at = order[a:b]
            docs, own = np.unique(row[at], return_inverse=True)
            yield pa.RecordBatch.from_arrays([
                pa.array([target[at[0]]], pa.int32()), pa.array([kind[at[0]]], pa.int32()),
                pa.array([hashed[at].view(np.int64) if kind[at[0]] != 1 else np.zeros(0, np.int64)], pa.list_(pa.int64())),
                pa.array([own.astype(np.int32)], pa.list_(pa.int32())), pa.array([pos[at].astype(np.int32)], pa.list_(pa.int32())),
                pa.array([ids[docs]], pa.list_(pa.int64())), pa.array([marks[docs]], pa.list_(pa.int64()))],
                ["target", "kind", "hash", "doc", "pos", "ids", "marks"])
        self.clear()


def send(ids: np.ndarray, marks: np.ndarray, pos: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """(part, ids, marks, pos): found positions packed by the partition their documents are gathered in."""
    part = (mix(ids.view(np.uint64) ^ mix(marks.view(np.uint64))) % np.uint64(parts)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.r_[True, np.diff(part[order]) > 0]) if len(part) else np.zeros(0, int)
    for a, b in zip(cuts, np.r_[cuts[1:], len(part)]):
        at = order[a:b]
        yield pa.RecordBatch.from_arrays([pa.array([part[at[0]]]), pa.array([ids[at]], pa.list_(pa.int64())), pa.array([marks[at]], pa.list_(pa.int64())),
                                          pa.array([pos[at].astype(np.int32)], pa.list_(pa.int32()))], ["part", "ids", "marks", "pos"])


def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row (id, mark, positions) for each document of a partition."""
    held = [tuple(batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in (1, 2, 3)) for batch in batches]
    if not held:
        return
    ids, marks, pos = (np.concatenate(p) for p in zip(*held))
    held.clear()
    order = np.lexsort((pos, marks, ids))
    ids, marks, pos = ids[order], marks[order], pos[order]
    cuts = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (marks[1:] != marks[:-1]), True])
    for a in range(0, len(cuts) - 1, 10_000):
        own = cuts[a:a + 10_001]
        yield pa.RecordBatch.from_arrays([
            pa.array(ids[own[:-1]]), pa.array(marks[own[:-1]]),
            pa.ListArray.from_arrays(pa.array((own - own[0]).astype(np.int32)), pa.array(pos[own[0]:own[-1]].astype(np.int32)))], ["id", "mark", "pos"])


def subtree(first_only: bool, parts: int):
    """Repeats of one group: all but the earliest of equal suffixes, or all of equal anchors; and what was known before."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        known: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            columns = [batch.column(k) for k in range(7)]
            for k, kind in enumerate(columns[1].to_pylist()):
                hashed, doc, pos, ids, marks = (c[k].values.to_numpy(zero_copy_only=False) for c in columns[2:])
                if kind == 1:
                    known.append((ids[doc], marks[doc], pos))
                else:
                    held.append((hashed, ids[doc], marks[doc], pos, np.full(len(pos), kind == 2)))
            if sum(len(k[2]) for k in known) >= FLUSH_SUFFIXES:
                yield from send(*(np.concatenate(p) for p in zip(*known)), parts)
                known.clear()
        if held:
            hashed, ids, marks, pos, shared = (np.concatenate(p) for p in zip(*held))
            held.clear()
            order = np.lexsort((pos, ids, hashed)) if first_only else np.argsort(hashed, kind="stable")
            begins = np.r_[True, np.diff(hashed[order]) != 0]
            if first_only:
                head = order[np.flatnonzero(begins)[np.cumsum(begins) - 1]]
                found = order[(ids[order] != ids[head]) | (pos[order] != pos[head])]
            else:
                start = np.flatnonzero(begins)
                many = (np.diff(np.r_[start, len(order)]) > 1) | np.logical_or.reduceat(shared[order], start)
                found = order[many[np.cumsum(begins) - 1] & ~shared[order]]
            known.append((ids[found], marks[found], pos[found]))
        if known:
            yield from send(*(np.concatenate(p) for p in zip(*known)), parts)

    return run


def word_counts(docs: DataFrame, width: int) -> np.ndarray:
    """How many windows begin with a word of each code (the top bits of its hash); tasks count before anything moves."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << _CODE_BITS, np.int64)
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                w = words(data, offsets)
                total += np.bincount((w.hash[windows(w, width)[1]] >> np.uint64(64 - _CODE_BITS)).astype(np.int64), minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["code", "n"])

    rows = docs.select("text").mapInArrow(count, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(1 << _CODE_BITS, np.int64)
    for code, n in rows:
        out[code] = n
    return out


def prefix_groups(counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """First group of each code, how many groups its longer prefixes are split over, and the number of groups."""
    split = np.maximum(1, -(-counts // size))
    first, group, room = np.zeros(len(counts), np.int64), 0, size
    for code in np.argsort(counts, kind="stable"):
        if split[code] > 1 or counts[code] > room:
            group, room = group + (room < size), size
        first[code] = group
        if split[code] > 1:
            group += split[code]
        else:
            room -= counts[code]
    return first, split, int(group + 1)


def deduplicate(docs: DataFrame, width: int = WINDOW, anchor: int = ANCHOR, group: int = GROUP_SUFFIXES) -> DataFrame:
    """`docs` with n_words, n_removed and kept, the words left joined by one space.

    A word goes if a window of `width` words over it, in its row as given, also begins earlier: in a
    smaller doc_id (null ids come last), or in the same at an earlier word. Rows alike in doc_id and
    text count as one. Null, empty and short texts lose nothing; no rows give none. Names
    that clash with the new columns are replaced.
    """
    docs = docs.drop("n_words", "n_removed", "kept")
    names = docs.columns
    id_, mark, found_id, found_mark, found_pos = (unused(names, c) for c in ("_id", "_mark", "_found_id", "_found_mark", "_found"))
    keyed = bound_batches(docs).withColumn(id_, F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1))).withColumn(mark, F.xxhash64("text"))
    counts = word_counts(docs, width)
    first, split, groups = prefix_groups(counts, group)
    sparse = max(1, int(-(-counts.sum() * 2 // ((width - anchor + 2) * group))))
    deal = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = keyed.repartition(deal, id_, mark)
    text_at, id_at, mark_at = names.index("text"), len(names), len(names) + 1

    def sparse_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Outbox(sparse, False)
        for batch in batches:
            ids, marks = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for at, to, data, offsets in slices(batch.column(2)):
                w = words(data, offsets)
                found = np.unique(anchors(w, windows(w, width)[1], width, anchor))
                row = np.searchsorted(w.first, found, side="right") - 1
                hashed = runs(w, found, anchor)
                out.add(hashed, row, found - w.first[row], (hashed % np.uint64(sparse)).astype(np.int64), ids[at:to], marks[at:to])
                if out.held >= FLUSH_SUFFIXES:
                    yield from out.flush()
        yield from out.flush()

    def full_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Outbox(groups, True)
        for batch in batches:
            ids, marks = (batch.column(k).to_numpy(zero_copy_only=False) for k in (id_at, mark_at))
            held = batch.column(mark_at + 1)
            for at, to, data, offsets in slices(batch.column(text_at)):
                w = words(data, offsets)
                own = held.slice(at, to - at)
                shared = np.zeros(len(w.hash) + 1, bool)
                shared[own.flatten().to_numpy(zero_copy_only=False) + np.repeat(w.first[:-1], np.array([len(x) for x in own], int))] = True
                doc, begin = windows(w, width)
                keep = shared[anchors(w, begin, width, anchor)]
                doc, begin = doc[keep], begin[keep]
                code = (w.hash[begin] >> np.uint64(64 - _CODE_BITS)).astype(np.int64)
                long = runs(w, begin, anchor)
                target = first[code] + (long % split[code].astype(np.uint64)).astype(np.int64)
                out.add(runs(w, begin, width), doc, begin - w.first[doc], target, ids[at:to], marks[at:to])
                if out.held >= FLUSH_SUFFIXES:
                    yield from out.flush()
        yield from out.flush()

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column(mark_at + 1)
            for at, to, data, offsets in slices(batch.column(text_at)):
                w, part = words(data, offsets), batch.slice(at, to - at)
                own = held.slice(at, to - at)
                sizes = np.array([len(x) if x.is_valid else 0 for x in own], int)
                begin = own.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + np.repeat(w.first[:-1], sizes)
                edge = np.bincount(begin, minlength=len(w.hash) + width + 1) - np.bincount(begin + width, minlength=len(w.hash) + width + 1)
                stays = np.cumsum(edge)[:len(w.hash)] == 0
                texts = kept_texts(w, stays)
                removed = np.diff(np.concatenate([[0], np.cumsum(~stays)])[w.first])
                yield pa.RecordBatch.from_arrays([*part.columns[:len(names)], pa.array(w.count.astype(np.int64)), pa.array(removed.astype(np.int64)),
                                                  texts], [*names, "n_words", "n_removed", "kept"])

    def gathered(rows: DataFrame, n: int, first_only: bool) -> DataFrame:
        found = rows.repartitionById(n, F.col("target")).mapInArrow(subtree(first_only, deal), "part int, ids array<long>, marks array<long>, pos array<int>")
        return found.repartitionById(deal, F.col("part")).mapInArrow(gather, "id long, mark long, pos array<int>").withColumnsRenamed(
            {"id": found_id, "mark": found_mark, "pos": found_pos}).hint("shuffle_hash")

    shared = gathered(keyed.select(id_, mark, "text").mapInArrow(sparse_suffixes, _ROWS), sparse, False)
    same = (F.col(id_) == F.col(found_id)) & (F.col(mark) == F.col(found_mark))
    repeats = gathered(parts.join(shared, same).drop(found_id, found_mark).mapInArrow(full_suffixes, _ROWS), groups, True)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return parts.join(repeats, same, "left").drop(found_id, found_mark).mapInArrow(remove, fields + ", n_words long, n_removed long, kept string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """`docs` less their repeated passages, n_chars to match; texts that lose nothing stay as they are."""
    out = deduplicate(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    changed = {"text": text} | ({"n_chars": F.when(F.col("n_removed") > 0, F.length("kept")).otherwise(F.col("n_chars"))} if "n_chars" in docs.columns else {})
    return out.select(*[changed.get(c, F.col(f"`{c}`")).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def kept_texts(w: Words, stays: np.ndarray) -> pa.Array:
    """Each text's staying words joined by one space."""
    length, at = (w.end - w.start)[stays], w.start[stays]
    n = np.diff(np.concatenate([[0], np.cumsum(stays)])[w.first])
    out_end = np.cumsum(length + 1)
    begin = out_end - length - 1
    out = np.full(int(out_end[-1]) if len(out_end) else 0, 32, np.uint8)
    rel = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    out[np.repeat(begin, length) + rel] = w.data[np.repeat(at, length) + rel]
    ends = np.concatenate([[0], out_end])[np.concatenate([[0], np.cumsum(n)])]
    raw = out.tobytes()
    return pa.array([raw[a:b - 1].decode() if b > a else "" for a, b in zip(ends, ends[1:])], pa.string())
