"""Token counts by a tokenizer compiled to a finite-state transducer.

The pieces of the vocabulary hold the space mark at their start only, so no token crosses
from a word into the space before the next: a text falls into segments, spaces and the word
behind them. Inside a segment a tokenization by ranked merges is right exactly when each
token stays whole on its own and each pair of neighbours stays as it is on its own. So
the tokens that can still end at the next character are a state, a character is a transition,
and the tokens it settles are written on it. States are made as they are met.

A chunk of text maps a state to a state: what completes the segment it was entered in (its
head), the tokens of its own segments, and the segment it leaves open (its tail). Such maps
compose associatively, so the chunks of a text are counted apart and composed in a scan.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitlens.llm.chunking import CHUNK_CHARS, long_chunks, short_texts
from pitlens.llm.words import slices, words

MARK = "▁"
#: What a task remembers, at most; beyond, it works out again what it meets.
KNOWN_STATES, KNOWN_PAIRS, KNOWN_WORDS = 100_000, 400_000, 500_000
_ONLY_SPACE = np.arange(256) == 32
_SEGMENT = re.compile(r"( *)([^ ]*)")


class StateMap(NamedTuple):
    """What a chunk does to any state: `count` and `tail` are None if no segment begins in it."""

    head: str
    count: int | None
    tail: str | None


class State:
    """The pieces still open: (trie node, token before, tokens so far less the settled ones, whether the
    mark is a token by itself); the last entry has not begun a piece. `step` holds its known transitions."""

    __slots__ = ("open", "step", "kept")

    def __init__(self, open_: tuple, kept: bool):
        self.open, self.step, self.kept = open_, {}, kept


class Transducer:
    """Deterministic transducer of one vocabulary."""

    def __init__(self, model: bytes):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.score = {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.get_piece_size())
                      if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        self.runs = {len(p) for p in self.score if len(p) > 1 and not p.strip(MARK)}
        run_scores = {self.score[MARK * k] for k in self.runs}
        others = [s for p, s in self.score.items() if len(p) > 1 and p.strip(MARK)]
        alone = {p for p in self.score if len(p) == 1}
        if (any(MARK in p.lstrip(MARK) for p in self.score) or len(run_scores) > 1 or any(s >= min(others) for s in run_scores)
                or any(set(p) - alone for p in self.score) or any(p.startswith(MARK * 2) and p.strip(MARK) for p in self.score)):
            raise ValueError("a vocabulary with pieces across a space, or space runs that merge before words")
        self.node: list[dict[str, int]] = [{}]
        self.piece: list[str | None] = [None]
        for p in self.score:
            if len(p) == 1 or p.strip(MARK):
                at = 0
                for ch in p:
                    if ch not in self.node[at]:
                        self.node[at][ch] = len(self.node)
                        self.node.append({})
                        self.piece.append(None)
                    at = self.node[at][ch]
                self.piece[at] = p
        self.rank = {p: -score for p, score in self.score.items()}
        self.edges: dict[str, tuple[list, list, bool]] = {}
        self.pairs: dict[str, dict[str, bool]] = {}
        self.n_pairs = 0
        self.spaces: list[int] = [0]
        self.blank: list[int] = []
        self.known: dict[int, int] = {}
        self.start = State(((0, None, 0, False),), True)
        self.states: dict[tuple, State] = {self.start.open: self.start}

    def history(self, token: str) -> tuple[list, list, bool]:
        """How the last and the first part of a token grow as it is merged, and whether it ends whole.

        Each growth comes with the highest rank passed on the way to it.
        """
        if (got := self.edges.get(token)) is not None:
            return got
        parts, last, first, late, early = list(token), [], [], -1e99, -1e99
        while found := [(self.rank[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.rank]:
            rank, k = min(found)
            late, early = max(late, rank), max(early, rank)
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
            if k + 1 == len(parts):
                last.append((late, parts[-1]))
                late = -1e99
            if k == 0:
                first.append((early, parts[0]))
                early = -1e99
        got = self.edges[token] = (last, first, parts == [token])
        return got

    def stays(self, before: str | None, token: str) -> bool:
        """Whether a token stays whole, and no merge joins it to the token before."""
        _, first, whole = self.history(token)
        if not whole or not before:
            return whole
        last = self.history(before)[0]
        a, b, i, j, rank = before[-1], token[0], 0, 0, self.rank
        while True:
            left = last[i][0] if i < len(last) else 1e99
            right = first[j][0] if j < len(first) else 1e99
            across = rank.get(a + b, 1e99)
            if across < left and across <= right:
                return False
            if left <= right:
                if left == 1e99:
                    return True
                a, i = last[i][1], i + 1
            else:
                b, j = first[j][1], j + 1

    def move(self, state: State, ch: str) -> tuple[State, int]:
        """(state, settled tokens) after one more character."""
        open_, last, node, pairs = [], None, self.node, self.pairs
        for at, before, count, alone in state.open:
            if (child := node[at].get(ch)) is None:
                continue
            if last is None and (p := self.piece[child]) is not None:
                after = pairs.get(before)
                if after is None:
                    after = pairs[before] = {}
                if (ok := after.get(p)) is None:
                    ok = self.stays(before, p)
                    if self.n_pairs < KNOWN_PAIRS:
                        after[p] = ok
                        self.n_pairs += 1
                if ok:
                    last = (0, p, count + 1, p == MARK if before is None else alone)
            if node[child]:
                open_.append((child, before, count, alone))
        if last is None:  # a character without a piece: its bytes, and nothing merges across it
            _, _, count, alone = state.open[-1]
            last, open_ = (0, "", count + len(ch.encode()), alone), []
        open_.append(last)
        if base := min([e[2] for e in open_]):
            open_ = [(n, b, c - base, a) for n, b, c, a in open_]
        if not state.kept:
            return State(tuple(open_), False), base
        key = tuple(open_)
        if (to := self.states.get(key)) is None:
            to = State(key, len(self.states) < KNOWN_STATES)
            if not to.kept:
                return to, base
            self.states[key] = to
        state.step[ch] = to, base
        return to, base

    def word(self, word: str) -> tuple[int, bool]:
        """Tokens of one mark and the word behind it, and whether the mark is one of them."""
        return next(self.words([word]))

    def words(self, sorted_words: list[str]) -> Iterator[tuple[int, bool]]:
        """What `word` says of each; a word starts from where the one before has the same beginning."""
        passed, before = [self.start.step.get(MARK) or self.move(self.start, MARK)], ""
        for word in sorted_words:
            same = 0
            for a, b in zip(before, word):
                if a != b:
                    break
                same += 1
            del passed[same + 1:]
            state, total = passed[-1]
            for ch in word[same:]:
                state, settled = state.step.get(ch) or self.move(state, ch)
                total += settled
                passed.append((state, total))
            before = word
            _, _, count, alone = state.open[-1]
            yield total + count, alone

    def run(self, n: int) -> int:
        """Tokens of n marks: all merges are alike, so the leftmost pair that can merge does.

        The stack reaches one and the same remainder again and again; `spaces` is filled as needed.
        """
        if n >= len(self.spaces):
            stack = self.blank
            for _ in range(len(self.spaces), n + 1):
                stack.append(1)
                shown = list(stack[-4:])
                while len(shown) > 1 and shown[-2] + shown[-1] in self.runs:
                    shown[-2:] = [shown[-2] + shown[-1]]
                stack[-min(4, len(stack)):] = shown
                self.spaces.append(len(stack))
        return self.spaces[n]

    def remember(self, keys: list[int], texts: list[bytes]) -> np.ndarray:
        """2 * tokens + (mark alone) of words, remembered by their hashes."""
        own = [self.known.get(k, -1) for k in keys]
        new = sorted((texts[i].decode("utf-8", "replace"), i) for i, x in enumerate(own) if x < 0)
        for (_, i), (count, alone) in zip(new, self.words([w for w, _ in new])):
            own[i] = 2 * count + alone
            if len(self.known) < KNOWN_WORDS:
                self.known[keys[i]] = own[i]
        return np.array(own, np.int64)

    def counts(self, data: np.ndarray, offsets: np.ndarray, begun: np.ndarray | int = 1) -> np.ndarray:
        """Tokens of each text; `begun` is 1 where a mark stands before the first character."""
        w = words(data, offsets, space=_ONLY_SPACE)
        size = np.diff(offsets)
        begun = np.broadcast_to(begun, size.shape) * (size > 0)
        out = np.zeros(len(size), np.int64)
        has = w.count > 0
        first, last = w.first[:-1][has], w.first[1:][has] - 1
        if len(w.start):
            before = np.concatenate([[0], w.end[:-1]])
            before[first] = offsets[:-1][has] - begun[has]
            lead = w.start - before
            keys, at, back = np.unique(w.hash, return_index=True, return_inverse=True)
            raw = data.tobytes()
            own = self.remember(keys.tolist(), [raw[a:b] for a, b in zip(w.start[at].tolist(), w.end[at].tolist())])[back]
            count, alone = own >> 1, own & 1
            many = np.flatnonzero(lead > 1)
            count[many] += np.array([self.run(n) for n in (lead[many] - 1 + alone[many]).tolist()], np.int64) - alone[many]
            out[has] = np.add.reduceat(count, first)
        trail = np.where(has, 0, size + begun)
        trail[has] = offsets[1:][has] - w.end[last]
        return out + np.array([self.run(n) for n in trail.tolist()], np.int64)

    def segments(self, text: str) -> int:
        """Tokens of a text that begins with a space."""
        return sum((c - a + self.run(len(s) - 1 + a)) if w else self.run(len(s))
                   for s, w in _SEGMENT.findall(text) if s or w for c, a in ([self.word(w)] if w else [(0, 0)]))

    def chunk(self, text: str) -> StateMap:
        """The state map of a chunk; a segment begins at a space behind another character."""
        head = re.match(r" *[^ ]*", text).end()
        if head == len(text):
            return StateMap(text, None, None)
        tail = re.search(r" +[^ ]*$", text[head:]).start() + head
        inner = text[head:tail].encode()
        count = self.counts(np.frombuffer(inner, np.uint8), np.array([0, len(inner)]), 0)
        return StateMap(text[:head], int(count[0]), text[tail:])

    def compose(self, a: StateMap, b: StateMap) -> StateMap:
        if a.count is None:
            return StateMap(a.head + b.head, b.count, b.tail)
        if b.count is None:
            return StateMap(a.head, a.count, a.tail + b.head)
        return StateMap(a.head, a.count + self.segments(a.tail + b.head) + b.count, b.tail)

    def total(self, maps: list[StateMap]) -> int:
        """Composes neighbours in rounds, then enters the text with the mark that stands before it."""
        while len(maps) > 1:
            maps = [self.compose(*maps[k:k + 2]) if k + 1 < len(maps) else maps[k] for k in range(0, len(maps), 2)]
        head, count, tail = maps[0]
        return self.segments(" " + head) + (0 if count is None else count + self.segments(tail))


@lru_cache(maxsize=2)
def transducer(model: bytes) -> Transducer:
    return Transducer(model)


def count_tokens(docs: DataFrame, model_path: str, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """doc_id, n_bytes, n_tokens: a row per row of `docs`.

    Counts are the library's for the model, without begin, end or special tokens; control
    strings inside texts are plain text, as its default has it. Null and empty texts count 0;
    repeated rows and ids give a row each; columns other than doc_id and text are not read. The
    model file, of fixed size, goes to the tasks with the code.
    """
    with open(model_path, "rb") as file:
        model = file.read()
    kind = docs.schema["doc_id"].dataType.simpleString()
    shape = f"doc_id {kind}, n_bytes long, n_tokens long"

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = transducer(model)
        for batch in batches:
            texts = batch.column(1)
            n_bytes = pc.binary_length(texts)
            if pc.any(pc.match_substring(texts, MARK)).as_py():
                texts = pc.replace_substring(texts, MARK, " ")
            counts = [own.counts(data, offsets) for _, _, data, offsets in slices(texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes.cast(pa.int64()),
                                              pa.array(np.concatenate([np.zeros(0, np.int64), *counts]))], ["doc_id", "n_bytes", "n_tokens"])

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = transducer(model)
        for batch in batches:
            texts = batch.column(5).to_pylist()
            found = [own.chunk(t.replace(MARK, " ")) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array([m.head for m in found], pa.string()),
                 pa.array([m.count for m in found], pa.int64()), pa.array([m.tail for m in found], pa.string())],
                ["row", "doc_id", "part", "n_bytes", "head", "count", "tail"])

    def join(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("part")
        found = [StateMap(h, None if t is None else int(c), t) for h, c, t in zip(group["head"], group["count"], group["tail"])]
        return pd.DataFrame({"doc_id": group["doc_id"].iloc[:1], "n_bytes": [group["n_bytes"].sum()],
                             "n_tokens": [transducer(model).total(found)]})

    parts = long_chunks(docs, chunk_chars).mapInArrow(
        maps, f"row long, doc_id {kind}, part int, n_bytes long, head string, count long, tail string")
    return short_texts(docs, chunk_chars).mapInArrow(whole, shape).unionByName(parts.groupBy("row").applyInPandas(join, shape))


def over_limit(counted: DataFrame, limit: int) -> DataFrame:
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
