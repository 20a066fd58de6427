"""Toxicity from a learned lexicon whose misspelled terms are met too, read in their context.

A lexicon is learned from labelled texts: words, and stems that longer words begin with, that toxic
texts hold far more often than others, as the likelihood ratio says. Its terms form a trie. The
words within a few edits of a term are those that the Levenshtein automata accept along the trie: a
state is a set of (trie node, edits spent), built when a word first leads to it, and all words of a
slice of texts are driven through the states together, a code point at a time, most of them no
further than a few. What a word that is met says counts by the log ratio of toxic texts
and others that hold it, backed off to its term at its distance for spellings not seen in learning.

A hit is then read in its window of words: in quotation marks or on a quoted line with no hit
outside them near, it is a mention and counts for little; other hits near make it count as abuse; the words around
it count by what they say in the labelled windows. A logistic curve over a text's total, its density, its densest window and
its contexts gives a score from 0 to 1.

Words are runs of letters and digits, with signs such as @ and $ between these, lower-cased. Null and
empty texts have none and get the score of a text without hits. Rows alike score alike; extra columns are
not read; no documents give no rows; labels of one kind or none give everything their smoothed rate. A text longer
than PIECE_BYTES is read in pieces cut at spaces, in which quotations and windows do not reach over a cut.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitlens.llm.chunking import bound_batches
from pitlens.llm.words import slices
from pitlens.llm.words import words as hashed_words

#: The model is fitted on at most so many labelled rows, those whose doc_id hashes lowest.
MAX_FIT_ROWS = 8_000
PIECE_BYTES = 2_000_000
LEAST_STEM, FOLD_MOD, WINDOW = 4, 4, 6
#: What a mention counts for, against abuse.
MENTION = 0.15
#: Pseudo-counts that draw a spelling's ratio to its term's, and a context word's to none.
_BACK_OFF, _CONTEXT_BACK_OFF, _RIDGE = 2.0, 8.0, 0.02
_WORDLY = np.array([chr(k).isalnum() for k in range(65_536)])
_FOLD = np.array([ord(chr(k).lower()) if len(chr(k).lower()) == 1 else k for k in range(65_536)], np.uint32)
_INNER = np.isin(np.arange(65_536), [ord(c) for c in "@$!*+"])
_QUOTE = np.isin(np.arange(65_536), [ord(c) for c in '"“”„«»'])


@dataclass
class Tokens:
    """Words of a few texts: lower-cased code points, where words begin and end, each word's text, which stand in quotation."""

    code: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    quoted: np.ndarray

    def word(self, k: int) -> str:
        return self.code[self.start[k]:self.end[k]].tobytes().decode("utf-32-le", "replace")


def tokens(data: np.ndarray, offsets: np.ndarray) -> Tokens:
    raw = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    basic = np.minimum(raw, 65_535)
    code = np.where(raw < 65_536, _FOLD[basic], raw)
    wordly = _WORDLY[basic] & (raw < 65_535) | (raw > 65_535)
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True
    beside = np.zeros(len(raw), bool)
    beside[1:-1] = wordly[:-2] & wordly[2:]
    inside = wordly | (_INNER[basic] & beside & ~edge[:-1] & ~edge[1:])
    start = np.flatnonzero(inside & (edge[:-1] | ~np.r_[False, inside[:-1]]))
    end = np.flatnonzero(inside & (edge[1:] | ~np.r_[inside[1:], False])) + 1
    mark = np.concatenate([[0], np.cumsum(_QUOTE[basic])])
    line_from = np.unique(np.concatenate([at, np.flatnonzero(raw == 10) + 1]))
    line_from = line_from[line_from < max(len(raw), 1)] if len(line_from) > 1 else line_from
    line = np.searchsorted(line_from, start, side="right") - 1
    line_to = np.append(line_from[1:], len(raw))
    if len(start):
        within = ((mark[start] - mark[line_from[line]]) % 2 == 1) & (mark[line_to[line]] > mark[end])
        cited = raw[np.minimum(line_from[line], len(raw) - 1)] == ord(">")
    else:
        within = cited = np.zeros(0, bool)
    return Tokens(code, start, end, np.searchsorted(at, start, side="right") - 1, within | cited)


def pieces(data: np.ndarray, offsets: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Slices of texts as they are; one long text in parts cut at spaces (at a code point where there is none)."""
    if len(data) <= limit or len(offsets) > 2:
        yield data, offsets
        return
    at = 0
    while at < len(data):
        to = min(at + limit, len(data))
        if to < len(data):
            space = np.flatnonzero(data[at:to] <= 32)
            to = at + int(space[-1]) + 1 if len(space) else to
            while to > at + 1 and data[to] & 0xC0 == 0x80:
                to -= 1
        yield data[at:to], np.array([0, to - at])
        at = to


def edits_allowed(term: str, stem: bool) -> int:
    return (1 if len(term) >= 7 else 0) if stem else 2 if len(term) >= 8 else 1 if len(term) >= 4 else 0


class Automaton:
    """The lexicon's trie under the Levenshtein automata of its terms, made deterministic as words ask for it."""

    def __init__(self, terms: list[tuple[str, bool]]):
        self.terms = terms
        self.children: list[dict[int, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.most = [0]
        self.allowed = [edits_allowed(*t) for t in terms]
        for k, (term, _) in enumerate(terms):
            node = 0
            self.most[0] = max(self.most[0], self.allowed[k])
            for c in map(ord, term):
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                    self.most.append(0)
                node = self.children[node][c]
                self.most[node] = max(self.most[node], self.allowed[k])
            self.ends[node].append(k)
        letters = sorted({c for d in self.children for c in d})
        self.letters = [-1, *letters]
        self.kind = np.zeros(65_536, np.int32)
        self.kind[[c for c in letters if c < 65_536]] = [k + 1 for k, c in enumerate(letters) if c < 65_536]
        self.sets: list[dict[int, int]] = [{}]
        self.number = {frozenset(): 0}
        self.table = np.full((256, len(self.letters)), -1, np.int32)
        self.table[0] = 0
        self.accepts = np.full(256, -1, np.int32)
        self.start = self.state(self.skipped({0: 0}))

    def skipped(self, items: dict[int, int]) -> dict[int, int]:
        """Also the nodes reached by leaving out letters of a term."""
        todo = [n for n in items if n >= 0]
        while todo:
            node = todo.pop()
            for child in self.children[node].values():
                spent = items[node] + 1
                if spent <= self.most[child] and spent < items.get(child, 99):
                    items[child] = spent
                    todo.append(child)
        return items

    def state(self, items: dict[int, int]) -> int:
        key = frozenset(items.items())
        if key not in self.number:
            k = self.number[key] = len(self.sets)
            self.sets.append(items)
            if k >= len(self.accepts):
                self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
                self.accepts = np.concatenate([self.accepts, np.full_like(self.accepts, -1)])
            best = min(((e, 1, ~n) if n < 0 else (e, 0, t) for n, e in items.items() for t in ([0] if n < 0 else self.ends[n])
                        if n < 0 or (not self.terms[t][1] and e <= self.allowed[t])), default=None)
            self.accepts[k] = -1 if best is None else best[2] * 3 + best[0]
        return self.number[key]

    def step(self, state: int, letter: int) -> int:
        code, out = self.letters[letter], {}

        def put(node: int, spent: int) -> None:
            if spent < out.get(node, 99):
                out[node] = spent

        for node, spent in self.sets[state].items():
            if node < 0:  # a stem that has been met stays met
                put(node, spent)
                continue
            for t in self.ends[node]:
                if self.terms[t][1] and spent <= self.allowed[t]:
                    put(~t, spent)
            if spent < self.most[node]:
                put(node, spent + 1)
            for c, child in self.children[node].items():
                if spent + (c != code) <= self.most[child]:
                    put(child, spent + (c != code))
        return self.state(self.skipped(out))

    def met(self, t: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """Words that are met, and of each 3 times its term plus the edits: fewest edits first, then whole words, then the earlier term."""
        alive, state = np.arange(len(t.start)), np.full(len(t.start), self.start, np.int32)
        length, found, k = t.end - t.start, [], 0
        while len(alive):
            ends = length[alive] == k
            found.append((alive[ends], self.accepts[state[ends]]))
            alive, state = alive[~ends], state[~ends]
            letter = self.kind[np.minimum(t.code[t.start[alive] + k], 65_535)]
            to = self.table[state, letter]
            if (to < 0).any():
                for pair in np.unique(state[to < 0].astype(np.int64) * len(self.letters) + letter[to < 0]):
                    s, c = divmod(int(pair), len(self.letters))
                    self.table[s, c] = self.step(s, c)
                to = self.table[state, letter]
            alive, state, k = alive[to > 0], to[to > 0], k + 1
        word, hit = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, np.int32))
        order = np.argsort(word[hit >= 0], kind="stable")
        return word[hit >= 0][order], hit[hit >= 0][order]


@dataclass
class Hit:
    """A word that was met: where in its text, what it is, in what it stands."""

    at: int
    hit: int
    word: str
    quoted: bool
    around: list[str]


@dataclass
class Read:
    """A text as the model sees it."""

    n: int = 0
    hits: list[Hit] = field(default_factory=list)


def read(automaton: Automaton, data: np.ndarray, offsets: np.ndarray) -> list[Read]:
    """The hits of each of a few texts."""
    out = [Read() for _ in offsets[1:]]
    for part, bounds in pieces(data, offsets):
        t = tokens(part, bounds)
        first = np.searchsorted(t.text, np.arange(len(bounds)))
        for k, hit in zip(*(x.tolist() for x in automaton.met(t))):
            own = int(t.text[k])
            low, high = max(first[own], k - WINDOW), min(first[own + 1], k + WINDOW + 1)
            out[own].hits.append(Hit(out[own].n + k - int(first[own]), hit, t.word(k), bool(t.quoted[k]), [t.word(j) for j in range(low, high) if j != k]))
        for own, n in enumerate(np.diff(first).tolist()):
            out[own].n += n
    return out


def pulled(toxic: float, other: float, prior: float, odds: float, strength: float) -> float:
    """Log ratio of the rates of toxic texts and others, drawn to `prior`; `odds` is toxic texts to others overall."""
    share = 1 / (1 + math.exp(-(prior + math.log(odds))))
    return math.log((toxic + strength * share) / (other + strength * (1 - share)) / odds)


@dataclass
class Model:
    """Lexicon, what its hits say, and the curve."""

    terms: list[tuple[str, bool]]
    spelled: dict[str, float]
    unseen: dict[int, float]
    context: dict[str, float]
    curve: np.ndarray

    def features(self, r: Read) -> np.ndarray:
        said = [(h, max(self.spelled.get(h.word, self.unseen.get(h.hit, 0.0)), 0.0)) for h in r.hits]
        said = [(h, w) for h, w in said if w > 0]
        open_at = np.array([h.at for h, _ in said if not h.quoted], int)
        most: dict[str, float] = {}
        span, best, i = 0.0, 0.0, 0
        counted, leanings = [], []
        for h, w in said:
            mention = h.quoted and not (len(open_at) and np.abs(open_at - h.at).min() <= WINDOW)
            w *= MENTION if mention else 1.0
            most[h.word] = max(most.get(h.word, 0.0), w)
            counted.append((h.at, w))
            span += w
            while counted[i][0] < h.at - 2 * WINDOW:
                span -= counted[i][1]
                i += 1
            best = max(best, span)
            leanings.append(sum(self.context.get(c, 0.0) for c in h.around) / (len(h.around) + 1))
        total = sum(most.values())
        return np.array([1.0, math.log1p(total), math.log1p(total * 50 / (r.n + 50)), math.log1p(best), float(np.mean(leanings)) if leanings else 0.0])

    def score(self, r: Read) -> float:
        return float(1 / (1 + math.exp(-max(-40.0, min(40.0, float(self.features(r) @ self.curve))))))


def choose_terms(sets: list[set[str]], toxic: list[bool]) -> list[tuple[str, bool]]:
    """Words and stems whose likelihood ratio passes chance over all candidates; of one path of the trie the best, the longest of equals."""
    n1, n0 = sum(toxic), len(toxic) - sum(toxic)
    if not n1 or not n0:
        return []

    def grams(words: set[str]) -> set[tuple[str, bool]]:
        return {(w, False) for w in words if len(w) > 2} | {(w[:k], True) for w in words for k in range(LEAST_STEM, min(len(w), 13))}

    many = Counter()
    for words, bad in zip(sets, toxic):
        if bad:
            many.update(grams(words))
    many = {g: n for g, n in many.items() if n >= 3}
    others = Counter()
    for words, bad in zip(sets, toxic):
        if not bad:
            others.update(g for g in grams(words) if g in many)
    rate, score = n1 / (n1 + n0), {}
    for g, a in many.items():
        b = others[g]
        if a / n1 > b / n0:
            p = a / (a + b)
            score[g] = 2 * (a * math.log(p / rate) + (b * math.log((1 - p) / (1 - rate)) if b else 0.0))
    least = max(16.0, 2 * math.log(len(many) + 1))
    good = {g: s for g, s in score.items() if s >= least}
    below: dict[tuple[str, bool], float] = defaultdict(float)
    for (text, stem), s in good.items():
        for k in range(LEAST_STEM, len(text) + (not stem)):
            below[text[:k], True] = max(below[text[:k], True], s)
    kept: list[tuple[str, bool]] = []
    taken: set[str] = set()
    for (text, stem), s in sorted(good.items(), key=lambda x: (len(x[0][0]), not x[0][1], x[0])):
        if any(text[:k] in taken for k in range(LEAST_STEM, len(text))) or (stem and s <= below[text, True]):
            continue
        kept.append((text, stem))
        if stem:
            taken.add(text)
    return sorted(kept)


def unlike(sketches: list[np.ndarray]) -> list[int]:
    """One of each group of near copies: texts that share half their least shingle hashes with an earlier one go."""
    owner: dict[int, int] = {}
    kept = []
    for k, sketch in enumerate(sketches):
        seen = Counter(owner[h] for h in sketch.tolist() if h in owner)
        if len(sketch) and seen and seen.most_common(1)[0][1] * 2 >= len(sketch):
            continue
        kept.append(k)
        owner.update((h, k) for h in sketch.tolist())
    return kept


def weigh(terms: list[tuple[str, bool]], reads: list[Read], toxic: list[bool]) -> Model:
    """What hits and the words around them say."""
    n1, n0 = sum(toxic), len(toxic) - sum(toxic)
    odds = max(n1, 0.5) / max(n0, 0.5)
    spelled, owners, near = defaultdict(lambda: [0, 0]), {}, defaultdict(lambda: [0, 0])
    for r, bad in zip(reads, toxic):
        for word, hit in {(h.word, h.hit) for h in r.hits}:
            spelled[word][bad] += 1
            owners[word] = hit
        for c in {c for h in r.hits for c in h.around}:
            near[c][bad] += 1
    exact, alone = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for word, (b, a) in spelled.items():
        if a + b == 1 or not owners[word] % 3 and not terms[owners[word] // 3][1]:
            alone[owners[word]][0] += b
            alone[owners[word]][1] += a
        exact[owners[word] % 3][0] += b
        exact[owners[word] % 3][1] += a
    unseen = {}
    for t, (_, stem) in enumerate(terms):
        level = 4.0 if not stem else 2.0
        for e in range(3):
            b, a = alone[t * 3 + e]
            level = unseen[t * 3 + e] = pulled(a, b, level if not e else level * 0.6, odds, _BACK_OFF)
    context = {c: pulled(a, b, 0.0, odds, _CONTEXT_BACK_OFF) for c, (b, a) in near.items() if a + b >= 5}
    return Model(terms, {w: pulled(a, b, unseen[owners[w]], odds, _BACK_OFF) for w, (b, a) in spelled.items()}, unseen, context,
                 np.array([math.log(odds), 0.0, 0.0, 0.0, 0.0]))


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Coefficients by Newton's method under a ridge; hits never speak for a text, so theirs stay at nought or above."""
    at, free = np.zeros(x.shape[1]), np.ones(x.shape[1], bool)
    for _ in range(x.shape[1]):
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(x[:, free] @ at[free], -40, 40)))
            hess = (x[:, free] * (p * (1 - p))[:, None]).T @ x[:, free] + _RIDGE * len(y) ** 0.5 * np.eye(free.sum())
            step = np.linalg.solve(hess, x[:, free].T @ (p - y) + _RIDGE * len(y) ** 0.5 * at[free])
            at[free] -= np.clip(step, -4, 4)
            if np.abs(step).max() < 1e-9:
                break
        wrong = (at < 0) & (np.arange(len(at)) > 0)
        if not wrong.any():
            break
        free &= ~wrong
        at[wrong] = 0.0
    return at


def _labelled(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """doc_id, label, fold, text of the rows to learn from; of repeated labels the lowest counts."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.min("toxic").alias("_toxic"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    return bound_batches(docs).select("doc_id", "text").join(F.broadcast(some), "doc_id").select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.col("_toxic") > 0).alias("label"),
        F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(FOLD_MOD)).cast("long").alias("fold"), F.coalesce("text", F.lit("")).alias("text"))


def _in_one(rows: DataFrame, work) -> object:
    """What `work` makes of all rows, a bounded number, in one task."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(frames)
        got = work(pd.concat(parts).sort_values(["doc_id", "packed"]).reset_index(drop=True) if parts else None)
        yield pd.DataFrame({"made": [pickle.dumps(got)]})

    got = rows.repartition(1).mapInPandas(run, "made binary").collect()
    return pickle.loads(got[0][0]) if got else work(None)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_FIT_ROWS) -> Model:
    """Fits labels (doc_id, toxic) to whole texts; near copies among the rows learned from count once."""
    rows = _labelled(docs, labels, max_rows)
    fields = "doc_id long, label boolean, fold long, packed binary"

    def packed(batch: pa.RecordBatch, at: int, to: int, made: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*batch.slice(at, to - at).columns[:3], pa.array([pickle.dumps(m) for m in made], pa.binary())], ["doc_id", "label", "fold", "packed"])

    def word_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, data, offsets in slices(batch.column(3)):
                said: list[set[str]] = [set() for _ in offsets[1:]]
                for part, bounds in pieces(data, offsets):
                    t = tokens(part, bounds)
                    for k, own in enumerate(t.text.tolist()):
                        said[own].add(t.word(k))
                hashes, first = hashed_words(data, offsets, lower=True).shingles(5)
                yield packed(batch, at, to, [(sorted(s), np.unique(hashes[a:b])[:16]) for s, a, b in zip(said, first, first[1:])])

    def lexicon(frame: pd.DataFrame | None):
        if frame is None:
            return [], [], [], []
        made = [pickle.loads(p) for p in frame["packed"]]
        kept = unlike([sketch for _, sketch in made])
        sets, toxic = [set(made[k][0]) for k in kept], [bool(frame["label"][k]) for k in kept]
        learn = [k for k, own in enumerate(kept) if frame["fold"][own]]
        return (choose_terms([sets[k] for k in learn], [toxic[k] for k in learn]), choose_terms(sets, toxic),
                frame["doc_id"][kept].tolist(), toxic)

    part_terms, terms, ids, toxic = _in_one(rows.mapInArrow(word_sets, fields), lexicon)
    if not terms:
        rate = (sum(toxic) + 1) / (len(toxic) + 2)
        return Model([], {}, {}, {}, np.array([math.log(rate / (1 - rate)), 0.0, 0.0, 0.0, 0.0]))
    ids = set(ids)

    def all_reads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = Automaton(part_terms), Automaton(terms)
        for batch in batches:
            for at, to, data, offsets in slices(batch.column(3)):
                yield packed(batch, at, to, list(zip(*(read(a, data, offsets) for a in both))))

    def whole(frame: pd.DataFrame | None) -> Model:
        frame = frame[frame["doc_id"].isin(ids)].drop_duplicates("doc_id").reset_index(drop=True)
        made, toxic, fold = [pickle.loads(p) for p in frame["packed"]], frame["label"].tolist(), frame["fold"].tolist()
        learn, held = [k for k, f in enumerate(fold) if f], [k for k, f in enumerate(fold) if not f]
        if len({toxic[k] for k in held}) < 2 or not part_terms:
            learn = held = list(range(len(toxic)))
        part = weigh(part_terms or terms, [made[k][not part_terms] for k in learn], [toxic[k] for k in learn])
        curve = logistic(np.stack([part.features(made[k][not part_terms]) for k in held]), np.array([toxic[k] for k in held], float))
        model = weigh(terms, [m[1] for m in made], toxic)
        model.curve = curve
        return model

    return _in_one(rows.mapInArrow(all_reads, fields), whole)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with toxicity (0 to 1, higher: label 1 likelier). Nothing but the text is read."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(model.terms)
        for batch in batches:
            found = [model.score(r) for _, _, data, offsets in slices(batch.column(batch.schema.get_field_index("text"))) for r in read(automaton, data, offsets)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], [*batch.schema.names, "toxicity"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "toxicity")
    return bound_batches(docs).drop("toxicity").mapInArrow(run, fields + ", toxicity double")
