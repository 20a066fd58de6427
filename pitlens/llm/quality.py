"""Quality scores by Naive Bayes support vectors.

A text is the set of its n-grams: runs of three bytes, and runs of one to four word shapes. A
word's shape says whether it repeats the word before, how it is cased, and what it ends in.
Each indicator is scaled by the log ratio of its smoothed counts in the two classes; a linear
model with hinge loss is fitted to the scaled indicators by dual coordinate descent, and a
logistic curve through the margins of rows left out of the fit gives scores from 0 to 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitlens.llm.chunking import bound_batches, unused
from pitlens.llm.words import mix, slices, words

BYTE_GRAMS, SHAPE_GRAMS = 1 << 15, 1 << 13
FEATURES = BYTE_GRAMS + SHAPE_GRAMS
#: The classifier is fitted on at most so many labelled rows, those whose doc_id hashes lowest.
MAX_FIT_ROWS = 8_000
#: A slice's table of n-grams has FEATURES bytes a text.
SLICE_BYTES, SLICE_ROWS = 1_000_000, 512
EPOCHS, COST, FOLD_MOD = 20, 1.0, 5
_KIND = np.full(256, 4, np.uint8)  # other signs
_KIND[np.r_[97:123, 128:256]] = 1
_KIND[65:91] = 2
_KIND[48:58] = 3


def presence(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which n-grams each text has, a row per text; a text without words has none."""
    n = len(offsets) - 1
    seen = np.zeros((n, FEATURES), bool)
    flat = seen.reshape(-1)
    w = words(data, offsets)
    if not len(w.start):
        return seen
    size = np.diff(offsets)
    text = np.repeat(np.arange(n), size)
    code = data.astype(np.uint32)
    for step, far in ((np.uint32(2654435761), 1), (np.uint32(2246822519), 2)):
        code[:-far or None] ^= (data[far:].astype(np.uint32) + np.uint32(1)) * step
    code = (code * np.uint32(3266489917)) >> np.uint32(32 - BYTE_GRAMS.bit_length() + 1)
    inside = np.arange(len(data)) + 2 < np.repeat(offsets[1:], size)
    flat[text[inside] * FEATURES + code[inside]] = True
    doc = np.repeat(np.arange(n), w.count)
    again = np.zeros(len(doc), bool)
    again[1:] = (w.hash[1:] == w.hash[:-1]) & (doc[1:] == doc[:-1])
    kind = _KIND[data]
    last, second = kind[w.end - 1], kind[np.maximum(w.end - 2, w.start)]
    upper = np.add.reduceat(np.append(kind == 2, False).astype(np.int32), np.stack([w.start, w.end], 1).reshape(-1))[::2]
    shape = (again.astype(np.uint64) + 2 * (last.astype(np.uint64) + 5 * (second.astype(np.uint64) + 5 * (
        np.minimum(upper, 2).astype(np.uint64) + 3 * np.minimum(w.end - w.start, 3).astype(np.uint64)))))
    gram = np.zeros(len(doc), np.uint64)
    for k in range(4):
        same = np.ones(len(doc), bool)
        if k:
            same[:k] = False
            same[k:] = doc[k:] == doc[:-k]
        gram = np.concatenate([gram[:0], np.roll(gram, 1)]) * np.uint64(1_000_003) + shape + np.uint64(1 + k)
        at = (mix(gram[same]) % np.uint64(SHAPE_GRAMS)).astype(np.int64)
        flat[doc[same] * FEATURES + BYTE_GRAMS + at] = True
    return seen


@dataclass(frozen=True)
class Model:
    """Weight of each n-gram, bias, and the logistic curve; scores of texts without n-grams come from the bias."""

    weight: np.ndarray
    scale: np.ndarray
    bias: float
    slope: float
    offset: float

    def margins(self, seen: np.ndarray) -> np.ndarray:
        row, at = np.nonzero(seen)
        norm = np.sqrt(np.bincount(row, self.scale[at] ** 2, len(seen)))
        return np.bincount(row, self.weight[at], len(seen)) / np.maximum(norm, 1e-9) + self.bias

    def scores(self, seen: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(seen) + self.offset, -40, 40)))


def curve(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through smoothed labels, by Newton's method."""
    n1, n0 = label.sum(), (~label).sum()
    want = np.where(label, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, at = np.stack([margin, np.ones_like(margin)], 1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (p - want))
        at = at - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(at[0]), float(at[1])


def fit_rows(rows: list[np.ndarray], label: np.ndarray, fold: np.ndarray) -> Model:
    """Fits indicator rows; those whose fold is 0 only place the logistic curve."""
    both = label.any() and (~label).any()
    if not both:
        rate = (label.sum() + 1) / (len(label) + 2)
        return Model(np.zeros(FEATURES), np.ones(FEATURES), 0.0, 1.0, float(np.log(rate / (1 - rate))))
    fit = np.flatnonzero(fold > 0)
    if not (label[fit].any() and (~label[fit]).any()):
        fit = np.arange(len(label))
    counts = {c: np.bincount(np.concatenate([rows[i] for i in fit if label[i] == c]), minlength=FEATURES) + 1.0 for c in (True, False)}
    scale = np.log(counts[True] / counts[True].sum()) - np.log(counts[False] / counts[False].sum())
    weight, bias = np.zeros(FEATURES), 0.0
    values = [scale[r] / max(np.sqrt((scale[r] ** 2).sum()), 1e-9) for r in rows]
    sign, alpha, rng = np.where(label, 1.0, -1.0), np.zeros(len(rows)), np.random.default_rng(8)
    cost = COST * len(fit) / 2 / np.array([(~label[fit]).sum(), label[fit].sum()])
    for _ in range(EPOCHS):
        moved = 0.0
        for i in rng.permutation(fit):
            r, x, y, most = rows[i], values[i], sign[i], cost[int(label[i])]
            now = min(max(alpha[i] - (y * (weight[r] @ x + bias) - 1) / (x @ x + 1), 0.0), most)
            step = (now - alpha[i]) * y
            if step:
                weight[r] += step * x
                bias += step
                alpha[i], moved = now, max(moved, abs(step))
        if moved < 1e-4:
            break
    held = np.flatnonzero(fold == 0)
    if not (label[held].any() and (~label[held]).any()):
        held = np.arange(len(label))
    slope, offset = curve(np.array([weight[rows[i]] @ values[i] + bias for i in held]), label[held])
    return Model(weight * scale, scale, bias, slope, offset)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_FIT_ROWS) -> Model:
    """Fits labels (doc_id, quality) to texts.

    Of repeated labels the lowest counts; null labels and ids are left out. At most `max_rows`
    labelled ids are used, so their n-grams fit in the one task that descends, and the ids in a broadcast.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("_quality"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = bound_batches(docs).select("doc_id", "text").join(F.broadcast(some), "doc_id").select(
        "doc_id", F.col("_quality") > 0, F.coalesce("text", F.lit("")), F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(FOLD_MOD)))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, data, offsets in slices(batch.column(2), SLICE_BYTES, SLICE_ROWS):
                part = batch.slice(at, to - at)
                sets = [np.flatnonzero(s).astype(np.int32) for s in presence(data, offsets)]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(1), part.column(3).cast(pa.int64()),
                                                  pa.array([s.tobytes() for s in sets], pa.binary())], ["doc_id", "label", "fold", "grams"])

    def descend(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        all_rows = pd.concat([pd.DataFrame({"doc_id": [], "label": [], "fold": [], "grams": []}), *frames]).sort_values(["doc_id", "grams"])
        model = fit_rows([np.frombuffer(g, np.int32) for g in all_rows["grams"]], all_rows["label"].to_numpy(bool), all_rows["fold"].to_numpy(int))
        yield pd.DataFrame({"weight": [model.weight.tobytes()], "scale": [model.scale.tobytes()], "bias": [model.bias],
                            "slope": [model.slope], "at": [model.offset]})

    got = rows.mapInArrow(grams, "doc_id long, label boolean, fold long, grams binary").repartition(1).mapInPandas(
        descend, "weight binary, scale binary, bias double, slope double, at double").collect()
    if not got:
        return fit_rows([], np.zeros(0, bool), np.zeros(0, int))
    weight, scale, *rest = got[0]
    return Model(np.frombuffer(weight), np.frombuffer(scale), *rest)


def score(docs: DataFrame, model: Model, name: str = "quality_score") -> DataFrame:
    """`docs` with the score (0 to 1, higher: label 1 likelier) as `name`; null text counts as empty. Nothing but the text is read."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.scores(presence(data, offsets)) for _, _, data, offsets in slices(batch.column(batch.schema.get_field_index("text")), SLICE_BYTES, SLICE_ROWS)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate([np.zeros(0), *found]))], [*batch.schema.names, name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != name)
    return bound_batches(docs).drop(name).mapInArrow(run, f"{fields}, {name} double")


def accepted(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents that score at least `least` under a model of the labels; columns as given."""
    names, name = [F.col(f"`{c}`") for c in docs.columns], unused(docs.columns, "quality_score")
    return score(docs, fit(docs, labels), name).where(F.col(name) >= least).select(*names)
