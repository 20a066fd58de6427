"""Language proportions of documents by mixture inference.

A word's likelihood in a language is that of its byte trigrams, a space on either side. Each
document is a mixture of languages; expectation-maximisation finds the proportions from
the words' likelihoods, for its likeliest language alone, its likeliest two, and so on, as long
as the likelihood of all languages, the most any set reaches, leaves room for a larger set.
The set whose likelihood, less a penalty for each language, is greatest is the document's.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitlens.llm.chunking import bound_batches
from pitlens.llm.words import LOWER, SPACE, slices, words

GRAMS, SMOOTHING, PENALTY = 1 << 14, 0.5, 3.0
#: Proportions are final once no others could raise the document's log-likelihood by more than this.
TOLERANCE = 0.001
UNKNOWN = "und"


def gram_codes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Hashed trigram around each byte; white space and the text's ends count as one space."""
    low = np.where(SPACE[data], np.uint8(32), LOWER[data]).astype(np.uint32)
    before, after = np.full(len(low), 32, np.uint32), np.full(len(low), 32, np.uint32)
    before[1:], after[:-1] = low[:-1], low[1:]
    begin, end = offsets[:-1][offsets[:-1] < offsets[1:]], offsets[1:][offsets[:-1] < offsets[1:]] - 1
    before[begin], after[end] = 32, 32
    return ((before | low << np.uint32(8) | after << np.uint32(16)) * np.uint32(2654435761)) >> np.uint32(32 - GRAMS.bit_length() + 1)


def spans(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Positions of the words of texts, text by text."""
    return np.arange(count.sum()) + np.repeat(first - (np.cumsum(count) - count), count)


@dataclass(frozen=True)
class Model:
    """Languages in order, and the log-likelihood of each trigram in each."""

    languages: list[str]
    log_p: np.ndarray

    def mixtures(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Proportions (texts by languages) over each text's chosen set; zero rows for texts without words."""
        w = words(data, offsets)
        out = np.zeros((len(offsets) - 1, len(self.languages)))
        if not len(w.start) or not self.languages:
            return out
        code = gram_codes(data, offsets)[~SPACE[data]]
        length = w.end - w.start
        begin = np.cumsum(length) - length
        like = np.stack([np.add.reduceat(p[code], begin, dtype=np.float64) for p in self.log_p], 1)
        top = like.max(axis=1)
        like = np.maximum(np.exp(like - top[:, None]), 1e-300)
        has = np.flatnonzero(w.count)
        first, count = w.first[:-1][has], w.count[has]
        doc = np.repeat(np.arange(len(has)), count)
        share, most = self.expect(np.full((len(has), len(self.languages)), 1 / len(self.languages)), like, count)
        order = np.argsort(-share, axis=1, kind="stable")
        best, value = np.zeros_like(share), np.add.reduceat(np.log(like[np.arange(len(doc)), order[doc, 0]]), first)
        np.put_along_axis(best, order[:, :1], 1.0, axis=1)
        for k in range(2, len(self.languages) + 1):
            penalty = PENALTY * (k - 1) * (1 + np.log(count))
            some = np.flatnonzero((share[np.arange(len(has)), order[:, k - 1]] > 0) & (most + TOLERANCE - penalty > value))
            if not len(some):
                break
            own, fit = self.expect(np.take_along_axis(share[some], order[some, :k], axis=1), np.take_along_axis(
                like[spans(first[some], count[some])], np.repeat(order[some, :k], count[some], axis=0), axis=1), count[some])
            fit -= penalty[some]
            better = fit > value[some]
            best[some[better]], value[some[better]] = 0, fit[better]
            best[some[better, None], order[some[better], :k]] = own[better]
        out[has] = best
        return out

    @staticmethod
    def expect(share: np.ndarray, like: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Likeliest proportions and their log-likelihoods of texts whose words follow one another; each text goes on until it is final.

        A round multiplies a proportion by its language's mean part of the words over that proportion;
        the words times the logarithm of the largest factor bounds what is left to gain.
        """
        out, value = share / share.sum(axis=1, keepdims=True), np.zeros(len(share))
        left, share = np.arange(len(share)), out
        while len(left):
            first, doc = np.cumsum(count) - count, np.repeat(np.arange(len(count)), count)
            total = (like * share[doc]).sum(axis=1)
            factor = np.add.reduceat(like / total[:, None], first, axis=0) / count[:, None]
            out[left], value[left] = share, np.add.reduceat(np.log(total), first)
            go = count * np.log(np.maximum(factor.max(axis=1), 1.0)) > TOLERANCE
            share = (share * factor)[go]
            share /= share.sum(axis=1, keepdims=True)
            if not go.all():
                like, left, count = like[np.repeat(go, count)], left[go], count[go]
        return out, value


def fit(docs: DataFrame) -> Model:
    """Trigram likelihoods of each language from all rows with text and lang.

    Tasks count their trigrams before anything moves, so a language costs GRAMS rows a task at most,
    and the model, languages times GRAMS numbers, is what comes to the driver. Null text and
    null lang teach nothing; extra columns are not read.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for at, to, data, offsets in slices(batch.column(0)):
                code, own = gram_codes(data, offsets), batch.column(1).slice(at, to - at)
                names = own.dictionary_encode()
                size = np.diff(offsets)
                which = np.repeat(names.indices.to_numpy(zero_copy_only=False).astype(np.int64), size)
                keep = ~SPACE[data]
                table = np.bincount(which[keep] * GRAMS + code[keep], minlength=len(names.dictionary) * GRAMS).reshape(-1, GRAMS)
                for name, row in zip(names.dictionary.to_pylist(), table):
                    totals[name] = totals[name] + row if name in totals else row
        for name, row in totals.items():
            at = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(row[at].astype(np.int64))], ["lang", "gram", "n"])

    counts = bound_batches(docs).where("text IS NOT NULL AND lang IS NOT NULL").select("text", F.col("lang").cast("string")).mapInArrow(
        count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counts["lang"].unique())
    table = np.full((len(languages), GRAMS), SMOOTHING)
    table[np.searchsorted(languages, counts["lang"]) if languages else [], counts["gram"].to_numpy(int)] += counts["n"].to_numpy(float)
    return Model(languages, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, languages: a row per row of `docs`.

    `languages` maps the document's languages to their proportions; lang_pred is the largest (ties:
    the first by name), score its proportion. Null text, text without a letter, or a model without
    languages gives `und`, score 0 and no languages. Only doc_id and text are read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, data, offsets in slices(batch.column(1)):
                part, share = batch.slice(at, to - at), model.mixtures(data, offsets)
                letters = np.array(part.column(2).to_pylist(), bool)
                known = letters & (share.sum(axis=1) > 0) if model.languages else np.zeros(len(letters), bool)
                top = share.argmax(axis=1) if model.languages else np.zeros(len(letters), int)
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array([model.languages[t] if k else UNKNOWN for t, k in zip(top, known)], pa.string()),
                    pa.array([min(1.0, float(s[t])) if k else 0.0 for s, t, k in zip(share, top, known)], pa.float64()),
                    pa.array([[(model.languages[j], float(s[j])) for j in np.flatnonzero(s)] if k else [] for s, k in zip(share, known)],
                             pa.map_(pa.string(), pa.float64()))], ["doc_id", "lang_pred", "score", "languages"])

    return bound_batches(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters")).mapInArrow(
        run, f"doc_id {kind}, lang_pred string, score double, languages map<string,double>")
