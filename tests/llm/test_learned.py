"""Language and quality models: held-out accuracy, odd rows, known mixtures."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from conftest import SF
from pitlens.llm import language, quality
from pitlens.llm.queries import QUERIES
from pitlens.llm.words import slices

import pyarrow as pa

HARD = [(None, None, None), (1, "", "en"), (2, "123 ... !!", "en"), (3, " \n\t ", None), (4, "é", "fr"), (4, "é", "fr"), (5, "the " * 200_000, "en"), (6, "x" * 300_000, None)]


def test_language_accuracy_and_folds(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = QUERIES["op7_language_id"](spark, SF).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count() and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.97


def test_language_odd_rows(spark):
    model = language.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    df = spark.createDataFrame([(*r, "x") for r in HARD], "doc_id long, text string, lang string, score string")
    got = language.predict(df, model).collect()
    assert len(got) == len(HARD)
    assert {r.doc_id: r.lang_pred for r in got} == {None: "und", 1: "und", 2: "und", 3: "und", 4: "fr", 5: "en", 6: [r for r in got if r.doc_id == 6][0].lang_pred}
    empty = language.fit(df.limit(0))
    assert {r.lang_pred for r in language.predict(df, empty).collect()} == {"und"} and language.predict(df.limit(0), model).count() == 0


def test_proportions_of_a_mixture(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.lang: r.text for r in docs.groupBy("lang").agg(F.max_by("text", F.length("text")).alias("text")).collect()}
    model = language.fit(docs)
    one, two = texts["de"].split()[:300], texts["fr"].split()[:100]
    (_, _, data, offsets), = slices(pa.array([" ".join(one + two), " ".join(one)]))
    share = model.mixtures(data, offsets)
    at = [model.languages.index(x) for x in ("de", "fr")]
    assert abs(share[0, at[0]] - 0.75) < 0.1 and abs(share[0, at[1]] - 0.25) < 0.1 and share[1, at[0]] == 1


def alphabets(n):
    """A model of n languages, each with letters of its own, and five words of each."""
    rng = np.random.default_rng(7)
    letters = "abcdefghijklmnopqrstuvwxyz"
    told = [[letters[3 * i + a] + letters[3 * i + b] + letters[3 * i + c] for a, b, c in rng.permuted(np.tile(np.arange(3), (5, 1)), axis=1)] for i in range(n)]
    table = np.full((n, language.GRAMS), 0.5)
    for i, of in enumerate(told):
        (_, _, data, offsets), = slices(pa.array([" ".join(of)]))
        np.add.at(table[i], language.gram_codes(data, offsets)[data != 32], 50)
    return language.Model([f"l{i}" for i in range(n)], np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)), told


def test_more_languages_than_four():
    model, told = alphabets(8)
    texts = [" ".join(w for i in range(n) for w in told[i] * 40 * (i + 1)) for n in range(1, 9)]
    (_, _, data, offsets), = slices(pa.array(texts))
    share = model.mixtures(data, offsets)
    for n in range(1, 9):
        want = np.array([i + 1 if i < n else 0 for i in range(8)]) / sum(range(1, n + 1))
        assert np.allclose(share[n - 1], want, atol=1e-3) and (share[n - 1] > 0).sum() == n


def test_language_of_a_small_share():
    model, told = alphabets(3)
    (_, _, data, offsets), = slices(pa.array([" ".join(told[0] * 8_000 + told[1] * 20)]))
    share = model.mixtures(data, offsets)[0]
    assert np.allclose(share, [8000 / 8020, 20 / 8020, 0], atol=1e-4) and share[2] == 0


def test_proportions_are_the_likeliest():
    rng = np.random.default_rng(8)
    count = np.array([1, 7, 400, 3_000])
    like = rng.random((count.sum(), 5)) ** 2
    share, value = language.Model.expect(np.full((4, 5), 0.2), like, count)
    at = np.cumsum(count) - count
    for d, (a, n) in enumerate(zip(at, count)):
        p = np.full(5, 0.2)
        for _ in range(20_000):
            p = (like[a:a + n] * p / (like[a:a + n] @ p)[:, None]).mean(axis=0)
        assert abs(value[d] - np.log(like[a:a + n] @ p).sum()) <= 0.002 and np.abs(share[d] - p).max() < 0.01


def test_quality_accuracy_and_folds(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = QUERIES["op8_quality_classifier"](spark, SF)
    rows = got.join(labels, "doc_id").collect()
    assert got.count() == docs.count() and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.5) for r in rows)
    assert np.mean([r.predicted == r.quality for r in rows if r.held_out]) > 0.9


def test_quality_odd_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    odd = labels.unionByName(spark.createDataFrame([(None, 1, 0), (3, None, 0), (10**9, 0, 0)], labels.schema)).union(labels)
    model = quality.fit(docs, odd)
    again = quality.fit(docs.repartition(5), labels)
    assert np.allclose(model.weight, again.weight)
    df = spark.createDataFrame([(i, t, "x") for i, t, _ in HARD], "doc_id long, text string, quality_score string")
    got = quality.score(df, model).collect()
    assert len(got) == len(HARD) and all(0 <= r.quality_score <= 1 for r in got)
    assert len({r.quality_score for r in got if r.doc_id in (None, 1, 3)}) == 1
    none = quality.fit(docs, labels.limit(0))
    assert {r.quality_score for r in quality.score(df, none).collect()} == {0.5}
    only = quality.fit(docs, labels.withColumn("quality", F.lit(1)))
    assert all(r.quality_score > 0.9 for r in quality.score(df, only).collect()) and quality.score(df.limit(0), only).count() == 0
