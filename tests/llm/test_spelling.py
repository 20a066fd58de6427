"""Spelling variants against all words with all their one-edit strings."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from conftest import SF
from pitlens.llm import spelling
from pitlens.llm.queries import QUERIES


def plain_vocabulary(docs):
    counts = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            if len(run) >= 7:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def plain_near(counts):
    """Words that share a hole: the same string around a replaced code point, or one string the other less a code point."""
    holes = {}
    for w in counts:
        for i in range(len(w)):
            holes.setdefault((w[:i], w[i + 1:]), set()).add(w)
    near = {w: set() for w in counts}
    for group in holes.values():
        for w in group:
            near[w] |= group - {w}
    for w in counts:
        for i in range(len(w)):
            v = w[:i] + w[i + 1:]
            if v in counts:
                near[w].add(v)
                near[v].add(w)
    return near


def plain(docs):
    counts = plain_vocabulary(docs)
    near, form = plain_near(counts), {}
    for w in counts:
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= 10 * counts[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w
    return {(w, form[w], root(w), counts[w], len(near[w]), counts[form[w]] if form[w] else None) for w in counts}


def got(df):
    rows = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("letters,least,most", [("ab", 7, 10), ("abc", 7, 9), ("aé", 12, 17)])
def test_near_words_of_dense_vocabularies(spark, letters, least, most):
    rng = random.Random(3)
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(least, most))) for _ in range(250)}
    counts = {w: rng.randint(2, 5) for w in words}
    found = spelling.near_words(spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)).collect()
    want = [(w, counts[w], v, counts[v]) for w, near in plain_near(counts).items() for v in near]
    assert sorted(map(tuple, found)) == sorted(want)


def test_long_words_and_ends(spark):
    rng = random.Random(4)
    long = "".join(rng.choice("abcd") for _ in range(900))
    base = ["a" * 40, "a" * 41, "abcdefg", "abcdefgh", "bcdefgh", "xbcdefgh", "abcdxfgh", long, long[:5] + "x" + long[6:], long[:450] + long[451:], long + "a", "a" + long, long[:200], long[:201], long[:199] + "ñ"]
    counts = dict.fromkeys(base, 3)
    found = spelling.near_words(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()
    assert sorted(map(tuple, found)) == sorted((w, 3, v, 3) for w, near in plain_near(counts).items() for v in near)


def test_odd_documents(spark):
    docs = [(1, None), (2, ""), (3, "Letters letters LETTERS lettersx lettersx ÀÉÎÕÜÇÑ ÀÉÎÕÜÇÑ àéîõüçñ àéîõüçñ"), (3, "Letters letters " * 30), (None, "letterz letterz " * 2),
            (4, "letter1letterz short"), (5, ("abcdefghij " * 2000 + "abcdefghik " * 150 + "abcdefghk " * 3))]
    df = spark.createDataFrame([(d, t, "w", 1) for d, t in docs], "doc_id long, text string, word string, n int")
    assert got(spelling.variants(df)) == plain(docs)
    assert spelling.variants(df.where("false")).count() == 0
    assert spelling.variants(df.where(F.col("text").isNull())).count() == 0


def test_the_query_on_given_tables(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert got(QUERIES["op12_spelling_variants"](spark, SF)) == plain(docs)
