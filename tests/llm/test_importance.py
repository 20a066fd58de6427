"""Importance resampling against sums over a dictionary of features."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from conftest import SF
from pitlens.llm import importance
from pitlens.llm.queries import QUERIES

TEXTS = ["The cat sat, the cat SAT on 3 mats.", "", None, "Él niño ñandú 漢字 x", "a", "A b", "word " * 5000, "...", "x" * 3000 + " y",
         "one two three four five six seven eight nine ten " * 3, "The cat sat, the cat SAT on 3 mats."]


def plain(text):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    return words, Counter(zlib.crc32(" ".join(words[i:i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(words) - k + 1))


def expected(docs, targets):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(plain(text)[1])
    for text in targets:
        t.update(plain(text)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000))))
    rows = []
    for doc, text in docs:
        words, counts = plain(text)
        weight = sum(gain(b) * n for b, n in counts.items())
        h = int(hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        rows.append([doc, sum(counts.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] if r[0] is not None else -1))
    for k, r in enumerate(able[:5 * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def test_counts_and_weights_of_odd_texts():
    rng = np.random.default_rng(1)
    gain = rng.integers(-20_000, 20_000, importance.BUCKETS)
    planes, worth = importance.signed_planes(gain)
    at = 0
    for words, counts in importance.counted(pa.array(TEXTS)):
        own = importance.weights(counts, planes, worth)
        for k in range(len(words)):
            said, want = plain(TEXTS[at + k])
            assert words[k] == len(said)
            assert {int(b): int(counts[k, b]) for b in np.flatnonzero(counts[k])} == dict(want)
            assert own[k] == sum(int(gain[b]) * n for b, n in want.items())
        at += len(words)
    assert at == len(TEXTS)


def test_runs_across_blocks(monkeypatch):
    monkeypatch.setattr(importance, "BLOCK_WORDS", 3)
    (_, counts), = importance.counted(pa.array(["a b c d e f g h a b c", "d e"]))
    assert [dict(zip(map(int, np.flatnonzero(c)), map(int, c[c > 0]))) for c in counts] == [dict(sorted(plain(t)[1].items())) for t in ("a b c d e f g h a b c", "d e")]


@pytest.mark.parametrize("percent", [5, 50])
def test_draw_matches_brute_force(spark, percent):
    rng = np.random.default_rng(2)
    docs = [(i, " ".join(rng.choice(list("abcdefgh"), int(rng.integers(0, 60))))) for i in range(120)] + list(enumerate(TEXTS, 200)) + [(None, "a b " * 20)]
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in docs], "doc_id long, text string, rank int, _place int").repartition(4)
    out = importance.resample(df, spark.createDataFrame([("a b c a b c",), (None,)], "text string"), percent=percent)
    want = expected(docs, ["a b c a b c", None])
    if percent == 5:
        assert got(out) == want
    else:
        ranks = sorted(r[4] for r in got(out) if r[4])
        assert ranks == list(range(1, len(ranks) + 1)) and [r[:4] for r in got(out)] == [r[:4] for r in want]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = docs.where("false")
    assert importance.resample(none, docs.select("text")).count() == 0
    assert got(importance.resample(docs, none.select("text"))) == expected([(1, "a b"), (2, None)], [])


def test_the_query_on_given_tables(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [r[0] for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("text").collect()]
    assert got(QUERIES["op13_importance_resampling"](spark, SF)) == expected(docs, items)
