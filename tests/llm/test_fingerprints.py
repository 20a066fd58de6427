"""Fingerprints against exact similarities, and the edited texts against a plain loop."""

from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest

from pitlens.llm.fingerprints import BINS, _EMPTY, densify, fingerprint, fingerprint_edits, likeness, signatures


def shingles(text, width=5):
    w = text.split()
    return {tuple(w)} if 0 < len(w) < width else {tuple(w[k:k + width]) for k in range(len(w) - width + 1)}


def rows(n=60):
    rng = np.random.default_rng(1)
    say = lambda k: " ".join(f"w{x}é" for x in rng.integers(0, 5000, k))
    base = say(300)
    out = [(int(i), base if i % 7 == 0 else say(int(rng.integers(0, 900)))) for i in rng.permutation(n)]
    return out + [(None, "no id"), (3, "a tie"), (3, None), (500, ""), (501, "x"), (-4, say(40_000)), (7, base), (7, base)]


@pytest.mark.parametrize("parts", ["1", "8", "40"])
def test_edits_follow_descending_ids(spark, parts):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = spark.createDataFrame([(i, t, "x", 0) for i, t in rows()], "doc_id long, text string, range string, extra int").repartition(7)
        got = sorted(map(tuple, fingerprint_edits(df).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    given = sorted(((i, t or "") for i, t in rows()), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    texts = [t for _, t in given]
    edited = [t[:len(t) - len(t) // 2] + n[:len(t) // 2] for t, n in zip(texts, texts[1:] + texts[:1])]
    a, b = signatures(pa.array(texts)), signatures(pa.array(edited))
    want = [(i, len(t), sha256(e.encode()).hexdigest(), x.hex(), y.hex(), likeness(x, y), likeness(x, z))
            for (i, t), e, x, y, z in zip(given, edited, a, b, a[1:] + a[:1])]
    assert got == sorted(want, key=str)


def test_lone_and_no_documents(spark):
    one = spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")
    assert fingerprint_edits(one).first()["edited_sha256"] == sha256(b"abcabc").hexdigest()
    assert fingerprint_edits(one.limit(0)).count() == 0 and fingerprint(one.limit(0)).count() == 0


@pytest.mark.parametrize("bits", [1, 4, 8])
def test_likeness_is_near_the_jaccard_similarity(bits):
    rng = np.random.default_rng(2)
    errors = []
    for cut in range(0, 400, 20):
        for n in (20, 400, 3000):
            w = [f"t{x}" for x in rng.integers(0, 9999, n)]
            v = list(w)
            v[:n * cut // 800] = [f"u{x}" for x in rng.integers(0, 9999, n * cut // 800)]
            a, b = " ".join(w), " ".join(v)
            x, y = signatures(pa.array([a, b]), bits=bits)
            errors.append(likeness(x, y, bits=bits) - len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b)))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < {1: 0.12, 4: 0.06, 8: 0.05}[bits]


def test_densification_fills_every_bin_and_keeps_the_filled():
    table = np.full((3, BINS), _EMPTY)
    table[0, 5], table[1, ::2] = 9, 4
    out = densify(table)
    assert (out[0] == 9).all() and (out[1] == 4).all() and (out[2] == _EMPTY).all()
