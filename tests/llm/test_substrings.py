"""Substring removal against a plain loop over all windows."""

import random
import re

import numpy as np
import pytest

from pitlens.llm.substrings import _ROWS, Outbox, deduplicate, prefix_groups

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows, width):
    first = {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        w = WORD.findall(t or "")
        for k in range(len(w) - width + 1):
            key, at = tuple(w[k:k + width]), (i is None, i or 0, k)
            first[key] = min(first.get(key, at), at)
    out = []
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = set()
        for k in range(len(w) - width + 1):
            if (i is None, i or 0, k) > first[tuple(w[k:k + width])]:
                gone |= set(range(k, k + width))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


def rows(seed, n, vocabulary):
    rnd = random.Random(seed)
    say = lambda k: [rnd.choice(vocabulary) for _ in range(k)]
    shared = [say(k) for k in (19, 20, 21, 60, 200)]
    out = []
    for i in rnd.sample(range(n), n):
        text = []
        for _ in range(rnd.randrange(4)):
            text += say(rnd.randrange(60)) + rnd.choice([[], *shared])
        out.append((i, rnd.choice([" ", "\n", "  "]).join(text)))
    long = " ".join(say(30_000))
    out += [(n, long), (n + 1, long), (n + 2, "the " * 500), (n + 2, "the " * 500), (n + 2, "a " * 30), (None, long), (None, None), (n + 3, ""), (n + 4, "　 é")]
    return out


@pytest.mark.parametrize("width,anchor,group,words", [(20, 8, 4_000_000, 3000), (20, 8, 500, 4), (5, 2, 300, 40)])
def test_same_as_plain_loop(spark, width, anchor, group, words):
    given = rows(width + group, 120, [f"w{k}" for k in range(words)])
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in given], "doc_id long, text string, id int, mark string").repartition(5)
    got = deduplicate(df, width, anchor, group).select("doc_id", "n_words", "n_removed", "kept").collect()
    assert sorted(map(tuple, got), key=str) == plain(given, width)


def test_no_rows_and_columns(spark):
    df = spark.createDataFrame([(1, "x", "en")], "doc_id long, text string, kept string").limit(0)
    out = deduplicate(df)
    assert out.columns == ["doc_id", "text", "n_words", "n_removed", "kept"] and out.count() == 0


def test_groups_are_bounded():
    counts = np.random.default_rng(1).zipf(1.3, 4096) % 10_000
    first, split, groups = prefix_groups(counts, 1_000)
    load = np.zeros(groups)
    for f, s, n in zip(first, split, counts):
        load[f:f + s] += n / s
    assert (first + split <= groups).all() and load.max() <= 1_000


def test_tasks_send_known_repeats_to_groups_of_their_own(spark):
    def run(batches):
        out = Outbox(100, True)
        for _ in batches:
            pass
        one = np.array([7, 7], np.uint64)
        out.add(one, np.arange(2), np.arange(2), np.zeros(2, np.int64), np.arange(2), np.arange(2))
        yield from out.flush()

    sent = spark.range(0, 16, 1, 16).mapInArrow(run, _ROWS).where("kind = 1").collect()
    assert len(sent) == 16 and len({r.target for r in sent}) == 16
