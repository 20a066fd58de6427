"""Toxicity: the automata against plain edit distances, held-out accuracy, misspellings, mentions, odd rows."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pitlens.llm import toxicity
from pitlens.llm.queries import QUERIES
from pitlens.llm.words import slices

SF = "/root/testdata/sf0.01"
INSULTS = ["grobbling", "snivvler", "wretchup", "plonkish"]
PLAIN = [a + b + c for a in "bdfg" for b in "aeiou" for c in ("lt", "rn", "st", "mp", "nd")]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def reads(automaton, texts):
    return [r for _, _, data, offsets in slices(pa.array(texts, pa.string())) for r in toxicity.read(automaton, data, offsets)]


def test_automata_accept_what_edit_distance_allows():
    rng = random.Random(5)
    terms = sorted({("".join(rng.choice("abé") for _ in range(rng.randint(3, 9))), rng.random() < 0.4) for _ in range(25)})
    words = ["".join(rng.choice("abéx") for _ in range(rng.randint(1, 12))) for _ in range(3_000)]
    got = {}
    for r in reads(toxicity.Automaton(terms), [" ".join(words)]):
        got = {h.at: h.hit for h in r.hits}
    for k, word in enumerate(words):
        able = []
        for t, (term, stem) in enumerate(terms):
            distance = min(edits(word[:i], term) for i in range(len(word))) if stem else edits(word, term)
            if distance <= toxicity.edits_allowed(term, stem):
                able.append((distance, int(stem), t))
        assert got.get(k, -1) == (min(able)[2] * 3 + min(able)[0] if able else -1), word


def test_words_and_quotation():
    data, offsets = next(toxicity.slices(pa.array(['He SAID "you Idi0t", st*pid\n> ÉTÉ cited', None, "", '"', 'a "b', "漢字 b@d! $x"])))[2:]
    t = toxicity.tokens(data, offsets)
    assert [t.word(k) for k in range(len(t.start))] == ["he", "said", "you", "idi0t", "st*pid", "été", "cited", "a", "b", "漢字", "b@d", "x"]
    assert t.text.tolist() == [0] * 7 + [4] * 2 + [5] * 3
    assert t.quoted.tolist() == [False, False, True, True, False, True, True] + [False] * 5


def test_long_texts_in_pieces(monkeypatch):
    terms = [(w, False) for w in INSULTS]
    text = " ".join(PLAIN * 3 + ["grobbling"] + PLAIN + ["snivler"] + ["ñ" * 300])
    whole, = reads(toxicity.Automaton(terms), [text])
    monkeypatch.setattr(toxicity, "PIECE_BYTES", 50)
    monkeypatch.setattr(toxicity.pieces, "__defaults__", (50,))
    cut, = reads(toxicity.Automaton(terms), [text])
    assert [(h.at, h.hit, h.word) for h in whole.hits] == [(h.at, h.hit, h.word) for h in cut.hits] and len(cut.hits) == 2


@pytest.fixture(scope="module")
def invented(spark):
    """Labelled texts whose toxic ones hold invented insults, with a large group of copies that a lexicon must not take words from."""
    rng, rows = random.Random(6), []
    for k in range(600):
        bad = k % 8 == 0
        words = [rng.choice(PLAIN) for _ in range(rng.randint(20, 60))]
        for _ in range(rng.randint(2, 4) if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(INSULTS))
        rows.append((k, " ".join(words), int(bad)))
    copied = " ".join(f"copied{c}{d}" for c in "abcdef" for d in "abcdef") + " grobbling snivvler"
    rows += [(1_000 + k, copied + f" tail{k}", 1) for k in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    return toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"))


def test_the_lexicon_is_learned_and_copies_are_not(invented):
    assert {t for t, _ in invented.terms} == set(INSULTS)


def test_misspellings_count_and_mentions_do_not(spark, invented):
    calm = " ".join(PLAIN[:40])
    texts = {1: f"{calm} grobbling {calm} snivvler", 2: f"you grobling snivvlerr {calm} wretch*p", 3: calm, 4: f'{calm} the word "grobbling" {calm} is unkind {calm}', 5: "", 6: None,
             7: f"{calm} copiedaa copiedab copiedac copiedad", 8: "GROBBLING PLONKISH!! snivvler###"}
    df = spark.createDataFrame([(k, t, "x", 0.5) for k, t in texts.items()], "doc_id long, text string, score string, toxicity double")
    got = {r.doc_id: r.toxicity for r in toxicity.score(df, invented).collect()}
    assert {k for k, v in got.items() if v >= 0.7} == {1, 2, 8}
    assert got[5] == got[6] and all(0 <= v <= 1 for v in got.values())


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (2, "x " * 300_000), (None, "y")], "doc_id long, text string")
    for labels in ([], [(1, 1)], [(1, 0), (2, 0)], [(1, 0), (1, 1), (2, 1), (2, None), (None, 1)]):
        model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        got = toxicity.score(docs, model).collect()
        assert len(got) == 4 and all(0 <= r.toxicity <= 1 for r in got)
    assert toxicity.score(docs.where("false"), model).count() == 0
    assert len(toxicity.fit(docs.where("false"), spark.createDataFrame([(1, 1)], "doc_id long, toxic int")).terms) == 0


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = QUERIES["op11_toxicity"](spark, SF).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.7) for r in got)
    held = [r for r in got if r.held_out]
    clean, toxic = [r.predicted for r in held if not r.toxic], [r.predicted for r in held if r.toxic]
    assert np.mean(clean) <= 0.02 and np.mean(toxic) >= 0.6
    assert docs.count() == QUERIES["op11_toxicity"](spark, SF).count()
