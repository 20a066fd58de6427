"""The pipeline's stages against plain versions of them, one input after the other."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import SF
from pitlens.llm import byte_pair, quality
from pitlens.llm.words import slices
from pitlens.session import cut_lineage
from test_mixing import plain_targets
from test_near_duplicates import plain as plain_groups
from test_substrings import WORD
from test_substrings import plain as plain_substrings


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output of each stage over the small table, a few odd rows added."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(None, None, None, None, None), (10**6, "", "en", "src0", 0), (10**6 + 1, None, "en", None, 0), (10**6 + 2, "Of the and then, is of.", "en", "src1", 23),
           (10**6 + 2, "Of the and then, is of.", "en", "src1", 23), (10**6 + 3, "of THE and then, is of.", "en", "src2", 23)]
    now, out = docs.unionByName(spark.createDataFrame(odd, docs.schema)), []
    for _, stage in corpus_pipeline.STAGES:
        then = spark.createDataFrame(stage(spark, now, SF).collect(), stage(spark, now, SF).schema)
        out.append((now.collect(), then.collect()))
        assert len(out) == 5 or then.schema.names == docs.schema.names
        now = then
    return out


def test_quality_keeps_what_scores(spark, stages):
    given, kept = stages[0]
    df = spark.createDataFrame(given, "doc_id long, text string, lang string, source string, n_chars long")
    model = quality.fit(df, spark.read.parquet(f"{SF}/labels.parquet"))
    scores = np.concatenate([model.scores(quality.presence(d, o)) for _, _, d, o in slices(pa.array([r.text for r in given], pa.string()))])
    assert Counter(kept) == Counter(r for r, s in zip(given, scores) if s >= 0.5)
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    stayed = {r.doc_id for r in kept}
    assert all(i in stayed for i, q in label.items() if q == 1) and np.mean([i not in stayed for i, q in label.items() if q == 0]) > 0.9


def test_one_of_each_group_stays(stages):
    given, kept = stages[1]
    unique = sorted(set(given), key=str)
    plain = [r for r in plain_groups([(r.doc_id, r.text) for r in unique], 5, 80, 100)]
    want = sorted(str(i) for i, _, _, stays in plain if stays)
    assert sorted(str(r.doc_id) for r in kept) == want and len(kept) < len(given)


def test_repeats_go(stages):
    given, kept = stages[2]
    plain = {i: (gone, text) for i, _, gone, text in plain_substrings([(r.doc_id, r.text) for r in given], 20)}
    assert {r.doc_id: r.text for r in kept} == {r.doc_id: plain[r.doc_id][1] if plain[r.doc_id][0] else r.text for r in given}
    assert all(r.n_chars == len(r.text) for r in kept if r.text and r.doc_id is not None)
    assert {(r.doc_id, r.lang, r.source) for r in kept} == {(r.doc_id, r.lang, r.source) for r in given}


def test_mixture_is_near_its_targets(stages):
    given, kept = stages[3]
    size = lambda t: len(WORD.findall(t or ""))
    sizes, got, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in given:
        sizes[r.source] += size(r.text)
        largest[r.source] = max(largest[r.source], size(r.text))
    for r in kept:
        got[r.source] += size(r.text)
    want = plain_targets(sizes)
    assert all(abs(got[s] - want[s]) <= largest[s] for s in sizes)
    times = Counter(kept)
    assert set(times) <= set(given) and max(times.values()) <= 2


def test_encoding_is_the_library_s(stages):
    given, got = stages[4]
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_pair.read_ranks(P.path(corpus_pipeline.RANKS)), special_tokens={})
    want = Counter((r.doc_id, np.array(lib.encode_ordinary(r.text or ""), "<u4").tobytes(), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in given)
    assert Counter((r.doc_id, bytes(r.ids), r.decoded_sha256) for r in got) == want


def test_run_is_the_stages_in_order(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"] and out.where(F.octet_length("ids") != F.col("n_tokens") * 4).count() == 0
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "near-duplicates", "repeated passages", "source mixture", "byte-pair encoding"]


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_extra_columns_with_any_names(spark):
    """Columns that the stages might use themselves come through every stage that keeps columns, as given."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    extra = ["_id", "_mark", "_Found", "_found_id", "_found_mark", "_key", "_copy", "_times", "_doc", "_mixed", "_stay_id", "_stay_mark", "_stay_at", "row", "id", "mark",
             "which", "times", "order", "at", "k", "size", "target", "taken", "quality_score"]
    wide = cut_lineage(docs.select("*", *[F.concat(F.lit(f"{c}-"), F.col("doc_id")).alias(c) for c in extra]))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, SF)
        assert out.columns == wide.columns or sorted(out.columns) == sorted(wide.columns)
        rows = out.select("doc_id", *[F.col(f"`{c}`") for c in extra]).collect()
        assert rows and all(r[k + 1] == f"{c}-{r[0]}" for r in rows for k, c in enumerate(extra))
    assert corpus_pipeline.STAGES[-1][1](spark, wide, SF).count() == 60
