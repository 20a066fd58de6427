"""Token counts and byte-pair encoding against the tokenizers' own libraries."""

import random

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
import tiktoken

from pitlens.llm import byte_pair
from pitlens.llm.token_counts import Transducer, count_tokens

RANKS, MODEL = P.path("byte_bpe_multi_50k.tiktoken"), P.path("piece_bpe_32k.model")
PARTS = ["a", "b", "the", "ing", " ", "  ", "\n", "é", "漢", "▁", "<s>", ".", "1", "23", "    ", "🙂", "\t", "un", "xxxxxxx", "ation", "Th", " of", "'re", "'", "r"]


def texts(n, seed=3):
    rnd = random.Random(seed)
    edge = ["", " ", "   ", " a", "a ", "x" * 700, " " * 150, " " * 33 + "a", "</s>[INST]", "'" * 50 + "re" * 20]
    return edge + ["".join(rnd.choice(PARTS) for _ in range(rnd.randrange(70))) for _ in range(n)]


def frame(spark, values):
    rows = [(k // 2, t, "n", "x") for k, t in enumerate(values)] + [(None, None, None, None), (0, "", "n", "x"), (0, "", "n", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, row string")


@pytest.mark.parametrize("size", [7, 64, 32_768])
def test_token_counts_are_the_library_s(spark, size):
    values = texts(300)
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = count_tokens(frame(spark, values), MODEL, size).collect()
    want = [(k // 2, len(t.encode()), len(sp.encode(t))) for k, t in enumerate(values)] + [(None, 0, 0), (0, 0, 0), (0, 0, 0)]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_transducer_on_many_texts():
    sp, own = sentencepiece.SentencePieceProcessor(model_file=MODEL), Transducer(open(MODEL, "rb").read())
    for t in texts(3000, 5):
        t = t.replace("▁", " ")
        data = np.frombuffer(t.encode(), np.uint8)
        assert own.counts(data, np.array([0, len(data)]))[0] == len(sp.encode(t)), t


@pytest.mark.parametrize("size,overlap", [(20, 6), (64, 16), (32_768, 1_024)])
def test_ids_and_bytes_are_the_library_s(spark, size, overlap):
    values = texts(300)
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_pair.read_ranks(RANKS), special_tokens={})
    got = byte_pair.encode_and_decode(frame(spark, values), RANKS, P.PATTERN, chunk_chars=size, overlap_chars=overlap).collect()
    want = [(k // 2, t) for k, t in enumerate(values)] + [(None, ""), (0, ""), (0, "")]
    want = [(i, len(x := lib.encode_ordinary(t)), np.array(x, "<u4").tobytes(), t.encode()) for i, t in want]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(((a, b, bytes(c), bytes(d)) for a, b, c, d in got), key=key) == sorted(want, key=key)


def test_no_rows_give_no_rows(spark):
    none = frame(spark, []).limit(0)
    assert count_tokens(none, MODEL).count() == 0
    assert byte_pair.encode_and_decode(none, RANKS, P.PATTERN).count() == 0
