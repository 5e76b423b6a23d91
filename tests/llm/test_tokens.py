import random

import numpy as np
import pytest
import sentencepiece

from fwlog.llm import sentencepiece_bpe as sp


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=sp.model_path())


@pytest.fixture(scope="module")
def coder():
    return sp.Encoder(sp.load(sp.model_path()))


def check(coder, library, texts):
    flat, counts = coder.encode(texts)
    ends = np.cumsum(counts)
    decoded = coder.decode(flat, counts).to_pylist()
    for text, lo, hi, back in zip(texts, ends - counts, ends, decoded):
        want = library.encode(text)
        assert flat[lo:hi].tolist() == want, text[:80]
        assert back == library.decode(want), text[:80]


def test_random_texts_against_the_library(coder, library):
    rng = random.Random(1)
    parts = ["a", "b", "ab", " ", "  ", "▁", "é", "日", "本", "\n", "\0", "th", "er", "in", "1", "23", "😀", "\t", "aaaa", " " * 15, "!"]
    for _ in range(20):
        check(coder, library, ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(200)])


def test_runs_and_long_words(coder, library):
    check(coder, library, ["", " ", *[" " * n for n in range(1, 70)], "ab" * 3000, "a" * 5000, "th" * 20000])


def test_ids_of_other_origin_decode_like_the_library(coder, library):
    for ids in ([3, 4, 200, 250, 229], [0, 1, 2, 29871, 29871], [227, 131], []):
        assert coder.decode(np.array(ids, np.int32), np.array([len(ids)])).to_pylist() == [library.decode(ids)]


def test_odd_documents(odd_documents, no_documents, library):
    clash = odd_documents.withColumnRenamed("lang", "ids")
    rows = sp.encode_decode(clash, sp.model_path()).collect()
    assert len(rows) == 11
    for r in rows:
        assert r["ids"] == library.encode(r["text"] or "")
    assert sp.digests(sp.encode_decode(no_documents, sp.model_path()), "doc_id").count() == 0
